"""Pose geometry as column expressions.

A pose is a column `joints`: array<struct<x,y,z>> in the order of catalog.JOINTS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import catalog
from .exprs import clamp, let, total

#: Distance from wrist to the finger joint that 22-joint input lacks, in metres.
FINGER = 0.1367


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def sub(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def mean(*ps: Column) -> Column:
    return point(*(total([p[c] for p in ps]) / len(ps) for c in "xyz"))


def norm(a: Column) -> Column:
    return F.sqrt(a["x"] * a["x"] + a["y"] * a["y"] + a["z"] * a["z"])


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return point(a["x"] / n, a["y"] / n, a["z"] / n)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def distance(a: Column, b: Column) -> Column:
    dx, dy, dz = (a[c] - b[c] for c in "xyz")
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def degrees_of_cos(x: Column) -> Column:
    """Degrees of an angle by its cosine; rounding beyond [-1, 1] is cut off."""
    return F.degrees(F.acos(clamp(x)))


def pose_view(embeddings: DataFrame) -> DataFrame:
    """embeddings -> pose_id, body (22 joints): the root at the origin, each other joint three elements of the vector."""
    e = lambda i: F.col("embedding")[i].cast("double")
    joints = [point(F.lit(0.0), F.lit(0.0), F.lit(0.0)), *(point(e(3 * i), e(3 * i + 1), e(3 * i + 2)) for i in range(21))]
    return embeddings.select(F.col("vec_id").alias("pose_id"), F.array(*joints).alias("body"))


def working_joints(poses: DataFrame) -> DataFrame:
    """pose_id, body -> pose_id, joints: the body joints, two finger joints beyond the wrists, and eleven derived points."""
    b = lambda name: F.col("body")[catalog.AT[name]]

    def finger(s: str) -> Column:
        u = unit(sub(b(f"{s}_wrist"), b(f"{s}_elbow")))
        return point(*(b(f"{s}_wrist")[c] + FINGER * u[c] for c in "xyz"))

    with_fingers = poses.select("pose_id", "body", *(finger(s).alias(f"{s}_finger") for s in catalog.SIDES))
    derived = [F.col(f"{s}_finger") for s in catalog.SIDES]
    derived += [mean(b(f"{s}_wrist"), F.col(f"{s}_finger")) for s in catalog.SIDES]
    derived.append(mean(b("pelvis"), b("neck"), b("spine3")))
    for one, two in (("hip", "knee"), ("knee", "ankle"), ("shoulder", "elbow"), ("elbow", "wrist")):
        derived += [mean(b(f"{s}_{one}"), b(f"{s}_{two}")) for s in catalog.SIDES]
    return with_fingers.select("pose_id", F.concat("body", F.array(*derived)).alias("joints"))


def mirrored(body: Column) -> Column:
    """Left and right swapped: joints change places, and rotation vectors turn the other way about y and z."""
    swap = {"left": "right", "right": "left"}
    names = ["_".join([swap.get(n.split("_")[0], n.split("_")[0]), *n.split("_")[1:]]) for n in catalog.BODY]
    return F.array(*(point(body[catalog.AT[n]]["x"], -body[catalog.AT[n]]["y"], -body[catalog.AT[n]]["z"]) for n in names))


# Rotations: quaternions as struct<w,x,y,z>.


def quaternion(v: Column) -> Column:
    """Of a rotation vector."""

    def turned(v: Column, angle: Column) -> Column:
        k = F.when(angle < 1e-12, F.lit(0.5)).otherwise(F.sin(angle / 2) / angle)
        return F.struct(F.cos(angle / 2).alias("w"), *((v[c] * k).alias(c) for c in "xyz"))

    return let(v, lambda v: let(norm(v), lambda angle: turned(v, angle)))


def multiply(a: Column, b: Column) -> Column:
    """Both operands are named many times, so each is bound first: nested products would double in size at every level."""

    def product(a: Column, b: Column) -> Column:
        return F.struct(
            (a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"]).alias("w"),
            (a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"]).alias("x"),
            (a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"]).alias("y"),
            (a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"]).alias("z"),
        )

    return let(a, lambda a: let(b, lambda b: product(a, b)))


def inverse(q: Column) -> Column:
    return let(q, lambda q: F.struct(q["w"].alias("w"), *((-q[c]).alias(c) for c in "xyz")))


def composed(rotations: Column, chain: list[int]) -> Column:
    """The rotations of a chain of joints, ancestor first, applied one in another."""
    one = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return F.aggregate(F.transform(F.array(*(rotations[i] for i in chain)), quaternion), one, multiply)


def euler(q: Column) -> Column:
    """Struct of x, y, z in radians, for a matrix Rz Ry Rx; q is a column or bound by `let`."""
    w, x, y, z = (q[c] for c in "wxyz")
    r21, r22 = 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)
    r20, r10, r00 = 2 * (x * z - w * y), 2 * (x * y + w * z), 1 - 2 * (y * y + z * z)
    return point(F.atan2(r21, r22), F.atan2(-r20, F.sqrt(r21 * r21 + r22 * r22)), F.atan2(r10, r00))


def from_euler(e: Column) -> Column:
    """Quaternion of Rz Ry Rx."""
    zero = F.lit(0.0)
    qs = [quaternion(point(zero, zero, e["z"])), quaternion(point(zero, e["y"], zero)), quaternion(point(e["x"], zero, zero))]
    return multiply(multiply(qs[0], qs[1]), qs[2])


def rotation_vector(q: Column) -> Column:
    """Rotation vector, of an angle up to pi."""

    def vector(q: Column) -> Column:
        s = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
        sign = F.when(q["w"] < 0, -1.0).otherwise(1.0)
        k = F.when(s < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(s, F.abs(q["w"])) / s) * sign
        return let(k, lambda k: point(*(q[c] * k for c in "xyz")))

    return let(q, vector)


def without_heading(root: Column) -> Column:
    """A root rotation with its Euler angle about z set to zero, as a quaternion."""
    return let(let(quaternion(root), euler), lambda e: from_euler(point(e["x"], e["y"], F.lit(0.0))))


def chain_between(joint: str, ancestor: str) -> list[int]:
    """Joints from the ancestor down to the joint, both included."""
    at, out = catalog.AT[joint], []
    while at != -1:
        out.append(at)
        if at == catalog.AT[ancestor]:
            return out[::-1]
        at = catalog.PARENTS[at]
    raise ValueError(f"{ancestor} is not above {joint}")
