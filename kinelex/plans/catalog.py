"""What is measured: joints, kinds of codes, code definitions and super-codes.

Everything here is a small constant of the domain.  Left and right variants are made by rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The body joints in storage order, then two finger joints and eleven derived points.
BODY = (
    "pelvis left_hip right_hip spine1 left_knee right_knee spine2 left_ankle right_ankle spine3 left_foot right_foot "
    "neck left_collar right_collar head left_shoulder right_shoulder left_elbow right_elbow left_wrist right_wrist"
).split()
DERIVED = "left_middle2 right_middle2 left_hand right_hand torso left_thigh right_thigh left_shin right_shin left_upperarm right_upperarm left_forearm right_forearm".split()
JOINTS = [*BODY, *DERIVED]
AT = {name: i for i, name in enumerate(JOINTS)}
PARENTS = (-1, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 12, 13, 14, 16, 17, 18, 19)


@dataclass(frozen=True)
class Kind:
    categories: tuple[str, ...]
    thresholds: tuple[float, ...]
    noise: float


# Categories, thresholds (degrees or metres) and noise of every kind of pose code.
KINDS = {
    "angle": Kind(("completely bent", "bent more", "right angle", "bent less", "slightly bent", "straight"), (45, 75, 105, 135, 160), 5),
    "distance": Kind(("close", "shoulder width", "spread", "wide"), (0.20, 0.40, 0.80), 0.05),
    "relativePosX": Kind(("at_right", "ignored_relpos0a", "x-aligned", "ignored_relpos0b", "at_left"), (-0.15, -0.05, 0.05, 0.15), 0.05),
    "relativePosY": Kind(("below", "ignored_relpos1a", "y-aligned", "ignored_relpos1b", "above"), (-0.15, -0.05, 0.05, 0.15), 0.05),
    "relativePosZ": Kind(("behind", "ignored_relpos2a", "z-aligned", "ignored_relpos2b", "front"), (-0.15, -0.05, 0.05, 0.15), 0.05),
    "relativeVAxis": Kind(("vertical", "ignored_relVaxis", "horizontal"), (10, 80), 5),
    "onGround": Kind(("on_ground", "ignored_onGround"), (0.10,), 0.05),
    "bodyInclineX": Kind(("body incline backward", "body incline backward slightly", "body_ignored_x_incline", "body incline forward slightly", "body incline forward"), (-50, -20, 20, 50), 5),
    "bodyInclineY": Kind(("body twist left", "body twist left slightly", "body_ignored_y_twist", "body twist right slightly", "body twist right"), (-50, -20, 20, 50), 5),
    "bodyInclineZ": Kind(("body lean right", "body lean right slightly", "body_ignored_z_lean", "body lean left slightly", "body lean left"), (-30, -15, 15, 30), 5),
    "relativeRotX": Kind(("incline backward", "ignored_x_incline", "incline forward"), (-45, 30), 5),
    "relativeRotY": Kind(("turn right", "turn right slightly", "ignored_y_turn", "turn left slightly", "turn left"), (-30, -15, 15, 30), 5),
    "relativeRotZ": Kind(("incline left", "ignored_z_incline", "incline right"), (-30, 30), 5),
}
# The same for pairs of poses; a value is pose A's minus pose B's.
PAIR_KINDS = {
    "pair_angle": Kind(("bent much less", "bent less", "bent slightly less", "ignored-bent", "bent slightly more", "bent more", "bent much more"), (-80, -45, -18, 18, 45, 80), 5),
    "pair_distance": Kind(("farther", "slightly farther", "ignored-distance", "slightly closer", "closer"), (-0.40, -0.1, 0.1, 0.40), 0.05),
    "pair_relativePosX": Kind(("more to left", "slightly more to left", "ignored-x", "slightly more to right", "more to right"), (-0.40, -0.15, 0.15, 0.40), 0.05),
    "pair_relativePosY": Kind(("higher", "slightly higher", "ignored-y", "slightly lower", "lower"), (-0.40, -0.15, 0.15, 0.40), 0.05),
    "pair_relativePosZ": Kind(("more to front", "slightly more to front", "ignored-z", "slightly more to back", "more to back"), (-0.40, -0.15, 0.15, 0.40), 0.05),
    "pair_bodyInclineX": Kind(("body incline forward more", "body incline forward slightly more", "body_ignored_x_incline_more", "body incline backward slightly more", "body incline backward more"), (-45, -20, 20, 45), 5),
    "pair_bodyInclineY": Kind(("body twist right more", "body twist right slightly more", "body_ignored_y_twist_more", "body twist left slightly more", "body twist left more"), (-45, -20, 20, 45), 5),
    "pair_bodyInclineZ": Kind(("body lean left more", "body lean left slightly more", "body_ignored_z_lean_more", "body lean right slightly more", "body lean right more"), (-30, -15, 15, 30), 5),
    "pair_relativeRotX": Kind(("incline forward more", "ignored_x_incline_more", "incline backward more"), (-30, 30), 5),
    "pair_relativeRotY": Kind(("turn left more", "turn left slightly more", "ignored_y_turn_more", "turn right slightly more", "turn right more"), (-30, -15, 15, 30), 5),
}
ROOT_ROTATION = Kind(
    ("around", "around to the right", "a quarter to the right", "slightly more to the right", "ignored-rotation", "slightly more to the left", "a quarter to the left", "around to the left", "around"),
    (-150, -120, -60, -20, 20, 60, 120, 150),
    10,
)
OPPOSITES = {"at_right": "at_left", "at_left": "at_right", "below": "above", "above": "below", "behind": "front", "front": "behind"}


@dataclass(frozen=True)
class Code:
    """An elementary code: which joints, what it talks about (None: either joint), and what becomes of each category."""

    kind: str
    joints: tuple[str, ...]
    focus: str | None
    accepted: tuple[str, ...]
    rare: tuple[str, ...] = ()
    support: tuple[tuple[str, int], ...] = ()
    absolute: tuple[str, ...] = ()


@dataclass(frozen=True)
class Super:
    name: str
    focus: tuple[str, ...]
    category: str
    rare: bool
    absolute: bool
    #: alternatives; each is a tuple of (kind, joints, category) that must all hold
    ways: tuple[tuple[tuple[str, tuple[str, ...], str], ...], ...] = field(default=())


SIDES = ("left", "right")
UPPER, LOWER = ("shoulder", "upperarm", "elbow", "forearm"), ("hip", "thigh", "knee", "shin")


def split_side(name: str | None) -> tuple[str | None, str | None]:
    """side, part of a body part's name."""
    if name is None:
        return None, None
    side, _, part = name.partition("_")
    return (side, part) if side in ("left", "right", "both") else (None, name)


def other(side: str) -> str:
    return "right" if side == "left" else "left"


def _all(kind: str) -> tuple[str, ...]:
    return tuple(c for c in (KINDS | PAIR_KINDS)[kind].categories if "ignored" not in c)


# The codes of single measurements, what is said of them, and the codes that combine them; left and right by rule.
def _elementary() -> list[Code]:
    both = lambda part: (f"left_{part}", f"right_{part}")
    out = []
    for upper, mid, end in (("hip", "knee", "ankle"), ("shoulder", "elbow", "wrist")):
        for s in SIDES:
            support = (("completely bent", 2),) if mid == "knee" else ()
            out.append(Code("angle", (f"{s}_{upper}", f"{s}_{mid}", f"{s}_{end}"), f"{s}_{mid}", _all("angle"), ("completely bent",), support, ("completely bent", "right angle", "straight")))
    for part, accepted, rare in (("elbow", "close|shoulder width|wide", "close"), ("hand", "close|shoulder width|spread|wide", ""), ("knee", "close|shoulder width|wide", "wide"), ("foot", "close|shoulder width|wide", "close")):
        out.append(Code("distance", both(part), None, tuple(accepted.split("|")), tuple(filter(None, [rare])), (("shoulder width", 1),), ("close",)))
    for part in ("shoulder", "elbow", "knee", "ankle", "foot"):
        for s in SIDES:
            for t in (s, other(s)) if part != "elbow" else (other(s),):
                out.append(Code("distance", (f"{s}_hand", f"{t}_{part}"), f"{s}_hand", ("close",), ("close",), (), ("close",)))
    for s in SIDES:
        for part in ("elbow", "hand", "knee", "foot"):
            out.append(Code("distance", (f"{s}_{part}", "torso"), f"{s}_{part}", ("close",), (), (("close", 1),)))
    y, z = ("below", "above"), ("behind", "front")
    for part in ("shoulder", "elbow", "hand", "knee", "foot"):
        if part in ("hand", "foot"):
            out.append(Code("relativePosX", both(part), None, ("at_right",), ("at_right",)))
        out.append(Code("relativePosY", both(part), None, y, (), (("above", 2),) if part == "knee" else ()))
        out.append(Code("relativePosZ", both(part), None, z))
    for s in SIDES:
        out.append(Code("relativePosY", (f"{s}_hip", f"{s}_knee"), f"{s}_hip", ("above",), (), (("above", 1),)))
    for end, root in (("hand", "shoulder"), ("foot", "hip")):
        for s in SIDES:
            crossed = "at_right" if s == "left" else "at_left"
            rare = end == "foot"
            out.append(Code("relativePosX", (f"{s}_{end}", f"{s}_{root}"), f"{s}_{end}", (crossed,), (crossed,) if rare else ()))
            out.append(Code("relativePosY", (f"{s}_{end}", f"{s}_{root}"), f"{s}_{end}", ("above",), ("above",) if rare else ()))
    for s in SIDES:
        out.append(Code("relativePosY", (f"{s}_wrist", "neck"), f"{s}_hand", ("above",)))
        out.append(Code("relativePosY", (f"{s}_hand", f"{s}_hip"), f"{s}_hand", ("below",)))
        out.append(Code("relativePosZ", (f"{s}_hand", "torso"), f"{s}_hand", ("behind",)))
        out.append(Code("relativePosZ", (f"{s}_foot", "torso"), f"{s}_foot", z))
    flat = ("horizontal", "vertical")
    for a, b, part, rare, absolute in (("hip", "knee", "thigh", "horizontal", ("horizontal",)), ("knee", "ankle", "shin", "horizontal", ("horizontal",)), ("shoulder", "elbow", "upperarm", "vertical", flat), ("elbow", "wrist", "forearm", "vertical", flat)):
        out += [Code("relativeVAxis", (f"{s}_{a}", f"{s}_{b}"), f"{s}_{part}", flat, (rare,), (), absolute) for s in SIDES]
    out += [Code("relativeVAxis", ("pelvis", f"{s}_shoulder"), f"{s}_backdiag", ("horizontal",), (), (("horizontal", 1),)) for s in SIDES]
    out.append(Code("relativeVAxis", ("pelvis", "neck"), "torso", ("vertical",)))
    out += [Code("relativeVAxis", both(part), f"both_{plural}", ("horizontal",), (), (("horizontal", 1),)) for part, plural in (("hand", "hands"), ("foot", "feet"))]
    out += [Code("onGround", (f"{s}_{part}",), f"{s}_{part}", ("on_ground",), (), (("on_ground", 1),)) for part in ("knee", "foot") for s in SIDES]
    out += [Code("onGround", (f"{s}_hand",), f"{s}_hand", ("on_ground",), (), (), ("on_ground",)) for s in SIDES]
    trunk = ("left_shoulder", "right_shoulder", "pelvis", "left_ankle", "right_ankle")
    out += [Code(f"bodyIncline{a}", trunk, "body", _all(f"bodyIncline{a}")) for a in "XYZ"]
    out += [Code(f"relativeRot{a}", ("head", root), "head", _all(f"relativeRot{a}")) for a, root in (("X", "neck"), ("Y", "pelvis"), ("Z", "neck"))]
    return out


def _supers() -> list[Super]:
    out = [Super("torso_horizontal", ("torso",), "horizontal", True, True, (tuple(("relativeVAxis", ("pelvis", f"{s}_shoulder"), "horizontal") for s in SIDES),))]
    for s in SIDES:
        lower = "below" if s == "left" else "above"
        way = (("relativePosY", ("left_knee", "right_knee"), lower), ("onGround", (f"{s}_knee",), "on_ground"), ("onGround", (f"{other(s)}_foot",), "on_ground"))
        out.append(Super(f"kneel_on_{s}", ("body",), f"kneel_on_{s}", True, False, (way,)))
    ground = tuple(("onGround", (f"{s}_knee",), "on_ground") for s in SIDES)
    upright = tuple(("relativePosY", (f"{s}_hip", f"{s}_knee"), "above") for s in SIDES)
    folded = tuple(("angle", (f"{s}_hip", f"{s}_knee", f"{s}_ankle"), "completely bent") for s in SIDES)
    out.append(Super("kneeling", ("body",), "kneeling", True, False, (upright + ground, folded + ground)))
    for part, plural, rare in (("hand", "hands", True), ("foot", "feet", False)):
        pair = (f"left_{part}", f"right_{part}")
        out.append(Super(f"{plural}_shoulder_width", (f"both_{plural}",), "shoulder width", rare, True, ((("distance", pair, "shoulder width"), ("relativeVAxis", pair, "horizontal")),)))
    # an extremity in line with a limb point, at any distance but wide
    for s in SIDES:
        for end in ("hand", "foot"):
            for t in SIDES:
                for limb in UPPER + LOWER:
                    if s == t and limb in (UPPER if end == "hand" else LOWER):
                        continue
                    pair = (f"{s}_{end}", f"{t}_{limb}")
                    for plane in ("xy", "xz", "yz"):
                        aligned = tuple((f"relativePos{a.upper()}", pair, f"{a}-aligned") for a in plane)
                        ways = tuple((*aligned, ("distance", pair, far)) for far in ("close", "shoulder width", "spread"))
                        out.append(Super(f"{plane}-aligned_{s}_{end}_{t}_{limb}", pair, f"{plane}-aligned", False, True, ways))
    return out


def _completed(codes: list[Code], supers: list[Super]) -> list[Code]:
    """Adds the codes that aligned super-codes need; where the joint set exists its categories are merged.

    A category that is needed there is a support: of type 1, or of type 2 if it is rare by itself;
    a type that is already given stays.
    """
    by = {(c.kind, c.joints): c for c in codes}
    for s in supers:
        if s.category.endswith("-aligned"):
            for kind, joints, category in (r for way in s.ways for r in way):
                c = by.get((kind, joints)) or Code(kind, joints, joints[0], ())
                accepted = c.accepted if category in c.accepted else (*c.accepted, category)
                support = c.support if category in dict(c.support) else (*c.support, (category, 2 if category in c.rare else 1))
                c = Code(kind, joints, c.focus, accepted, c.rare, support, c.absolute)
                by[kind, joints] = c
    order = list(KINDS)
    return sorted(by.values(), key=lambda c: order.index(c.kind))


SUPERS = _supers()
CODES = _completed(_elementary(), SUPERS)
CODE_ID = {(c.kind, c.joints): i for i, c in enumerate(CODES)}
#: Global ids: each kind's categories follow those of the kinds before it, then the categories only super-codes have.
OFFSET: dict[str, int] = {}
CATEGORIES: list[str] = []
for _name, _kind in KINDS.items():
    OFFSET[_name] = len(CATEGORIES)
    CATEGORIES.extend(_kind.categories)
CATEGORIES.extend(dict.fromkeys(s.category for s in SUPERS if s.category not in CATEGORIES))
CATEGORIES.append("touch")
PAIR_OFFSET: dict[str, int] = {}
PAIR_CATEGORIES: list[str] = []
for _name, _kind in PAIR_KINDS.items():
    PAIR_OFFSET[_name] = len(CATEGORIES) + len(PAIR_CATEGORIES)
    PAIR_CATEGORIES.extend(_kind.categories)
PAIR_CATEGORIES.append("straighten")


# The codes of pairs of poses and those that combine them.
def pair_codes() -> list[Code]:
    out = [Code("pair_angle", c.joints, c.focus, _all("pair_angle"), (), (("bent less", 2), ("bent more", 2))) for c in CODES if c.kind == "angle"]
    moved = ("farther", "slightly farther", "slightly closer", "closer")
    for part in ("elbow", "hand", "knee", "foot"):
        out.append(Code("pair_distance", (f"left_{part}", f"right_{part}"), None, moved, (), tuple((m, 1) for m in moved)))
    out += [Code("pair_distance", (f"{s}_{part}", "torso"), f"{s}_{part}", moved, (), tuple((m, 1) for m in moved)) for s in SIDES for part in ("elbow", "hand", "knee", "foot")]
    for axis in "XYZ":
        for part in ("shoulder", "elbow", "hand", "knee", "foot"):
            if (axis, part) != ("X", "shoulder"):
                out += [Code(f"pair_relativePos{axis}", (f"{s}_{part}",) * 2, f"{s}_{part}", _all(f"pair_relativePos{axis}")) for s in SIDES]
    trunk = ("left_shoulder", "right_shoulder", "pelvis", "left_ankle", "right_ankle")
    out += [Code(f"pair_bodyIncline{a}", trunk, "body", _all(f"pair_bodyIncline{a}")) for a in "XYZ"]
    out += [Code(f"pair_relativeRot{a}", ("head", root), "head", _all(f"pair_relativeRot{a}")) for a, root in (("X", "neck"), ("Y", "pelvis"))]
    return out


PAIR_CODES = pair_codes()
PAIR_CODE_ID = {(c.kind, c.joints): i for i, c in enumerate(PAIR_CODES)}


@dataclass(frozen=True)
class SuperPair:
    """ways: requirements (role, kind, joints, category): role a or b (a pose code of that pose), strict or direction (a pair code)."""

    name: str
    focus: str
    category: str
    ways: tuple[tuple[tuple[str, str, tuple[str, ...], str], ...], ...]


def super_pairs() -> list[SuperPair]:
    out = []
    for limb, joints in (("leg", ("hip", "knee", "ankle")), ("arm", ("shoulder", "elbow", "wrist"))):
        for s in SIDES:
            j = tuple(f"{s}_{x}" for x in joints)
            ways = tuple((("direction", "pair_angle", j, "bent less"), ("b", "angle", j, end)) for end in ("slightly bent", "straight"))
            out.append(SuperPair(f"straighten_{s}_{limb}", f"{s}_{limb}", "straighten", ways))
    for part in ("elbow", "hand", "knee", "foot"):
        for amount in ("", "slightly "):
            for move, role in (("farther", "a"), ("closer", "b")):
                for name, focus, pair in ((part, f"both_{part}", (f"left_{part}", f"right_{part}")), *((f"{s}_{part}", f"{s}_{part}", (f"{s}_{part}", "torso")) for s in SIDES)):
                    out.append(SuperPair(f"{amount}{move}_{name}", focus, amount + move, ((("strict", "pair_distance", pair, amount + move), (role, "distance", pair, "close")),)))
    return out


SUPER_PAIRS = super_pairs()
