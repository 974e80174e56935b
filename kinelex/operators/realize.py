"""Texts from codes: descriptions of poses and instructions from pose to pose.

The wording is this package's own.  Choices are drawn by keyed hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import uniform
from ..functions.stages import stored
from ..plans import catalog
from . import codes, compose, pairs, rewrite
from .text import sentence_case

#: Wordings of each category: {s} subject, {v} its verb, {o} object.
PHRASES: dict[str, tuple[str, ...]] = {
    "completely bent": ("{s} {v} fully flexed", "{s} {v} bent as far as possible"),
    "bent more": ("{s} {v} strongly flexed",),
    "right angle": ("{s} {v} bent to a right angle", "{s} {v} at ninety degrees"),
    "bent less": ("{s} {v} moderately flexed",),
    "slightly bent": ("{s} {v} a little flexed",),
    "straight": ("{s} {v} stretched out", "{s} {v} extended"),
    "close": ("{s} {v} near {o}", "{s} {v} next to {o}"),
    "shoulder width": ("{s} {v} about a shoulder's width from {o}",),
    "spread": ("{s} {v} some way from {o}",),
    "wide": ("{s} {v} far from {o}",),
    "at_right": ("{s} {v} further to the right than {o}",),
    "at_left": ("{s} {v} further to the left than {o}",),
    "below": ("{s} {v} lower than {o}", "{s} {v} beneath {o}"),
    "above": ("{s} {v} higher than {o}", "{s} {v} over {o}"),
    "behind": ("{s} {v} further back than {o}",),
    "front": ("{s} {v} further forward than {o}",),
    "vertical": ("{s} {v} upright",),
    "horizontal": ("{s} {v} level with the floor",),
    "on_ground": ("{s} {v} on the floor",),
    "touch": ("{s} {v} touching {o}", "{s} {v} in contact with {o}"),
    "x-aligned": ("{s} {v} at one width with {o}",),
    "y-aligned": ("{s} {v} at the height of {o}", "{s} {v} level with {o}"),
    "z-aligned": ("{s} {v} at one depth with {o}",),
    "xy-aligned": ("{s} {v} straight in front of or behind {o}", "{s} {v} in one line of sight with {o}"),
    "xz-aligned": ("{s} {v} straight above or below {o}", "{s} {v} in one upright line with {o}"),
    "yz-aligned": ("{s} {v} beside {o} at its height", "{s} {v} in one level line with {o}"),
    "kneel_on_left": ("{s} {v} kneeling on the left knee",),
    "kneel_on_right": ("{s} {v} kneeling on the right knee",),
    "kneeling": ("{s} {v} kneeling", "{s} {v} on both knees"),
}
#: Wordings of categories whose second part is left out.
ALONE: dict[str, tuple[str, ...]] = {
    "behind": ("{s} {v} held back", "{s} {v} at the back"),
    "front": ("{s} {v} held to the front",),
    "at_right": ("{s} {v} held out to the right",),
    "at_left": ("{s} {v} held out to the left",),
    "above": ("{s} {v} raised high",),
}
for _k in ("bodyInclineX", "bodyInclineY", "bodyInclineZ", "relativeRotX", "relativeRotY", "relativeRotZ"):
    for _c in catalog.KINDS[_k].categories:
        PHRASES.setdefault(_c, (("{s} {v} " if _c.startswith("body") else "{s} {v} ") + {"incline": "tilted", "twist": "twisted", "lean": "leaning", "turn": "turned"}.get(_c.removeprefix("body ").split(" ")[0], "") + " " + " ".join(_c.removeprefix("body ").split(" ")[1:]),))

#: Wordings of changes: {s} what changes, {o} the other part.
PAIR_PHRASES: dict[str, tuple[str, ...]] = {
    "straighten": ("straighten {s}", "stretch {s} out"),
    "touch": ("make {s} touch {o}", "let {s} reach {o}"),
    **{c: (f"bend {{s}} {c.removeprefix('bent ')}",) for c in catalog.PAIR_KINDS["pair_angle"].categories if "ignored" not in c},
    **{c: (f"bring {{s}} {c.replace('farther', 'further')} {'from' if 'farther' in c else 'to'} {{o}}",) for c in catalog.PAIR_KINDS["pair_distance"].categories if "ignored" not in c},
    **{c: (f"move {{s}} {c.replace('more ', '')}",) for a in "XYZ" for c in catalog.PAIR_KINDS[f"pair_relativePos{a}"].categories if "ignored" not in c},
    **{c: (c.replace("body incline", "tilt the body").replace("body twist", "twist the body").replace("body lean", "lean the body"),) for a in "XYZ" for c in catalog.PAIR_KINDS[f"pair_bodyIncline{a}"].categories if "ignored" not in c},
}
#: What stands between two clauses.  After `with`, and after every `and` that follows it, a clause has no verb.
TRANSITIONS = (". ", " and ", " with ", "; ", ", while ")
#: What stands between the clauses of one subject: the first two drop the verb; {it} and {v} agree with the subject.
LINKS = (" and ", ", ", " and {v} ", ". {it} {v} ")


def plural(part: Column) -> Column:
    return F.when(part == "foot", "feet").when(part.isin("toes", "feet", "hands"), part).otherwise(F.concat(part, F.lit("s")))


def spaced(part: Column) -> Column:
    """Joined words apart."""
    for joined, apart in (("upperarm", "upper arm"), ("lowerleg", "lower leg"), ("upperback", "upper back"), ("lowerback", "lower back"), ("backdiag", "back")):
        part = F.replace(part, F.lit(joined), F.lit(apart))
    return part


def noun(side: Column, part: Column) -> Column:
    """The words for a body part."""
    return spaced(F.when(side == "both", F.concat(F.lit("both "), plural(part))).when(side.isNotNull(), F.concat(F.lit("the "), side, F.lit(" "), part)).otherwise(F.concat(F.lit("the "), part)))


def pick(options: dict[str, tuple[str, ...]], category: Column, draw: Column) -> Column:
    """One wording of a category."""
    table = F.create_map(*(x for c, ws in options.items() for x in (F.lit(c), F.array(*(F.lit(w) for w in ws)))))
    ws = table[category]
    return F.element_at(ws, F.floor(draw * F.size(ws)).cast("int") + 1)


def polish(text: Column) -> Column:
    return F.concat(sentence_case(F.trim(F.regexp_replace(text, r"\s+", " "))), F.lit("."))


def several(nouns: Column) -> Column:
    """Nouns as a list: commas, and `and` before the last."""
    n = F.size(nouns)
    return F.when(n == 1, F.get(nouns, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(nouns, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(nouns, n - 1)))


def predicate(code: Column, draw: Column) -> Column:
    """What is said of a code's first part, without subject and verb; null where the category has no words."""
    silent = rewrite.needless(code["part1"], code["intptt"], code["part2"])
    words = F.when((silent | code["part2"].isNull()) & code["intptt"].isin(*ALONE), pick(ALONE, code["intptt"], draw)).otherwise(pick(PHRASES, code["intptt"], draw))
    return F.replace(F.replace(words, F.lit("{s} {v} "), F.lit("")), F.lit("{o}"), F.coalesce(noun(code["side2"], code["part2"]), F.lit("each other")))


def is_plural(code: Column) -> Column:
    return F.coalesce(code["side1"] == "both", F.lit(False)) | code["part1"].isin("hands", "feet", "toes")


def unit_text(key: str, bare: Column, seed: int = 0) -> Column:
    """The words of a unit (how, grp, codes) of `compose.fuse`; bare: without its verb."""
    draw = lambda site, i: uniform(seed, site, F.col(key), F.col("how"), F.col("grp"), i)
    first = F.get("codes", F.lit(0))
    subjects = F.transform("codes", lambda c: noun(c["side1"], c["part1"]))
    many = (F.col("how") == "predicate") | is_plural(first)
    verb, it = F.when(many, "are").otherwise("is"), F.when(many, "they").otherwise("it")
    shared = F.concat(several(subjects), F.when(bare, " ").otherwise(" are "), predicate(first, draw("phrase", F.lit(0))))

    def clause(c: Column, i: Column) -> Column:
        n = F.when(bare, 2).otherwise(len(LINKS))
        link = F.element_at(F.array(*(F.lit(x) for x in LINKS)), F.floor(draw("link", i) * n).cast("int") + 1)
        start = F.when(i == 0, F.concat(F.get(subjects, F.lit(0)), F.when(bare, " ").otherwise(F.concat(F.lit(" "), verb, F.lit(" "))))).otherwise(F.replace(F.replace(link, F.lit("{v}"), verb), F.lit("{it}"), it))
        return F.concat(start, predicate(c, draw("phrase", i)))

    return F.when(F.col("how") == "predicate", shared).otherwise(F.array_join(F.transform("codes", clause), ""))


def sentences(rows: DataFrame, key: str, seed: int = 0, p: float = 1.0) -> DataFrame:
    """Formatted codes -> key, text: fused, in the order of the item's walk, and joined by drawn transitions.

    A unit that follows `with`, or an `and` in its wake, says nothing of being.  Codes without words are
    left out before anything else, so they never open a text.
    """
    said = rows.where(F.col("intptt").isin(*PHRASES))
    units = compose.ordered(stored(compose.fuse(said, key, p, seed), "units"), key, seed)
    mine = Window.partitionBy(key).orderBy("place")
    drawn = F.element_at(F.array(*(F.lit(t) for t in TRANSITIONS)), F.floor(uniform(seed, "transition", F.col(key), F.col("place")) * len(TRANSITIONS)).cast("int") + 1)
    units = units.withColumn("link", F.when(F.col("place") == 0, "").otherwise(drawn))
    units = units.withColumn("bare", F.coalesce(F.last(F.when(F.col("link") != " and ", F.col("link") == " with "), ignorenulls=True).over(mine), F.lit(False)))
    c = units.select(key, F.struct("place", F.concat("link", unit_text(key, F.col("bare"), seed)).alias("c")).alias("x"))
    return c.groupBy(key).agg(polish(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]), "")).alias("text"))


def describe(poses: DataFrame, contacts: DataFrame | None = None, seed: int = 0, simple: bool = False, p: float = 0.95) -> DataFrame:
    """poses (pose_id, joints) -> pose_id, text.

    contacts (pose_id, side1, part1, side2, part2): parts that touch, if known.  p: how often codes
    that can be said together are.  simple: without merging, pruning and fusing of codes.
    """
    facts = stored(codes.measure(poses).select("pose_id", "code_id", "intptt_id"), "facts")
    supers = stored(codes.super_codes(facts), "supers")
    settled = codes.resolve_support(codes.eligibility(facts), supers)
    kept = stored(codes.skip(codes.with_supers(settled, supers), seed=seed).where("kept").select("pose_id", "code_id", "intptt_id", "elig"), "kept")
    if simple:
        rows = rewrite.formatted(kept).drop("code_id")
    else:
        pruned = rewrite.prune_statistical(kept, facts)
        rows = stored(rewrite.prune_transitive(stored(rewrite.formatted(pruned), "formatted")), "pruned").drop("code_id")
    if contacts is not None:
        rows = stored(rewrite.merge_contacts(rows, rewrite.prune_contained(stored(contacts, "contacts"))), "touching")
    if not simple:
        # each step looks at its rows several times, so what it looks at is made once
        rows = rewrite.merge_symmetric(stored(rewrite.merge_entities(rows, seed=seed), "merged"))
        rows = rewrite.collapse(rewrite.reverse(rows, seed=seed), seed=seed)
    return sentences(stored(rows, "rewritten"), "pose_id", seed, 0.0 if simple else p)


PAIR_DIFFERENCES = ("pair_angle", "pair_distance")
#: Changes that two same parts can share as one subject.
PAIR_SHARED = tuple("change " + c for c in (*catalog.PAIR_KINDS["pair_distance"].categories, "touch"))
#: Marks categories of changes where they stand beside those of poses, of which some have the same name.
CHANGE = "change "
#: What may stand between two instructions, and between those on one part.
STEPS, GOES_ON = (". ", ", then ", ", while ", " and "), (" and ", ", then ", ". also ")
#: How a fact about the pose to reach is put: a verb and what follows it.  Verbs of duty have one form.
OUGHT, DUTIES = ("should be", "must be", "need to be", "end up"), ("should", "must")


def third_person(verb: Column) -> Column:
    """A verb as it goes with one part."""
    return F.when(verb.isin(*DUTIES), verb).when(verb.rlike("(s|x|z|ch|sh|o)$"), F.concat(verb, F.lit("es"))).otherwise(F.concat(verb, F.lit("s")))


def gerund(verb: Column) -> Column:
    """The -ing form: a last e goes, the last letter of `let` is doubled, verbs of duty stay."""
    return F.when(verb.isin(*DUTIES), verb).when(verb.isin("let"), F.concat(verb, F.substring(verb, -1, 1), F.lit("ing"))).when(verb.endswith("e"), F.regexp_replace(verb, "e$", "ing")).otherwise(F.concat(verb, F.lit("ing")))


def conjugated(clause: Column, form: Callable[[Column], Column]) -> Column:
    """A clause whose first word, a verb, takes a form."""
    verb = F.substring_index(clause, " ", 1)
    return F.concat(form(verb), F.substring(clause, F.length(verb) + 1, F.length(clause)))


def change_rows(eligible: DataFrame, supers: DataFrame) -> DataFrame:
    """Eligible pair facts and super-pair-codes that hold -> pair_id, code_id, elig, side1, part1, intptt (marked), side2, part2, nature, direction, magnitude.

    A super-pair-code has a nature of its own, so it is merged with its likes only.
    """
    spark = eligible.sparkSession
    names = [(catalog.PAIR_OFFSET[k] + n, CHANGE + c) for k, kind in catalog.PAIR_KINDS.items() for n, c in enumerate(kind.categories)]
    t = F.broadcast(spark.createDataFrame(names, "intptt_id int, intptt string"))
    own = eligible.where("elig > 0").join(F.broadcast(pairs.pair_code_table(spark).drop("accepted", "rare")), ["code_id", "intptt_id"]).join(t, "intptt_id")
    columns = ("pair_id", "code_id", "elig", "side1", "part1", "intptt", "side2", "part2", "nature", "direction", "magnitude")
    rows = []
    for i, x in enumerate(catalog.SUPER_PAIRS):
        torso = any("torso" in joints for way in x.ways for _, _, joints, _ in way)
        rows.append((i, len(catalog.PAIR_CODES) + i, 1, *catalog.split_side(x.focus), CHANGE + x.category, None, "torso" if torso else None, -1 if x.category == "straighten" else -2, -1 if "farther" in x.category else 1, 1 if "slightly" in x.category else 2))
    more = F.broadcast(spark.createDataFrame(rows, "super_id int, code_id int, elig int, side1 string, part1 string, intptt string, side2 string, part2 string, nature int, direction int, magnitude int"))
    return own.select(*columns).unionByName(supers.join(more, "super_id").select(*columns))


def fact_rows(facts: DataFrame, supers: DataFrame, ids: DataFrame, changed: DataFrame) -> DataFrame:
    """What is said of pose B as such: its absolute codes about changed parts and those further out -> pair_id, code_id, elig and the columns of a code."""
    spark = facts.sparkSession
    absolute = pairs.resolve_pose_support(pairs.absolute_eligibility(facts), supers, ids).where("elig > 0")
    t = F.broadcast(rewrite.format_table(spark).drop("kind"))
    b = absolute.join(t, ["code_id", "intptt_id"]).join(ids.select("pair_id", F.col("pose_b").alias("pose_id")), "pose_id").withColumn("part", F.concat_ws("_", "side1", "part1"))
    b = stored(b, "facts-of-b")  # looked at three times below
    held = pairs.facts_of_b(changed, b.select("pair_id", "code_id", "part"))
    return b.join(held.select("pair_id", "code_id"), ["pair_id", "code_id"], "left_semi").select("pair_id", "code_id", "elig", *compose.CODE)


def rewritten_changes(ids: DataFrame, facts: DataFrame, changes: DataFrame, contacts: DataFrame | None = None, seed: int = 0, p: float = 0.95) -> DataFrame:
    """pair_id, side1, part1, intptt, side2, part2: what there is to say of each pair, merged.

    ids (pair_id, pose_a, pose_b); facts of poses and changes of pairs (code_id, intptt_id, kind); contacts
    of poses, of which a pair says those that B has and A lacks.
    """
    supers = stored(pairs.super_pairs(facts, changes.where(F.col("kind").isin(*PAIR_DIFFERENCES)), ids), "super-pairs")
    settled = pairs.resolve_pair_support(pairs.pair_eligibility(changes), supers)
    said = stored(change_rows(settled, supers), "changes")
    changed = stored(said.select("pair_id", F.concat_ws("_", "side1", "part1").alias("part")).distinct(), "changed")
    of_b = fact_rows(facts, supers, ids, changed).select("*", F.lit(0).alias("nature"), F.lit(0).alias("direction"), F.lit(0).alias("magnitude"))
    # facts are numbered after the changes, so that each draws for itself
    first = len(catalog.PAIR_CODES) + len(catalog.SUPER_PAIRS)
    rows = said.unionByName(of_b.withColumn("code_id", F.col("code_id") + first))
    kept = stored(codes.skip(rows.withColumnRenamed("pair_id", "pose_id"), seed=seed).where("kept").drop("kept", "elig").withColumnRenamed("pose_id", "pair_id"), "kept")
    rows = stored(pairs.merge_entities(kept, rewrite.ENTITIES, p, seed), "merged")
    if contacts is not None:
        c = stored(contacts, "contacts").select(F.col("pose_id").alias("pose"), *(x for x in compose.CODE if x != "intptt"))
        had = c.join(ids.select("pair_id", F.col("pose_a").alias("pose")), "pose").drop("pose")
        has = c.join(ids.select("pair_id", F.col("pose_b").alias("pose")), "pose").drop("pose").distinct()
        new = has.exceptAll(had.distinct()).withColumn("intptt", F.lit(CHANGE + "touch"))
        rows = rows.unionByName(rewrite.prune_contained(stored(new.drop("intptt"), "new-contacts").withColumnRenamed("pair_id", "pose_id")).withColumnRenamed("pose_id", "pair_id").withColumn("intptt", F.lit(CHANGE + "touch")))
    rows = rewrite.merge_symmetric(stored(rows, "touching").withColumnRenamed("pair_id", "pose_id"))
    return rewrite.collapse(rewrite.reverse(rows, seed=seed), seed=seed, shared=PAIR_SHARED).withColumnRenamed("pose_id", "pair_id").select("pair_id", *compose.CODE)


def exempt_changes() -> Column:
    """Changes of distance and new contacts are never said together with others."""
    return F.col("intptt").isin(*(CHANGE + c for c in (*catalog.PAIR_KINDS["pair_distance"].categories, "touch")))


def instruction_text(key: str, going: Column, seed: int = 0) -> Column:
    """The words of a unit of changes and facts; going: changes go on while something else does."""
    draw = lambda site, i: uniform(seed, site, F.col(key), F.col("how"), F.col("grp"), i)
    first = F.get("codes", F.lit(0))
    subjects = F.transform("codes", lambda c: noun(c["side1"], c["part1"]))
    many = (F.col("how") == "predicate") | is_plural(first)

    def said(c: Column, subject: Column, plural: Column, i: Column) -> Column:
        change = F.replace(F.replace(pick(PAIR_PHRASES, F.replace(c["intptt"], F.lit(CHANGE), F.lit("")), draw("phrase", i)), F.lit("{s}"), subject), F.lit("{o}"), F.coalesce(noun(c["side2"], c["part2"]), F.lit("each other")))
        ought = F.element_at(F.array(*(F.lit(x) for x in OUGHT)), F.floor(draw("ought", i) * len(OUGHT)).cast("int") + 1)
        ought = F.when(plural, ought).otherwise(conjugated(ought, third_person))
        change = F.when(going, conjugated(change, gerund)).otherwise(change)
        nominative = F.when(subject == "them", "they").otherwise(subject)
        return F.when(c["intptt"].startswith(CHANGE), change).otherwise(F.concat(nominative, F.lit(" "), ought, F.lit(" "), predicate(c, draw("phrase", i))))

    def clause(c: Column, i: Column) -> Column:
        link = F.element_at(F.array(*(F.lit(x) for x in GOES_ON)), F.floor(draw("link", i) * len(GOES_ON)).cast("int") + 1)
        it = F.when(many, "them").otherwise("it")
        return F.when(i == 0, said(c, F.get(subjects, F.lit(0)), many, i)).otherwise(F.concat(link, said(c, it, many, i)))

    return F.when(F.col("how") == "predicate", said(first, several(subjects), F.lit(True), F.lit(0))).otherwise(F.array_join(F.transform("codes", clause), ""))


def instructions(rows: DataFrame, rotations: DataFrame | None = None, seed: int = 0, p: float = 0.95) -> DataFrame:
    """Rows of `rewritten_changes` -> pair_id, text, preceded by the turn of the whole body (rotations: pair_id, degrees), if it is told.

    A pair of which nothing is to be said has no row.
    """
    known = rows.where(F.col("intptt").isin(*PHRASES, *(CHANGE + c for c in PAIR_PHRASES)))
    units = compose.ordered(stored(compose.fuse(known, "pair_id", p, seed, exempt_changes()), "units"), "pair_id", seed)
    step = F.element_at(F.array(*(F.lit(t) for t in STEPS)), F.floor(uniform(seed, "step", F.col("pair_id"), F.col("place")) * len(STEPS)).cast("int") + 1)
    units = units.withColumn("step", F.when(F.col("place") == 0, "").otherwise(step))
    # what follows `while`, and each `and` in its wake, goes on at the same time
    going = F.last(F.when(F.col("step") != " and ", F.col("step") == ", while "), ignorenulls=True).over(Window.partitionBy("pair_id").orderBy("place"))
    units = units.withColumn("going", F.coalesce(going, F.lit(False)))
    c = units.select("pair_id", F.struct("place", F.concat("step", instruction_text("pair_id", F.col("going"), seed)).alias("c")).alias("x"))
    texts = c.groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]), "").alias("text"))
    if rotations is not None:
        turns = F.create_map(*(F.lit(x) for i, c in enumerate(catalog.ROOT_ROTATION.categories[:-1]) for x in (i, "" if "ignored" in c else f"turn {c}. ")))
        turned = pairs.root_rotation(rotations).select("pair_id", turns[F.col("bin")].alias("turn")).where("turn <> ''")
        texts = texts.join(turned, "pair_id", "full").select("pair_id", F.concat(F.coalesce("turn", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
        texts = texts.withColumn("text", F.regexp_replace("text", r"\. $", ""))
    return texts.select("pair_id", polish(F.col("text")).alias("text"))


def instruct(poses: DataFrame, ids: DataFrame, changes: DataFrame, rotations: DataFrame | None = None, contacts: DataFrame | None = None, seed: int = 0, p: float = 0.95) -> DataFrame:
    """poses (pose_id, joints), ids (pair_id, pose_a, pose_b), changes of the pairs -> pair_id, text: how to get from pose A to pose B."""
    facts = stored(codes.measure(poses).select("pose_id", "code_id", "kind", "intptt_id"), "facts")
    return instructions(stored(rewritten_changes(ids, facts, changes, contacts, seed, p), "rewritten-changes"), rotations, seed, p)


def clean_tags(tags: Column) -> Column:
    """Distinct tags without nulls and dataset markers (`__name__`)."""
    return F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & ~t.rlike("^__.*__$")))


def tag_sentence(items: DataFrame, seed: int = 0) -> DataFrame:
    """items (data_id, tags) -> data_id, text: nothing, one tag, or two drawn tags joined by `and` or `while`."""
    t = items.select("data_id", clean_tags(F.col("tags")).alias("tags"))
    drawn = F.transform(F.sort_array(F.transform("tags", lambda x: F.struct(uniform(seed, "tag", F.col("data_id"), x).alias("d"), x.alias("t")))), lambda x: x["t"])
    link = F.when(uniform(seed, "join", F.col("data_id")) < 0.5, " and ").otherwise(" while ")
    text = F.when(F.size("tags") == 0, "").when(F.size("tags") == 1, F.concat(F.lit("Someone does: "), F.get("tags", F.lit(0)), F.lit("."))).otherwise(F.concat(F.lit("Someone does: "), F.get(drawn, F.lit(0)), link, F.get(drawn, F.lit(1)), F.lit(".")))
    return t.select("data_id", text.alias("text"))


# Determiners of a description and their weights.
DETERMINERS, WEIGHTS = ("the", "their", "his", "her"), (0.5, 0.3, 0.1, 0.1)
BOUNDS = tuple(round(sum(WEIGHTS[: i + 1]), 6) for i in range(len(WEIGHTS) - 1))


def determiner(key: Column, seed: int = 0) -> Column:
    """The determiner of an item, drawn by weight."""
    draw, out = uniform(seed, "determiner", key), F.lit(DETERMINERS[-1])
    for word, bound in reversed(list(zip(DETERMINERS, BOUNDS, strict=False))):
        out = F.when(draw < bound, word).otherwise(out)
    return out


def with_action(text: Column, action: Column, determiner: Column) -> Column:
    """The sentence on the action before the text, put to agree with a determiner of one sex; a null action adds nothing."""
    put = lambda pronoun, noun: F.when(action.rlike("^They "), F.replace(F.replace(action, F.lit("They"), F.lit(pronoun)), F.lit(" are "), F.lit(" is "))).when(action.rlike("^[^ ]+ human "), F.replace(action, F.lit(" human "), F.lit(f" {noun} "))).otherwise(action)
    agreed = F.when(determiner == "his", put("He", "man")).when(determiner == "her", put("She", "woman")).otherwise(action)
    return F.concat(F.coalesce(agreed, F.lit("")), text)
