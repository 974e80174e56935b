"""Chat formatting with a grammar round trip (DataFrame functions only).

Template: `[INST] user [/INST]`, `assistant</s>`, `[ROLE name] any other [/ROLE]`, turns end
to end.  A text that holds one of these control strings, or reads as an escape, is written
with character references for `&`, `<` and `[`; all others stay as they are.  The whole
rendered conversation is then parsed again; if its turns are not those of the source, all of
its texts are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

CONTROL = r"</s>|\[INST\]|\[/INST\]|\[ROLE |\[/ROLE\]"
REFERENCE = r"&amp;|&lt;|&#91;|&#93;"
TURN = r"(?s)\[INST\] .*? \[/INST\]|\[ROLE [^\]]*\] .*? \[/ROLE\]|.*?</s>"


def escape(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def unescape(t: Column) -> Column:
    for a, b in (("]", "&#93;"), ("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        t = F.replace(t, F.lit(b), F.lit(a))
    return t


def render(role: Column, text: Column) -> Column:
    """One turn; `text` as it shall stand there."""
    named = F.concat(F.lit("[ROLE "), escape(role), F.lit("] "), text, F.lit(" [/ROLE]"))
    return F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))).when(role == "assistant", F.concat(text, F.lit("</s>"))).otherwise(named)


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text), texts unescaped.

    Turns follow each other without gaps; where they don't, the result is null.
    """

    def turn(m: Column) -> Column:
        user = m.startswith("[INST] ") & m.endswith(" [/INST]")
        named = m.startswith("[ROLE ") & m.endswith(" [/ROLE]")
        head = F.instr(m, "] ")
        n = F.length(m)
        role = F.when(user, F.lit("user")).when(named, unescape(F.substring(m, F.lit(7), head - 7))).otherwise(F.lit("assistant"))
        text = F.when(user, F.substring(m, F.lit(8), n - 15)).when(named, F.substring(m, head + 2, n - head - 9)).otherwise(F.substring(m, F.lit(1), n - 4))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    found = lambda f: let(F.regexp_extract_all(f, F.lit(TURN), F.lit(0)), lambda ms: F.when(F.array_join(ms, "") == f, F.transform(ms, turn)))
    return let(formatted, found)


def learned(formatted: Column, mask: Column) -> Column:
    """The texts that a model learns from: each run of `formatted` under the loss mask, unescaped, end to end."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"))

    def step(done: Column, run: Column) -> Column:
        own = unescape(F.substring(formatted, done["at"], run["chars"]))
        return F.struct((done["at"] + run["chars"]).alias("at"), F.when(run["loss"], F.concat(done["text"], own)).otherwise(done["text"]).alias("text"))

    return F.aggregate(mask, start, step, lambda done: done["text"])


def format_conversations(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, formatted, mask.

    One row per conversation (null conv_id: one too), its turns by `turn` (null first), then
    role and text, so ties and repeated rows have a defined order.  Null role or text counts
    as empty.  `mask` lists runs (chars, loss) over `formatted`: loss is true over the texts of
    assistant turns and false over everything else.  Very long texts are formatted whole; an empty
    table gives an empty result.  Other columns are not carried.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    read_back = lambda x: (F.size(x) == 1) & (x[0]["text"] == F.col("text")) & (x[0]["role"] == F.col("role"))
    # Texts with control strings are escaped in any case; parsing them as they are could take the square of their length.
    same = F.coalesce(let(parse(render(F.col("role"), F.col("text"))), read_back), F.lit(False))
    t = t.withColumn("__plain", F.when(F.col("text").rlike(f"{CONTROL}|{REFERENCE}"), F.lit(False)).otherwise(same))
    t = t.withColumn("__shown", F.when(F.col("__plain"), F.col("text")).otherwise(escape(F.col("text"))))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "__shown"))).alias("__turns"))
    c = c.withColumn("__first", F.array_join(F.transform("__turns", lambda x: render(x["role"], x["__shown"])), ""))
    source = F.transform("__turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    c = c.withColumn("__same", F.coalesce(parse(F.col("__first")) == source, F.lit(False)))
    c = c.withColumn("__turns", F.when(F.col("__same"), F.col("__turns")).otherwise(F.transform("__turns", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"), escape(x["text"]).alias("__shown")))))
    formatted = F.array_join(F.transform("__turns", lambda x: render(x["role"], x["__shown"])), "")

    def runs(x: Column) -> Column:
        n, whole = F.length(x["__shown"]), F.length(render(x["role"], x["__shown"]))
        run = lambda k, loss: F.struct(k.alias("chars"), F.lit(loss).alias("loss"))
        return F.when(x["role"] == "assistant", F.array(run(n, True), run(whole - n, False))).otherwise(F.array(run(whole, False)))

    return c.select("conv_id", formatted.alias("formatted"), F.flatten(F.transform("__turns", runs)).alias("mask"))
