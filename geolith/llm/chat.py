"""Chat formatting: every participant's view of a dialogue.

For each speaker of a conversation the dialogue is rendered with that speaker as `assistant`, everyone else as a user of
their own name, and a mask that is on for the speaker's turns alone. Built-in functions only.

A row holds one part: the turns whose number falls in the same span of `part_turns`, in order of turn, then role and text.
Parts put one after the other are the whole dialogue, so a conversation without end never has to fit in one row; with
the default almost all conversations are one part. A speaker has a row for each part, also where silent.

Defined results: null text is empty; a null or empty role is one speaker, null in the result and named `unknown` in others' views, and never
taken for a speaker of that name; null turns have no order and come first, in parts of their own of about `part_turns` rows each, by a
hash; turns that share a number share a part; repeated rows are repeated turns; a null conversation is one of its own. No rows: no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
#: Parts of turns without a number count down from here.
UNNUMBERED = -(1 << 60)


def rotate(turns: DataFrame, part_turns: int = 256) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, speaker, part, n_turns, n_spoken, rendered, mask.

    mask: array of struct(start, end), 0-based character offsets in `rendered` of what the speaker says, with the
    closing tag, as training on a turn needs its end. Markers inside a text or a name are broken up and a name is one line, so that
    neither can open a turn.
    """
    broken = lambda c: F.replace(F.replace(c, F.lit("<|im_start|>"), F.lit("<| im_start|>")), F.lit("<|im_end|>"), F.lit("<| im_end|>"))
    role, at = F.when(F.col("role") != "", F.col("role")), F.col("turn").cast("long")
    name = broken(F.translate(F.coalesce(role, F.lit("unknown")), "\r\n", "  "))
    said = broken(F.coalesce(F.col("text"), F.lit("")))
    rows = turns.select(F.col("conv_id"), F.floor(at / part_turns).cast("long").alias("part"), F.struct(at.alias("turn"), role.alias("role"), said.alias("text"), name.alias("name")).alias("t"))
    loose = rows.where("part is null").groupBy("conv_id").agg(F.ceil(F.count("*") / part_turns).alias("loose")).withColumnRenamed("conv_id", "loose_id")
    spread = F.lit(UNNUMBERED) - F.pmod(F.xxhash64("t"), F.col("loose"))
    rows = rows.where("part is not null").unionByName(rows.where("part is null").join(loose, F.col("conv_id").eqNullSafe(F.col("loose_id"))).select("conv_id", spread.alias("part"), "t"))
    speakers = rows.groupBy("conv_id").agg(F.collect_set(F.struct("t.role")).alias("speakers"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    both = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")))
    views = both.select("p.conv_id", "part", "turns", F.explode("speakers").alias("s")).select("conv_id", "part", "turns", F.col("s.role").alias("speaker"))

    def piece(t):
        own = t["role"].eqNullSafe(F.col("speaker"))
        named = F.when(own, F.lit("assistant\n")).otherwise(F.concat(F.lit("user name="), t["name"], F.lit("\n")))
        return F.struct(F.concat(F.lit(HEAD), named).alias("head"), F.concat(t["text"], F.lit(TAIL)).alias("body"), own.alias("own"))

    views = views.withColumn("pieces", F.transform("turns", piece))
    # starts of the bodies, by one fold
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return views.select(
        "conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_spoken"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("mask"),
    )
