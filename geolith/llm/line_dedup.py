"""Near-duplicate lines by a segment-partition edit join. Built-in functions only.

Lines (trimmed, A-Z lower-cased, of `least` characters or more) are made unique first, so copies cost nothing later. A line is split into
EDITS + 1 segments; two lines within EDITS edits share a segment, as it stands, near its place. Each line files its
segments under (length, number, hash); it looks up, for its own and each shorter length in reach, only the substrings whose
place fits both sides of the alignment. Matches are verified: Spark's banded `levenshtein` with a limit turns most down in
compiled code, and a banded bit-parallel automaton (one small word of vertical deltas, a column a character) gives the
distance of the rest. Links join into classes by distributed components; of each class, copies
included, the first line by (doc_id, row, place) stays.

Skew: copies of a line are one row after the first combine; a segment shared by many different lines is compared
chunk by chunk, filed and probing lines both in chunks of bounded size, and only links leave a pair of chunks (see candidates).

Every row has a number of its own (see numbered), so rows that share an id, or repeat, or have none, are told apart, and a place is
dropped from its own row only. Lines are matched with their class by 128 bits of hash.

Defined results: null text is empty and has one empty line; lines shorter than `least` are never linked to different ones, and exact
repeats of them go down to `shortest` characters (1 in op10 and the pipeline: all lines but blank ones); a line may repeat within its document; of rows that
share an id the first in the table has its lines first; a null id sorts first. An empty table: no rows. Extra columns pass
through, whatever their names; those named as an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, lower_ascii, numbered

EDITS, LEAST = 2, 20
#: The lines of a key with more than HOT filed ones are compared in chunks of about CHUNK.
HOT, CHUNK = 16, 64
#: Line numbers up to this many are sent to every executor (8 bytes each), beyond it joined by shuffle.
BROADCAST_LINES = 2_000_000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normal(line: Column) -> Column:
    return F.trim(lower_ascii(line))


def _keys(lines: DataFrame, places: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """line_id, line, key, other (that length): for each (shorter, i, move) the hash of the substring that segment i of a line shorter by so much would cover,
    moved by so much, with that length and i; none where it lies outside the line.

    The places are rows, not expressions side by side, so that the compiled code stays small enough for the JVM to compile.
    """
    k = edits + 1
    spec = F.array(*(F.struct(F.lit(n).alias("shorter"), F.lit(i).alias("i"), F.lit(m).alias("move")) for n, i, m in places))
    rows = lines.select("line_id", "line", "size", F.explode(spec).alias("s")).select("line_id", "line", "size", "s.i", "s.move", (F.col("size") - F.col("s.shorter")).alias("other"))
    # segments of other div k characters; the last ones take the rest
    rows = rows.withColumn("base", F.expr(f"cast(other div {k} as int)"))
    extra = F.col("other") - F.col("base") * k
    rows = rows.withColumn("at", F.col("i") * F.col("base") + F.greatest(F.lit(0), F.col("i") - k + extra) + F.col("move"))
    rows = rows.withColumn("long", F.col("base") + (F.col("i") >= k - extra).cast("int"))
    rows = rows.where((F.col("at") >= 0) & (F.col("at") + F.col("long") <= F.col("size")))
    return rows.select("line_id", "line", F.xxhash64(F.substring("line", F.col("at") + 1, F.col("long")), "other", "i").alias("key"), "other")


def filed(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """The keys of a line's own segments."""
    return _keys(lines, [(0, i, 0) for i in range(edits + 1)], edits)


def probes(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """The keys under which a line of this or a shorter length may be filed: at most i edits before segment i, and at most
    edits - i after it."""
    places = [(n, i, m) for n in range(edits + 1) for i in range(edits + 1) for m in range(max(-i, n - (edits - i)), min(i, n + (edits - i)) + 1)]
    return _keys(lines, places, edits)


def candidates(lines: DataFrame, edits: int = EDITS, most: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """Pairs a < b (line_id) of lines that share a key; every pair within the edits is among them. Pairs may repeat.

    A key under which more than `most` lines are filed pairs none of them in the join. Its filed lines are held in chunks instead, and so
    are its probing ones; each chunk of the one is compared with each of the other inside one row, and only pairs within the edits leave it.
    """
    own = filed(lines, edits).select("line_id", "key")
    hot = cut(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / chunk).alias("parts")), "line-hot")
    n = hot.count()
    small = lambda df: F.broadcast(df) if n <= BROADCAST_LINES else df
    cold = own
    if n:
        cold = cold.join(small(hot.select("key")), "key", "left_anti")
    a, b = F.col("line_id"), F.col("other_id")
    looked = probes(lines, edits).select(F.col("line_id").alias("other_id"), "key")
    # a bounded number of filed lines a key: no sort of the probes
    met = looked.join(cold.hint("shuffle_hash"), "key").where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    if not n:
        return met
    placed = lambda rows: rows.join(small(hot), "key")
    asked = cut(placed(probes(lines, edits).select("line_id", "line", "key")), "line-probes")
    counts = cut(asked.groupBy("key").agg(F.ceil(F.count("*") / chunk).alias("chunks")), "line-asked")
    m = counts.count()
    with_chunks = lambda rows: rows.join(F.broadcast(counts) if m <= BROADCAST_LINES else counts, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")))
    held = lambda rows, chunks, name: rows.groupBy("key", "parts", "chunks", F.pmod(F.xxhash64("line_id"), chunks).alias(name)).agg(F.collect_set(F.struct("line_id", "line")).alias(f"{name}s"))
    # each chunk of filed lines goes to every chunk of probing ones, so that a key is spread over its chunks
    few = held(with_chunks(placed(filed(lines, edits).select("line_id", "line", "key"))), F.col("parts"), "own").select("key", "owns", every(F.col("chunks")).alias("other"))
    many = held(with_chunks(asked), F.col("chunks"), "other").select("key", "others", "other")
    near = F.flatten(
        F.transform("owns", lambda x: F.transform(
            F.filter("others", lambda y: (x["line_id"] != y["line_id"]) & (F.levenshtein(x["line"], y["line"], edits) >= 0)),
            lambda y: F.struct(F.least(x["line_id"], y["line_id"]).alias("a"), F.greatest(x["line_id"], y["line_id"]).alias("b")),
        ))
    )
    within = few.join(many, ["key", "other"]).select(F.explode(near).alias("p")).select("p.a", "p.b")
    return met.union(within)


def bit_parallel_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two strings if at most `edits`, else edits + 1; a must not be longer than b by more than that, nor shorter.

    A band of 2 edits + 1 diagonals around the main one, kept as bits of vertical deltas (plus in p, minus in n), shifted down by one with
    each character of b; the distance is tracked along the lowest diagonal, then along the last row of a.
    """
    width = 2 * edits + 2
    full, top = (1 << width) - 1, 1 << (width - 1)

    def step(acc, c, chars, size):
        j = acc["j"]
        # bit width - 1 - edits + k stands for place j + k of a
        match = F.lit(0)
        for k in range(-edits, edits + 1):
            same = F.coalesce(F.get(chars, j + k) == c, F.lit(False)) & (j + k >= 0) & (j + k < size)
            match = match + F.when(same, F.lit(1 << (width - 1 - edits + k))).otherwise(F.lit(0))
        p, n = acc["p"], acc["n"]
        d0 = ((match.bitwiseAND(p) + p).bitwiseXOR(p)).bitwiseOR(match).bitwiseOR(n).bitwiseAND(full)
        hp = n.bitwiseOR(F.lit(full) - d0.bitwiseOR(p)).bitwiseAND(full)
        hn = d0.bitwiseAND(p)
        down = F.shiftright(d0, 1)
        diagonal = j < size - edits
        mask = F.when(diagonal, F.lit(top)).otherwise(F.call_function("shiftright", F.lit(top), (j - (size - edits) + 1).cast("int")))
        dist = acc["d"] + F.when(diagonal, (d0.bitwiseAND(top) == 0).cast("int")).otherwise(
            (hp.bitwiseAND(mask) != 0).cast("int") - (hn.bitwiseAND(mask) != 0).cast("int")
        )
        return F.struct(
            (j + 1).cast("int").alias("j"), dist.cast("int").alias("d"),
            hn.bitwiseOR(F.lit(full) - down.bitwiseOR(hp)).bitwiseAND(full).cast("int").alias("p"), down.bitwiseAND(hp).cast("int").alias("n"),
        )

    first = F.struct(F.lit(0).alias("j"), F.lit(edits).alias("d"), F.lit((full << (width - 1 - edits)) & full).alias("p"), F.lit(0).alias("n"))

    def run(s):
        return F.aggregate(s["b"], first, lambda acc, c: step(acc, c, s["a"], s["size"]), lambda acc: acc["d"])

    # bound once as a lambda's variable: inside a fold, anything else is worked out anew for each character
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    bound = F.array(F.struct(letters(a).alias("a"), letters(b).alias("b"), F.length(a).alias("size")))
    found = F.get(F.transform(bound, run), F.lit(0))
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, F.lit(edits + 1)).otherwise(F.least(found, F.lit(edits + 1)))


def signs() -> list[Column]:
    """128 bits of a line."""
    return [F.xxhash64("line").alias("sign"), F.xxhash64("line", F.lit(17)).alias("sign2")]


def lines_of(rows: DataFrame, shortest: int) -> DataFrame:
    """rows as numbered() gives them -> file, at, doc_id, place, line (normal, of `shortest` characters or more)."""
    found = rows.select("file", "at", F.col("row.doc_id").alias("doc_id"), F.posexplode(split_lines(F.col("row.text"))).alias("place", "line"))
    return found.withColumn("line", normal(F.col("line"))).where(F.length("line") >= shortest)


def unique_lines(found: DataFrame) -> DataFrame:
    """Each different line: line_id, line, size (characters), copies. A cut table."""
    lines = found.groupBy("line").agg(F.count("*").alias("copies"))
    return cut(lines.select(F.monotonically_increasing_id().alias("line_id"), "line", F.length("line").alias("size"), "copies"), "lines")


def link(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """lines: line_id, line, size -> pairs a < b (line_id) with their distance, 1 to edits. A cut table."""
    pairs = cut(candidates(lines, edits).distinct(), "line-pairs")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("line_id")).distinct(), "line-ids")
    few = ids.count() <= BROADCAST_LINES
    named = cut(lines.select("line_id", "line").join(F.broadcast(ids) if few else ids, "line_id", "left_semi"), "line-texts")
    both = pairs.join(named.select(F.col("line_id").alias("a"), F.col("line").alias("x")), "a").join(named.select(F.col("line_id").alias("b"), F.col("line").alias("y")), "b")
    likely = both.where(F.levenshtein("x", "y", edits) >= 0)
    return cut(likely.withColumn("distance", bit_parallel_distance(F.col("x"), F.col("y"), edits)).where(F.col("distance") <= edits).select("a", "b", "distance"), "line-links")


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, shortest: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with text without its repeated lines, and n_lines, n_dropped, n_links (links of its lines to
    different lines), first_docs (ids of the documents where the first of the dropped lines are, sorted, each once).

    Lines of `least` characters or more are compared with others, those of `shortest` (if not given: least) or more go if they repeat."""
    shortest = least if shortest is None else max(1, shortest)
    rows = numbered(docs)
    found = lines_of(rows, shortest)
    lines = unique_lines(found)
    links = link(lines.where(F.col("size") >= least) if shortest < least else lines, edits)
    joined = components(links.select("a", "b"), "lines").select(F.col("node").alias("line_id"), F.col("component").alias("class"))
    degree = links.select(F.explode(F.array("a", "b")).alias("line_id")).groupBy("line_id").agg(F.count("*").alias("links"))
    # only lines that repeat or link matter from here on
    known = lines.join(joined, "line_id", "left").where("copies > 1 or class is not null").join(degree, "line_id", "left")
    known = cut(known.select(*signs(), F.coalesce("class", "line_id").alias("class"), F.coalesce("links", F.lit(0)).alias("links")), "line-classes")
    marked = cut(found.select("file", "at", "doc_id", "place", *signs()).join(known, ["sign", "sign2"]).drop("sign", "sign2"), "line-places")
    # a table, so that the join with it can split a class that holds many places
    heads = cut(marked.groupBy("class").agg(F.min(F.struct("doc_id", "file", "at", "place")).alias("head")), "line-heads")
    repeat = ~F.struct("file", "at", "place").eqNullSafe(F.struct("head.file", "head.at", "head.place"))
    per = marked.join(heads, "class").groupBy("file", "at").agg(
        F.collect_set(F.when(repeat, F.col("place"))).alias("drop"),
        F.sort_array(F.collect_set(F.when(repeat, F.col("head.doc_id")))).alias("first_docs"),
        F.sum("links").alias("n_links"),
    )
    whole = rows.join(per, ["file", "at"], "left")
    drop = F.coalesce(F.size("drop"), F.lit(0))
    gone = F.map_from_arrays("drop", F.transform("drop", lambda x: F.lit(True)))
    # bound once, so that it is not made anew for each line
    stays = F.flatten(F.transform(F.array(gone), lambda m: F.filter(split_lines(F.col("row.text")), lambda x, i: F.element_at(m, i).isNull())))
    text = F.when(drop > 0, F.array_join(stays, "\n")).otherwise(F.col("row.text"))
    added = ("n_lines", "n_dropped", "n_links", "first_docs")
    return whole.select(
        *(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added),
        F.size(split_lines(F.col("row.text"))).cast("long").alias("n_lines"), F.greatest(F.lit(0), drop).cast("long").alias("n_dropped"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first_docs", F.array().cast("array<long>")).alias("first_docs"),
    )
