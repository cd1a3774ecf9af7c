import random

from pyspark.sql import functions as F

from geolith.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def family(rng, n, changes, base=None):
    base = base or "".join(rng.choice("abcdefgh ") for _ in range(60)).strip() + "zz"
    out = set()
    while len(out) < n:
        line = list(base)
        for _ in range(rng.randint(0, changes)):
            k, how = rng.randrange(1, len(line) - 1), rng.random()
            if how < 0.4:
                line[k] = rng.choice("xyzwé")
            elif how < 0.7:
                del line[k]
            else:
                line.insert(k, rng.choice("xyzw"))
        out.add("".join(line))
    return sorted(out)


def expected(rows, edits=2, least=20, shortest=20):
    """Brute force: kept text, dropped lines, links and head documents for each row, rows in the order of the table."""
    by_id = lambda k: (rows[k][0] is not None, rows[k][0] or 0, k)
    lines = [(*by_id(k), p, x.lower().strip(" ")) for k in range(len(rows)) for p, x in enumerate((rows[k][1] or "").split("\n"))]
    names = sorted({x for *_, x in lines if len(x) >= least})
    root = {x[-1]: x[-1] for x in lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = dict.fromkeys(names, 0)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                degree[a] += 1
                degree[b] += 1
                root[top(a)] = top(b)
    first = {}
    for *_, k, p, x in sorted(lines):
        if len(x) >= shortest:
            first.setdefault(top(x), (k, p))
    out = []
    for k, (_, t) in enumerate(rows):
        own = (t or "").split("\n")
        low = [x.lower().strip(" ") for x in own]
        gone = [p for p, x in enumerate(low) if len(x) >= shortest and first[top(x)] != (k, p)]
        stay = [x for p, x in enumerate(own) if p not in gone]
        heads = sorted({rows[first[top(low[p])][0]][0] for p in gone} - {None})
        out.append(("\n".join(stay), len(own), len(own) - len(stay), sum(degree.get(x, 0) for x in low), heads))
    return out


def check(spark, rows, **how):
    # one partition, so that rows are numbered in this order; columns that clash with results and with what goes on inside
    docs = spark.createDataFrame([(*r, k, "clash") for k, r in enumerate(rows)], "doc_id long, text string, at long, file string").coalesce(1)
    docs = docs.withColumns({c: F.lit("clash") for c in ("n_lines", "row", "line", "place", "_drop", "class")})
    got = {r["at"]: (r.text or "", r.n_lines, r.n_dropped, r.n_links, r.first_docs) for r in line_dedup.dedup_lines(docs, **how).collect()}
    assert [got[k] for k in range(len(rows))] == expected(rows, **how)


def test_against_brute_force(spark):
    rng = random.Random(5)
    lines = family(rng, 60, 3) + family(rng, 40, 2) + ["short", "", "A line OF its own, all alone here", "  a line of its own, all alone here  "]
    rng.shuffle(lines)
    rows = [(k, "\n".join(rng.choices(lines, k=rng.randint(1, 6)))) for k in range(60)]
    check(spark, [*rows, (900, None), (901, ""), (902, "x" * 70000)])


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c = "the same line in several documents", "one more unique line that nobody else has", "a third line, found in just one place"
    rows = [(8, f"{a}\n{c}"), (8, f"{b}\nshort"), (7, a), (7, a), (None, f"{a}\nshort"), (None, f"{b}x\n{a}"), (9, "short\n\nShort")]
    check(spark, rows, shortest=1)
    check(spark, rows)


def test_rows_of_files(spark, tmp_path):
    """Numbered by file and place, without a copy of the table."""
    rows = [(k % 3, f"line {k % 4} of a table that lies in files\nonly here {k}") for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    got = line_dedup.dedup_lines(docs, edits=0).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in rows)
    # the doc_id that comes first keeps each of the four lines; no line of its own goes
    assert sum(r.n_dropped for r in got) == 8 and all("only here" in r.text for r in got)
    assert all(r.doc_id == 0 or r.n_dropped for r in got if r.doc_id == 2)


def test_hot_segments_lose_no_link(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(90)) + "end"
    lines = family(rng, 150, 6, base)
    x = spark.createDataFrame([(k, line, len(line)) for k, line in enumerate(lines)], "line_id long, line string, size int")
    want = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if abs(len(lines[a]) - len(lines[b])) <= 2 and distance(lines[a], lines[b]) <= 2}
    every = {(r.a, r.b) for r in line_dedup.candidates(x, most=10**6).collect()}
    split = {(r.a, r.b) for r in line_dedup.candidates(x, most=8, chunk=10).collect()}
    assert want and want <= split <= every and len(split) < len(every)


def test_no_rows(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_side_of_a_hot_segment_may_be_large(spark):
    """Few lines filed, many that look them up: still in chunks, still every link."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(59)).strip() + "qq"
    lines = family(rng, 30, 1, base) + family(rng, 200, 2, base + "x")
    x = spark.createDataFrame([(k, line, len(line)) for k, line in enumerate(lines)], "line_id long, line string, size int")
    want = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if lines[a] != lines[b] and abs(len(lines[a]) - len(lines[b])) <= 2 and distance(lines[a], lines[b]) <= 2}
    got = {(r.a, r.b) for r in line_dedup.candidates(x, most=8, chunk=10).collect()}
    assert want <= got


def test_lower_case_is_of_ascii_alone(spark):
    from geolith.llm.common import lower_ascii

    every = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    rows = [f"A{x}B" for x in every] + ["ABC é ß Z", "ÀÉ Z", "ΑΣ Σ", None, ""]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string").withColumn("y", lower_ascii(F.col("x")))
    table = {c: c + 32 for c in range(65, 91)}
    assert all(r.y == (r.x or "").translate(table) for r in df.collect())


def test_bit_parallel_distance(spark):
    rng = random.Random(7)
    words = family(rng, 40, 4, "the quick brown fox jumps over")
    pairs = [(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 2]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.d for r in df.withColumn("d", line_dedup.bit_parallel_distance(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b): min(3, distance(a, b)) for a, b in pairs}
