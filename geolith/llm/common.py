"""What the training-data operators share: text rules, cut tables, components."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` over lower-cased text, as bytes.
ALNUM_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


#: Anything but ASCII and kinds of characters that have no lower case.
CASED = r"[\x{80}-\x{10FFFF}&&[^\p{Ll}\p{Lm}\p{Lo}\p{M}\p{P}\p{Z}\p{Sc}\p{Sk}\p{Sm}\p{Nd}]]"


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty.

    `lower` does so in a text whose other characters have no lower case, and is many times as fast as `translate`.
    """
    text = F.coalesce(col, F.lit(""))
    plain = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(CASED))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def numbered(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns, so that none can clash with another), file and at: a number for each row, the same
    whenever the rows are read.

    Rows of files are numbered by file and place. Any other frame is written first.
    """
    if "_metadata" not in docs.columns:
        try:
            return docs.select(F.struct("*").alias("row"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        except AnalysisException:
            pass
    whole = cut(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "rows")
    return whole.select("row", F.lit(0).cast("long").alias("file"), "at")


def bucket(col: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null ids fall in the bucket of the empty string."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; a temporary one only where all runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='geolith-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/geolith/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, **values: str):
    """Session settings (dots as double underscores) for the block, then as they were."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends at a table that outlives any
    executor, and the shuffle files that made it go as soon as it is written."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    with setting(spark, **{CLEANUP.replace(".", "__"): "true", "spark__sql__parquet__compression__codec": "zstd"}):
        # a frame takes its clean-up mode when it is made
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of cut tables that nothing reads any more."""
    jvm = spark._jvm
    for df in frames:
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, label: str = "cc", rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b (long, any direction; loops and repeats are harmless). Returns node, component (the
    least node reachable) for every node of an edge between two different nodes. Each step only takes minima and joins
    them back, so no neighbour list is ever gathered; a hub's join is split by adaptive execution. The table is cut
    after each round. No edges: no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = cut(e, label)
    seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("x")
        )
        new = cut(small.select("x.u", "x.v").where("u > v").distinct(), label)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_tables(spark, e)
        e, done = new, tuple(now) == tuple(seen)
        seen = now
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    children = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return children.union(roots)


def slices(batches, rows: int = 256):
    """Arrow batches in smaller pieces, so that what is built from texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def rest_of(batch, added: dict):
    """The batch without the named columns, and then those."""
    import pyarrow as pa

    keep = [i for i, n in enumerate(batch.schema.names) if n not in added]
    names = [batch.schema.names[i] for i in keep]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *added.values()], names=[*names, *added])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int):
    """At most `bound` labelled documents to learn from, as pandas (text, y): those least by a hash of doc_id, without
    the held-out bucket. Whole texts; an id that repeats counts once, with its greatest text and label."""
    picked = labels.where(F.col(label).isNotNull() & (bucket(F.col("doc_id"), modulus) != held)).groupBy("doc_id").agg(F.max(label).alias("y"))
    # labels of documents that are not there must not take up the bound
    there = docs.select("doc_id").join(picked, "doc_id", "left_semi").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    few = cut(picked.join(there, "doc_id"), "sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    with setting(docs.sparkSession, spark__sql__execution__arrow__pyspark__enabled="true"):
        found = rows.select("doc_id", "text", F.col("y").cast("int").alias("y")).toPandas()
    return found.sort_values("doc_id")[["text", "y"]].reset_index(drop=True)
