"""Exact deduplication as a stateful stream.

The stream keeps, on disk (RocksDB) and without expiry, one entry per digest of the normalised text: the largest
identifier seen, how many rows, and where that row lies. Each micro-batch appends the entries it changed to a table; the
last per digest is the state. Entries are combined before they are shuffled, so a text with a third of all rows is
a handful of partial sums.

Hits (digests seen twice or more) are then checked by full bytes: rows of hit digests are grouped by digest and text. If
one digest ever stands for two texts, its rows are told apart by text.

Defined results: null text is empty text; texts are equal when identical after lower-casing A-Z; the largest id stays;
rows that repeat id and text share one decision, as nothing tells them apart; a null id stays only where its whole
group has none. An empty table: no rows. Extra columns are ignored. A restart with the same `state_dir` reads new files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, setting, shared_path

#: Hit digests up to this many are sent to every executor (32 bytes each, 64 MB at most); beyond it they are joined by shuffle.
BROADCAST_HITS = 500_000


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("norm", lower_ascii(F.col("text"))).withColumn("digest", F.unhex(F.sha2("norm", 256)))


def update_state(spark: SparkSession, path: str, state_dir: str) -> DataFrame:
    """Read what is new under `path` into the state; returns digest, keep_id, n, locator."""
    schema = spark.read.parquet(path).schema
    table = f"{state_dir}/changed"

    def append(batch: DataFrame, number: int) -> None:
        # by batch number, so that a batch that runs again replaces what it wrote
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/at={number}")

    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    with setting(spark, spark__sql__streaming__stateStore__providerClass=rocks, spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false"):  # each store would claim megabytes ahead
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", "4096").parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, as a stream takes one file by pattern only
        where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        state = (
            _keyed(rows.select("doc_id", "text", where.alias("locator")))
            .groupBy("digest")
            .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("last"))
            .select("digest", "keep_id", "n", F.col("last.locator").alias("locator"))
        )
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).foreachBatch(append).start()
        query.awaitTermination()
    shape = state.withColumn("batch", F.lit(0)).schema
    # counts only grow, so the largest entry of a digest is its last
    changed = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(table) if _there(spark, table) else spark.createDataFrame([], shape)
    return changed.groupBy("digest").agg(F.max(F.struct("n", "keep_id", "locator")).alias("x")).select("digest", "x.keep_id", "x.n", "x.locator")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def exact_dedup(spark: SparkSession, path: str, state_dir: str | None = None) -> DataFrame:
    """One row per row under `path`: doc_id, keep_id, group_size, kept, text_sha256, locator (of the row that stays)."""
    state = cut(update_state(spark, path, state_dir or shared_path(spark, "exact-state")), "exact-digests")
    rows = _keyed(spark.read.parquet(path).select("doc_id", "text"))
    hits = state.where("n > 1").select("digest")
    few = hits.count() <= BROADCAST_HITS
    checked = rows.join(F.broadcast(hits) if few else hits, "digest", "left_semi").groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    clash = checked.groupBy("digest").count().where("count > 1").select("digest")
    clash = cut(clash, "exact-clash")
    result = rows.select("doc_id", "digest").join(state, "digest")
    if clash.head(1):
        told = checked.join(clash, "digest", "left_semi").withColumn("locator", F.lit(None).cast(state.schema["locator"].dataType))
        apart = rows.join(clash, "digest", "left_semi").join(told, ["digest", "norm"]).select("digest", "doc_id", "keep_id", "n", "locator")
        result = result.join(clash, "digest", "left_anti").unionByName(apart)
    return result.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "locator",
    )
