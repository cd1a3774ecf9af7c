import corpus_pipeline
from geolith.llm import decontaminate

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
OTHER = "red orange yellow green blue indigo violet black white grey pink brown"


def test_a_whole_item_is_rejected(spark, tmp_path):
    items = [(1, ITEM), (2, OTHER), (3, "yes no")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = ITEM.split()
    rows = [
        (1, f"before {ITEM} after"),
        (2, "before " + " ".join(words[:8]) + " after"),
        (3, "before " + " ".join(words[:10]) + " after"),
        (4, "nothing of it here, but yes no"),
        (5, " ".join(words[:8]) + " and " + " ".join(OTHER.split()[:8])),
        (6, None),
        # the same window over and over is no more of the item
        (7, " ".join(words[:8] + ["x"] + words[:8] + ["x"] + words[:8])),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.reject_contaminated(spark, docs, str(tmp_path)).collect()}
    assert kept == {2, 4, 6, 7}
    # in blocks of the benchmark as well
    small = decontaminate.find_overlaps(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=150)
    got = {r.doc_id: (round(r.extent, 3), r.n) for r in small.selectExpr("doc_id", "extent", "size(items) as n").collect()}
    assert got == {1: (1.0, 1), 2: (0.4, 1), 3: (0.5, 1), 4: (0.0, 1), 5: (0.667, 2), 6: (0.0, 0), 7: (0.4, 1)}
