import corpus_pipeline
from geolith.llm import queries


def test_short_lines_that_repeat_go(spark, tmp_path):
    rows = [(1, "les.\n\nand ornd."), (2, "les.\nless\n\n LES. "), (3, "x\nx\nand ornd.")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, str(tmp_path)).collect()}
    assert found == {1: "les.\n\nand ornd.", 2: "less\n", 3: "x"}
    got = {r.doc_id: (r.n_dropped, r.n_links, r.first_docs) for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 0, []), 2: (2, 0, [1]), 3: (2, 0, [1, 3])}
