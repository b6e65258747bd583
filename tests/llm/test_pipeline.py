"""The stages before packing on a few rows: which documents each keeps."""

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
WORDS = " ".join(f"w{i}" for i in range(300))
ROWS = [
    (1, WORDS, "en", "a", 1, "s"), (2, WORDS, "en", "a", 1, "s"), (3, WORDS.replace("w150 ", "x "), "en", "b", 1, "s"), (4, None, None, None, None, None), (5, "", "en", "a", 0, "s"),
    (None, "alone in the world", "en", None, 1, "s"), (7, "one two", "de", "b", 1, "s"), (8, "one two", "de", "b", 1, "s"),
]


def test_documents_kept_from_stage_to_stage(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame(ROWS, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    # a null text is the empty text, so 5 stays for 4
    want = {"toxicity": {1, 2, 3, 4, 5, None, 7, 8}, "exact dedup": {2, 3, 5, None, 8}, "n-gram Jaccard join": {2, 5, None, 8}, "mixing": {2, 5, None, 8}}
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, at).collect()
        assert {r.doc_id for r in rows} == want[name], name
        assert len(rows) == len(want[name]) or name == "mixing" and len(rows) <= 2 * len(want[name])
        docs = spark.createDataFrame(rows, DOCS)
