"""The stages of the pipeline on the smallest tables."""

import re

import corpus_pipeline
from lanecraft.llm import exact, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        counts.append(after.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if name == "toxicity":
            found = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert counts[-1] == found.where("predicted = 0").count()
        elif name == "exact_dedup":
            assert counts[-1] == exact.exact_groups(docs).where("kept").count()
        elif name == "simhash_near_dedup":
            assert counts[-1] == simhash.near_groups(docs).select("component_id").distinct().count()
        elif name == "source_mixing":
            words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect())
            assert abs(words(after) - words(docs)) < 0.1 * words(docs)
        docs = after
    assert counts[-1] == counts[-2]
    assert docs.where("size(ids) <> n_tokens").count() == 0


def test_run_over_odd_rows(spark, tmp_path, monkeypatch):
    """Null texts, sources and ids, repeated rows, a long text and columns that stages name themselves, from end to end."""
    texts = ["one two three four five", "one two three  four five", "ONE two three four five", "", None, None, "x " * 30_000, "other words are here to stay", "other words are here to stay", "y" * 20_000]
    rows = [(None if k == 3 else k, t, None if k % 2 else "en", None if k % 4 == 1 else f"s{k % 3}", k, "a", "b", k) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, name string, size int"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(str(tmp_path / (kept[-1] if kept else "documents.parquet")))
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        kept.append(name)
        assert spark.read.parquet(str(tmp_path / name)).columns == docs.columns
    # One of each group of equal texts and of near ones is left: both spellings of the first, the empty ones, and so on.
    left = spark.read.parquet(str(tmp_path / "simhash_near_dedup"))
    assert left.count() == 5 and left.where("length(text) > 1000").count() == 2
    found = corpus_pipeline.run(spark, str(tmp_path))
    ids = found.collect()
    mixed = spark.read.parquet(str(tmp_path / "source_mixing")).count()
    assert len(ids) == mixed and all(len(r["ids"]) == r["n_tokens"] for r in ids)


def test_run_over_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
