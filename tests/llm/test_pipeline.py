"""The pipeline stage by stage, on documents with known fates."""

import corpus_pipeline
from textloom.llm import stages

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "secret_scan", "mix_sources", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_one_of_each_group(spark, sf):
    words = [f"w{i}" for i in range(60)]
    near = words[:30] + ["other"] + words[31:]
    texts = [(4, " ".join(words)), (2, " ".join(near)), (9, " ".join(words)), (5, "alone here"), (6, None), (7, "")]
    texts += [(5, "alone here"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows_of(texts), COLUMNS)
    kept = stages.keep_one_of_each_group(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["2", "5", "6", "7", "None", "None"]


def test_whole_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = stages.materialize(stage(spark, docs, sf), name)
        seen[name] = (docs, path)
        if name != "bpe":
            assert path.columns == docs.columns
        docs = path
    before, after = seen["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in before.join(after, "doc_id", "left_anti").collect()}
    assert sum(labels.get(i) == 0 for i in gone) <= 0.1 * len(gone)
    before, after = seen["secret_scan"]
    assert before.count() == after.count()
    assert after.filter(r"text rlike '[0-9a-f]{24}'").count() == 0
    before, after = seen["mix_sources"]
    assert set(r["doc_id"] for r in after.collect()) <= set(r["doc_id"] for r in before.collect())
    assert seen["bpe"][1].count() == after.count()
    assert "text" not in seen["bpe"][1].columns


def test_stages_keep_clashing_columns_and_empty_tables(spark, sf):
    extra = "_score double, _id long, _spans string, _size long, _row long, _copies long, `column 3` string"
    rows = [(*r, 0.5, 7, "s", 3, 9, 2, "c") for r in rows_of([(i, t, ) for i, t in enumerate(
        ["plain words here", None, "", "user: alice Zm9vYmFyYmF6cXV4MTIzNDU2", "word " * 30_000]
    )])]
    docs = spark.createDataFrame(rows, f"{COLUMNS}, {extra}")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.collect() == []
        out = stage(spark, docs, sf)
        found = out.collect()
        assert found and {tuple(r[c] for c in docs.columns[5:]) for r in found} == {(0.5, 7, "s", 3, 9, 2, "c")}
        if name != "bpe":
            assert out.columns == docs.columns
