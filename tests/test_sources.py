import gzip
import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import corpus, preference, sinks


@pytest.fixture
def tree(spark, tmp_path):
    write = lambda df, p: df.coalesce(1).write.parquet(str(tmp_path / p))
    write(spark.createDataFrame([(f"a{i}", i) for i in range(5)], "text string, n long"), "x/a")
    write(spark.createDataFrame([("b0",), (None,)], "text string"), "x/deep/b")
    write(spark.createDataFrame([("c",)], "text string"), ".cache/c")
    (tmp_path / "x" / "notes.txt").write_text("no")
    return tmp_path


def test_scan_is_recursive_and_skips_hidden_folders(spark, tree):
    rows = corpus.corpus_scan(spark, str(tree)).collect()
    assert {(r.text, r.row_index) for r in rows} == {(f"a{i}", i) for i in range(5)} | {("b0", 0), (None, 1)}
    assert len({r.shard for r in rows}) == 2


def test_scan_reads_only_what_is_asked(spark, tree):
    plan = corpus.corpus_scan(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,_tmp_metadata_row_index:bigint>" in plan


def test_nothing_found(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        corpus.corpus_scan(spark, str(tmp_path))


def test_files_without_text(spark, tree):
    spark.range(3).write.parquet(str(tree / "x" / "ids"))
    names = {tuple(sorted(r.columns)) for r in corpus.file_columns(corpus.file_listing(spark, str(tree))).collect()}
    assert names == {("n", "text"), ("text",), ("id",)}
    with pytest.raises(ValueError, match="no text column"):
        corpus.corpus_scan(spark, str(tree), on_missing="error")
    skipped = corpus.corpus_scan(spark, str(tree), on_missing="skip")
    assert skipped.count() == 6


def test_listing(spark, tree):
    listing = corpus.listing_manifest(corpus.file_listing(spark, str(tree)))
    rows = listing.collect()
    assert {r.compressed_bytes for r in rows} == {sum(r.bytes for r in rows)}
    plan = corpus.file_listing(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def route(spark, names, **options):
    df = spark.createDataFrame([(f"/data/train/{n}",) for n in names], "path string")
    return {(corpus_name(r.path), r.split) for r in corpus.split_by_filename(df, **options).collect()}


def corpus_name(path):
    return path.rsplit("/", 1)[1]


def test_routing_by_file_name(spark):
    names = ["Train-0.parquet", "TEST-0.parquet", "eval.parquet", "train-test.parquet", "other.parquet"]
    both = {
        ("Train-0.parquet", "train"),
        ("TEST-0.parquet", "validation"),
        ("eval.parquet", "validation"),
        ("train-test.parquet", "train"),
        ("train-test.parquet", "validation"),
    }
    assert route(spark, names) == both
    assert route(spark, names, disjoint=True) == both - {("train-test.parquet", "train")}
    assert route(spark, ["a", "test"]) == {("a", "train"), ("test", "train"), ("test", "validation")}


@pytest.mark.parametrize(
    "files,wanted",
    [
        ({"a/preference-1.jsonl": 2, "a/preference-0.jsonl": 2, "b/x.jsonl": 2}, "a/preference-0.jsonl"),
        ({".cache-x/preference.jsonl": 3, "d/preferences.jsonl": 1}, "d/preferences.jsonl"),
        ({"preference.jsonl": 0, "my-preferences/rows.jsonl": 2}, "my-preferences/rows.jsonl"),
        ({"preference.jsonl": 0, "other/rows.jsonl": 2}, None),
        ({"notes.txt": 1, "q/preference_set.jsonl.gz": 2}, "q/preference_set.jsonl.gz"),
    ],
)
def test_choice_of_scored_file(spark, tmp_path, files, wanted):
    for name, lines in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        data = b'{"prompt": "p"}\n' * lines
        path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    if wanted is None:
        with pytest.raises(FileNotFoundError):
            preference.preference_file(spark, str(tmp_path))
    else:
        assert preference.preference_file(spark, str(tmp_path)).endswith("/" + wanted)


def test_gzip_is_spread_after_reading(spark, tmp_path):
    path = tmp_path / "preference.jsonl.gz"
    rows = [{"prompt": f"p{i}", "response_1": "a", "response_2": "b", "preference_strength": 1} for i in range(20)]
    path.write_bytes(gzip.compress("\n".join(map(json.dumps, rows)).encode()))
    frame = preference.preference_scan(spark, str(path), 4)
    assert frame.count() == 20 and frame.rdd.getNumPartitions() == 4
    assert frame.filter(F.col("split").isNull()).count() == 20


def scan_lines(spark, tmp_path, *lines):
    path = tmp_path / "preference.jsonl"
    path.write_text("\n".join(lines))
    return str(path)


def test_strengths_in_any_spelling(spark, tmp_path):
    path = scan_lines(spark, tmp_path, *[f'{{"preference_strength": {v}}}' for v in ("2", "2.0", '"2"', '"-1"', "-3.0")])
    got = [r["preference_strength"] for r in preference.preference_scan(spark, path).collect()]
    assert sorted(got) == [-3, -1, 2, 2, 2]


@pytest.mark.parametrize("bad", ['{"preference_strength": 2.5}', '{"preference_strength": "x"}', '{"prompt": "p"}', "{oops"])
def test_bad_records_fail_instead_of_vanishing(spark, tmp_path, bad):
    path = scan_lines(spark, tmp_path, '{"preference_strength": 1}', bad)
    with pytest.raises(Exception):
        preference.preference_scan(spark, path).collect()


def test_fields_of_all_records_count(spark, tmp_path):
    path = scan_lines(spark, tmp_path, '{"prompt": "p"}', '{"prompt": "p", "preference_strength": 1}')
    preference.require_fields(spark, path, ["prompt", "preference_strength"])
    with pytest.raises(ValueError, match="split"):
        preference.require_fields(spark, path, ["prompt", "split"])


def test_every_footer_is_checked(spark, tmp_path):
    spark.range(2).selectExpr("'a' AS messages").coalesce(1).write.parquet(str(tmp_path / "a"))
    corpus.require_stored(spark, str(tmp_path), ["messages"])
    spark.range(2).selectExpr("'a' AS other").coalesce(1).write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="messages"):
        corpus.require_stored(spark, str(tmp_path), ["messages"])


def test_hidden_file_names_are_refused(spark, tree):
    corpus.file_listing(spark, str(tree))
    (tree / "x" / "deep" / "_late.parquet").write_bytes(b"")
    with pytest.raises(ValueError, match="underscore"):
        corpus.file_listing(spark, str(tree))


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from textloom import session

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_preference_file_order_and_fallback(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        preference.preference_file(spark, str(tmp_path))
    (tmp_path / "my-preference").mkdir()
    (tmp_path / "my-preference" / "data.jsonl").write_text("{}")
    (tmp_path / "zz.jsonl").write_text("{}")
    assert preference.preference_file(spark, str(tmp_path)).endswith("my-preference/data.jsonl")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "preference-a.jsonl").write_text("{}")
    (tmp_path / "z" / "preference-0.jsonl").touch()
    assert preference.preference_file(spark, str(tmp_path)).endswith("z/preference-a.jsonl")


def test_normalized_sink_merges_columns(spark, tmp_path):
    one = spark.createDataFrame([(1, "train"), (2, "validation")], "a int, split string")
    two = spark.createDataFrame([("x", "train")], "b string, split string")
    for _ in range(2):  # a second run replaces the first
        sinks.normalized_sink({"one": one, "two": two}, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.collection, r.split, r.a, r.b) for r in rows} == {
        ("one", "train", 1, None),
        ("one", "validation", 2, None),
        ("two", "train", None, "x"),
    }


def test_spread(spark):
    assert corpus.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 2
    wide = spark.range(10).repartition(64)
    assert corpus.spread(wide) is wide


def test_published_collections_are_versions(spark, tmp_path):
    path = str(tmp_path / "collections")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, path)
    one = spark.createDataFrame([(1, "train", "x"), (2, "validation", "y")], "id int, split string, a string")
    two = spark.createDataFrame([(3, "train")], "id int, split string")
    first = sinks.publish_collections({"one": one, "two": two}, path, {"seed": 4, "rows": None})
    rows = lambda **at: sorted((r.collection, r.split, r.id) for r in sinks.published(spark, path, **at).collect())
    want = [("one", "train", 1), ("one", "validation", 2), ("two", "train", 3)]
    assert rows() == want
    entry = sinks.manifest_rows(spark, path).first()
    assert json.loads(entry.details) == {"seed": 4, "rows": None}
    assert [tuple(c) for c in entry.counts] == [("one", "train", 1), ("one", "validation", 1), ("two", "train", 1)]
    # A run that breaks off while writing leaves the version before it.
    broken = two.withColumn("id", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish_collections({"two": broken}, path, {})
    assert rows() == want
    second = sinks.publish_collections({"two": two}, path, {"seed": 5})
    assert rows() == want[2:] and rows(version=first) == want and second > first


def test_scan_of_a_table_that_is_a_folder(spark, tmp_path):
    from textloom.registry.queries import QUERIES

    for part, texts in (("a", ["one", "two"]), ("b", ["three", None])):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
        rows.write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["corpus_scan"](spark, str(tmp_path)).collect()
    assert {r.chars for r in found} == {3, 5, None} and len(found) == 4
    assert len({(r.file, r.row_index) for r in found}) == 4
    assert all(r.file.startswith("documents.parquet/part-") for r in found)
