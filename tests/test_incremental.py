import os

import pytest
from pyspark.sql import functions as F

from textloom.functions.vocabulary import BpeModel
from textloom.plans import incremental

OTHER = BpeModel([(7, 8, 263, 2)])


@pytest.fixture
def place(spark, tmp_path):
    rows = [(i, f"row {i} " + "é x" * (i % 40)) for i in range(300)]
    frame = spark.createDataFrame(rows, "row long, text string")
    root, out = str(tmp_path / "raw"), str(tmp_path / "out")
    frame.filter("row < 100").coalesce(1).write.parquet(root + "/a")
    frame.filter("row between 100 and 199").coalesce(1).write.parquet(root + "/b with space")
    return frame, root, out


def tokens_of(rows):
    return sum(len(r.text.encode()) + 2 for r in rows if len(r.text.strip()) >= 64)


def held(spark, out, version=None):
    total = incremental.live_manifest(spark, out, version).filter("level = 'all'").first().tokens
    stored = incremental.live_tokens(spark, out, version).agg(F.sum(F.octet_length("tokens"))).first()[0]
    assert stored == 2 * total
    return total


def run(spark, place, model=BpeModel(), **options):
    _, root, out = place
    return incremental.prepare_incremental(spark, root, model, out, 0.09, **options)


def test_new_unchanged_changed_and_gone(spark, place):
    frame, root, out = place
    first = run(spark, place)
    rows = frame.collect()
    assert first.version == 1 and held(spark, out) == tokens_of(rows[:200])
    assert run(spark, place).version == 1
    audit = incremental.audit_snapshot(spark, out, BpeModel().sha256()).collect()
    assert {(r.manifest, r.passed) for r in audit} == {("train", True), ("validation", True)}
    assert {r.reason for r in incremental.audit_snapshot(spark, out, "other").collect()} == {"tokenizer"}
    frame.filter("row < 50").coalesce(1).write.mode("overwrite").parquet(root + "/a")
    frame.filter("row >= 200").coalesce(1).write.parquet(root + "/c")
    second = run(spark, place)
    assert second.version == 2 and second.builds.count() == 3
    assert held(spark, out) == tokens_of(rows[:50] + rows[100:])
    # The version before is still what it was.
    assert held(spark, out, 1) == tokens_of(rows[:200])
    parts = {"a": rows[:50], "b with space": rows[100:200], "c": rows[200:]}
    for r in second.builds.collect():
        own = parts[r.source.split("/")[-2].replace("%20", " ")]
        usable = sum(len(x.text.strip()) >= 64 for x in own)
        assert (r.documents, r.skipped_documents) == (usable, len(own) - usable)
    third = run(spark, place, OTHER, files_per_run=1)
    assert third.version > 2 and third.builds.select("tokenizer_sha256").distinct().count() == 1
    spark.range(3).write.parquet(root + "/no text")
    with pytest.raises(ValueError, match="no text column"):
        run(spark, place)
    assert incremental.snapshot(spark, out).version == third.version


def test_compaction_and_vacuum(spark, place):
    frame, root, out = place
    run(spark, place)
    frame.filter("row < 50").coalesce(1).write.mode("overwrite").parquet(root + "/a")
    run(spark, place)
    before, version = held(spark, out), incremental.snapshot(spark, out).version
    rows = lambda: sorted(map(tuple, incremental.live_tokens(spark, out).drop("run").collect()))
    kept = rows()
    done = incremental.compact(spark, out)
    assert done.version == version + 1 and held(spark, out) == before and rows() == kept
    assert incremental.compact(spark, out).version == done.version
    assert incremental.audit_snapshot(spark, out, BpeModel().sha256()).filter("not passed").count() == 0
    assert len(incremental.vacuum(spark, out, keep=1)) == 1
    assert rows() == kept and run(spark, place).version == done.version
    assert incremental.vacuum(spark, out, keep=1) == []


def test_broken_runs_and_races(spark, place, monkeypatch):
    frame, _, out = place
    commit = incremental._commit

    def broken(*args):
        raise RuntimeError("died before the commit")

    monkeypatch.setattr(incremental, "_commit", broken)
    with pytest.raises(RuntimeError, match="died"):
        run(spark, place)
    assert incremental.snapshot(spark, out) is None
    monkeypatch.setattr(incremental, "_commit", commit)
    now = run(spark, place)
    assert held(spark, out) == tokens_of(frame.filter("row < 200").collect())
    assert len(incremental.vacuum(spark, out)) == 1
    # Two jobs that both start from the same snapshot: one of them becomes the next version.
    one = commit(spark, out, now.builds, now)
    with pytest.raises(incremental.LostRace):
        commit(spark, out, now.builds, now)
    assert incremental.snapshot(spark, out).name == one.name
    assert run(spark, place).version == one.version


def test_lost_tokens_are_built_again(spark, place):
    _, _, out = place
    now = run(spark, place)
    whole = held(spark, out)
    for path in incremental._tokens(spark, out).filter("split = 'train'").inputFiles()[:1]:
        os.remove(path.removeprefix("file://").replace("%20", " "))
    again = run(spark, place)
    assert again.version == now.version + 1 and held(spark, out) == whole


def test_files_that_are_gone_leave_the_snapshot(spark, place):
    frame, root, out = place
    run(spark, place)
    for name in os.listdir(root + "/a"):
        os.remove(f"{root}/a/{name}")
    now = run(spark, place)
    assert now.version == 2 and now.builds.count() == 1
    assert held(spark, out) == tokens_of(frame.filter("row between 100 and 199").collect())
