"""Checkpoints as a log: concurrent writers, compaction, older versions; what of a checkpoint is usable, and what is cut again."""

import threading

import pytest
from pyspark.sql import functions as F

from quire.sources import checkpoints as cp
from quire.sources.epub import TITLE
from quire.sources.files import create_text, list_names, replace_file


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "book string, name string, status string")


def shown(spark, path, version=None):
    return {(r["book"], r["name"]): r["status"] for r in cp.read(spark, path, version).collect()}


def test_empty_folder(spark, tmp_path):
    assert shown(spark, f"{tmp_path}/none") == {} and cp.compact(spark, f"{tmp_path}/none") == 0 and cp.vacuum(spark, f"{tmp_path}/none") == []


def test_later_batches_win_and_compaction_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    assert cp.append(batch(spark, ("b", "1", "pending"), ("b", "2", "pending"), (None, "1", "pending")), path) == 1
    assert cp.append(batch(spark, ("b", "1", "completed"), ("c", "1", "pending")).withColumn("more", F.lit(1)), path) == 2
    want = {("b", "1"): "completed", ("b", "2"): "pending", (None, "1"): "pending", ("c", "1"): "pending"}
    assert shown(spark, path) == want and shown(spark, path, 1)[("b", "1")] == "pending"
    assert cp.compact(spark, path) == 3 and shown(spark, path) == want
    assert cp.append(batch(spark, ("b", "2", "completed")), path) == 4
    assert len(cp.vacuum(spark, path)) == 2 and len(list_names(spark, f"{path}/data")) == 2 and len(list_names(spark, f"{path}/log")) == 2
    assert shown(spark, path) == want | {("b", "2"): "completed"}


def test_a_batch_during_a_compaction_still_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    for s in ("pending", "translated"):
        cp.append(batch(spark, ("b", "1", s)), path)
    publish = cp._publish

    def late(*a):
        monkeypatch.setattr(cp, "_publish", publish)
        cp.append(batch(spark, ("b", "1", "completed")), path)
        return publish(*a)

    monkeypatch.setattr(cp, "_publish", late)
    assert cp.compact(spark, path) == 4 and shown(spark, path) == {("b", "1"): "completed"}


def test_of_two_compactions_one_gives_way(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    for s in ("pending", "translated"):
        cp.append(batch(spark, ("b", "1", s)), path)
    publish = cp._publish

    def late(*a):
        monkeypatch.setattr(cp, "_publish", publish)
        cp.compact(spark, path)
        return publish(*a)

    monkeypatch.setattr(cp, "_publish", late)
    with pytest.raises(cp.Conflict):
        cp.compact(spark, path)
    assert shown(spark, path) == {("b", "1"): "translated"}


def test_many_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path)
    tasks = [threading.Thread(target=lambda i=i: cp.append(batch(spark, ("b", str(i), "completed")), path)) for i in range(8)]
    for t in tasks:
        t.start()
    for t in tasks:
        t.join()
    assert shown(spark, path) == {("b", str(i)): "completed" for i in range(8)} and cp.snapshot(spark, path).version == 8


def test_unpublished_data_and_other_schemas(spark, tmp_path):
    path = str(tmp_path)
    cp.append(batch(spark, ("b", "1", "completed")), path)
    batch(spark, ("b", "2", "completed")).write.parquet(f"{path}/data/{'0' * 32}")
    assert shown(spark, path) == {("b", "1"): "completed"}
    with pytest.raises(FileExistsError):
        create_text(spark, f"{path}/log/{1:0{cp.DIGITS}d}.json", "{}")
    replace_file(spark, f"{path}/log/{2:0{cp.DIGITS}d}.json", '{"batch": "x", "checkpoint_schema_version": 1}')
    with pytest.raises(ValueError, match="version 1"):
        cp.read(spark, path)


def test_what_is_usable(spark):
    one, none = ["<pre/>"], None
    items = "book string, id string, preserved_pre array<string>, preserved_code array<string>, preserved_style array<string>"
    stored = spark.createDataFrame([("same", "i", one, none, []), ("same", "nav", none, none, none), ("same", "t", none, none, none), ("changed", "i", one, none, none), ("changed", "j", none, none, none), ("gone", "i", none, none, none)], items)
    now = spark.createDataFrame(
        [("same", "i", one, [], none, False, True), ("same", "nav", none, none, none, True, None), ("same", "t", none, none, none, None, True), ("changed", "i", one * 2, none, none, False, True), ("changed", "j", none, none, none, False, True), ("new", "i", one, none, none, False, True)],
        items + ", is_nav boolean, meaningful boolean",
    )
    rows = [("same", "i", "a", "x", "completed", "html_fragment", ["/html/body/p"], 0), ("same", "nav", "n", None, "pending", "nav_text", [], 25), ("same", "t", "title", "书", "completed", "html_fragment", [TITLE], 0)]
    rows += [("changed", "j", "b", "x", "completed", "html_fragment", ["/p"], 0), ("gone", "i", "g", "x", "completed", "html_fragment", ["/p"], 0)]
    chunks = spark.createDataFrame(rows, "book string, id string, name string, translated string, status string, chunk_mode string, xpaths array<string>, n_targets int").withColumn("original", F.lit("o"))
    got = cp.resume(stored, chunks, now)
    assert [r["name"] for r in got.chunks.collect()] == ["a"] and [r["book"] for r in got.unusable.collect()] == ["changed"]
    again = {(r["book"], r["id"]): [c["name"] for c in r["kept"] or []] for r in got.again.collect()}
    assert again == {("same", "nav"): [], ("same", "t"): ["title"], ("changed", "i"): [], ("changed", "j"): [], ("new", "i"): []}
    cut = spark.createDataFrame([("same", "nav", "n0", []), ("same", "t", "t0", [TITLE]), ("same", "t", "t1", ["/html/body/p"]), ("changed", "j", "j0", [TITLE]), ("same", "i", "other", ["/x"])], "book string, id string, name string, xpaths array<string>")
    whole = {(r["book"], r["id"], r["name"]): r["status"] for r in cp.rechunked(got, cut).collect()}
    assert whole == {("same", "i", "a"): "completed", ("same", "nav", "n0"): "pending", ("same", "t", "title"): "completed", ("same", "t", "t1"): "pending", ("changed", "j", "j0"): "pending"}
