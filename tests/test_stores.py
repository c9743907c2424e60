"""Tables that are merged when read: histories against a dict, what a change writes, crashes, compaction; stores on top of them."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fathomline.schema import CANDIDATE
from fathomline.sources.deltas import KeyedTable
from fathomline.sources.folders import Folder, JsonFile
from fathomline.sources.stores import ModelRegistry, SeedStore, SeenUrls


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sizes(path):
    """Rows of each part on disk."""
    return {p.name: p for p in Path(path, "data").iterdir()}


@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_a_dict(spark, tmp_path, seed):
    rng = random.Random(seed)
    held, want = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k", buckets=3, most=2), {}
    for step in range(7):
        new = {rng.randrange(30): f"{step}-{i}" for i in range(rng.randrange(1, 12))}
        gone = {rng.randrange(30) for _ in range(rng.randrange(0, 6))}
        rows = spark.createDataFrame([*new.items(), (None, "no key")], "k long, v string")
        n = held.change(rows, spark.createDataFrame([(k,) for k in gone], "k long"))
        assert n == len(new.keys() | gone)
        want = {k: v for k, v in (want | new).items() if k not in gone}
        assert rows_of(held.read()) == sorted(want.items(), key=repr)
        key = rng.randrange(30)
        assert rows_of(held.read(only=F.lit(key).cast("long"))) == ([(key, want[key])] if key in want else [])
    held.vacuum()
    assert rows_of(held.read()) == sorted(want.items(), key=repr)
    named = {f"_part={p['name']}" for v in held.versions() for p in held._manifest(v)["parts"]}
    assert set(sizes(held.path)) == named and len(held.versions()) == 2


def test_the_last_row_of_a_batch_counts(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), "k string, v long, added double", "k")
    held.change(spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 7), ("b", 4, 1)], "k string, v long, at int"), order="at")
    assert rows_of(held.read()) == [("a", 2, None), ("b", 4, None)]
    assert held.change(spark.createDataFrame([], "k string, v long")) == 0 and held.versions() == [1]


def test_a_change_writes_only_itself(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k", buckets=4)
    held.change(spark.range(5000).select(F.col("id").alias("k"), F.lit("x" * 50).alias("v")))
    first = sizes(held.path)
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    base = sum(map(size, first.values()))
    held.change(gone=spark.createDataFrame([(7,)], "k long"))
    held.change(spark.createDataFrame([(8, "y")], "k long, v string"))
    new = [p for n, p in sizes(held.path).items() if n not in first]
    assert len(new) == 2 and sum(map(size, new)) < base / 3
    assert held.read().count() == 4999 and rows_of(held.read().filter("k in (7, 8)")) == [(8, "y")]
    assert held.read(1).count() == 5000  # an earlier version is still there


def test_the_base_is_not_shuffled_and_one_bucket_is_read(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k")
    held.change(spark.range(2000).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    held.change(spark.createDataFrame([(8, "y")], "k long, v string"))
    plan = lambda df: df._jdf.queryExecution().toString()
    df = held.read()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final.split("Initial Plan")[0]
    assert "_bucket" in plan(held.read(only=F.lit(8).cast("long"))).split("PartitionFilters")[1][:200]


def test_a_crash_leaves_the_last_version(spark, tmp_path, monkeypatch):
    held = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k")
    held.change(spark.createDataFrame([(1, "a")], "k long, v string"))

    def dies(*a):
        raise OSError("gone")

    monkeypatch.setattr(KeyedTable, "_commit", dies)
    with pytest.raises(OSError):
        held.change(spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"))
    monkeypatch.undo()
    again = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k", buckets=99)  # buckets are the table's own
    assert rows_of(again.read()) == [(1, "a")] and again.buckets == 16
    again.change(spark.createDataFrame([(2, "d")], "k long, v string"))
    assert rows_of(again.read()) == [(1, "a"), (2, "d")]
    before = len(sizes(again.path))
    again.vacuum()
    assert len(sizes(again.path)) == before - 1


def test_two_writers_do_not_commit_one_version(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k")
    stale = held._manifest()
    held.change(spark.createDataFrame([(1, "a")], "k long, v string"))
    with pytest.raises(FileExistsError):
        held._commit(stale, [], {})
    assert rows_of(held.read()) == [(1, "a")] and not [n for n in Folder(spark, f"{tmp_path}/t").children("log") if n.startswith(".")]


def test_compaction_keeps_parts_few_and_work_small(spark, tmp_path):
    held, written = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k", buckets=1, most=3), 0
    held.change(spark.range(400).select(F.col("id").alias("k"), F.lit("base").alias("v")))
    rewritten = []
    compact = held.compact
    held.compact = lambda: rewritten.append(compact())
    for i in range(10):
        written += held.change(spark.createDataFrame([(1000 + i, "n"), (i, "m")], "k long, v string"))
    assert len(held._manifest()["parts"]) <= 4 and held.read().count() == 410
    assert sum(rewritten) <= 6 * written  # the large part is left alone
    assert held.read().filter("v = 'm'").count() == 10


def test_sync_writes_what_differs(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), "k long, v array<string>", "k")
    rows = [(i, [str(i)]) for i in range(100)]
    assert held.sync(spark.createDataFrame(rows, "k long, v array<string>")) == 100
    assert held.sync(spark.createDataFrame(rows, "k long, v array<string>")) == 0
    rows = rows[10:] + [(200, None)]
    rows[0] = (10, ["other"])
    assert held.sync(spark.createDataFrame(rows, "k long, v array<string>")) == 12
    assert rows_of(held.read()) == sorted(rows, key=repr)
    assert held.sync(spark.createDataFrame([], "k long, v array<string>")) == 91 and held.read().count() == 0


def test_seen_urls(spark, tmp_path):
    seen = SeenUrls(spark, str(tmp_path / "s"))
    batch = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert [seen.add(batch("b", " a ", "", None, "a", "  ")), seen.add(batch("a", "c")), seen.add(batch("c", " b"))] == [2, 1, 0]
    assert [r["url"] for r in seen.listed().collect()] == ["a", "b", "c"]


def test_seed_store(spark, tmp_path):
    held = SeedStore(spark, str(tmp_path / "s"))
    row = lambda name, score, pos: (name, "customer", ["customer"], score, 1, 1, [("u", "t", "s", "d")], "q", "x", "y", None, pos)
    candidates = spark.createDataFrame([row("Acme  Bhd", 0.5, 1), row("acme bhd", 0.7, 2), row("Beta", 0.1, 3), row(" ", 0.9, 4)], CANDIDATE)
    assert held.save_candidates(candidates) == 2 and held.save_candidates(candidates) == 0
    assert sorted((r["score"], r["name"], r["evidence"][0]["url"]) for r in held.candidates().collect()) == [(0.1, "Beta", "u"), (0.7, "acme bhd", "u")]
    held.save_seeds(spark.createDataFrame([("Acme", 2), ("ACME", 1), (" ", 3), ("Beta", 4)], "name string, pos long"))
    assert held.save_seeds(spark.createDataFrame([("ACME", 1), ("Beta", 4), ("Gamma", 5)], "name string, pos long")) == 1
    assert rows_of(held.seeds()) == [("ACME", 1), ("Beta", 4), ("Gamma", 5)]


def test_json_file_and_model_registry(spark, tmp_path):
    file = JsonFile(spark, str(tmp_path / "x" / "m.json"))
    assert file.load({"d": 1}) == {"d": 1}
    file.save({"é": [1, None]})
    assert file.load() == {"é": [1, None]} and "é" in (tmp_path / "x" / "m.json").read_text()
    (tmp_path / "x" / "m.json").write_text(" \n")
    assert file.load([]) == []
    registry = ModelRegistry(spark, str(tmp_path / "r.json"), {"a": {"name": "A"}, "b": {"name": "B"}})
    assert registry.delete("a") is False and registry.all().keys() == {"a", "b"}
    registry.save("b", {"name": "mine"})
    registry.save("c", {"name": "C", "enabled": False})
    assert registry.get("b") == {"name": "mine"} and registry.get("c") is None and registry.custom().keys() == {"b", "c"}
    assert registry.delete("b") is True and registry.get("b") == {"name": "B"}
    (tmp_path / "r.json").write_text(json.dumps([1]))
    assert registry.custom() == {}
