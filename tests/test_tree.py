"""Snapshots that are compared by trees of checksums."""

from __future__ import annotations

import random

from papyrarc.sources import tree as T

SCHEMA = "id long, kind string, text string"


def made(n=3000):
    rng = random.Random(1)
    return [(i, rng.choice(["a", None]), rng.choice([None, "", "x" * (i % 50), f"t{i}"])) for i in range(n)]


def changes(spark, tmp_path, first, second, keys=("id",)):
    paths = [str(tmp_path / name) for name in ("before", "after")]
    for rows, path in zip((first, second), paths, strict=True):
        T.write_tree_snapshot(spark.createDataFrame(rows, SCHEMA).repartition(3), path, list(keys))
    return paths, sorted(map(str, (tuple(r) for r in T.changed_rows(spark, *paths, list(keys)).collect())))


def test_one_altered_one_lost_one_new(spark, tmp_path):
    rows = made()
    after = [(5, rows[5][1], "altered"), *(r for r in rows if r[0] not in (5, 77)), (9999, None, None)]
    paths, found = changes(spark, tmp_path, rows, after)
    assert found == ["(5, 'changed')", "(77, 'removed')", "(9999, 'added')"]
    buckets = T.differing_buckets(spark, *paths)
    assert len(buckets) == 3
    plan = T.changed_rows(spark, *paths, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("In(_bucket") + plan.count("In(_bucket,") >= 2  # the filter reaches both scans
    read = spark.read.parquet(f"{paths[0]}/rows")
    assert read.where(T.F.col("_bucket").isin(buckets)).count() < 30


def test_equal_tables_read_no_rows(spark, tmp_path):
    rows = made(500)
    paths, found = changes(spark, tmp_path, rows, rows[::-1])
    assert found == [] and T.differing_buckets(spark, *paths) == []


def test_repeated_and_null_keys(spark, tmp_path):
    first = [(None, "a", "1"), (None, "a", "2"), (1, "a", "1"), (1, "a", "1"), (2, None, "q"), (3, "a", None)]
    second = [(None, "a", "2"), (None, "a", "1"), (1, "a", "1"), (2, None, None), (2, None, "r"), (3, "a", "")]
    _, found = changes(spark, tmp_path, first, second)
    assert found == ["(1, 'changed')", "(2, 'changed')", "(3, 'changed')"]
    _, found = changes(spark, tmp_path / "two", first, second[:2], ("id", "kind"))
    assert found == ["(1, 'a', 'removed')", "(2, None, 'removed')", "(3, 'a', 'removed')"]


def test_empty_tables(spark, tmp_path):
    rows = made(5)
    assert changes(spark, tmp_path, [], [])[1] == []
    assert changes(spark, tmp_path / "one", [], rows)[1] == [f"({i}, 'added')" for i in range(5)]
