"""Scans of keys of any size against windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrarc.operators import browse as B
from papyrarc.operators import scan
from papyrarc.operators.scan import running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    made = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c", None, "z"]), i // 2 if i % 5 else None, i, rng.choice([None, *range(9)]), rng.choice(["x", "y", None])) for i in range(3000)]
    return spark.createDataFrame(made, "key string, at long, id long, n long, v string").repartition(5)


def plain(rows):
    w = Window.partitionBy("key").orderBy("at", "id")
    return rows.select("key", "at", "id", F.row_number().over(w).cast("long").alias("number"), F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sum"), F.lag("v").over(w).alias("v0"), F.lag("n").over(w).alias("n0"))


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_equals_windows(spark, rows, parts):
    got = running(rows, ["key"], ["at", "id"], number="number", sums={"sum": "n"}, before={"v0": "v", "n0": "n"}, parts=parts)
    assert got.columns == ["key", "at", "id", "n", "v", "sum", "v0", "n0", "number"]
    want = plain(rows)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_is_spread(spark, rows, monkeypatch):
    seen = []
    stored = scan.stored
    monkeypatch.setattr(scan, "stored", lambda df: [seen.append(out := stored(df)), out][1])
    running(rows, ["key"], ["at", "id"], sums={"sum": "n"}, parts=20).collect()
    sizes = [r["count"] for r in seen[0].groupBy("_part", "key").count().where("key = 'hot'").collect()]
    assert len(sizes) > 10 and max(sizes) < 3000 / 20 * 2


def test_two_keys_and_no_rows(spark, rows):
    got = running(rows.withColumn("k2", F.col("id") % 3), ["key", "k2"], ["at", "id"], number="number", parts=7)
    assert got.where("number = 1").count() == got.select("key", "k2").distinct().count()
    assert running(rows.limit(0), ["key"], ["at"], number="number", sums={"sum": "n"}).collect() == []


def test_budget_of_one_large_document(spark):
    pages = spark.createDataFrame([(1, i, "é" * 5) for i in range(400)] + [(2, 0, None), (2, 1, "abc")], "doc long, page long, text string")
    got = {(r.doc, r.page): (r.bytes_kept, r.truncated) for r in B.text_budget(pages, "doc", "page", "text", 1005).collect()}
    assert [got[1, i] for i in (0, 99, 100, 101)] == [(10, False), (10, False), (5, True), (0, True)] and got[2, 1] == (3, False) and len(got) == 402
