"""A legacy archive read as a Spark source: ranges of rows, folders, filters and what is refused."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from papyrarc.sources import legacy as G


def _archive(root, n=100, name="index.sqlite3", columns="id, url, timestamp, title, bookmarked_at, downloaded_at"):
    con = sqlite3.connect(root / name)
    con.execute(f"CREATE TABLE core_snapshot ({columns})")
    con.execute("CREATE TABLE core_archiveresult (id INTEGER PRIMARY KEY, snapshot_id, extractor, status COLLATE NOCASE, output)")
    con.execute("CREATE TABLE core_tag (id INTEGER PRIMARY KEY, name)")
    con.execute("CREATE TABLE core_snapshot_tags (id INTEGER PRIMARY KEY, snapshot_id, tag_id)")
    if "title" in columns:
        con.executemany("INSERT INTO core_snapshot VALUES (?, ?, ?, ?, ?, ?)", [(f"s{i}", f"https://e.com/{i}", f"17000000{i:02}.5", None if i % 3 else f"é {i}", None, "2024" if i % 2 else None) for i in range(n)])
    # row numbers far apart
    con.executemany("INSERT INTO core_archiveresult VALUES (?, ?, ?, ?, ?)", [(i * 10**12 + k, f"s{i}", e, "succeeded" if i % 2 else "Succeeded", None) for i in range(n) for k, e in enumerate(["wget", "pdf"])])
    con.executemany("INSERT INTO core_tag VALUES (?, ?)", [(1, "one"), (2, "two")])
    con.executemany("INSERT INTO core_snapshot_tags (snapshot_id, tag_id) VALUES (?, ?)", [(f"s{i}", 1 + i % 2) for i in range(n)])
    con.commit()
    con.close()
    for i in range(n // 10):
        (root / "archive" / f"17000000{i:02}.5").mkdir(parents=True)
        (root / "archive" / f"17000000{i:02}.5" / "singlefile.html").write_text("x" * i)
    (root / "archive" / "orphan").mkdir(parents=True)
    (root / "archive" / "file").write_text("no folder")
    return str(root)


@pytest.fixture
def pushing(spark):
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    yield
    spark.conf.unset(key)


def test_index_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "LEAST_BYTES", 1)
    path = _archive(tmp_path)
    reader = G.LegacyReader("snapshots", path, 30, 3)
    parts = reader.partitions()
    assert len(parts) == 4 and sum(b.num_rows for p in parts for b in reader.read(p)) == 100
    spread = G.LegacyReader("results", path, 30, 3)
    assert sum(b.num_rows for p in spread.partitions() for b in spread.read(p)) == 200
    rows = G.legacy_table(spark, path, "snapshots", rows=10).collect()
    assert sorted((r.id, r.url, r.title) for r in rows) == sorted((f"s{i}", f"https://e.com/{i}", None if i % 3 else f"é {i}") for i in range(100))


def test_results_and_tags_join_to_snapshots(spark, tmp_path):
    path = _archive(tmp_path)
    results, tags = G.legacy_table(spark, path, "results"), G.legacy_table(spark, path, "tags")
    assert {(r.extractor, r["count"]) for r in results.groupBy("extractor").count().collect()} == {("wget", 100), ("pdf", 100)}
    assert {(r.tag, r["count"]) for r in tags.groupBy("tag").count().collect()} == {("one", 50), ("two", 50)}
    assert results.join(tags, "snapshot_id").count() == 200


def test_folders_and_files(spark, tmp_path):
    path = _archive(tmp_path)
    files = G.legacy_table(spark, path, "files", folders=3)
    assert {(r.snapshot, r.name, r.length) for r in files.collect()} == {(f"17000000{i:02}.5", "singlefile.html", i) for i in range(10)}
    assert files.rdd.getNumPartitions() == 4
    folders, index = G.legacy_table(spark, path, "folders"), G.legacy_table(spark, path, "snapshots")
    assert [r.snapshot for r in folders.join(index, F.col("snapshot") == F.col("timestamp"), "left_anti").collect()] == ["orphan"]


def test_filters_reach_the_database(spark, tmp_path, pushing):
    path = _archive(tmp_path)
    results = G.legacy_table(spark, path, "results").where("status = 'succeeded' and extractor in ('pdf', 'x')")
    assert {r.snapshot_id for r in results.collect()} == {f"s{i}" for i in range(1, 100, 2)}
    assert G.legacy_table(spark, path, "snapshots").where("id = 's7' and url like '%7'").count() == 1
    assert G.legacy_table(spark, path, "snapshots").where("id = 's7' and id in ('s8', 's9')").count() == 0
    assert G.legacy_table(spark, path, "snapshots").where("title is null or id = 's0'").count() == 67
    assert [r.length for r in G.legacy_table(spark, path, "files").where("snapshot = '1700000004.5' and name = 'singlefile.html'").collect()] == [4]
    reader = G.PushingReader("results", path, 50_000, 3)
    kept = list(reader.pushFilters([G.EqualTo(("status",), "succeeded")]))
    assert len(kept) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 100


def test_several_databases_and_empty_ones(spark, tmp_path):
    one, two = tmp_path / "a", tmp_path / "b c?"
    for folder in (one, two):
        folder.mkdir()
    _archive(one)
    assert G.legacy_table(spark, _archive(two, n=0), "snapshots").count() == 0
    (two / "index-2.sqlite3").write_bytes((one / "index.sqlite3").read_bytes())
    reader = G.LegacyReader("snapshots", str(two), 50, 3)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 100


def test_what_is_refused(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(G.LegacySourceError, match="no index"):
        G.LegacyReader("snapshots", str(tmp_path / "none"), 10, 10).partitions()
    with pytest.raises(G.LegacySourceError, match="isn't a folder"):
        G.LegacyReader("files", str(tmp_path / "none"), 10, 10).partitions()
    _archive(tmp_path, columns="id, url, timestamp")
    with pytest.raises(G.LegacySourceError, match="lacks bookmarked_at, downloaded_at, title"):
        G.LegacyReader("results", str(tmp_path), 10, 10).partitions()
    with pytest.raises(Exception, match="no table pages"):
        G.legacy_table(spark, str(tmp_path), "pages").count()
    with pytest.raises(G.LegacySourceError, match="in place"):
        G.local_path("hdfs://host/archive")
