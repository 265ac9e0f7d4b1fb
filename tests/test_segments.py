"""Indexes in segments and bounds of blocks against indexes that are built anew."""

from __future__ import annotations

import random

import pytest

from papyrarc.operators import search as S
from papyrarc.operators import segments as G

SCHEMA = "doc_id long, text string, deleted boolean"
WORDS = "license public general rights apache stone river cloud maple quiet".split()


def text(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))


def ranks(index, **ask):
    return sorted((r.doc, round(r.bm25, 9), r.matched) for r in S.search(index, **ask).collect())


@pytest.fixture
def batches():
    rng = random.Random(8)
    return [
        [(i, text(rng), False) for i in range(200)], [(i, text(rng), False) for i in range(190, 210)], [(i, None, True) for i in (3, 4, 195, 999)], [(3, "license again", False), (5, None, False), (None, "license", False)],
        [(i, text(rng), False) for i in range(300, 308)] + [(4, "stone", None), (8, None, True)],
    ]


def same_as_rebuilt(spark, path, live, stems=False):
    found = G.read_segments(spark, path)
    again = S.build_index(spark.createDataFrame([(i, t, False) for i, t in live.items()], SCHEMA), "doc_id", ["text"], stems)
    assert found.totals[0] == len(live)
    for ask in ({"any_of": ["license", "stone"]}, {"all_of": ["public"], "none_of": ["apache"], "prefixes": ["ri"]}, {"none_of": ["license"]}):
        assert ranks(found, **ask) == ranks(again, **ask)
    assert sorted(r.doc for r in S.phrase(found, ["public", "general"]).collect()) == sorted(r.doc for r in S.phrase(again, ["public", "general"]).collect())


def test_batches_equal_a_rebuild(spark, batches, tmp_path, monkeypatch):
    path, live = str(tmp_path / "index"), {}
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA)
        assert G.add_batch(df, k, path, "doc_id", ["text"], "deleted")
        assert not G.add_batch(df, k, path, "doc_id", ["text"], "deleted")
        for i, t, gone in rows:
            live.pop(i, None)
            if i is not None and not gone:
                live[i] = t
    assert len(G._state(spark, path)["segments"]) == 2  # small ones are merged
    same_as_rebuilt(spark, path, live)


def test_an_update_reads_changed_texts_only(spark, batches, tmp_path):
    path = str(tmp_path / "index")
    G.add_batch(spark.createDataFrame(batches[0], SCHEMA), 0, path, "doc_id", ["text"], "deleted")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "index" / "segments").rglob("*.parquet")}
    G.add_batch(spark.createDataFrame(batches[2], SCHEMA), 1, path, "doc_id", ["text"], "deleted")
    assert {f: f.stat().st_mtime_ns for f in before} == before  # nothing is written again
    plan = G.read_segments(spark, path).postings.where("term = 'license'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(term), EqualTo(term,license)]") == 2


def test_a_broken_batch_is_repeated(spark, batches, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    G.add_batch(spark.createDataFrame(batches[0], SCHEMA), 0, path, "doc_id", ["text"], "deleted")
    real = G._live
    monkeypatch.setattr(G, "_live", lambda *args: 1 / 0)  # after the segment is written
    changed = spark.createDataFrame(batches[1], SCHEMA)
    with pytest.raises(ZeroDivisionError):
        G.add_batch(changed, 1, path, "doc_id", ["text"], "deleted")
    monkeypatch.setattr(G, "_live", real)
    live = {i: t for i, t, _ in batches[0]}
    same_as_rebuilt(spark, path, live)
    assert G.add_batch(changed, 1, path, "doc_id", ["text"], "deleted")
    same_as_rebuilt(spark, path, live | {i: t for i, t, _ in batches[1]})


def test_stream_with_a_repeated_batch(spark, batches, tmp_path):
    path, source = str(tmp_path / "index"), str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).json(source)
    live = {}
    for rows in batches[:2]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)
        G.index_stream(stream, path, str(tmp_path / "check"), "doc_id", ["text"], "deleted").awaitTermination()
        live |= {i: t for i, t, _ in rows}
    # the commit of the last batch is lost, so that the stream hands it over again
    (tmp_path / "check" / "commits" / "1").unlink()
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    state = G._state(spark, path)
    G.index_stream(stream, path, str(tmp_path / "check"), "doc_id", ["text"], "deleted").awaitTermination()
    assert G._state(spark, path) == state
    same_as_rebuilt(spark, path, live)


def test_no_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        G.read_segments(spark, str(tmp_path / "none"))


def test_bounds_rule_out_blocks_and_no_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_DOCS", 2)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[4:]) for _ in range(rng.randint(1, 200))) + (" license" * (i % 3) if i % 9 == 0 else ""), False) for i in range(600)]
    S.write_index(S.build_index(spark.createDataFrame(rows, SCHEMA), "doc_id", ["text"]), str(tmp_path / "i"))
    index = S.read_index(spark, str(tmp_path / "i"))
    assert {r.term: r.documents for r in index.vocabulary().collect()} == {r.term: r.n for r in index.postings.groupBy("term").agg(S.F.count_distinct("doc").alias("n")).collect()}
    for terms in (["license"], ["license", "stone"], ["river", "cloud", "absent"], ["absent"]):
        for k in (1, 7, 1000):
            full = [(r.doc, r.bm25) for r in S.bm25(index, terms).orderBy("bm25", "doc").limit(k).collect()]
            assert [(r.doc, r.bm25) for r in S.best_documents(index, terms, k, first_blocks=3, few=0).collect()] == full
    read = {}
    plain = S.bm25
    monkeypatch.setattr(S, "bm25", lambda i, t, **o: [read.update({len(read): i.postings.where(S.F.col("term").isin(t)).count()}), plain(i, t, **o)][1])
    S.best_documents(index, ["license", "stone"], 5, first_blocks=3, few=0).collect()
    assert sum(read.values()) < index.postings.where("term in ('license', 'stone')").count() / 2
