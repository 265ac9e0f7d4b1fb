from __future__ import annotations

import base64
import gzip
import hashlib
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrarc.llm import warc
from papyrarc.llm.covertree import build, pairs_within
from papyrarc.llm.embedding_dedup import near_vectors
from papyrarc.llm.prefix_forest import PrefixForest, cosines, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score double, id string, key string"


def vectors(n=160, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    center = rng.standard_normal(12)
    for i in range(n):
        v = center + 0.12 * rng.standard_normal(12) if i % 3 == 0 else rng.standard_normal(12)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    same = rows[3][1]
    rows += [(500, same, 1), (501, same, 1), (501, same, 1), (502, None, 1), (503, [0.0] * 12, 1), (504, [float("nan")] * 12, 1), (505, [1.0, None] * 6, 1), (506, same, None), (None, same, 1), (550, [float("inf")] * 12, 0), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1), (600, [], 1)]
    return [(*r, 0.1, "x", "y") for r in rows]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return a @ b / np.linalg.norm(a) / np.linalg.norm(b)


@pytest.mark.parametrize("block", [7, 1024])
def test_near_vectors(spark, block):
    rows = vectors()
    out = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block)
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if None in (a[0], b[0], a[2], b[2]) or a[2] != b[2] or not good(a[1]) or not good(b[1]) or len(a[1]) != len(b[1]):
                continue
            if cosine(a[1], b[1]) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    want = sorted(str((r[0], n, find(r[0]) if r[0] is not None else None)) for r, n in zip(rows, links, strict=True))
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in out.collect()) == want
    assert max(links) > 20
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("spread", [0.01, 0.3, 3.0])
def test_dual_traversal_finds_all_pairs(spread):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(6) + spread * rng.standard_normal((80, 6)) for _ in range(3)] + [np.ones((20, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = build(x, np.arange(150)), build(x, np.arange(150, len(x)))
    full = x @ x.T >= 0.93
    i, j = pairs_within(x, a, b, 0.93)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(p) for p in np.argwhere(full[:150, 150:]) + [0, 150]]
    i, j = pairs_within(x, a, a, 0.93)
    assert sorted((min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)) == [tuple(p) for p in np.argwhere(np.triu(full[:150, :150], 1))]


def test_nearest(spark):
    rows = vectors(400, 1)
    out = nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), every=50, block=64, queries_per_task=3)
    by = {}
    for r in out.collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in rows:
        if q[0] is None or q[0] % 50 or not good(q[1]):
            continue
        found = sorted(by[q[0]])
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        truth = sorted((-cosine(q[1], r[1]), r[0]) for r in rows if r is not q and r[0] is not None and good(r[1]) and len(r[1]) == len(q[1]))[:5]
        best = {i for _, i in truth}
        hits += len(best & {f[1] for f in found})
        total += len(best)
        for _, i, s in found:
            assert any(abs(cosine(q[1], r[1]) - s) < 1e-12 for r in rows if r[0] == i and good(r[1]) and len(r[1]) == len(q[1]))
    assert hits >= 0.9 * total > 0
    assert set(by) <= {r[0] for r in rows if r[0] is not None and r[0] % 50 == 0}
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_neighbours_when_all_rows_are_candidates(spark):
    rows = vectors(200, 2)
    out = nearest(spark.createDataFrame(rows, SCHEMA), every=50, candidates=1.0).collect()
    for q in rows:
        if q[0] is None or q[0] % 50 or not good(q[1]):
            continue
        truth = sorted((-round(cosine(q[1], r[1]), 9), r[0]) for r in rows if r is not q and r[0] is not None and good(r[1]) and len(r[1]) == len(q[1]))[:5]
        assert [(-round(r.score, 9), r.vec_id) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q[0]] == truth


def test_ties_go_to_the_smaller_id():
    """A quarter of the rows are exact copies; among equal cosines the smaller ids win, whatever a product of matrices rounds to."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        raw = rng.standard_normal((200, 16))
        raw[rng.permutation(200)[:50]] = rng.standard_normal(16)
        raw[rng.permutation(200)[:20]] = rng.standard_normal(16)
        ids = rng.permutation(1000)[:200]
        x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        forest = PrefixForest(x, raw, 8, 1)
        for i, (rows, cos) in enumerate(forest.search(x[:40], raw[:40], np.arange(40), np.arange(200), ids, 200, 5)):
            exact = cosines(raw, raw[i])
            want = sorted((-exact[j], ids[j]) for j in range(200) if j != i)[:5]
            assert [(-c, ids[j]) for c, j in zip(cos, rows, strict=True)] == want


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://e.com/", "z" * 50_000 + str(i)) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), archive_bytes=120_000)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in Path(tmp_path / "w").glob("part-*")]
    assert len(sizes) >= 6 and max(sizes) <= 120_000
    assert warc.assemble_captures(warc.read_records(spark, str(tmp_path / "w"), with_payload=True)).count() == 12


def test_archives(spark, tmp_path):
    pages = [(1, "http://e.com/a", "<p>x\r\n\r\nWARC/1.1</p>"), (2, "http://e.com/b?q", "<p>x\r\n\r\nWARC/1.1</p>"), (3, None, None), (4, "http://e.com/c", ""), (5, "http://e.com/é", "été"), (5, "http://e.com/é", "été"), (6, "http://e.com/d", "d"), (6, "http://e.com/e", "e"), (-7, "http://e.com/f", "d"), (None, "http://e.com/g", "d"), (8, "x", "y" * 300_000)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, key int").repartition(2)
    warc.write_archives(df, str(tmp_path / "w"))
    captures = warc.assemble_captures(warc.read_records(spark, str(tmp_path / "w"), with_payload=True))
    rows = captures.select(warc.page_of(F.col("response.record_id")).alias("page"), "response", "request", "metadata", warc.page_of(F.col("response.refers_to")).alias("to")).collect()
    assert len(rows) == len(pages)
    want = sorted(str((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode())) for p, _, h in pages)
    assert sorted(str((r.page, r.response.payload_bytes or r.metadata.payload_bytes, r.response.payload_digest)) for r in rows) == want
    assert all(r.request is not None and r.metadata is not None and r.response.digest_ok is not False for r in rows)
    kinds = sorted((str(r.page), r.response.type, r.to) for r in rows)
    assert ("1", "revisit", 2) in kinds and ("2", "response", None) in kinds and ("3", "revisit", 4) in kinds and ("-7", "revisit", 6) in kinds and ("None", "revisit", 6) in kinds
    assert [k for k in kinds if k[0] == "5"] == [("5", "response", None), ("5", "revisit", 5)]
    long = next(r for r in rows if r.page == 8)
    assert bytes(long.response.payload) == b"y" * 300_000
    text = b"".join(gzip.decompress(f.read_bytes()) for f in Path(tmp_path / "w").glob("part-*"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == 3 * len(pages) and text.endswith(b"\r\n\r\n")


def test_small_payloads_are_never_revisits(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b"), (4, "u", "b")], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), min_bytes=2)
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert {r.type: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 4, "metadata": 4, "response": 3, "revisit": 1}


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    assert warc.assemble_captures(warc.read_records(spark, str(tmp_path / "w"))).count() == 0


def test_pages_without_ids(spark, tmp_path):
    """Each has records of its own, alike or not; a revisit names a response that is there, and no key holds unlike ones."""
    pages = [(None, f"http://e.com/{i}", f"text {i}") for i in range(300)] + [(None, "http://e.com/0", "text 0")] * 20 + [(None, None, None)] * 5 + [(0, "http://e.com/0", "text 1")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write_archives(df, str(tmp_path / "w"))
    captures = warc.assemble_captures(warc.read_records(spark, str(tmp_path / "w"), with_payload=True)).collect()
    ids = {c.response.record_id for c in captures}
    assert len(captures) == len(ids) == len(pages)
    responses = {c.response.record_id: bytes(c.response.payload) for c in captures if c.response.type == "response"}
    assert sorted(responses.values()) == sorted({(h or "").encode() for _, _, h in pages})
    digests = {base64.b32encode(hashlib.sha1(p).digest()).decode(): i for i, p in responses.items()}
    revisits = [c.response for c in captures if c.response.type == "revisit"]
    assert len(revisits) == len(pages) - 301 and all(r.refers_to == digests[r.payload_digest] for r in revisits)
    zero = [c.response for c in captures if c.response.record_id.startswith("<urn:uuid:00000000-0000") and c.response.record_id[29:33] == "8000"]
    assert [(r.type, r.payload_digest) for r in zero] == [("response", base64.b32encode(hashlib.sha1(b"text 1").digest()).decode())]
