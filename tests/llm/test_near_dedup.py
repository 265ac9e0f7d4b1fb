from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from papyrarc.llm.components import components
from papyrarc.llm.near_dedup import intersections, near_duplicates
from papyrarc.llm.superminhash import signatures
from papyrarc.llm.wordhash import mix

from .conftest import sentence


def brute(rows, k=5, percent=85):
    """Component of each row by comparing all pairs of sets."""
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {b" ".join(w)} if w else set())
    ids = [r[0] for r in rows]
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
            continue
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(find(i)) if i is not None else "None") for i, s in zip(ids, sets, strict=True))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_odd_rows(odd_docs, odd_rows):
    out = near_duplicates(odd_docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(out) == brute(odd_rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out.collect())


def test_large_groups_of_near_copies(spark):
    rng = random.Random(1)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 999)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(df, block=16)) == brute(rows)


def test_large_buckets_of_unlike_documents(spark):
    """Bands of one value gather documents that share little; those far from all pivots still find each link across blocks."""
    rng = random.Random(2)
    common = sentence(rng, 25).split()
    rows = []
    for g in range(12):
        own = [f"g{g}w{j}" for j in range(rng.randint(30, 60))]
        for i in range(rng.choice([1, 3, 14])):
            words = common + list(own)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 999)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (85, 60):
        assert got(near_duplicates(df, percent=percent, n_bands=60, band_width=1, block=5)) == brute(rows, percent=percent)


@pytest.mark.parametrize("hot", [3, 2000])
def test_components_with_hot_nodes(spark, hot, monkeypatch):
    """Stars of many more edges than others, joined through a long chain, whose nodes are joined apart or not."""
    monkeypatch.setattr("papyrarc.llm.components.HOT_LEAST", hot)
    edges = [(0 if i % 2 else 5000, i) for i in range(1, 400)] + [(5000 + i, 5001 + i) for i in range(6)] + [(9000, 9001)]
    out = {r.id: r.component for r in components(spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")).collect()}
    want = {x: 5000 for x in range(5000, 5007)} | {i: 0 if i % 2 else min(range(2, 400, 2)) for i in range(1, 400)} | {0: 0, 9000: 9000, 9001: 9000}
    want |= {x: 2 for x in range(5000, 5007)}
    assert out == want


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_signatures_estimate_similarity():
    """The share of equal slots is the similarity, with less spread than independent hashes would have."""
    rng = np.random.default_rng(0)
    errors = []
    for t in range(200):
        pool = mix(rng.integers(0, 2**63, 60).astype(np.uint64))
        a, b = np.sort(pool[:45]), np.sort(pool[15:])
        s = signatures(np.concatenate([a, b]), np.repeat([0, 1], 45), 2, 64)
        errors.append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < np.sqrt(0.25 / 64)


def test_signature_is_a_minimum_over_elements():
    x = np.sort(mix(np.arange(40, dtype=np.uint64)))
    whole = signatures(x, np.zeros(40, np.int64), 1, 32)
    parts = signatures(x, np.repeat([0, 1], 20), 2, 32)
    assert np.array_equal(whole[0], parts.min(0))
    assert np.isinf(signatures(x[:0], np.zeros(0, np.int64), 1, 8)).all()


def test_intersections():
    sets = [np.arange(0, 10, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64), np.array([3], np.uint64)]
    assert intersections(sets).tolist() == [[10, 5, 1], [5, 10, 0], [1, 0, 1]]


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(1, 2), (2, 3), (10, 11)], []])
def test_components(spark, edges):
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")
    out = {r.id: r.component for r in components(df).collect()}
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert out == root
