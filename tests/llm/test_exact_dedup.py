"""Exact deduplication against a plain grouping of the texts."""

from __future__ import annotations

import hashlib
import re

import pytest
from compare import rows

from papyrarc.llm import exact_dedup
from papyrarc.llm.exact_dedup import OP12_SQL, exact_duplicates, op12_exact_dedup


def brute(pairs):
    groups: dict[str, list] = {}
    for k, (i, text) in enumerate(pairs):
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(hashlib.sha256(plain.encode()).hexdigest(), []).append((-len(text or ""), i is None, i or 0, k, i))
    out = []
    for sha, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m is best, sha) for m in members]
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("most_pages", [exact_dedup.MOST_PAGES, 1])
def test_odd_documents(spark, odd_docs, odd_rows, most_pages, monkeypatch):
    if most_pages == 1:  # many slices, each with a filter of its own
        monkeypatch.setattr(exact_dedup, "PAGE", 32_768)
        monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 4000)
    assert found(exact_duplicates(odd_docs, most_pages=most_pages)) == brute([(r[0], r[1]) for r in odd_rows])


def test_large_groups_and_ties(spark):
    pairs = [(i % 700, "the same\ttext" if i % 3 else " the same text " * (1 + i % 2)) for i in range(2000)] + [(5000 + i, f"text {i}") for i in range(500)] + [(9, "é\x0b"), (8, "é"), (None, "é "), (9000, "a b"), (9001, "ab")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = found(exact_duplicates(docs))
    assert got == brute(pairs)


def test_full_filter_only_lets_more_rows_through(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1)
    monkeypatch.setattr(exact_dedup, "PAGE", 8)
    assert found(exact_duplicates(odd_docs)) == brute([(r[0], r[1]) for r in odd_rows])


def test_empty_table(spark, no_docs):
    assert exact_duplicates(no_docs).collect() == []


def test_query_equals_sql(spark, sf_dir, duck):
    ours, theirs = op12_exact_dedup(spark, sf_dir).toPandas(), duck.sql(OP12_SQL).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_rows_without_a_copy_are_not_shuffled(spark, odd_docs):
    plan = exact_duplicates(odd_docs)._jdf.queryExecution().optimizedPlan().toString()
    alone = plan[plan.rindex("Relation") :]
    assert "Join" not in alone and "PythonUDF" not in plan and "InArrow" not in plan
