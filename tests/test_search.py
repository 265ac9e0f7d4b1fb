"""The search index: stems, fields, marks, upkeep and storage against a plain model of it."""

from __future__ import annotations

import pytest

from papyrarc.operators import search as S

DOCS = [
    (1, "License terms", "All licenses are reserved. Reserved rights, the right reserve."),
    (2, "Licensed works", "Ł ÉTÉ été cafe\u0301 tőke őş the the the"),
    (3, None, ""),
    (4, "the end", None),
    (5, "rights", "general public license general public license"),
]
SCHEMA = "doc_id long, title string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def plain(docs):
    return S.build_index(docs, "doc_id", ["title", "text"])


@pytest.fixture(scope="module")
def stemmed(docs):
    return S.build_index(docs, "doc_id", ["title", "text"], stems=True)


def found(df):
    return {r.doc for r in df.collect()}


def test_marks_are_taken_off(plain):
    terms = {r.term for r in plain.postings.where("doc = 2").collect()}
    assert {"ete", "cafe", "toke", "os", "ł"} <= terms


def test_postings_hold_every_place(plain):
    (row,) = plain.postings.where("doc = 5 and term = 'license'").collect()
    assert (row.tf, row.positions, row.field) == (2, [2, 5], "text")
    assert {r.doc: r.length for r in plain.doc_stats.collect()} == {1: 11, 2: 11, 3: 0, 4: 2, 5: 7}


def test_boolean_search(plain):
    assert found(S.search(plain, all_of=["license", "rights"])) == {5, 1}
    assert found(S.search(plain, all_of=["license"], none_of=["general"])) == {1}
    assert found(S.search(plain, any_of=["license", "the"], prefixes=["re"])) == {1}
    assert found(S.search(plain, none_of=["the"])) == {3, 5}
    assert found(S.search(plain, prefixes=["licen", "work"])) == {2}
    assert found(S.search(plain)) == {1, 2, 3, 4, 5}
    assert found(S.search(plain, all_of=["absent"])) == set()


def test_fields(plain):
    assert found(S.search(plain, any_of=["rights"], fields=["title"])) == {5}
    assert found(S.search(plain, any_of=["rights"], fields=["text"])) == {1}
    assert {r.field for r in S.phrase(plain, ["the", "end"]).collect()} == {"title"}


def test_stems_of_query_phrase_and_upkeep(docs, stemmed, spark):
    assert found(S.search(stemmed, any_of=["licenses"])) == found(S.search(stemmed, any_of=["licensing"])) == {1, 2, 5}
    assert found(S.phrase(stemmed, ["right", "reserving"])) == {1}
    changed = spark.createDataFrame([*DOCS[:2], (4, "licensing ends", None), (6, "a licensed copy", "new")], SCHEMA)
    after = S.update_index(stemmed, docs, changed, "doc_id", ["title", "text"])
    again = S.build_index(changed, "doc_id", ["title", "text"], stems=True)
    assert found(S.search(after, any_of=["license"])) == {1, 2, 4, 6}
    key = lambda i: sorted(map(str, i.postings.collect())) + sorted(map(str, i.doc_stats.collect()))
    assert key(after) == key(again) and after.stems


def test_stored_index(plain, stemmed, spark, tmp_path):
    for name, index in (("plain", plain), ("stems", stemmed)):
        S.write_index(index, str(tmp_path / name))
        stored = S.read_index(spark, str(tmp_path / name))
        assert stored.stems == index.stems
        for ask in ({"any_of": ["license", "the"]}, {"all_of": ["rights"], "none_of": ["the"]}, {"prefixes": ["lic"]}):
            assert sorted(S.search(index, **ask).collect()) == sorted(S.search(stored, **ask).collect())


def test_phrases_may_repeat_words(plain):
    assert found(S.phrase(plain, ["the", "the", "the"])) == {2} and not found(S.phrase(plain, ["the"] * 4))
