"""Alignment of tokenizers against whole texts, encoded and compared offset by offset."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter

import public_tokenizers
import pytest

from papyrarc.llm import alignment
from papyrarc.llm.alignment import align_tokenizers, common_ends, op11_alignment, tokenizers

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "plain words, twice plain", "a  b   c\n\nd\n e\t f ", " leading", "\nnew line", "it's they'll 123 4,567", "<|endoftext|> and <s> </s>", "東京 été 😀😀 \x00 \x1c x", "▁ marked", "a\r\nb c d\x85e",
    "   ", " ", "\n", "x" * 3000, "ﬁ ½ Å é", "🏳️‍🌈 flag​zero", "end. ", "a \n b \n\n c", "don't\n'tis 'S", "end\n",
]


def ends(raws):
    out, at = [], 0
    for r in raws:
        at += len(r)
        out.append(at)
    return out


def brute(pairs):
    """The result by the definition: every pair of tokens of a whole text is compared."""
    both = tokenizers(BYTES, PIECES)
    aligned = []
    for i, text in pairs:
        links, written, n_a, n_b, n_groups = [], "", 0, 0, 0
        if text:
            a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
            a_raw, b_raw = [both.a_raw[x] for x in a], [both.b_raw[x] for x in b]
            if b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
                n_a, n_b, a_ends, b_ends = len(a), len(b), ends(a_raw), ends(b_raw)
                cuts = [0, *sorted(set(a_ends) & set(b_ends))]
                parts = [[ids[bisect_right(at, low) : bisect_right(at, high)] for ids, at in ((a, a_ends), (b, b_ends))] for low, high in zip(cuts, cuts[1:], strict=False)]
                written, n_groups = ";".join("|".join(",".join(map(str, x)) for x in p) for p in parts), len(parts)
                at_end = {e: y for y, e in zip(b, b_ends, strict=True)}
                links = [(x, at_end[e]) for x, e in zip(a, a_ends, strict=True) if e in at_end]
        aligned.append((i, n_a, n_b, n_groups, links, hashlib.sha256(written.encode()).hexdigest() if written else ""))
    counts = Counter(x for row in aligned for x in row[4])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(str((i, n_a, n_b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha)) for i, n_a, n_b, g, links, sha in aligned)


def found(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("limit", [80_000, 3])
def test_odd_documents(spark, odd_docs, odd_rows, limit, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_LIMIT", limit)
    monkeypatch.setattr(alignment, "BATCH_CHARACTERS", 1_000_000 if limit > 3 else 200)
    monkeypatch.setattr(alignment, "SCORED_ROWS", 500 if limit > 3 else 7)
    own = [(1000 + i, t) for i, t in enumerate(TEXTS)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(own, "doc_id long, text string"))
    assert found(align_tokenizers(docs, BYTES, PIECES)) == brute([(r[0], r[1]) for r in odd_rows] + own)


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op11_alignment(spark, sf_dir)) == brute(docs)


def test_groups_and_links_are_returned(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    first, second = align_tokenizers(docs, BYTES, PIECES, with_groups=True).orderBy("doc_id").collect()
    assert hashlib.sha256(first.groups.encode()).hexdigest() == first.groups_sha256 and len(first.pairs) == first.n_links == first.n_groups
    assert (second.groups, second.pairs, second.n_groups) == ("", [], 0)


def test_tabs_and_runs_of_spaces_that_make_up_for_each_other(spark):
    own = list(enumerate(["a\tb  c", "  a\tb\u00a0c", "x\ty\n\nz \x85 q\tr", "a\tb\n", "a b\nc d"]))
    assert found(align_tokenizers(spark.createDataFrame(own, "doc_id long, text string"), BYTES, PIECES)) == brute(own)


def test_a_line_of_parts_that_is_not_given_back_is_taken_apart():
    both = alignment.Tokenizers(BYTES, PIECES)
    words = [f"word{i}" for i in range(250)]
    both.want({*words, "\ufb01ne", "\nline"})
    alone = alignment.Tokenizers(BYTES, PIECES)
    for w in words:
        alone.want({w})
    assert [both.known[w] for w in words] == [alone.known[w] for w in words]
    assert (both.known["\ufb01ne"] is None) == (both.b.decode(both.b.encode("\ufb01ne")) != "\ufb01ne")


def test_common_ends_slice_both_lists():
    assert common_ends([2, 4, 5, 9], [1, 2, 5, 6, 9]) == ([2, 5, 9], [1, 3, 4], [2, 3, 5])


def test_pairs_are_bounded_by_the_vocabularies():
    assert 300_000 < tokenizers(BYTES, PIECES).most_pairs() < 2_000_000


def test_empty_table(spark, no_docs):
    assert align_tokenizers(no_docs, BYTES, PIECES).collect() == []
