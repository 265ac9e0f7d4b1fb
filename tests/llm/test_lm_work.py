"""That op2 does its work once: texts are read twice, and rare subwords cost about as much as frequent ones."""

from __future__ import annotations

import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyrarc.llm import lm_scoring
from papyrarc.llm.attention import FAN, HEAD, WIDTH, _softmax_gradient, start_weights, train, windows


def test_texts_are_read_twice(spark):
    """Once to count words, once to encode; training and scoring read what was encoded."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = spark.createDataFrame([(i, f"some words and number {i}") for i in range(60)], "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    assert len(lm_scoring.score_texts(docs, F.lit(False), public_tokenizers.path("piece_bpe_32k.model")).collect()) == 60
    assert read.value == 120


def test_rare_subwords_cost_little_more():
    """A quarter of subwords spread over the softmax's tree doesn't double the time of training, as a copy of its node's weights for each of them did."""
    rng, size = np.random.default_rng(2), 30_000
    w = start_weights(np.ones(32_000))

    def seconds(flat):
        given = windows(flat, np.array([0, len(flat)]))[:3]
        best = []
        for _ in range(3):
            t = time.process_time()
            train(w, *given, 0.01)
            best.append(time.process_time() - t)
        return min(best)

    frequent = rng.integers(1, HEAD, size)
    mixed = np.where(rng.random(size) < 0.25, rng.integers(HEAD, 12_000, size), frequent)
    assert seconds(mixed) < 2 * seconds(frequent)


@pytest.mark.parametrize("longest", [1, 5, 400])
def test_gradients_of_many_nodes_are_those_of_each(longest):
    from papyrarc.llm.attention import _node_gradients, _runs

    rng = np.random.default_rng(longest)
    u = rng.standard_normal((40, WIDTH + 1, FAN)).astype(np.float32)
    node = np.repeat(np.arange(3, 31), rng.integers(1, longest + 1, 28))
    h, column = rng.standard_normal((len(node), WIDTH + 1)).astype(np.float32), rng.integers(0, FAN, len(node))
    nodes, begin, end = _runs(node)
    back = np.zeros_like(h)
    grads = _node_gradients(u, h, column, nodes, begin, end, np.float32(0.1), back)
    for k, a, b, own in zip(nodes, begin, end, grads, strict=True):
        want, rows = _softmax_gradient(u[k], h[a:b], column[a:b], np.float32(0.1))
        assert np.allclose(own, want, atol=1e-4) and np.allclose(back[a:b], rows, atol=1e-4)


def test_words_of_a_column_are_those_of_each_text():
    texts = ["", None, " ", "One two\tTWO\n\x0bthree\x0c four\r\n", " \x1cÀ b c d ", "ÄÖ aé", "x" * 70_000, "\x85 \x1f e"]
    words, n = lm_scoring._words(pa.array(texts))
    want = [lm_scoring.words_of(t) for t in texts]
    assert words.to_pylist() == sum(want, []) and n.tolist() == list(map(len, want))
    assert lm_scoring._words(pa.array([], pa.string()))[0].to_pylist() == []


@pytest.mark.parametrize("n_ranks", [32_001, 70_000])
def test_ranks_are_read_as_they_were_written(n_ranks):
    rng = np.random.default_rng(5)
    lengths = [1, 3, 500, 1, 1, 40, 2]
    starts = np.r_[0, np.cumsum(lengths)]
    flat = rng.integers(0, n_ranks, starts[-1])
    column = lm_scoring._packed(flat, starts, n_ranks).slice(1)
    for most in (1, 100, 10_000):
        found = [part[a:b].tolist() for part, ends in lm_scoring._unpacked(column, n_ranks, most) for a, b in zip(ends, ends[1:], strict=False)]
        assert found == [flat[a:b].tolist() for a, b in zip(starts[1:], starts[2:], strict=False)]
