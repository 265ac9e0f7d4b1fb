"""What operators must do for all rows and words, at sizes where a cut would show."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers

from papyrarc.llm import lm_scoring, toxicity
from papyrarc.llm.attention import start_weights

from .conftest import sentence


def test_attention_learns_from_all_training_rows(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i, sentence(rng, 4)) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = {}
    start, drop = lm_scoring.bigram_weights, lm_scoring.drop_scratch
    monkeypatch.setattr(lm_scoring, "bigram_weights", lambda w, pairs: [seen.update(pairs=pairs.sum()), start(w, pairs)][1])
    monkeypatch.setattr(lm_scoring, "drop_scratch", lambda df: [seen.update(parts=df.groupBy("trainer", "round").count().collect()), drop(df)][1])
    held = lm_scoring.crc_mod("doc_id", 7) == 2
    out = lm_scoring.score_texts(docs, held, path, per_trainer=1000).where("not held_out").count()
    lib = lm_scoring._pieces(path)
    tokens = sum(len(lib.encode(w)) for i, t in rows for w in t.split() if i is None or zlib.crc32(str(i).encode()) % 7 != 2)
    assert seen["pairs"] == tokens + out
    assert sum(r["count"] for r in seen["parts"]) == out
    # null ids don't meet in one trainer
    assert max(r["count"] for r in seen["parts"]) < 300


def test_the_dictionary_changes_no_score(spark, odd_docs, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    # weights that don't depend on the order of rows
    monkeypatch.setattr(lm_scoring, "train_attention", lambda docs, model_file, ranks, *rest, **more: start_weights(ranks.mass))
    docs = odd_docs.select("doc_id", "text").where("doc_id is not null").union(spark.createDataFrame([(900 + i, "quiet " + "y" * 80) for i in range(9)], "doc_id long, text string"))
    held = lm_scoring.crc_mod("doc_id", 7) == 2
    found = []
    for most in (200_000, 3):
        monkeypatch.setattr(lm_scoring, "DICTIONARY", most)
        for longest in (64, 1000):
            monkeypatch.setattr(lm_scoring, "LONGEST", longest)
            found.append(sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm_scoring.score_texts(docs, held, path).collect()))
    for other in found[1:]:
        assert [r[:3] for r in other] == [r[:3] for r in found[0]]
        assert np.allclose([r[3:] for r in other], [r[3:] for r in found[0]], rtol=1e-6)


def test_doubled_letters_and_spaced_words_are_decoded():
    text = "the idiot was stupid and a moron in the old trash i will kill you all and a better letter too " * 50
    model = toxicity.CharacterModel(toxicity.trigram_counts(text))
    for written, words in {
        "iidiot": ["idiot"], "stuupid": ["stupid"], "idiott": ["idiot"], "such a i d i o t": ["such", "a", "idiot"], "I i d i o t": ["idiot"],
        "k i l l y o u": ["kill", "you"], "s t u p i d i d i o t": ["stupid", "idiot"], "better letter all": ["better", "letter", "all"],
    }.items():
        assert set(words) <= set(toxicity.Restorer(model).words(written)), written


def test_pairs_decode_as_in_the_lattice(monkeypatch):
    rng = random.Random(4)
    model = toxicity.CharacterModel(np.random.default_rng(1).integers(0, 50, toxicity.LETTERS**3))
    words = ["".join(rng.choice("abcéö") * rng.choice((1, 2)) for _ in range(rng.randint(1, 6))) for _ in range(800)]
    words = [w for w in words if not toxicity._TRIPLE.search(w)]
    short = [toxicity.decode_token(w, model) for w in words]
    monkeypatch.setattr(toxicity, "_TRIPLE", re.compile(""))
    assert short == [toxicity.decode_token(w, model) for w in words] and short != words
