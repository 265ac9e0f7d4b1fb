"""Operators on texts against the libraries, brute force and held-out labels."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from papyrarc.llm import language_id, licenses, lm_scoring, packing, pieces, toxicity
from papyrarc.llm.attention import WIDTH, Scorer, add_changes, flatten, pack_changes, start_weights, train, unflatten, windows
from papyrarc.llm.common import crc_mod
from papyrarc.llm.queries import QUERIES, SQL


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_pieces_equal_the_library(odd_docs, no_docs, spark, sf_dir):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in (odd_docs, docs_of(spark, sf_dir)):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        out = pieces.encode_pieces(docs, path).collect()
        assert len(out) == docs.count() and all(r.agrees for r in out)
        want, have = [], []
        for i, ts in texts.items():
            for t in ts:
                ids = lib.encode(t)
                want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
        have = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out]
        assert sorted(want) == sorted(have)
    assert pieces.encode_pieces(no_docs, path, with_ids=True).count() == 0


def test_agenda_equals_the_library_on_random_words():
    vocab, _ = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    letters = list("abcdehilnorstu") + ["é", "ß", "▁", "東", "0"]
    words = ["▁" + "".join(rng.choice(letters, rng.integers(1, 30))).replace("▁", "") for _ in range(2000)]
    words = [w for w in words if len(w) > 1]
    assert [vocab.merge(w) for w in words] == pieces._library_ids(vocab, words)


def test_both_agendas_join_the_same_symbols():
    vocab, _ = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    chunks = ["".join(rng.choice(list("aeinorst\u00e9,1"), n)) for n in rng.integers(2, 60, 400)] + ["\u2581thestone", "aaaaaaaa", "\u2581\u2581\u2581", "\u6771\u4eac", "a"]
    assert [vocab._by_place(c) for c in chunks] == [vocab._by_heap(c) for c in chunks]
    assert [vocab.merge(c) for c in chunks] == pieces._library_ids(vocab, chunks)


def test_a_difference_from_the_library_is_told_every_time(spark):
    """A vocabulary whose merges went wrong: each text with such a part says so, and still gets the library's ids."""
    vocab = pieces.PieceVocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    right = vocab.merge
    vocab.merge = lambda chunk: [1] if chunk == "▁stone" else right(chunk)
    known = pieces.Known()
    for _ in range(3):
        (ids, n, text, agrees), (*_, fine) = pieces.encode_texts(["a stone", "a  b "], vocab, known)
        assert not agrees and fine and text == "a stone" and ids == ",".join(map(str, vocab.library.encode("a stone"))) and n == ids.count(",") + 1


def check_packing(out, docs, path, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(-(-len(ids) // capacity)):
            part = ids[k * capacity : (k + 1) * capacity]
            want[str(r.doc_id), k, k * capacity, len(part), zlib.crc32(part.tobytes())] += 1
    rows = out.collect()
    assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing(odd_docs, no_docs, spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(packing.pack_documents(odd_docs, path, capacity=64, per_block=30), odd_docs, path, 64)
    docs = docs_of(spark, sf_dir)
    n, least = check_packing(packing.pack_documents(docs, path), docs, path, 2048)
    assert n <= least + 1
    assert packing.pack_documents(no_docs, path).count() == 0


def test_letters_composed_in_lower_case_only_are_encoded_like_whole_texts():
    texts = ["J\u030ca, H\u0331x. T\u0308s!", "\u0130stanbul, <|endoftext|> \u03a3\u03c3 \u0391\u03a3.", "\u00c9t\u00e9 \u01c5x IT'S 12.5% A\u0301b,", "Words words, WORDS. words"]
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    whole = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == whole and [encoder.encode([t])[0] for t in texts] == whole


def test_words_with_marks_and_special_tokens_encode_as_texts():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's 3.5%, isn't it? <|endoftext|>! A<|startoftext|>b", "ΣΑΣ. É́a, ﬁ ½.. don't!", "a\x1cb\x1d. c", "İstanbul,  x"]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want == encoder.encode(texts)


def test_a_mark_that_lower_case_adds_joins_the_marks_behind_it():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["\u03a3 \u0130, \u0130!", "\u0130: <| \u0301", "", "One\u3000two\u00a0THREE, \x1cfour\x85"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_each_distinct_word_is_numbered_once_and_kept_when_others_are_forgotten(monkeypatch):
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "CACHE_LIMIT", 6)
    for texts in (["a stone, A STONE", "a stone"], ["b bridge a", ""], ["stone, lamp.", "kite a"], ["kite Lamp. a, b"]):
        ids = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert ids == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert sorted(encoder.known.values()) == list(range(len(encoder.ids.sizes)))


def test_genetic_packing_never_gets_worse():
    rng = np.random.default_rng(1)
    sizes = rng.integers(300, 1100, 400)
    start = packing.evolve(sizes, [], 2048, 0, 0, 4)
    end = packing.evolve(sizes, [p.copy() for p in start], 2048, 1, 30, 4)
    assert packing._fitness(end[0], sizes, 2048) <= packing._fitness(start[0], sizes, 2048)
    assert np.bincount(end[0], weights=sizes).max() <= 2048


def test_genetic_packing_beats_best_fit():
    """Sets of pieces that fill their bins to the last token, which best-fit by falling size does not find."""
    won = 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        sizes = []
        for _ in range(12):
            a, b = sorted(rng.choice(np.arange(300, 1748), 2, replace=False).tolist())
            sizes += [a, b - a, 2048 - b] if b - a >= 30 else [a, 2048 - a]
        sizes = rng.permutation(np.array(sizes, np.int64))
        least = -(-int(sizes.sum()) // 2048)
        bins = [0] * len(sizes)
        best_fit = packing.best_fit(sizes.tolist(), np.argsort(-sizes, kind="stable").tolist(), [], bins, 0, 2048)
        got = packing._fitness(packing.evolve(sizes, [], 2048, seed + 1, 60, 6)[0], sizes, 2048)[0]
        assert least <= got <= best_fit
        won += got < best_fit
    assert won >= 4


def test_emptied_keeps_items_and_capacity():
    rng = np.random.default_rng(8)
    sizes = rng.integers(20, 900, 300)
    bins = np.arange(300) // 2
    after = packing.emptied(bins, sizes, 2048)
    assert np.bincount(after, weights=sizes).max() <= 2048 and len(np.unique(after)) < 150
    assert len(np.unique(after)) <= -(-int(sizes.sum()) // 2048) + 1


def test_blocks_share_the_room_that_they_leave(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 1400, 600))]
    items = spark.createDataFrame(rows, "item long, length long")
    used = {}
    for full in (0.0, 0.98):  # without the second level, and with it
        got = packing.pack(items, 2048, per_block=60, full=full).collect()
        fill = Counter()
        for r in got:
            fill[r.sequence_id] += rows[r.item][1]
        assert sorted(r.item for r in got) == list(range(600)) and max(fill.values()) <= 2048
        used[full] = len(fill)
    assert used[0.98] < used[0.0] and used[0.98] <= -(-sum(n for _, n in rows) // 2048) + 3


def test_languages(odd_docs, no_docs, spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    model = language_id.train_language_model(docs.where(crc_mod("doc_id", 5) != 0), "text", "lang")
    out = language_id.identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(crc_mod("doc_id", 5) == 0)
    assert out.where("lang_pred = lang").count() >= 0.97 * out.count()
    odd = language_id.identify_language(odd_docs, language_id.train_language_model(odd_docs, "text", "lang")).collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang_pred for r in odd if r.doc_id in (4, 5, 6, 11)} == {"und"}
    assert all(0 <= r.score <= 1 for r in odd)
    nothing = language_id.train_language_model(no_docs, "text", "lang")
    assert {r.lang_pred for r in language_id.identify_language(odd_docs, nothing).collect()} == {"und"}
    assert language_id.identify_language(no_docs, model).count() == 0


def test_languages_by_brute_force(odd_docs, spark, sf_dir):
    """Naive Bayes in plain Python, one n-gram after the other."""
    docs = docs_of(spark, sf_dir).where("doc_id < 120").select("doc_id", "text", "lang").union(odd_docs.select("doc_id", "text", "lang"))
    rows = docs.collect()
    size, orders, smoothing = 512, (1, 2, 3), 0.5
    grams = lambda t: language_id.ngram_buckets([t.replace("\0", " ")], orders, size)[0].tolist()
    counts, seen = {}, Counter()
    for r in rows:
        if r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
            seen[r.lang] += 1
    want = Counter()
    for r in rows:
        mine = Counter(grams(r.text or ""))
        if not mine:
            want[str(r.doc_id), "und", 0.0] += 1
            continue
        logs = {x: math.log(seen[x] / sum(seen.values()) + 1e-12) + sum(n * math.log((c[g] + smoothing) / (sum(c.values()) + smoothing * size)) for g, n in mine.items()) for x, c in counts.items()}
        best = min(x for x in logs if logs[x] == max(logs.values()))
        want[str(r.doc_id), best, round(1 / sum(math.exp(v - logs[best]) for v in logs.values()), 6)] += 1
    model = language_id.train_language_model(docs, "text", "lang", orders, size, smoothing)
    assert Counter((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in language_id.identify_language(docs, model).collect()) == want


def test_decoding_by_all_paths():
    """The likeliest path of a short token's lattice, by trying every path."""
    model = toxicity.CharacterModel(toxicity.trigram_counts("the idiot was stupid and a moron in the old trash book bell " * 50))
    logs, border = model.logs, toxicity.LETTERS - 1

    def paths(token, i, a, b, score, out):
        if i == len(token):
            yield score + logs[a][b][border], out
            return
        c = token[i]
        letters = c if c.isalpha() else ""
        for x, cost in [*((x, 0.0) for x in letters), *((x, toxicity.SUBSTITUTED) for x in toxicity.LEET.get(c, ""))]:
            yield from paths(token, i + 1, b, toxicity._code(x), score + logs[a][b][toxicity._code(x)] + cost, out + x)
        if i and c == token[i - 1] and letters:
            yield from paths(token, i + 1, a, b, score + toxicity.REPEATED, out)
        elif c in toxicity.SPACERS and 0 < i < len(token) - 1:
            yield from paths(token, i + 1, a, b, score + toxicity.SPACED, out)
        if not letters:
            yield from paths(token, i + 1, border, border, score + logs[a][b][border] + toxicity.SYMBOL_KEPT, out + c)

    rng = np.random.default_rng(7)
    written = ["iidiot", "stuupid", "idioot", "bbook", "1d!0t", "m.o-r.on", "tr@@sh", "be11", "b00k", "the", "oold", "$tuupid"]
    written += ["".join(rng.choice(list("aoitsd10$.-"), 6)) for _ in range(60)]
    for token in written:
        scored = sorted(paths(token, 0, border, border, 0.0, ""), reverse=True)
        best = {out for score, out in scored if score > scored[0][0] - 1e-9}
        assert toxicity.decode_token(token, model) in best, token
    assert toxicity.decode_token("stuupid", model) == "stupid" and toxicity.decode_token("iidiot", model) == "idiot" and toxicity.decode_token("book", model) == "book"


def test_ngrams_stay_within_their_text():
    one, cut = language_id.ngram_buckets(["abc", "", "12", "x-y"], (1, 2, 3), 1 << 20)
    alone = [language_id.ngram_buckets([t], (1, 2, 3), 1 << 20)[0] for t in ("abc", "", "12", "x-y")]
    for i, a in enumerate(alone):
        assert sorted(one[cut[i] : cut[i + 1]]) == sorted(a)
    # three letters, four pairs with the borders, three triples with the borders
    assert len(alone[0]) == 3 + 4 + 3 and not len(alone[1]) and not len(alone[2])


def test_toxicity(odd_docs, no_docs, spark):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "tu", "vo", "sel", "pan") for b in ("ran", "tel", "mon", "dis", "fur", "gol")]
    rows, labels = [], []
    for i in range(600):
        text = [str(w) for w in rng.choice(words, 40)]
        bad = i % 5 == 0
        if bad:
            written = ["stupid", "idiot", "1d10t", "s.t.u.p.i.d", "stuuuupid", "i d i o t", "$tup1d"][i // 5 % 7] if i >= 300 else ["stupid", "idiot"][i // 5 % 2]
            text[20] = written
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tags = spark.createDataFrame([*labels, (0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs.where("doc_id < 300"), tags)
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    caught = [out[i].predicted for i in range(300, 600) if i % 5 == 0]
    clean = [out[i].predicted for i in range(300, 600) if i % 5]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) == 0
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    empty = toxicity.train_toxicity(no_docs, tags.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(odd_docs, empty).collect()} == {0}


def test_values_of_tokens_are_those_of_all_words(odd_rows):
    model = toxicity.CharacterModel(toxicity.trigram_counts("the idiot was stupid and a moron in the old trash " * 50))
    texts = [t for _, t, _ in odd_rows if t] + ["such a i d i o t", "k i l l, y o u! a b", "a b", "x. y. z. stuupid 1d10t 1d10t", "I a m. s t u p i d I", "", " ", "s-t u p i d"]
    values = toxicity.TokenValues(toxicity.Restorer(model), tuple)
    for text in texts * 2:
        assert {w for words in values.values(text) for w in words} == set(toxicity.Restorer(model).words(text)), text[:80]


def test_shares_rise():
    got = toxicity.rising(np.array([0, 2, 1, 0, 5]), np.array([10, 10, 10, 0, 5]))
    assert np.allclose(got, [0, 0.15, 0.15, 0.15, 1.0])


def test_viterbi_restores_words():
    text = "the idiot was stupid and a moron in the old trash " * 50
    model = toxicity.CharacterModel(toxicity.trigram_counts(text))
    for written, word in {"1d10t": "idiot", "stuuupid": "stupid", "m.o.r.o.n": "moron", "tr@$h": "trash", "idiot": "idiot"}.items():
        assert toxicity.decode_token(written, model) == word
    assert toxicity.is_plain("idiot") and not toxicity.is_plain("idiooot") and not toxicity.is_plain("1diot")


def test_licenses(odd_docs, no_docs, spark):
    texts = [
        "a CC-BY b cc by, CC  by", "The General Public License; general public\nlicense general public", "All Rights Reserved", "allrights reserved cc byte", "",
        "Permission is hereby granted, free of charge, to any good person obtaining a copy of this software and associated documentation files", "permission is hereby granted by the king " + "x " * 50, "cc", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    out = licenses.scan_licenses(docs)
    have = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out.collect())
    have = sorted(map(str, have))
    want = []
    for r in docs.collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().lower())
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.encode().split()
            found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        want.append(str((str(r.doc_id), len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))))
    assert have == sorted(want)
    (worn,) = out.where("doc_id = 5 and n_words > 0").collect()
    (other,) = out.where("doc_id = 6 and n_words > 0").collect()
    assert "mit" in worn.labels and worn.score > 0.75 and "mit" not in other.labels
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert licenses.scan_licenses(no_docs).count() == 0


def worn_labels(text, templates, coverage=0.75):
    """Labels of templates of which some stretch of the text, of at most twice the template's length, holds enough word pairs in order."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())
    found = set()
    for template, label in templates.items():
        t = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.encode().lower())
        pairs = list(zip(t, t[1:], strict=False))
        for begin in range(len(words)):
            ours = list(zip(words[begin:], words[begin + 1 : begin + 2 * len(t)], strict=False))
            best = [0] * (len(pairs) + 1)  # longest common subsequence
            for g in ours:
                row = best[:]
                for j, p in enumerate(pairs):
                    row[j + 1] = best[j] + 1 if p == g else max(best[j + 1], row[j])
                best = row
            if best[-1] >= coverage * len(pairs):
                found.add(label)
                break
    return found


def test_worn_licenses_by_brute_force(spark):
    rng = np.random.default_rng(5)
    known = licenses.TEMPLATES
    filler = "the of a river stone under license copy software free".split()
    texts = ["under the x " * 8 + "under the released under the mit license", "under the x " * 200 + "released under the mit license " + "under the y " * 200]
    for template in list(known) * 4:
        words = template.split()
        for _ in range(int(rng.integers(0, 4))):  # wear it
            at = int(rng.integers(0, len(words)))
            kind = rng.integers(0, 3)
            words[at : at + 1] = [] if kind == 0 else [str(rng.choice(filler))] if kind == 1 else [words[at], str(rng.choice(filler))]
        texts.append(" ".join([*rng.choice(filler, rng.integers(0, 30)), *words, *rng.choice(filler, rng.integers(0, 30))]))
    texts += [" ".join(sorted(list(known)[0].split())), " ".join(reversed(list(known)[1].split()))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.scan_licenses(docs, phrases={}, templates=known).collect()}
    for i, text in enumerate(texts):
        assert set(filter(None, out[i].labels.split(","))) == worn_labels(text, known), text
        assert all(s.coverage >= 0.75 and s.first <= s.last < out[i].n_words for s in out[i].spans)
    assert "mit" in out[0].labels and "mit" in out[1].labels and not out[len(texts) - 1].labels


def test_whole_licenses(spark):
    texts = [t for t in licenses.WHOLE_TEXTS]
    texts = [*texts, *(" ".join(w for i, w in enumerate(t.split()) if i % 20) for t in texts)]  # every twentieth word is lost
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=licenses.WHOLE_TEXTS).collect()
    for r in out:
        assert list(licenses.WHOLE_TEXTS.values())[r.doc_id % len(licenses.WHOLE_TEXTS)] in r.labels.split(",")


def test_scores(odd_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    held = crc_mod("doc_id", 7) == 2
    out = lm_scoring.score_texts(odd_docs, held, path).collect()
    rows = odd_docs.collect()
    counts = Counter()
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update(lm_scoring.words_of(r.text))
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        words = [*lm_scoring.words_of(r.text), None]
        want.append((str(r.doc_id), len(words), sum(counts[w] > 0 for w in words), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), 3)))
    have = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in out]
    assert sorted(want) == sorted(have)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert lm_scoring.score_texts(no_docs, held, path).count() == 0


def test_windows_score_each_token_once():
    rng = np.random.default_rng(0)
    lengths = [1, 5, 23, 24, 25, 31, 32, 33, 100, 61]
    starts = np.r_[0, np.cumsum(lengths)]
    ranks = rng.integers(1, 900, starts[-1])
    inputs, targets, counts, text = windows(ranks, starts)
    got = [targets[text == i][counts[text == i]].tolist() for i in range(len(lengths))]
    assert got == [ranks[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


def test_attention_is_causal_and_normalised():
    rng = np.random.default_rng(0)
    n = 2500  # ranks in the head, in whole branches and in one that isn't full
    w = start_weights(np.ones(n))
    flat = rng.integers(1, 40, 400)
    flat[::7] = rng.integers(40, n, len(flat[::7]))
    inputs, targets, counts, _ = windows(flat, np.array([0, 400]))
    w = train(w, inputs, targets, counts, 0.02)
    scorer = Scorer(w)
    total = sum(10 ** scorer.log10_probabilities(inputs[:1], np.full_like(targets[:1], r), counts[:1])[7] for r in range(n))
    assert abs(total - 1) < 1e-4
    changed = inputs[:1].copy()
    changed[0, 20:] = 3
    a, b = (scorer.log10_probabilities(x, targets[:1], counts[:1]) for x in (inputs[:1], changed))
    assert np.allclose(a[:20], b[:20], atol=1e-6) and not np.allclose(a[20:], b[20:], atol=1e-6)


def test_training_gradients():
    """A pass of training lowers the loss on text with structure."""
    flat = np.tile([5, 9, 2, 7], 500)
    inputs, targets, counts, _ = windows(flat, np.array([0, 2000]))
    w = start_weights(np.ones(1025))
    before = Scorer(w).log10_probabilities(inputs, targets, counts).mean()
    for i in range(6):
        w = train(w, inputs, targets, counts, 0.03, batch=16, seed=i)
    assert Scorer(w).log10_probabilities(inputs, targets, counts).mean() > before / 3


def test_scores_without_training_rows(odd_docs):
    out = lm_scoring.score_texts(odd_docs, F.lit(True), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(out) == odd_docs.count() and all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert {(r.n_known, r.train_tokens, r.base_score) for r in out} == {(0, 0, 0.0)}


def test_gradients_by_differences():
    """A step of training goes down the slope that small changes of the weights show, in every weight and at every level of the softmax."""
    rng = np.random.default_rng(4)
    flat = np.r_[rng.integers(1, 100, 60), rng.integers(100, 1500, 60), 0]
    inputs, targets, counts, _ = windows(flat, np.array([0, len(flat)]))
    w = start_weights(np.ones(1500), seed=3)
    loss = lambda v: -Scorer(v).log10_probabilities(inputs, targets, counts).sum()
    after = train(w, inputs, targets, counts, 1e-2, batch=len(inputs))  # Adam's first step has the sign of the gradient
    step = flatten(after) - flatten(w)
    for key in w:
        only = w | {key: after[key]}
        assert loss(only) < loss(w), key
    assert loss(after) < loss(w) and np.allclose(flatten(unflatten(flatten(w) + step, w)), flatten(after), atol=1e-6)


def test_changes_add_up():
    rng = np.random.default_rng(6)
    total, want = np.zeros((50, WIDTH)), np.zeros((50, WIDTH))
    for times in (0.25, 0.75):
        change = np.where(rng.random((50, 1)) < 0.3, rng.standard_normal((50, WIDTH)), 0).astype(np.float32)
        add_changes(total, pack_changes(change), times)
        want += times * change
    assert np.allclose(total, want)


def test_attention_beats_word_counts_on_held_out_texts(spark):
    """On given tables the attention model alone gives held-out texts a higher probability than word counts do."""
    docs = docs_of(spark, "/root/testdata/sf0.01")
    out = lm_scoring.score_texts(docs, crc_mod("doc_id", 7) == 2, public_tokenizers.path("piece_bpe_32k.model"))
    base, score = out.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_sql(name, spark, sf_dir, duck):
    from compare import rows

    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(SQL[name]).df())
