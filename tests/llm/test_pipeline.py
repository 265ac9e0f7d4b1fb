"""The pipeline's stages against what each must keep, on the given documents and on odd rows."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pyarrow as pa

import corpus_pipeline as P
from papyrarc.llm.common import crc_mod, table
from papyrarc.llm.language_id import identify_language, train_language_model
from papyrarc.llm.toxicity import score_toxicity, train_toxicity

from .test_near_dedup import brute
from .test_texts import check_packing


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["language", "toxicity", "near_dedup", "packing"]


def test_each_stage_by_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = P.language(spark, docs, sf_dir).cache()
    model = train_language_model(docs.where(crc_mod("doc_id", 5) != 0), "text", "lang")
    want = {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    assert model.langs == sorted({r.lang for r in docs.select("lang").distinct().collect() if r.lang})
    two = P.toxicity(spark, one, sf_dir).cache()
    toxic = train_toxicity(one.where(crc_mod("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    gone = {r.doc_id for r in score_toxicity(one, toxic).where("predicted = 1").collect()}
    assert {r.doc_id for r in two.collect()} == want - gone and two.columns == docs.columns
    three = P.near_dedup(spark, two, sf_dir).cache()
    groups = brute([(r.doc_id, r.text) for r in two.collect()], percent=80)
    assert {str(r.doc_id) for r in three.collect()} == {i for i, _, c in groups if i == c} and three.columns == docs.columns
    n, least = check_packing(P.packing(spark, three, sf_dir), three, public_tokenizers.path("word_bpe_49k.json"), 2048)
    assert n <= least + 1


def test_run_equals_the_stages(spark, sf_dir):
    out = P.run(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def test_odd_rows(spark, odd_docs, no_docs, sf_dir):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "score")
    one = P.language(spark, docs, sf_dir)
    assert one.columns == docs.columns
    kept = Counter(r.doc_id for r in one.collect())
    assert kept[7] == 2 and not {4, 5, 6, 11} & set(kept) and kept[1] == 1
    three = P.near_dedup(spark, P.toxicity(spark, one, sf_dir), sf_dir)
    left = Counter(r.doc_id for r in three.collect())
    assert left[1] == 1 and not left[2] and not left[3]
    assert P.packing(spark, three, sf_dir).count() > 0
    for _, stage in P.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0


def test_rows_are_judged_by_their_own_text(spark, sf_dir):
    """One id with a clean and a toxic text, copies without an id, repeated rows, and columns with clashing names."""
    rows, tags = [], []
    for i in range(400):
        words = " ".join("bcdfgmnprst"[(i + k) % 11] + "aeiou"[(i * k) % 5] + "lnrst"[(i * 3 + k * k) % 5] + "aeo"[k % 3] for k in range(30))
        rows.append((i, words + (" vile" if i % 4 == 0 else "")))
        tags.append((i, int(i % 4 == 0)))
    extra = [(1000, "a gentle text about rivers and stones that nobody minds"), (1000, "a vile text about rivers and hills that everybody minds"), (None, "copies of a text that have no number at all here"), (None, "copies of a text that have no number at all here"), (None, "12 34"), (1001, "Copies of a text that have no number at all here"), (1002, "the same row twice in the table is kept once"), (1002, "the same row twice in the table is kept once")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows + extra], "doc_id long, text string, lang string, source string, score int, id string, _row int").repartition(3)
    labels = str(spark.conf.get("spark.checkpoint.dir")).removeprefix("file://") + "/small"
    spark.createDataFrame(tags, "doc_id long, toxic int").write.mode("overwrite").parquet(labels + "/labels.parquet")
    one = P.language(spark, docs, sf_dir)
    assert one.where("text = '12 34'").count() == 0 and one.count() == docs.count() - 1
    two = P.toxicity(spark, one, "file://" + labels)
    assert [r.text for r in two.where("doc_id = 1000").collect()] == [extra[0][1]]
    three = P.near_dedup(spark, two, sf_dir).where("doc_id >= 1000 or doc_id is null")
    assert Counter(r.doc_id for r in three.collect()) == {1000: 1, 1001: 1, 1002: 1} and three.columns == docs.columns


def test_near_dedup_takes_a_similarity_of_four_fifths(spark, sf_dir):
    words = [f"w{i}" for i in range(40)]
    near = [*words[:36], "other"]  # 32 shingles of 36 and 33 are shared, 37 in all
    far = [*words[:30], *(f"v{i}" for i in range(10))]
    docs = spark.createDataFrame([(3, " ".join(near)), (1, " ".join(words)), (2, " ".join(far))], "doc_id long, text string")
    assert {r.doc_id for r in P.near_dedup(spark, docs, sf_dir).collect()} == {1, 2}
    edge = [*words[:36], *(f"u{i}" for i in range(4))]  # 32 of 40: exactly 0.8
    docs = spark.createDataFrame([(5, " ".join(edge)), (4, " ".join(words))], "doc_id long, text string")
    assert {r.doc_id for r in P.near_dedup(spark, docs, sf_dir).collect()} == {4}


def test_identify_keeps_null_ids(spark, odd_docs):
    model = train_language_model(odd_docs, "text", "lang")
    assert identify_language(odd_docs, model).where("doc_id is null").count() == 2


def test_every_stage_forgets_what_the_others_remember(monkeypatch):
    from papyrarc.llm import common, language_id, near_dedup

    forgotten = []
    monkeypatch.setitem(common.REMEMBERED, "probe", lambda: forgotten.append(1))
    counted = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["a stone"])], names=["lang", "text"])
    assert list(language_id._counts((1,), 8)(iter([counted]))) and len(forgotten) == 1
    sketched = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a stone"])], names=["id", "text"])
    assert list(near_dedup._sketch(2, 2, 2)(iter([sketched]))) and len(forgotten) == 2
