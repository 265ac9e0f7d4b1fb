"""Language identification (operator 10): multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, tidy
from .wordhash import U64

CHUNK_CHARS = 1 << 18  # what is counted at a time takes some hundred bytes a character
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)


def ngram_buckets(texts: list[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the lower-cased texts, and where each text's begin (one more at the end).

    All but letters counts as a single blank; blanks also stand at a text's ends. A text without letters has none.
    """
    codes = np.frombuffer("\0".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # Lower-casing may change a text's length, so texts are told apart by a separator that texts hold no more.
    blank = ~_letters()[codes]
    keep = np.ones(len(codes), bool)
    edge = codes == 0
    keep[1:] = ~(blank[1:] & blank[:-1]) | edge[1:] | edge[:-1]
    codes, blank, edge = codes[keep], blank[keep], edge[keep]
    row = np.cumsum(edge) - 1
    codes = np.where(blank, np.uint32(32), codes).astype(np.uint64)
    rows, found = [], []
    for n in orders:
        total = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        real = np.zeros(len(total), bool)
        with np.errstate(over="ignore"):
            for i in range(n):
                part = slice(i, len(codes) - n + 1 + i)
                total = (total + codes[part] + U64(1)) * U64(0x9E3779B97F4A7C15)
                total ^= total >> U64(29)
                real |= ~blank[part]
        # an n-gram may begin with a text's first separator or end with its last, but not span one
        for i in range(1, n - 1):
            real &= ~edge[i : len(codes) - n + 1 + i]
        found.append((total[real] >> U64(40)) % U64(buckets))
        rows.append(row[: len(total)][real])
    bucket, at = np.concatenate(found).astype(np.int64), np.concatenate(rows)
    order = np.argsort(at, kind="stable")
    return bucket[order], np.searchsorted(at[order], np.arange(len(texts) + 1))


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about CHUNK_CHARS characters, null as empty, without NUL."""
    held: list[str] = []
    size = first = 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        held.append(text.replace("\0", " ") if "\0" in text else text)
        size += len(text)
        if size >= CHUNK_CHARS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _counts(orders: tuple[int, ...], buckets: int):
    schema = pa.schema([("lang", pa.string()), ("docs", pa.int64()), ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in _texts(batch.column(1)):
                bucket, cut = ngram_buckets(texts, orders, buckets)
                here = langs[first : first + len(texts)]
                for lang in set(here):
                    mine = np.fromiter((x == lang for x in here), bool, len(here))
                    docs[lang] = docs.get(lang, 0) + int(mine.sum())
                    got = np.bincount(bucket[np.repeat(mine, np.diff(cut))], minlength=buckets)
                    sums[lang] = sums[lang] + got if lang in sums else got
        for lang, total in sums.items():
            has = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([docs[lang]]), pa.array([has.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[has]], pa.list_(pa.int64()))], schema=schema)

    return tidy("language", run)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # (languages, buckets): log probabilities
    prior: np.ndarray
    orders: tuple[int, ...]

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability for each text; `und` and 0 without letters."""
        bucket, cut = ngram_buckets(texts, self.orders, self.weights.shape[1] if len(self.langs) else 1)
        some = np.diff(cut) > 0
        if not len(self.langs) or not some.any():
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        logs = np.stack([np.add.reduceat(w[bucket], cut[:-1][some]) for w in self.weights], 1) + self.prior
        best = logs.argmax(1)
        share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for i, b in zip(np.flatnonzero(some), best, strict=True):
            langs[i] = self.langs[b]
        scores[some] = share
        return langs, scores


def train_language_model(docs: DataFrame, text_col: str, lang_col: str, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, smoothing: float = 0.5) -> LanguageModel:
    """Count hashed n-grams of every row with a language; what reaches the driver is languages x buckets numbers."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    parts = rows.mapInArrow(_counts(orders, buckets), "lang string, docs long, bucket array<int>, n array<long>")
    # the pairs are few in a task, so both sums are taken from one pass
    pairs = parts.select("lang", F.explode(F.expr("array_append(arrays_zip(bucket, n), named_struct('bucket', -1, 'n', docs))")).alias("x"))
    got = pairs.groupBy("lang", "x.bucket").agg(F.sum("x.n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    counts, seen = np.zeros((len(langs), buckets)), np.zeros(len(langs))
    where = np.array([langs.index(x) for x in got["lang"].to_pylist()], int)
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    counts[where[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    seen[where[bucket < 0]] = n[bucket < 0]
    weights = np.log(counts + smoothing) - np.log(counts.sum(1, keepdims=True) + smoothing * buckets)
    return LanguageModel(langs, weights, np.log(seen / max(1.0, seen.sum()) + 1e-12), orders)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for each row of `docs`, from its whole text.

    Null texts, and texts without a letter, are `und` with score 0; so is all where the model has seen no
    language. Ties go to the language that sorts first. Null and repeated ids keep their rows; other columns
    are ignored. Texts of any length are read to their end, a part at a time. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _texts(batch.column(1)):
                langs, scores = shared.value.score(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(langs, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidy("language", run), f"`{id_col}` {kind}, lang_pred string, score double")


def keep_determined(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has a language: those that `identify_language` doesn't call `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _texts(batch.column(at)):
                langs, _ = shared.value.score(texts)
                yield batch.slice(first, len(texts)).filter(pa.array([x != UNDETERMINED for x in langs], pa.bool_()))

    return docs.mapInArrow(tidy("language", run), docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.where(crc_mod("doc_id", 5) != 0), "text", "lang")
    return identify_language(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
