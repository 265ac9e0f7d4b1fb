"""Toxicity scoring (operator 5): noisy-channel deobfuscation by Viterbi decoding, then a lexicon learned from labels."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, drop_scratch, materialise, table, tidy

#: What a written symbol may stand for. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
#: Marks that may be put between the letters of a word.
SPACERS = set(".-_*~'`^,:;/\\")
#: log10 costs of the channel: a symbol for a letter, a spacer put in, a letter repeated once more.
SUBSTITUTED, SPACED, REPEATED, SYMBOL_KEPT = -0.7, -0.7, -0.5, -2.6

_EDGES = ".,;:!?\"'()[]{}<>*-_~`|/\\%#&$=+"
_PLAIN = re.compile(r"[^\W\d_]+", re.UNICODE)
_DOUBLE, _TRIPLE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
_CACHE_LIMIT = 300_000
LETTERS = 28  # a-z, any other letter, a word's border


def _code(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26


_ASCII_CODE = np.full(256, 27, np.int64)
_ASCII_CODE[97:123] = np.arange(26)
_ASCII_CODE[65:91] = np.arange(26)
_ASCII_CODE[128:] = 26  # bytes of other characters: their runs count as one letter


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the letter trigrams of a text, words bordered by 27."""
    data = np.frombuffer(b"  " + text.encode("utf-8", "replace") + b"  ", np.uint8)
    code = _ASCII_CODE[data]
    follow = np.ones(len(code), bool)
    follow[1:] = ~((data[1:] >= 128) & (data[1:] < 192))  # only a character's first byte
    code = code[follow]
    at = (code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:]
    return np.bincount(at, minlength=LETTERS**3)


class CharacterModel:
    """log10 P(letter | two letters before); a tenth is added to each count."""

    def __init__(self, counts: np.ndarray) -> None:
        table_ = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float) + 0.1
        self.logs = np.log10(table_ / table_.sum(2, keepdims=True)).tolist()


def is_plain(token: str) -> bool:
    """Whether a token's lattice has one path only: letters alone, none twice in a row."""
    return bool(_PLAIN.fullmatch(token)) and not _DOUBLE.search(token)


def _undoubled(token: str, logs: list) -> str:
    """decode_token for letters alone, none three times in a row: what follows a pair sees the same letters either way, so each pair decides alone."""
    codes = [LETTERS - 1, *map(_code, token), LETTERS - 1]
    out = []
    for i, c in enumerate(token):
        if i and c == token[i - 1]:
            before, own, after = codes[i - 1], codes[i], codes[i + 2]
            if logs[before][own][own] + logs[own][own][after] < logs[before][own][after] + REPEATED:
                continue
        out.append(c)
    return "".join(out)


def decode_token(token: str, model: CharacterModel, spaced: bool = False) -> str:
    """The likeliest word for a token, by Viterbi search over its lattice of letters.

    If the token's symbols were written apart (`spaced`), a word may also end before each of them; a blank in the result
    stands there.

    Every symbol is a letter (itself, or those it may stand for), is kept as a symbol that ends a word, or
    is dropped: a spacer between letters, or a letter that repeats the one before. States are the last two
    letters; the score is the character model's log-probability plus the channel's costs.
    """
    logs = model.logs
    if token.isalpha() and not spaced and not _TRIPLE.search(token):
        return _undoubled(token, logs)
    border = LETTERS - 1
    states: dict[tuple[int, int], tuple[float, tuple]] = {(border, border): (0.0, ())}
    inner = len(token)
    for i, c in enumerate(token):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        if spaced and i:
            score, path = max(((s + logs[a][b][border], p) for (a, b), (s, p) in states.items() if b != border), key=lambda x: x[0], default=(0.0, None))
            if path is not None and ((border, border) not in states or states[border, border][0] < score):
                states[border, border] = (score, (path, " "))

        def offer(state: tuple[int, int], score: float, path: tuple, after: dict = after) -> None:
            if state not in after or after[state][0] < score:
                after[state] = (score, path)

        letters = c if c.isalpha() else ""
        drop = REPEATED if i and c == token[i - 1] and letters else SPACED if c in SPACERS and 0 < i < inner - 1 else None
        for (a, b), (score, path) in states.items():
            row = logs[a][b]
            for x in letters:
                offer((b, _code(x)), score + row[_code(x)], (path, x))
            for x in LEET.get(c, ""):
                offer((b, _code(x)), score + row[_code(x)] + SUBSTITUTED, (path, x))
            if drop is not None:
                offer((a, b), score + drop, path)
            if not letters:
                offer((border, border), score + row[border] + SYMBOL_KEPT, (path, c))
        states = after
    _, path = max(((s + logs[a][b][border], p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def _is_single(token: str) -> bool:
    """Whether a token is one symbol, which a mark may follow."""
    return len(token) == 1 or (len(token) == 2 and token[1] in _EDGES)


class Restorer:
    """Whole texts to words, with obfuscated words restored; remembers decoded tokens up to a bound."""

    def __init__(self, model: CharacterModel | None) -> None:
        self.model = model
        self.seen: dict[str, list[str]] = {}

    def _words(self, token: str, spaced: bool = False) -> list[str]:
        core = token.strip(_EDGES)
        if not core and not any(c in LEET for c in token):
            return []
        if self.model is None or (is_plain(core) and not spaced):
            return [core] if core else []
        whole = token.rstrip(".,;:?\"'") if any(c in LEET for c in token) else core
        restored = [w for w in re.split(r"[\W\d_]+", decode_token(whole, self.model, spaced)) if w]
        # what stands plainly in the token counts too
        return restored + [w for w in re.split(r"[\W\d_]+", core) if len(w) > 2 and w not in restored]

    def words(self, text: str) -> list[str]:
        """The words of a text, and the letters that are written apart."""
        out: list[str] = []
        single: list[str] = []
        seen = self.seen
        if len(seen) > _CACHE_LIMIT:
            seen.clear()
        for token in text.lower().split():
            if _is_single(token):
                single.append(token[0])
                continue
            if len(single) > 2:
                out += self._words("".join(single), spaced=True)
            if single:
                out += single
                single = []
            got = seen.get(token)
            if got is None:
                got = seen[token] = self._words(token)
            out += got
        if len(single) > 2:
            out += self._words("".join(single), spaced=True)
        return out + single


class TokenValues:
    """What `of` makes of the words of each different token of a text, and of those of each run of letters written apart.

    Together they have the same words as `Restorer.words`; each token's value is remembered up to a bound, as most recur.
    """

    def __init__(self, restorer: Restorer, of: Callable[[list[str]], Any]) -> None:
        self.restorer, self.of = restorer, of
        self.seen: dict[str, Any] = {}
        self.single: set[str] = set()

    def _learn(self, token: str) -> Any:
        if _is_single(token):
            self.single.add(token)
            value = self.of([token[0]])
        else:
            value = self.of(self.restorer._words(token))
        self.seen[token] = value
        return value

    def values(self, text: str) -> list:
        tokens = text.lower().split()
        different = set(tokens)
        if len(self.seen) > _CACHE_LIMIT:
            self.seen.clear()
            self.single.clear()
        out = list(map(self.seen.get, different))
        if None in out:
            out = [v for v in out if v is not None] + [self._learn(t) for t in different if t not in self.seen]
        if not self.single.isdisjoint(different):
            for single, run in itertools.groupby(tokens, self.single.__contains__):
                letters = "".join(t[0] for t in run) if single else ""
                if len(letters) > 2:
                    out.append(self.of(self.restorer._words(letters, spaced=True)))
        return out


STEMS = (4, 5, 6)


def features(word: str) -> list[str]:
    """A word and its beginnings, the latter marked."""
    n = len(word)
    return [word, *(f"{word[:k]}~" for k in STEMS if n > k)]


def _learn_toxic(model):
    """Features of toxic texts: in how many texts, and a bitmap of the words before them."""
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64()), ("contexts", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        n: dict[str, int] = {}
        bits: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array(bits.values(), pa.int64())], schema=schema)
            n.clear()
            bits.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                mine: dict[str, int] = {}
                before = ""
                for word in restorer.words(value.as_py() or ""):
                    bit = 1 << zlib.crc32(before.encode()) % 61
                    for f in features(word):
                        mine[f] = mine.get(f, 0) | bit
                    before = word
                for f, b in mine.items():
                    n[f] = n.get(f, 0) + 1
                    bits[f] = bits.get(f, 0) | b
                if len(n) > 1_000_000:
                    yield flush()
        yield flush()

    return tidy("toxicity", run)


def _count_clean(model, wanted):
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value
        kept = TokenValues(Restorer(model.value), lambda words: tuple({f for w in words for f in features(w)} & keep))
        n: dict[str, int] = {}
        for batch in batches:
            for value in batch.column(0):
                for f in {f for found in kept.values(value.as_py() or "") for f in found}:
                    n[f] = n.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], schema=schema)

    return tidy("toxicity", run)


def _trigrams():
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += trigram_counts(value.as_py() or "")
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], schema=schema)

    return tidy("toxicity", run)


BINS = 400


def _weigh(model, weights):
    """Counts of texts by label and by the bin of their largest weight."""
    schema = pa.schema([("bin", pa.int32()), ("toxic", pa.bool_()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = TokenValues(Restorer(model.value), ToxicityModel(model.value, weights.value).weight)
        n: dict[tuple[int, bool], int] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                key = (int(max(weigher.values(text.as_py() or ""), default=0.0) * BINS), toxic)
                n[key] = n.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in n], pa.int32()), pa.array([t for _, t in n], pa.bool_()), pa.array(n.values(), pa.int64())], schema=schema)

    return tidy("toxicity", run)


def rising(toxic: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Share of toxic texts in each bin, made to rise from bin to bin by pooling neighbours; empty bins take the share below."""
    pools: list[list[float]] = []  # toxic, all, bins
    for t, n in zip(toxic.tolist(), all_.tolist(), strict=True):
        pools.append([t, n, 1])
        while len(pools) > 1 and (pools[-1][1] == 0 or pools[-2][1] == 0 or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
            t2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), t / n if n else 0.0) for t, n, k in pools])


@dataclass
class ToxicityModel:
    characters: CharacterModel | None
    weights: dict[str, float] = field(default_factory=dict)
    shares: np.ndarray | None = None  # of toxic texts, by the bin of the largest weight

    def weight(self, words: list[str]) -> float:
        """The largest weight of the words' features."""
        weights = self.weights
        return max((weights[f] for w in set(words) for f in features(w) if f in weights), default=0.0)

    def score(self, w: float) -> float:
        """The share of toxic texts among training texts whose largest weight is about w; the weight itself parts equal shares."""
        if self.shares is None:
            return 0.0
        return 0.999 * float(self.shares[int(w * BINS)]) + 0.001 * w


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", min_texts: int = 3, min_contexts: int = 3, max_features: int = 200_000) -> ToxicityModel:
    """Learn the lexicon from labelled texts.

    A feature (a restored word or a word's beginning) weighs the lower confidence bound of the share of toxic
    texts among the texts that have it. It must stand in min_texts toxic texts and after min_contexts
    different words, which a passage that is merely copied does not, and its share must exceed that of all
    texts by more than chance, given how many features are tried. max_features bounds the model: the
    features of most toxic texts are kept, down to a count at which they are no more than that. All labelled rows are counted. A text's score is the share of toxic ones among
    the labelled texts whose largest weight is about the same, made to rise with the weight. A text with several labels is toxic
    if one of them says so; null labels are ignored.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # sorted and merged at every size: labels grow with the corpus, and so must not be broadcast
    rows = materialise(texts.join(known.hint("merge"), "id").select("text", "toxic"), "labelled")
    toxic, clean = rows.where("toxic").select("text"), rows.where("not toxic").select("text")
    total = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = total.get(True, 0), total.get(False, 0)
    if not n_toxic:
        return ToxicityModel(None)
    got = rows.select("text").mapInArrow(_trigrams(), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(LETTERS**3)
    counts[got["at"].to_numpy()] = got["n"].to_numpy()
    characters = CharacterModel(counts)
    model = spark.sparkContext.broadcast(characters)
    found = (
        toxic.mapInArrow(_learn_toxic(model), "feature string, n long, contexts long")
        .groupBy("feature").agg(F.sum("n").alias("n"), F.bit_count(F.expr("bit_or(contexts)")).alias("contexts"))
        .where((F.col("n") >= min_texts) & (F.col("contexts") >= min_contexts)).select("feature", "n", F.floor(8 * F.log2("n")).alias("class"))
    )
    found = materialise(found, "features")
    held, least = 0, None
    for row in found.groupBy("class").count().orderBy(F.desc("class")).collect():  # at most 8 * 63 classes of counts
        held += row["count"]
        if held > max_features:
            break
        least = row["class"]
    table_ = found.where(F.col("class") >= F.lit(least).cast("long")).select("feature", "n").toArrow()
    drop_scratch(found)
    bad = dict(zip(table_["feature"].to_pylist(), table_["n"].to_pylist(), strict=True))
    wanted = spark.sparkContext.broadcast(frozenset(bad))
    got = clean.mapInArrow(_count_clean(model, wanted), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    good = dict(zip(got["feature"].to_pylist(), got["n"].to_pylist(), strict=True))
    prior = n_toxic / (n_toxic + n_clean)
    weights = {}
    beyond_chance = math.log(max(1, len(bad))) + 2
    for f, n in bad.items():
        m = n + good.get(f, 0)
        share = n / m
        if share <= prior or prior == 1:
            continue
        surprise = m * (share * math.log(share / prior) + ((1 - share) * math.log((1 - share) / (1 - prior)) if share < 1 else 0))
        if surprise > beyond_chance:
            p = (n + prior) / (m + 1)
            weights[f] = p - math.sqrt(p * (1 - p) / (m + 1))
    got = rows.mapInArrow(_weigh(model, spark.sparkContext.broadcast(weights)), "bin int, toxic boolean, n long").groupBy("bin", "toxic").agg(F.sum("n").alias("n")).toArrow()
    drop_scratch(rows)
    counts = np.zeros((2, BINS + 1))
    counts[got["toxic"].to_numpy(zero_copy_only=False).astype(int), got["bin"].to_numpy()] = got["n"].to_numpy()
    return ToxicityModel(characters, weights, rising(counts[1], counts.sum(0)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id_col, score, predicted) for each row of `docs`, from its whole text.

    Null, empty and unknown texts get the model's lowest score. Null and repeated ids keep their rows, equal
    texts get equal scores, texts of any length are read to their end, other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weigher = TokenValues(Restorer(model.characters), model.weight)
        for batch in batches:
            scores = [model.score(max(weigher.values(value.as_py() or ""), default=0.0)) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy("toxicity", run), f"`{id_col}` {kind}, score double, predicted int")


def keep_harmless(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all their columns, that `score_toxicity` doesn't predict toxic. Null and empty texts, null and repeated ids are judged as there."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weigher = TokenValues(Restorer(model.characters), model.weight)
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):  # rows come back with their texts, so few at a time
                batch = whole.slice(first, 1000)
                yield batch.filter(pa.array([model.score(max(weigher.values(value.as_py() or ""), default=0.0)) < threshold for value in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy("toxicity", run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs.where(crc_mod("doc_id", 4) != 2), labels)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
