"""Language-model scoring (operator 2): a causal self-attention model over subword ids, beside a unigram base."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import END, HEAD, Adam, Scorer, Weights, add_changes, bigram_weights, flatten, pack_changes, start_weights, train_more, tree_place, unflatten, windows
from .common import crc_mod, drop_scratch, materialise, table

DICTIONARY, LONGEST = 200_000, 64  # words that every task knows: at most so many of at most so many bytes
PART = 4 << 20  # bytes of text that are split at a time
FLUSH = 400_000


@functools.lru_cache(maxsize=2)
def _pieces(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return (text or "").encode().lower().split()


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """As many texts at a time as have about PART bytes, and where they begin."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """`words_of` for many texts, laid end to end, and how many each text has."""
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    split = pc.ascii_split_whitespace(lower)
    words = split.flatten()
    n = pc.list_value_length(split).to_numpy().astype(np.int64)
    empty = pc.equal(pc.binary_length(lower), 0)  # is split into one empty word
    if pc.any(empty).as_py():
        n -= empty.to_numpy(zero_copy_only=False)
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).dictionary_encode(), n


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = 0
    for batch in batches:
        docs += len(batch)
        for _, texts in _parts(batch.column(0)):
            words, _ = _words(texts)
            counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([docs], pa.int64())], names=["word", "n"])


def _count_pieces(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = _pieces(model_file)
        total = np.zeros(lib.get_piece_size(), np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ids = lib.encode([w.decode() for w in words], num_threads=1)
            if ids:
                total += np.bincount(np.concatenate([np.asarray(x, np.int64) for x in ids]), weights=np.repeat(n, [len(x) for x in ids]), minlength=len(total)).astype(np.int64)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["piece", "n"])

    return run


class Ranks:
    """Ranks of all subword ids: END, the most frequent ones by falling frequency, then all others by their letters, so that neighbours in the softmax's tree begin alike."""

    def __init__(self, names: list[str], counts: np.ndarray, n_docs: int) -> None:
        order = np.lexsort((np.arange(len(names)), -counts))
        own = order[: HEAD - 1]
        others = sorted(order[HEAD - 1 :].tolist(), key=names.__getitem__)
        order = np.r_[own, np.array(others, np.int64)]
        self.rank = np.empty(len(names), np.int64)
        self.rank[order] = np.arange(1, len(names) + 1)
        self.mass = np.r_[float(n_docs), counts[order]] + 0.5


class WordTable:
    """Words by number: where their ranks lie in a pool, and log10 of their share in the lexicon (nan if not in it).

    Number 0 is the end of a text. A table starts with the lexicon's words and learns others, which it forgets when they grow too many.
    """

    def __init__(self, lib, ranks: Ranks, lexicon: list[bytes] = (), logs: np.ndarray | None = None, end_log: float = np.nan) -> None:
        self.lib, self.ranks = lib, ranks
        self.at: dict[bytes, int] = {}
        self.pool = np.array([END], np.int32)
        self.starts, self.sizes, self.logs = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([end_log])
        if len(lexicon):
            self._learn(list(lexicon), logs)
        self.first = (dict(self.at), self.pool, self.starts, self.sizes, self.logs)

    def _learn(self, words: list[bytes], logs: np.ndarray | None = None) -> None:
        ids = self.lib.encode([w.decode() for w in words], num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum()))
        self.at.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.r_[self.starts, len(self.pool) + np.cumsum(sizes) - sizes]
        self.pool = np.r_[self.pool, self.ranks.rank[flat].astype(np.int32)]
        self.sizes = np.r_[self.sizes, sizes]
        self.logs = np.r_[self.logs, np.full(len(words), np.nan) if logs is None else logs]

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        """Numbers of distinct words."""
        if len(self.at) > FLUSH + DICTIONARY:
            at, self.pool, self.starts, self.sizes, self.logs = self.first
            self.at = dict(at)
        new = [w for w in distinct if w not in self.at]
        if new:
            self._learn(new)
        return np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the words laid end to end, and how many each word has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)
        return self.pool[place].astype(np.int64), sizes


def _rank_type(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def _packed(ranks: np.ndarray, starts: np.ndarray, n_ranks: int) -> pa.Array:
    """The ranks of each text as bytes, of as many ranks as the vocabulary has."""
    data = ranks.astype(_rank_type(n_ranks))
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((data.itemsize * starts).astype("<i4")), pa.py_buffer(data)])


def _unpacked(column: pa.Array, n_ranks: int, most: int = 160_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranks of texts laid end to end and where each text begins (one more at the end), as many texts at a time as have about `most` ranks."""
    kind = np.dtype(_rank_type(n_ranks))
    ends = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64) // kind.itemsize)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        end = min(len(column), int(np.searchsorted(ends, before + most)) + 1)
        yield np.frombuffer(b"".join(column.slice(at, end - at).to_pylist()), kind).astype(np.int64), np.r_[0, ends[at:end] - before]
        at = end


def _count_pairs(shared, outputs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_ranks = len(shared.value.mass)
        total = np.zeros(n_ranks * outputs, np.int64)
        for batch in batches:
            for flat, _ in _unpacked(batch.column(0), n_ranks):
                np.add.at(total, np.r_[END, flat[:-1]] * outputs + tree_place(flat)[0], 1)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["pair", "n"])

    return run


_CHANGES = "trainer long, n double, change binary"


def _changes(trainer: int, n: float, change: bytes) -> pa.Table:
    return pa.table({"trainer": pa.array([trainer], pa.int64()), "n": pa.array([n]), "change": pa.array([change], pa.binary())})


def _trainer(shared, round_: int, rate: float):
    def run(group: pa.Table) -> pa.Table:
        weights, n = shared.value, 0
        adam = Adam({k: v.copy() for k, v in weights.items()})
        for chunk in group["ranks"].chunks:
            for flat, starts in _unpacked(chunk, len(weights["E"])):
                inputs, targets, counts, _ = windows(flat, starts)
                train_more(adam, inputs, targets, counts, rate, seed=round_)
                n += len(flat)
        return _changes(group["trainer"][0].as_py(), float(n), pack_changes(flatten(adam.w) - flatten(weights)))

    return run


def _mean(n_rows: int, width: int):
    def run(group: pa.Table) -> pa.Table:
        total, n = np.zeros((n_rows, width)), group["n"].to_numpy()
        for own, change in zip(n.tolist(), group["change"], strict=True):
            add_changes(total, change.as_py(), own / n.sum())
        return _changes(group["group"][0].as_py(), float(n.sum()), pack_changes(total))

    return run


def train_attention(texts: DataFrame, rounds: int, ranks: Ranks, trainers: int, rate: float = 0.02, fan_in: int = 16) -> Weights:
    """Train on all texts (trainer, round, ranks: see `_encode`), each once.

    The weights start from a bigram model of all texts, whose counts are summed over all tasks: at most one for each
    subword and output of the softmax's head. Each round hands its texts to their trainers, which all start
    from the same weights; their changes are averaged by number of tokens, fan_in at a time, until one is left.
    Without rows the weights that the counts give are returned.
    """
    weights = start_weights(ranks.mass)
    spark = texts.sparkSession
    outputs = weights["U0"].shape[2]
    counted = texts.select("ranks").mapInArrow(_count_pairs(spark.sparkContext.broadcast(ranks), outputs), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(len(ranks.mass) * outputs)
    pairs[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    weights = bigram_weights(weights, pairs.reshape(-1, outputs))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(weights)
        state = texts.where(F.col("round") == r).select("trainer", "ranks").groupBy("trainer").applyInArrow(_trainer(shared, r, rate * (1 - 0.85 * r / rounds)), _CHANGES)
        flat = flatten(weights).astype(np.float64)
        left = trainers
        while left > 1:
            left = -(-left // fan_in)
            state = state.withColumn("group", F.pmod("trainer", F.lit(left))).groupBy("group").applyInArrow(_mean(*flat.shape), _CHANGES)
        for row in state.collect():  # one row
            add_changes(flat, row["change"], 1.0)
        weights = unflatten(flat, weights)
    return weights


HELD_OUT, RARE = -1, -2  # the rounds of rows that no trainer gets


def _encode(model_file: str, shared, denominator: float):
    """Two kinds of rows: a text's ranks, with its base over the words of the dictionary, and (round RARE) how often it has each other word."""
    names = ["row", "id", "held_out", "trainer", "round", "word", "n", "known", "base", "ranks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, words_, counts_, end_count = shared.value
        table_ = WordTable(_pieces(model_file), ranks, words_, np.log10((counts_ + 1) / denominator), math.log10((end_count + 1) / denominator))
        for batch in batches:
            for at, texts in _parts(batch.column(5)):
                k = len(texts)
                words, n = _words(texts)
                ends = np.cumsum(n + 1)
                begin = ends - n - 1
                of_word = table_.numbers(words.dictionary.to_pylist())
                index, text_of = words.indices.to_numpy(), np.repeat(np.arange(k), n)
                numbers = np.zeros(ends[-1], np.int64)  # 0 closes a text
                numbers[np.arange(len(index)) + text_of] = of_word[index]
                flat, sizes = table_.tokens(numbers)
                value = table_.logs[numbers]
                in_lexicon = ~np.isnan(value)
                base = np.add.reduceat(np.nan_to_num(value), begin)
                known = np.add.reduceat(in_lexicon.astype(np.int64), begin) - (end_count == 0)
                keys = [batch.column(c).slice(at, k) for c in range(5)]
                yield pa.RecordBatch.from_arrays([*keys, pa.nulls(k, pa.binary()), pa.array(n + 1), pa.array(known), pa.array(base), _packed(flat, np.r_[0, np.cumsum(sizes)[ends - 1]], len(ranks.mass))], names=names)
                # the words that aren't in the lexicon
                missing = np.flatnonzero(np.isnan(table_.logs[of_word])[index])
                pair, times = np.unique(text_of[missing] * len(words.dictionary) + index[missing], return_counts=True)
                own, word = np.divmod(pair, max(1, len(words.dictionary)))
                m = len(pair)
                none = [pa.nulls(m, t) for t in (keys[1].type, pa.bool_(), keys[3].type)]
                yield pa.RecordBatch.from_arrays([keys[0].take(pa.array(own)), *none, pa.array(np.full(m, RARE), pa.int32()), words.dictionary.cast(pa.binary()).take(pa.array(word)), pa.array(times, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.binary())], names=names)

    return run


def _score(shared):
    names = ["row", "id", "held_out", "n", "known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            at = 0
            for flat, starts in _unpacked(batch.column(6), len(scorer.embed)):
                inputs, targets, counts, _ = windows(flat, starts)
                score = np.add.reduceat(scorer.log10_probabilities(inputs, targets, counts), starts[:-1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(score)) for c in range(6)), pa.array(score)], names=names)
                at += len(score)

    return run


def _common(words: DataFrame) -> pa.Table:
    """The words of the highest counts: as many classes of counts, an eighth of a doubling each, as together hold DICTIONARY words at most."""
    short = words.where(F.col("word").isNotNull() & (F.octet_length("word") <= LONGEST)).withColumn("class", F.floor(8 * F.log2("n")).cast("int"))
    held, least = 0, None
    for row in short.groupBy("class").count().orderBy(F.desc("class")).collect():  # at most 8 * 63 classes
        held += row["count"]
        if held > DICTIONARY:
            break
        least = row["class"]
    return short.where(F.col("class") >= F.lit(least).cast("int")).select("word", "n").toArrow()


def score_texts(docs: DataFrame, held_out, model_file: str, id_col: str = "doc_id", text_col: str = "text", per_trainer: int = 4000, rounds: int = 4, **options) -> DataFrame:
    """Score whole texts by an attention model and by word counts, both learned from rows that are not held out.

    Returns (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Words are counted over all training texts. Every task knows the most frequent ones (a dictionary bounded in number and
    length); a text's other words go through a join with the whole table of counts, so that the dictionary is only a
    cache and its bounds change no result. Every text is split and encoded once; training and scoring read its ranks. The
    attention model is trained by `train_attention` over all training texts, dealt to trainers of about per_trainer / rounds
    documents a round, and gives every subword of the vocabulary a probability of its own. Rows are dealt by number, not by id, so
    that null and repeated ids are spread evenly; null and empty texts teach the end of a text alone, repeated rows count as often as
    they occur. A text is scored in overlapping windows, each token once; its score is the sum of log10 of the model's
    probabilities of its subwords and of its end.

    Null and empty texts have the closing token alone. Rows for which `held_out` is null (a null id) count as training rows. Repeated ids keep
    their rows; texts of any length are scored to their end; other columns are ignored; an empty table gives an empty result. With no training rows
    all tokens are unknown, base_score is 0 and the model is the one that training starts from, so that scores stay finite.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    text = F.col(text_col).cast("string").alias("text")
    words = materialise(docs.where(~held).select(text).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct, n_docs = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    got = words.where("word is not null").mapInArrow(_count_pieces(model_file), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    lib = _pieces(model_file)
    counts = np.zeros(lib.get_piece_size())
    counts[got["piece"].to_numpy()] = got["n"].to_numpy()
    ranks = Ranks([lib.id_to_piece(i) for i in range(len(counts))], counts, n_docs)
    common = _common(words)
    denominator = float(total + distinct + 1)
    shared = spark.sparkContext.broadcast((ranks, common["word"].to_pylist(), common["n"].to_numpy().astype(np.float64), n_docs))

    trainers = max(1, math.ceil(n_docs / per_trainer))
    at = F.xxhash64("row")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held.alias("held_out"), text).select(
        "row", "id", "held_out", F.pmod(at, F.lit(trainers)).alias("trainer"),
        F.when(F.col("held_out"), F.lit(HELD_OUT)).otherwise(F.pmod(F.shiftrightunsigned(at, 32), F.lit(rounds)).cast("int")).alias("round"), "text",
    )
    kind = docs.schema[id_col].dataType.simpleString()
    encoded = numbered.mapInArrow(_encode(model_file, shared, denominator), f"row long, id {kind}, held_out boolean, trainer long, round int, word binary, n long, known long, base double, ranks binary")
    encoded = materialise(encoded, "encoded", "round")
    training = encoded.where(F.col("round") >= 0)
    weights = train_attention(training.select("trainer", "round", "ranks"), rounds, ranks, trainers, **options)
    scored = encoded.where(F.col("round") >= HELD_OUT).select("row", "id", "held_out", "n", "known", "base", "ranks")
    scored = scored.mapInArrow(_score(spark.sparkContext.broadcast(weights)), f"row long, id {kind}, held_out boolean, n long, known long, base double, score double")
    scored = materialise(scored, "scored")
    rare = encoded.where(F.col("round") == RARE).select("row", "word", "n")
    count = F.coalesce(F.col("c"), F.lit(0))
    others = (
        rare.join(words.where("word is not null").select("word", F.col("n").alias("c")), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.log10((count + 1) / F.lit(denominator))).alias("more_base"), F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("more_known"))
    )
    others = materialise(others, "others")
    drop_scratch(training)  # with all that was encoded
    return (
        scored.join(others, "row", "left")
        .select(
            F.col("id").alias(id_col), "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
        )
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2, public_tokenizers.path("piece_bpe_32k.model"))
