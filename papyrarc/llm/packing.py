"""Best-fit packing (operator 6): a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import functools
import itertools
import os
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REMEMBERED, materialise, table, tidy

CACHE_LIMIT = 200_000
IDS_LIMIT = 4_000_000
CHUNK_BYTES = 2_000_000
SEPARATOR = (0).to_bytes(4, "little")
#: Marks that the tokenizer parts from a letter or digit before them, and that begin no special token's end.
_MARKS = ".,;:!?%*$#&"
_TOGETHER = 200
_LATIN_END = "\u0250"

#: Words that hold these aren't lower-cased before they are composed: a sigma depends on its place, and some letters are composed with these marks in lower case only.
_COMPOSED = re.compile("[\u03a3\u0300-\u036f]")


class _Numbers(dict[str, int]):
    """Words by number, in the order in which they are met; `new` lists those that aren't learned yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class _Ids:
    """Ids of words by number: where they lie in a pool, and how many they are."""

    def __init__(self) -> None:
        self.pool, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid end to end, and where each word's end."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)], ends


class WordEncoder:
    """Ids of words, each as little-endian 32-bit numbers; remembers words up to a bound.

    The tokenizer drops white space and joins nothing across it, so texts can be encoded word by word; words are what stands between ASCII white space. It also parts
    letters from marks and lower-cases, so a new word is looked up by its lower-cased letters and its closing marks.
    New words of letters alone are encoded many to a line, as each ends with a token that closes a word. Where they are lower-case Latin letters
    there is nothing to normalise, and the same model takes the line's words as they are. Arrow splits texts and finds their distinct words;
    each of these is looked up once, by which it gets a number, and ids are gathered by numbers when the new words are learned.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known, self.ids = _Numbers(), _Ids()
        self.older, self.older_ids = _Numbers(), _Ids()
        size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")

    def _ids(self, lines: list[str], letters: bool = False) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in (self.letters if letters else self.tokenizer).encode_batch_fast(lines, add_special_tokens=False)]

    def _learn(self) -> None:
        known, older, ids = self.known, self.older, self.ids
        first = len(ids.sizes)
        held: list[tuple[int, int]] = []
        parts: list[tuple[int, int, int]] = []
        nothing = known[""]
        latin, letters, others = [], [], []
        for n, w in enumerate(known.new, first):  # the parts of words join the list
            if (at := older.get(w)) is not None:
                held.append((n, at))
                continue
            plain = w.isascii()
            if plain and w.isalpha():
                if w.islower():
                    latin.append(n)
                else:
                    parts.append((n, known[w.lower()], nothing))
                continue
            low = w if "<|" in w or not plain and _COMPOSED.search(w) else w.lower()
            if low.isalpha():
                if low != w:
                    parts.append((n, known[low], nothing))
                else:
                    (latin if max(w) < _LATIN_END and w == w.lower() else letters).append(n)
            elif not (core := low.rstrip(_MARKS)) or len(core) == len(low) or not core[-1].lower()[-1].isalnum() or low is w and not plain and _COMPOSED.search(w) or "<|" in w:
                others.append(n)
            else:
                parts.append((n, known[core], known[low[len(core) :]]))
        words, known.new = known.new, []
        ids.starts, ids.sizes = (np.r_[x, np.zeros(len(words), np.int64)] for x in (ids.starts, ids.sizes))
        pools, end = [ids.pool], len(ids.pool)

        def put(numbers: np.ndarray | list[int], pool: np.ndarray, ends: np.ndarray) -> None:
            nonlocal end
            begins = np.r_[0, ends[:-1]]
            ids.starts[numbers], ids.sizes[numbers] = end + begins, ends - begins
            pools.append(pool)
            end += len(pool)

        if held:
            own, at = np.array(held).T
            put(own, *self.older_ids.of(at))
        lines = [x[i : i + _TOGETHER] for x in (latin, letters) for i in range(0, len(x), _TOGETHER)]
        n = -(-len(latin) // _TOGETHER)
        joined = [" ".join([words[i - first] for i in x]) for x in lines]
        numbers, found, ends, size = [], [], [], 0
        for line, got in zip(lines, self._ids(joined[:n], True) + self._ids(joined[n:]), strict=True):
            own = np.flatnonzero(self.closes[got]) + 1
            if len(own) != len(line):
                others += line
                continue
            numbers += line
            found.append(got)
            ends.append(own + size)
            size += len(got)
        if found:
            put(numbers, np.concatenate(found), np.concatenate(ends))
        if others:
            got = self._ids([words[i - first] for i in others])
            put(others, np.concatenate(got), np.cumsum([len(x) for x in got]))
        ids.pool = np.concatenate(pools)
        if parts:
            own, *pair = np.array(parts).T
            pool, ends = ids.of(np.stack(pair, 1).ravel())
            pools = [ids.pool]
            put(own, pool, ends[1::2])
            ids.pool = np.concatenate(pools)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if len(self.known) > CACHE_LIMIT or len(self.ids.pool) > IDS_LIMIT:  # words that haven't been met since the last time are forgotten
            self.older, self.older_ids, self.known, self.ids = self.known, self.ids, _Numbers(), _Ids()
        split = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        met = split.flatten().dictionary_encode()
        distinct = met.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        if self.known.new:
            self._learn()
        flat, ends = self.ids.of(numbers[met.indices.to_numpy()])
        cuts = (4 * np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        held = flat.tobytes()
        return [held[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


REMEMBERED["packing"] = _encoder.cache_clear


def _cut(tokenizer_file: str, capacity: int, id_col: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        for batch in batches:
            column = batch.column(1).fill_null("")
            read = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
            n, at = batch.num_rows, 0
            while at < n:
                until = int(np.searchsorted(read, (read[at - 1] if at else 0) + CHUNK_BYTES)) + 1
                texts = column.slice(at, until - at)
                row, piece, length, crc, ids = [], [], [], [], []
                for i, held in enumerate(encoder.encode(texts)):
                    held += SEPARATOR
                    for k, begin in enumerate(range(0, len(held), 4 * capacity)):
                        part = held[begin : begin + 4 * capacity]
                        row.append(at + i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                piece_ = np.array(piece, np.int64)
                columns = [batch.column(0).take(pa.array(row)), pa.array(piece_.astype(np.int32)), pa.array(piece_ * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(texts)

    return tidy("packing", run)


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens: (id_col, piece, start, length, ids_crc32[, ids]). Null and empty texts give the closing id alone, texts of any length all their pieces."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(_cut(tokenizer_file, capacity, id_col, with_ids), schema)


def best_fit(sizes: list[int], items: list[int], room: list[tuple[int, int]], bins: list[int], fresh: int, capacity: int) -> int:
    """Put items, in their order, where the least room is left that suffices; `room` is sorted (room, bin). Returns the next free bin."""
    for i in items:
        s = sizes[i]
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, fresh
            fresh += 1
        bins[i] = b
        if left > s:
            insort(room, (left - s, b))
    return fresh


def _fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then a larger mean of squared fills."""
    fill = np.bincount(bins, weights=sizes)
    fill = fill[fill > 0]
    return len(fill), -float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


_POOL = 40


@functools.cache
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def refilled(child: list[int], displaced: list[int], sizes: np.ndarray, capacity: int, rng: random.Random) -> list[int]:
    """Make bins fuller by exchanging up to two of their items for up to two displaced ones; returns what is displaced then.

    `child` gives each item's bin, -1 for those displaced, and is changed in place. At most _POOL displaced items are on offer at a time, to all bins with room in turn.
    What is on offer, one item or two, is a number whose order is that of (sum, item, item before it in the pool); all are sorted at once, anew after each exchange.
    """
    size = sizes.tolist()
    pool = displaced[:]
    rng.shuffle(pool)
    at_bin = np.array(child)
    order = np.flatnonzero(np.bincount(at_bin[at_bin >= 0], weights=sizes[at_bin >= 0]) < capacity).tolist()
    rng.shuffle(order)
    members = np.argsort(at_bin, kind="stable")
    cuts = np.searchsorted(at_bin[members], np.arange(int(at_bin.max()) + 2)).tolist()
    members = members.tolist()
    bits = len(size).bit_length()
    low, mask = 2 * bits, (1 << bits) - 1
    kind = np.int64 if low + (2 * capacity).bit_length() < 63 else object

    def offers() -> list[int]:
        items = np.array(pool[:_POOL], kind)
        own = sizes[items.astype(np.int64)].astype(kind)
        first, second = _pairs(len(items))
        both = own[first] + own[second]
        found = np.concatenate([own << low | items << bits, (both << low | items[second] << bits | items[first] + 1)[both <= capacity]])
        found.sort()
        return found.tolist()

    offer = offers()
    for b in order:
        if not pool:
            break
        own = members[cuts[b] : cuts[b + 1]]
        if not own:
            continue
        held = [size[i] for i in own]
        room = capacity - sum(held)
        outs = [(0, ()), *((held[k], (i,)) for k, i in enumerate(own)), *((held[k] + held[m], (i, own[m])) for k, i in enumerate(own[:12]) for m in range(k))]
        most, best = 0, None
        for given, out in outs:
            k = bisect_left(offer, room + given + 1 << low) - 1
            if k >= 0 and (offer[k] >> low) - given > most:
                most, best = (offer[k] >> low) - given, (out, offer[k])
                if most == room:
                    break
        if best is None:
            continue
        for i in best[0]:
            child[i] = -1
        for i in ((best[1] >> bits) & mask, (best[1] & mask) - 1):
            if i >= 0:
                child[i] = b
                pool.remove(i)
        pool += best[0]
        offer = offers()
    return pool


def crossover(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, capacity: int, rng: random.Random, share: float = 0.15) -> np.ndarray:
    """Inject whole well-filled bins of `second` (a share of them) into `first`, drop the bins that then hold duplicates, and best-fit what was displaced."""
    fill = np.bincount(second, weights=sizes)
    full = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = rng.sample(full.tolist(), max(1, int(share * len(full))))
    mark = np.zeros(len(fill), bool)
    mark[chosen] = True
    injected = mark[second]
    hit = np.zeros(int(first.max()) + 1, bool)
    hit[first[injected]] = True
    displaced = np.flatnonzero(hit[first] & ~injected)
    kept = ~hit[first] & ~injected
    child = np.full(len(first), -1)
    old, place = np.unique(first[kept], return_inverse=True)
    child[kept] = place
    own, place = np.unique(second[injected], return_inverse=True)
    child[injected] = place + len(old)
    n = len(old) + len(own)
    return _settled(child.tolist(), displaced.tolist(), n, sizes, capacity, rng)


def _settled(bins: list[int], displaced: list[int], n: int, sizes: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Bins 0 to n - 1, refilled from the displaced items, and the rest put by best-fit, largest first."""
    order = np.array(sorted(refilled(bins, displaced, sizes, capacity, rng), key=lambda i: -sizes[i]), np.int64)
    placed = np.array(bins)
    load = np.bincount(placed[placed >= 0], weights=sizes[placed >= 0], minlength=n).astype(int)
    room = sorted((capacity - x, b) for b, x in enumerate(load.tolist()) if x < capacity)
    best_fit(sizes.tolist(), order.tolist(), room, bins, n, capacity)
    return np.array(bins)


def opened(bins: np.ndarray, sizes: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Open the lightest bin and a few others, and settle their items anew."""
    fill = np.bincount(bins, weights=sizes)
    used = np.flatnonzero(fill)
    chosen = {int(used[fill[used].argmin()]), *rng.sample(used.tolist(), min(len(used), 4))}
    displaced = np.flatnonzero(np.isin(bins, list(chosen)))
    child = bins.copy()
    child[displaced] = -1
    return _settled(child.tolist(), displaced.tolist(), len(fill), sizes, capacity, rng)


def emptied(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Empty the lightest bins: move their items where they fit, or exchange them for smaller items of bins with just enough room.

    Every step makes the lightest bin lighter and another one fuller, until none is left that does.
    """
    bins = bins.copy()
    order = np.argsort(sizes, kind="stable")
    ascending = sizes[order]
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    while True:
        used = np.flatnonzero(fill)
        if len(used) < 2:
            return bins
        light = int(used[fill[used].argmin()])
        if fill.sum() + capacity > capacity * len(used):  # the least possible number of bins
            return bins
        room = np.where(fill > 0, capacity - fill, 0)
        room[light] = 0
        reach = ascending + room[bins[order]]  # how large an item may be that takes the place of this one
        while fill[light]:
            own = np.flatnonzero(bins == light)
            for i in own[np.argsort(-sizes[own], kind="stable")]:
                fits = np.flatnonzero(room >= sizes[i])
                if len(fits):
                    to, gain, other = int(fits[room[fits].argmin()]), int(sizes[i]), -1
                    break
                smaller = reach[: np.searchsorted(ascending, sizes[i])] >= sizes[i]
                if smaller.any():  # the smallest such item makes the light bin lightest
                    other = int(order[smaller.argmax()])
                    to, gain = int(bins[other]), int(sizes[i] - sizes[other])
                    break
            else:
                return bins
            bins[i] = to
            if other >= 0:
                bins[other] = light
            fill[light] -= gain
            fill[to] += gain
            room[to] -= gain
            reach = ascending + room[bins[order]]


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, generations: int, keep: int) -> list[np.ndarray]:
    """Best `keep` packings of an island: ends when `generations` in a row bring none that is better (up to 20 times as many for few items, where each
    costs little), or with the least possible number of bins.

    Children come by turns from a crossover and from opening some bins; each has its lightest bins emptied as far as exchanges go.
    """
    rng = random.Random(seed)
    listed = sizes.tolist()
    least = -(-int(sizes.sum()) // capacity)
    population = list(population)
    while len(population) < keep:
        noise = np.array([rng.gauss(0, 0.05) for _ in listed]) if population or seed else 0.0
        order = np.argsort(-(sizes * (1 + noise)), kind="stable").tolist()
        bins = [0] * len(listed)
        best_fit(listed, order, [], bins, 0, capacity)
        population.append(np.array(bins))
        if _fitness(population[-1], sizes, capacity)[0] <= least:
            break
    ranked = sorted(((_fitness(p, sizes, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    born, idle = len(population), 0
    generations *= max(1, min(20, 4096 // max(1, 2 * len(listed))))
    while idle < generations and ranked[0][0][0] > least and len(ranked) > 1:
        a, b = rng.sample(ranked[: max(2, keep)], 2)
        child = a[2] if born == len(population) else crossover(a[2], b[2], sizes, capacity, rng) if born % 2 else opened(a[2], sizes, capacity, rng)
        child = emptied(child, sizes, capacity)
        best = ranked[0][0]
        fit = _fitness(child, sizes, capacity)
        if all(fit != r[0] for r in ranked):  # equal ones would crowd out the others
            ranked = sorted([*ranked, (fit, born, child)], key=lambda x: x[:2])[: max(2, keep)]
        born, idle = born + 1, 0 if ranked[0][0] < best else idle + 1
    return [p for *_, p in ranked[:keep]]


_STATE = "block long, island int, items binary, sizes binary, bins binary, n_bins long, score double"


def _state(block: int, island: int, items: np.ndarray, sizes: np.ndarray, bins: np.ndarray, capacity: int) -> pa.Table:
    n, score = _fitness(bins, sizes, capacity)
    return pa.table({
        "block": pa.array([block], pa.int64()), "island": pa.array([island], pa.int32()), "items": pa.array([items.astype("<i8").tobytes()], pa.binary()),
        "sizes": pa.array([sizes.astype("<i4").tobytes()], pa.binary()), "bins": pa.array([bins.astype("<i4").tobytes()], pa.binary()),
        "n_bins": pa.array([n], pa.int64()), "score": pa.array([score], pa.float64()),
    })


def _placed(full: float):
    """Items with their bin, their place in it, and whether the bin holds less than `full`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bins, sizes = np.frombuffer(r["bins"], "<i4").astype(np.int64), np.frombuffer(r["sizes"], "<i4").astype(np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                begin = ends - sizes[order]
                new = np.r_[True, bins[order][1:] != bins[order][:-1]]
                offset = begin - np.maximum.accumulate(np.where(new, begin, 0))
                loose = np.bincount(bins, weights=sizes)[bins[order]] < full
                columns = [np.frombuffer(r["items"], "<i8")[order], sizes[order], (r["block"] << 32) + bins[order], offset, loose]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "length", "sequence_id", "offset", "loose"])

    return run


def _pack_blocks(items: DataFrame, n_blocks: int, first_block: int, capacity: int, islands: int, generations: int, keep: int, migrations: int, full: float) -> DataFrame:
    """Pack items dealt into blocks, each on its own: (item, length, sequence_id, offset, loose)."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.select(F.expr(f"{first_block} + pmod(xxhash64(item), {n_blocks})").alias("block"), "item", F.col("length").cast("int").alias("length"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))

    def found(group: pa.Table) -> pa.Table:
        group = group.sort_by("item")
        block, island = group["block"][0].as_py(), group["island"][0].as_py()
        sizes = group["length"].to_numpy().astype(np.int64)
        best = evolve(sizes, [], capacity, block * 31 + island, generations, keep)[0]
        return _state(block, island, group["item"].to_numpy(), sizes, best, capacity)

    def settle(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["n_bins"], r["score"], r["home"]))
        sizes = np.frombuffer(rows[0]["sizes"], "<i4").astype(np.int64)
        items_ = np.frombuffer(rows[0]["items"], "<i8")
        block, island = rows[0]["block"], rows[0]["island"]
        population = [np.frombuffer(r["bins"], "<i4").astype(np.int64) for r in rows]
        best = evolve(sizes, population, capacity, block * 31 + island + 7919, generations, keep)[0]
        return _state(block, island, items_, sizes, best, capacity)

    state = dealt.repartition(parts, "block", "island").groupBy("block", "island").applyInArrow(found, _STATE)
    for _ in range(migrations):
        moved = state.withColumn("home", F.col("island")).withColumn("island", F.explode(F.array("island", ((F.col("island") + 1) % islands).cast("int"))))
        state = moved.groupBy("block", "island").applyInArrow(settle, _STATE)
    best = state.groupBy("block").agg(F.min_by(F.struct("items", "sizes", "bins"), F.struct("n_bins", "score", "island")).alias("s")).select("block", "s.*")
    return materialise(best.mapInArrow(_placed(full * capacity), "item long, length long, sequence_id long, offset long, loose boolean"), "packings")


def pack(items: DataFrame, capacity: int, per_block: int = 4096, islands: int = 3, generations: int = 12, keep: int = 4, migrations: int = 1, full: float = 0.98) -> DataFrame:
    """Pack items (columns item long, unique, and length long, 1 to capacity) into bins: (item, sequence_id, offset).

    Items are dealt by a hash into blocks of about `per_block`, which bounds a task. Every block evolves on several islands,
    each a task of its own; after each epoch the elite of an island moves to the next one, and the best packing of all
    islands is taken at the end. The bins of all blocks that hold less than a share of `full` are opened again and their items
    packed in the same way, so that the room that each block leaves is used up by the others. An empty table gives an empty result.
    """
    how = {"capacity": capacity, "islands": islands, "generations": generations, "keep": keep, "migrations": migrations, "full": full}
    n_blocks = max(1, -(-items.count() // per_block))
    out = _pack_blocks(items, n_blocks, 0, **how)
    if n_blocks == 1:
        return out.select("item", "sequence_id", "offset")
    loose = out.where("loose").select("item", "length")
    again = _pack_blocks(loose, max(1, -(-loose.count() // per_block)), n_blocks, **how)
    return out.where("not loose").select("item", "sequence_id", "offset").union(again.select("item", "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **options) -> DataFrame:
    """Cut documents into pieces of at most `capacity` tokens and pack these into sequences.

    Returns (id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]). A full piece is a sequence
    of its own; all others go through `pack`. Null and empty texts hold the closing id alone. Null and repeated
    ids keep their rows as documents of their own; texts of any length are cut, never shortened; other columns are ignored; an empty table gives an empty result.
    """
    pieces = materialise(token_pieces(docs, tokenizer_file, capacity, id_col, text_col, with_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    packed = pack(rest.select("item", "length"), capacity, **options)
    columns = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return rest.join(packed, "item").select(columns).union(full.select(columns))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
