"""Alignment of two tokenizers (operator 11): groups of tokens between the byte offsets at which tokens of both end."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REMEMBERED, materialise, table, tidy
from .pieces import SPACE

#: So many parts are remembered by a process before those that aren't wanted any more are forgotten.
CACHE_LIMIT = 80_000

#: Texts are taken together until they have so many characters.
BATCH_CHARACTERS = 1_000_000

#: Rows whose links are looked up at a time.
SCORED_ROWS = 500

#: A pair of ids as one number: the first id times this, plus the second, which is smaller.
PAIR = 1 << 32

#: Where tokens of both kinds end wherever they stand: after a character that is no white space, before one space or line break and no more.
_PARTS = re.compile(r"(?<=\S)(?=[ \n]\S)")


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The offsets at which tokens of both lists end, in order, and how many tokens of each list end up to there: these slice both lists into groups.

    Ends are kept in dictionaries from end to index, whose keys are intersected.
    """
    a_after, b_after = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True)), dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_after.keys() & b_after.keys())
    return common, list(map(a_after.__getitem__, common)), list(map(b_after.__getitem__, common))


#: So many new parts are encoded in one line.
_TOGETHER = 100

#: Of a part of a text: numbers of ids and groups, groups as text, and links as 64-bit numbers. None if a tokenizer doesn't give its bytes back.
Aligned = tuple[int, int, int, str, bytes] | None


class Tokenizers:
    """A byte-level BPE file and a sentencepiece model, and this process's bounded memory of aligned parts."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = lib = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        letters = _byte_letters()
        plain = {t["content"] for t in json.loads(self.a.to_str())["added_tokens"]}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_raw = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_raw[i] = entry.encode() if entry in plain else bytes(map(letters.__getitem__, entry))
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.b_raw = [bytes([int(p[3:-1], 16)]) if lib.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        kinds = [p for i, p in enumerate(pieces) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.sizes = [np.array(list(map(len, raws))) for raws in (self.a_raw, self.b_raw)]
        if not all(x.all() for x in self.sizes):
            raise ValueError("a token without bytes; it would end where the one before it ends")
        self.names = [pa.array(map(str, range(len(raws)))) for raws in (self.a_raw, self.b_raw)]
        #: Parts are encoded on their own only if no piece goes over a border of parts.
        self.by_parts = not any(SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1 for p in kinds)
        self.line = len(lib.encode("\n"))
        self.known: dict[str, Aligned] = {}
        self.older: dict[str, Aligned] = {}

    def most_pairs(self) -> int:
        """A bound on the distinct pairs that links can hold in any corpus.

        Both ranges end together, so the bytes of one token are the end of those of the other: each token meets at most the tokens
        that are one of its ends, and as many tokens as spell the same bytes.
        """
        same_a, same_b = Counter(self.a_raw), Counter(self.b_raw)
        ends = lambda raws, same: sum(same[raw[k:]] for raw in raws for k in range(len(raw) + 1))
        return ends(self.a_raw, same_b) + ends(self.b_raw, same_a)

    def parts(self, text: str | None) -> list[str]:
        """A space and the text, cut where both tokenizers put a border; none of a null or empty text. Parts that begin with one space are given without it."""
        if not text:
            return []
        if not self.by_parts:
            return [f" {text}"]
        if text.replace("\n", " ").split(" ") == text.split():  # single spaces and line breaks between words, and no other white space
            return text.replace("\n", " \n").split(" ")
        return [p[1:] if p[:1] == " " and not p[1:2].isspace() else p for p in _PARTS.split(f" {text}")]

    def want(self, parts: set[str]) -> None:
        """Have these parts in `known`. When there are too many, those that haven't been wanted since the last time are forgotten."""
        if len(self.known) > CACHE_LIMIT:
            self.older, self.known = self.known, {}
        new = []
        for p in parts.difference(self.known):
            if (held := self.older.get(p)) is None:
                new.append(p)
            else:
                self.known[p] = held
        if new:
            self._learn(new)

    def _learn(self, new: list[str]) -> None:
        """Align new parts. Those without white space are encoded many to a line, as both tokenizers have a border before a single space; a line that isn't given back is taken apart."""
        plain, odd = [], []
        for p in new:
            (plain if p.split() == [p] else odd).append(p)
        lines = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        joined = list(map(" ".join, lines))
        done, lists = [], ([], [])
        for line, whole, a, b in zip(lines, joined, self.a.encode_batch_fast([f" {x}" for x in joined], add_special_tokens=False), self.b.encode(joined, num_threads=1), strict=True):
            ids = a.ids
            if self._exact(f" {whole}".encode(), ids, b):
                done += line
                lists[0].append(ids)
                lists[1].append(b)
            else:
                odd += line
        if (found := self.align([f" {p}".encode() for p in done], *lists)) is None:
            odd += done
        else:
            self.known.update(zip(done, found, strict=True))
        if odd:
            whole = [p if p[0] in " \n" else f" {p}" for p in odd]
            raws = [p.encode() for p in whole]
            lists = [e.ids for e in self.a.encode_batch_fast(whole, add_special_tokens=False)], self._pieces(whole)
            exact = list(map(self._exact, raws, *lists))
            self.known.update(dict.fromkeys(odd))
            self.known.update(zip(compress(odd, exact), self.align(*(list(compress(x, exact)) for x in (raws, *lists))), strict=True))

    def _exact(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_raw.__getitem__, a)) == raw == b"".join(map(self.b_raw.__getitem__, b))

    def _pieces(self, parts: list[str]) -> list[list[int]]:
        """The library's ids. It puts a space before each text; a part that has none gets a line break first, whose ids are taken off."""
        spaced = [p[:1] == " " for p in parts]
        found = self.b.encode([p[1:] if s else f"\n{p}" for p, s in zip(parts, spaced, strict=True)], num_threads=1)
        return [ids if s else ids[self.line :] for ids, s in zip(found, spaced, strict=True)]

    def align(self, raws: list[bytes], a_lists: list[list[int]], b_lists: list[list[int]]) -> list[Aligned] | None:
        """Parts, given by their bytes, of which both tokenizers give the bytes back, one after the other. None if a border of parts is no end for both."""
        if not raws:
            return []
        ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a_lists, b_lists)]
        token_ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True)]
        common, *cuts = common_ends(*(x.tolist() for x in token_ends))
        ends = np.cumsum(list(map(len, raws)))
        to = np.searchsorted(common, ends, side="right")
        if (np.array(common)[to - 1] != ends).any():
            return None
        # groups as text, then those of a part
        listed = lambda cuts, values: pa.ListArray.from_arrays(pa.array([0, *cuts], pa.int32()), values)
        a_text, b_text = (pc.binary_join(listed(to, name.take(pa.array(x))), ",") for to, name, x in zip(cuts, self.names, ids, strict=True))
        to = to.tolist()
        written = pc.binary_join(listed(to, pc.binary_join_element_wise(a_text, b_text, "|")), ";").to_pylist()
        a_last, b_last = (x[np.array(at) - 1] for x, at in zip(ids, cuts, strict=True))
        pairs = (a_last * PAIR + b_last).tobytes()
        n_a, n_b = (np.diff(np.searchsorted(x, ends, side="right"), prepend=0).tolist() for x in token_ends)
        return [(a, b, high - low, text, pairs[8 * low : 8 * high]) for a, b, low, high, text in zip(n_a, n_b, [0, *to], to, written, strict=False)]

    def text(self, parts: list[str]) -> tuple[int, int, int, str, bytes]:
        """Numbers of ids and groups, the groups' text, and the links of a text, given in known parts."""
        found = list(map(self.known.__getitem__, parts))
        if not found or None in found:
            return 0, 0, 0, "", b""
        n_a, n_b, n_groups, groups, pairs = zip(*found, strict=True)
        return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(pairs)


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself where it is printable in Latin-1, else the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def tokenizers(byte_file: str, piece_file: str) -> Tokenizers:
    return Tokenizers(byte_file, piece_file)


REMEMBERED["alignment"] = tokenizers.cache_clear


def _align_batches(batches: Iterator[pa.RecordBatch], byte_file: str, piece_file: str, id_col: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    """A row for each text; the first of each batch also has the batch's distinct links with their counts."""
    both = tokenizers(byte_file, piece_file)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, size = [], 0
            while at + len(texts) < batch.num_rows and size < BATCH_CHARACTERS:
                texts.append(batch.column(1)[at + len(texts)].as_py())
                size += len(texts[-1] or "")
            parts = list(map(both.parts, texts))
            both.want(set().union(*parts))
            n_a, n_b, n_groups, groups, pairs = map(list, zip(*map(both.text, parts), strict=True))
            links = np.frombuffer(b"".join(pairs), np.int64)
            ends = np.cumsum([0, *map(len, pairs)], dtype=np.int64) // 8
            distinct, counts = np.unique(links, return_counts=True)
            firsts = lambda values: pa.LargeListArray.from_arrays(pa.array([0, *[len(values)] * len(texts)], pa.int64()), pa.array(values, pa.int64()))  # noqa: E731, B023
            columns = [
                batch.column(0).slice(at, len(texts)), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)),
                pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
                pa.LargeListArray.from_arrays(pa.array(ends), pa.array(links)).cast(pa.list_(pa.int64())), firsts(distinct).cast(pa.list_(pa.int64())), firsts(counts).cast(pa.list_(pa.int64())),
            ]
            names = [id_col, "n_a", "n_b", "n_groups", "groups_sha256", "links", "pairs", "counts"]
            if with_groups:
                columns, names = [*columns, pa.array(groups, pa.string())], [*names, "groups"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            at += len(texts)


def pair_counts(aligned: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a corpus in ascending order, their counts, and whether a count is the highest of its second id.

    They come to the driver: `most` bounds their number by the vocabularies alone, whatever the corpus.
    """
    found = aligned.where(F.size("pairs") > 0).select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy("x.pairs").agg(F.sum("x.counts").alias("n")).toArrow()
    if found.num_rows > most:
        raise ValueError(f"{found.num_rows} pairs, where the vocabularies allow {most}")
    pairs, counts = found.column("pairs").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    best = np.zeros(int((pairs % PAIR).max(initial=0)) + 1, np.int64)
    np.maximum.at(best, pairs % PAIR, counts)
    return pairs, counts, counts == best[pairs % PAIR]


def align_tokenizers(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Align the ids that two tokenizers give for a space and each text, and count linked ids over all texts.

    Returns (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and, if asked, groups string and pairs
    array<struct<a, b>>, the links in order. A group holds the tokens between two neighbouring byte offsets at which tokens of both
    kinds end. A link is a pair of tokens whose ranges end together; the count of a pair of ids is how many links hold it in all
    texts; `n_best` links have a count that no other pair of the same second id exceeds.

    Null and empty texts, and texts whose bytes a tokenizer doesn't give back, have zeros and an empty hash. Texts are cut where
    both tokenizers have a border, and distinct parts are aligned once for a process; whole texts are read, however long. Null and
    repeated ids keep their rows, each of which counts; other columns are ignored; an empty table gives an empty result. No text is shuffled:
    counts are added up by batch, and their table, bounded by the vocabularies, is sent to all tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counted = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string"
    first = f"{counted}, links array<long>, pairs array<long>, counts array<long>" + (", groups string" if with_groups else "")
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    aligned = materialise(texts.mapInArrow(tidy("alignment", lambda batches: _align_batches(batches, byte_file, piece_file, id_col, with_groups)), first), "aligned")
    counts = docs.sparkSession.sparkContext.broadcast(pair_counts(aligned, Tokenizers(byte_file, piece_file).most_pairs()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = counts.value
        for batch in (whole.slice(at, SCORED_ROWS) for whole in batches for at in range(0, whole.num_rows, SCORED_ROWS)):
            links = batch.column("links")
            values = links.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
            at = np.searchsorted(pairs, values)
            upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            bests, sums = (pa.array(np.diff(upto(x[at])[ends]), pa.int64()) for x in (best, n))
            columns = [*batch.columns[:4], pa.array(np.diff(ends), pa.int64()), bests, sums, batch.column(4)]
            names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            if with_groups:
                ids = pa.StructArray.from_arrays([pa.array(values // PAIR), pa.array(values % PAIR)], names=["a", "b"])
                columns += [batch.column("groups"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)]
                names += ["groups", "pairs"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.drop("pairs", "counts").mapInArrow(tidy("scores of links", score), out + (", groups string, pairs array<struct<a: long, b: long>>" if with_groups else ""))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
