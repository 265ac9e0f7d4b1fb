"""SentencePiece encoding and decoding (operator 3) for merge-type vocabularies, in Arrow batches."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
CACHE_LIMIT = 450_000

#: Chunks of more characters have their agenda in a heap.
SHORT = 40
_NEVER = float("inf")


class PieceVocabulary:
    """Pieces and scores of a model file, as far as encoding and decoding need them."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.skipped = {i for i in range(n) if lib.is_control(i)}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.costs = {self.pieces[i]: -lib.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character; words can't be encoded one by one")
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.line_break_alone = "\n" not in joined
        value = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            value[i] = bytes([b])
        for i in self.skipped:
            value[i] = b""
        value[lib.unk_id()] = " ⁇ ".encode()
        self.numbers, self.raws = list(map(str, range(n))), value
        self.values = dict(zip(self.numbers, value, strict=True))

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk: an agenda of adjacent symbol pairs, best score first and leftmost on ties.

        A pair is on the agenda if its union is a piece. Taking one joins its symbols and puts the pairs with
        the new neighbours on the agenda; entries whose symbols have changed meanwhile are passed over.
        A short chunk's agenda is a list by place, whose smallest entry is looked for each time.
        """
        if chunk in self.ids and len(chunk) == 1:
            return [self.ids[chunk]]
        return self._ids_of(self._by_place(chunk) if len(chunk) <= SHORT else self._by_heap(chunk))

    def _by_place(self, chunk: str) -> list[str]:
        cost = self.costs.get
        symbols = list(chunk)
        agenda = [cost(union, _NEVER) for union in map(str.__add__, chunk, chunk[1:])]
        while agenda and (best := min(agenda)) is not _NEVER:
            i = agenda.index(best)
            union = symbols[i] + symbols.pop(i + 1)
            symbols[i] = union
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(union + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + union, _NEVER)
        return symbols

    def _by_heap(self, chunk: str) -> list[str]:
        costs = self.costs
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(costs[union], i, union, i + 1) for i, union in enumerate(map(str.__add__, chunk, chunk[1:])) if union in costs]
        heapq.heapify(agenda)
        while agenda:
            _, i, union, j = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or after[i] != j or len(left) + len(right) != len(union):
                continue
            symbols[i], symbols[j] = union, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (wider := union + symbols[k]) in costs:
                    heapq.heappush(agenda, (costs[wider], i, wider, k))
            if (h := before[i]) >= 0 and (wider := symbols[h] + union) in costs:
                heapq.heappush(agenda, (costs[wider], h, wider, i))
        return [s for s in symbols if s is not None]

    def _ids_of(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if (known := self.ids.get(s)) is not None:
                out.append(known)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode()]
            else:
                out.append(self.library.unk_id())
        return out

    def chunks(self, text: str) -> list[str]:
        """Parts of a text, spaces written as SPACE, that no piece crosses."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return (_BY_LINE if self.line_break_alone else _BY_SPACE).findall(marked)

    def raw(self, ids: list[str]) -> bytes:
        """What ids given as decimal strings stand for."""
        return b"".join(map(self.values.__getitem__, ids))

    def text(self, raw: bytes, first: str) -> str:
        """Text of what ids stand for, the first of which is given; the blank that encoding puts first is taken off."""
        return (raw[1:] if raw[:1] == b" " and first != self._blank else raw).decode("utf-8", "replace")

    def decode(self, ids: list[str]) -> str:
        return self.text(self.raw(ids), ids[0]) if ids else ""

    @functools.cached_property
    def _blank(self) -> str:
        return str(self.byte_ids.get(0x20, -1))


_BY_LINE = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_BY_SPACE = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Known:
    """A process's bounded memory of encoded chunks: their ids in decimal with commas, how many, and what these decode to; and the chunks on which the library differs."""

    def __init__(self) -> None:
        self.ids: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}
        self.differ: set[str] = set()

    def want(self, vocab: PieceVocabulary, chunks: set[str]) -> None:
        """Have these chunks in `ids`. When there are too many, those that haven't been wanted since the last time are forgotten."""
        if len(self.ids) > CACHE_LIMIT:
            self.older, self.ids = self.ids, {}
            self.differ &= self.older.keys()
        new = []
        for c in chunks.difference(self.ids):
            if (held := self.older.get(c)) is None:
                new.append(c)
            else:
                self.ids[c] = held
        if new:
            self._learn(vocab, new)

    def _learn(self, vocab: PieceVocabulary, new: list[str]) -> None:
        """Encode and decode new chunks, and compare with the library; where it differs, its ids are taken."""
        ours = [vocab.merge(c) for c in new]
        theirs = _library_ids(vocab, new)
        texts = vocab.library.decode(theirs)
        for c, a, b, text in zip(new, ours, theirs, texts, strict=True):
            ids = list(map(vocab.numbers.__getitem__, b))
            raw = b"".join(map(vocab.raws.__getitem__, b))
            self.ids[c] = (",".join(ids), len(ids), raw)
            if a != b or vocab.text(raw, ids[0]) != text:
                self.differ.add(c)


@functools.lru_cache(maxsize=2)
def vocabulary(model_file: str) -> tuple[PieceVocabulary, Known]:
    """The vocabulary and this process's memory of encoded chunks."""
    return PieceVocabulary(model_file), Known()


def _library_ids(vocab: PieceVocabulary, chunks: list[str]) -> list[list[int]]:
    """The library's ids of chunks; it puts a space before each text, which is allowed for, and gives no ids to an empty one."""
    alone = {c: f"a{c.replace(SPACE, ' ')}" if c.startswith(SPACE) else f"\n{c}" for c in chunks if not c.startswith(SPACE) or c == SPACE}
    before = {x: len(vocab.library.encode(x)) for x in ("a", "\n")}
    got = vocab.library.encode([alone.get(c, c[1:]) for c in chunks], num_threads=1)
    return [x[before[alone[c][0]] :] if c in alone else x for c, x in zip(chunks, got, strict=True)]


def encode_texts(texts: list[str], vocab: PieceVocabulary, known: Known) -> Iterator[tuple[str, int, str, bool]]:
    """Of each text the ids in decimal with commas, how many, the text that they decode to, and whether the library has the same for all its parts."""
    parts = [vocab.chunks(t) for t in texts]
    known.want(vocab, set().union(*map(set, parts)))
    held = known.ids
    for chunks in parts:
        if not chunks:
            yield "", 0, "", True
            continue
        ids, counts, raws = zip(*map(held.__getitem__, chunks), strict=True)
        yield ",".join(ids), sum(counts), vocab.text(b"".join(raws), ids[0].partition(",")[0]), not known.differ or known.differ.isdisjoint(chunks)


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text, check it against the library, and decode it again.

    Returns (id_col, n_tokens, ids_sha256, decoded_sha256, agrees) and, if asked, ids array<int> and decoded
    string. No piece crosses a space or line break, so texts are encoded part by part; distinct parts are
    encoded and decoded once, and compared with the library's ids and text for them; `agrees` is false if a text has a part for
    which these differ, and such a part gets the library's ids. Null texts are taken as empty and give no ids. Null and repeated ids keep their
    rows; texts of any length are encoded to their end; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(model_file)
        for batch in batches:
            n, at = batch.num_rows, 0
            while at < n:
                texts: list[str] = []
                size = 0
                while at + len(texts) < n and size < 4_000_000:
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                joined, counts, decoded, agrees = map(list, zip(*encode_texts(texts, vocab, known), strict=True))
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    pa.array(agrees, pa.bool_()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
                if with_ids:
                    columns += [pa.array([list(map(int, j.split(","))) if j else [] for j in joined], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
