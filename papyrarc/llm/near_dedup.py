"""MinHash near-duplicate detection (operator 1): SuperMinHash signatures, banding, verification, grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowgroups import runs
from .common import drop_scratch, materialise, rows_of, table, tidy
from .components import components
from .superminhash import bands, signatures
from .wordhash import chunks, shingle_hashes, word_hashes

CHUNK_BYTES = 1 << 20
PIVOTS = 16


def _sets(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Distinct sorted shingle hashes of each row, for a chunk of rows at a time."""
    for _, offsets, data in chunks(column, CHUNK_BYTES):
        words, rows = word_hashes(offsets, data)
        shingles, rows = shingle_hashes(words, rows, k)
        cut = np.searchsorted(rows, np.arange(len(offsets)))
        yield [np.unique(shingles[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _sketch(k: int, n_bands: int, width: int):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _sets(batch.column(1), k):
                n = len(sets)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                keys = bands(signatures(flat, np.repeat(np.arange(n), sizes), n, n_bands * width), n_bands)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                lists = pa.ListArray.from_arrays(np.arange(0, n * n_bands + 1, n_bands, dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(sizes), pa.array(digests, pa.binary()), lists], schema=schema)
                at += n

    return tidy("near_dedup", run)


def _shingle_table(k: int):
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)
                at += len(sets)

    return tidy("near_dedup", run)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the intersections of sorted distinct arrays."""
    n = len(sets)
    if n == 2:
        out = np.diag([len(sets[0]), len(sets[1])])
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((n, n), np.float64)
    step = max(256, (1 << 20) // n)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        dense = np.zeros((n, step), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        total += dense @ dense.T
    return np.rint(total).astype(np.int64)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between n local nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out[0].append(x)
            out[1].append(y)
    return out


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("block", pa.int64())])


def _links(group: pa.Table, numerator: int, denominator: int) -> np.ndarray:
    """(n, n) which of a task's sets are similar enough."""
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    both = intersections(sets)
    return denominator * both >= numerator * (sizes[:, None] + sizes[None, :] - both)


class _Found:
    """Rows for the links of tasks and for what is left to do, in batches."""

    def __init__(self) -> None:
        self.rows: list[tuple[list, list, list, list]] = []
        self.size = 0

    def add(self, a: list[int], b: list[int | None], bucket: int | None = None, block: int | None = None) -> None:
        self.rows.append((a, b, [bucket] * len(a), [block] * len(a)))
        self.size += len(a)

    def batch(self) -> pa.RecordBatch:
        columns = [[x for part in parts for x in part] for parts in zip(*self.rows, strict=True)] if self.rows else [[]] * 4
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)


def _verify_blocks(numerator: int, denominator: int):
    """Links within a block and to its bucket's pivots, and the block's rows that no pivot of the bucket's main group is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found()
        for group in runs(batches, ["bucket", "block"]):
            ids, pivot = group.column("rep").to_numpy(), group.column("pivot").to_numpy()
            if len(ids) < 2:
                continue
            linked = _links(group, numerator, denominator)
            x, y = forest(len(ids), *np.nonzero(np.triu(linked, 1)))
            found.add(ids[x].tolist(), ids[y].tolist())
            if pivot.any():
                # every block of the bucket sees the same pivots, and so agrees on the main group of those that are linked
                at = np.flatnonzero(pivot)
                at = at[np.lexsort(([len(group.column("shingles")[int(i)].as_py()) for i in at], ids[at]))]
                root = np.arange(len(at))
                for i, j in zip(*np.nonzero(np.triu(linked[np.ix_(at, at)], 1)), strict=True):
                    root[root == root[j]] = root[i]
                main = at[root == np.bincount(root).argmax()]
                far = np.flatnonzero(~pivot & ~linked[:, main].any(1))
                if len(far):
                    found.add(ids[far].tolist(), [None] * len(far), group.column("bucket")[0].as_py(), group.column("block")[0].as_py())
            if found.size > 50_000:
                yield found.batch()
        yield found.batch()

    return tidy("near_dedup", run)


def _verify_across(numerator: int, denominator: int):
    """Links between a bucket's rows that are far from its pivots and the rows of another block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found()
        for group in runs(batches, ["bucket", "block", "part"]):
            ids, side = group.column("rep").to_numpy(), group.column("side").to_numpy()
            if side.all() or not side.any():
                continue
            linked = np.triu(_links(group, numerator, denominator) & (side[:, None] != side[None, :]), 1)
            x, y = forest(len(ids), *np.nonzero(linked))
            found.add(ids[x].tolist(), ids[y].tolist())
            if found.size > 50_000:
                yield found.batch()
        yield found.batch()

    return tidy("near_dedup", run)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85,
    n_bands: int = 20, band_width: int = 5, block: int = 256,
) -> DataFrame:
    """Group documents whose sets of k-word shingles have a Jaccard similarity of `percent`/100 or more.

    Returns (id_col, n_shingles, component_id, kept), a row for each row of `docs`:

    1. Every text gets its set of distinct shingle hashes, a digest of that set, a SuperMinHash
       signature of n_bands * band_width values, and a key for each band.
    2. Texts with equal sets form a class, whose least id stands for it. Copies meet in a grouped
       minimum, never as pairs.
    3. Classes that share a band's key form a bucket. Buckets with the same members are verified once. A
       bucket is cut into blocks of about `block` classes, each a task of its own, so that a bucket of any size is
       spread evenly; no pairs are emitted. A task intersects whole sets exactly and returns a spanning forest of the
       confirmed links.
    4. The blocks of a bucket also get up to PIVOTS of its classes. Classes that are linked to one of the main
       group of these need no comparison with each other across blocks, as they belong together already. Only those that are
       not so linked are compared with all other blocks, in parts of about `block`. So no link between
       components is lost, and the sets of a bucket of copies are sent once, not once for each other block.
    5. Connected components of those forests give component_id.

    A pair at the very threshold shares no band with a probability of (1 - 0.85^5)^20 = 8e-6.

    Null or white texts have an empty set: n_shingles 0, linked with nothing, kept. Rows with a null id
    keep their n_shingles, have a null component_id, and are kept. Repeated ids stay as rows of their own
    and are linked by the component of their texts; if one id has several texts they form one component.
    Other columns of `docs`, whatever their names, are ignored. Texts of any length give whole sets. Empty input gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = materialise(docs.mapInArrow(_sketch(k, n_bands, band_width), "id long, n_shingles long, digest binary, bands array<long>"), "sketches")
    linked = sketches.where("n_shingles > 0 and id is not null")
    classes = materialise(linked.groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")

    keyed = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = (
        keyed.groupBy("band", "key")
        .agg(F.count("*").alias("n"), F.min("rep").alias("least"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members"))
        .where("n > 1")
        .groupBy("n", "least", "members").agg(F.min(F.struct("band", "key")).alias("at"))
        .select("at.band", "at.key", F.xxhash64("at.band", "at.key").alias("bucket"), F.expr(f"cast(ceil(n / {block}) as int)").alias("blocks"))
    )
    members = materialise(keyed.join(buckets, ["band", "key"]).select("bucket", "rep", "blocks", F.expr("cast(pmod(xxhash64(rep, 7), blocks) as long)").alias("block")), "members")
    large = members.where("blocks > 1")
    pivots = large.groupBy("bucket", "blocks", F.expr(f"pmod(xxhash64(rep, 11), {PIVOTS})").alias("s")).agg(F.min_by("rep", F.xxhash64("rep", F.lit(13))).alias("rep"))
    tasks = members.select("bucket", "block", "rep", F.lit(False).alias("pivot")).union(pivots.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)), "rep", F.lit(True)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    sets = materialise(rows_of(docs, members.select(F.col("rep").alias("id")), "id").mapInArrow(_shingle_table(k), "rep long, shingles binary").dropDuplicates(["rep", "shingles"]), "sets")

    def with_sets(tasks: DataFrame, *keys: str) -> DataFrame:
        return tasks.join(sets.hint("merge"), "rep").repartition(parts, *keys).sortWithinPartitions(*keys)

    kind = "a long, b long, bucket long, block long"
    found = materialise(with_sets(tasks, "bucket", "block").mapInArrow(_verify_blocks(percent, 100), kind), "found")
    edges = found.where("b is not null").select("a", "b")
    far = found.where("b is null").select("bucket", "block", F.col("a").alias("rep"))
    spare = []
    if far.take(1):
        n_parts = far.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        ours = far.join(n_parts, "bucket").join(large.select("bucket", F.col("rep"), "blocks"), ["bucket", "rep"]).select("bucket", F.col("block").alias("own"), "rep", F.expr("cast(pmod(xxhash64(rep, 17), parts) as long)").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
        theirs = large.join(n_parts, "bucket").select("bucket", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), "rep", F.lit(True).alias("side"))
        across = materialise(ours.where("own <> block").select("bucket", "block", "part", "rep", F.lit(False).alias("side")).union(theirs), "across")
        spare.append(across)
        edges = edges.union(with_sets(across, "bucket", "block", "part").mapInArrow(_verify_across(percent, 100), kind).select("a", "b"))
    extra = linked.select("id", "digest").join(classes.select("digest", "rep"), "digest").where("id <> rep")
    repeated = linked.groupBy("id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("id")
    links = edges.union(extra.join(repeated, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    grouped = components(links.where("a <> b"))
    drop_scratch(members, sets, found, *spare)  # the links are in the components' own tables now

    home = classes.select("digest", "rep").join(grouped, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sketches.join(home.withColumn("_on", F.lit(True)), "digest", "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
