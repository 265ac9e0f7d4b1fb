"""Approximate nearest neighbours (operator 9): a forest of sorted hash strings, searched by longest prefix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowgroups import runs
from .common import materialise, table
from .embedding_dedup import unit_rows, usable

BITS = 32
SHIFTS = np.arange(BITS - 1, -1, -1, dtype=np.uint64)


def hash_strings(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(trees, n) strings of BITS signs of random projections, as unsigned numbers whose first bit is the highest."""
    rng = np.random.default_rng(seed)
    out = np.zeros((trees, len(x)), np.uint64)
    for t in range(trees):
        signs = (x @ rng.standard_normal((x.shape[1], BITS))) >= 0
        out[t] = (signs.astype(np.uint64) << SHIFTS).sum(1, dtype=np.uint64)
    return out


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with one vector; each row is summed by itself, so that equal rows get equal values wherever they stand."""
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))


class PrefixForest:
    """For each tree the rows in order of their hash strings, which is a trie laid flat. `x` are unit vectors, `raw` those that were given."""

    def __init__(self, x: np.ndarray, raw: np.ndarray, trees: int, seed: int) -> None:
        self.x, self.raw, self.trees, self.seed = x, raw, trees, seed
        strings = hash_strings(x, trees, seed)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(BITS + 1, trees, queries) bounds of the rows that share the first 0, 1, ... BITS bits."""
        low = np.zeros((BITS + 1, self.trees, len(q)), np.int32)
        high = np.full_like(low, len(self.x))
        strings = hash_strings(q, self.trees, self.seed)
        for depth in range(1, BITS + 1):
            rest = np.uint64((1 << (BITS - depth)) - 1)
            for t in range(self.trees):
                begin = strings[t] & ~rest
                low[depth, t] = np.searchsorted(self.sorted[t], begin, "left")
                high[depth, t] = np.searchsorted(self.sorted[t], begin | rest, "right")
        return low, high

    def search(self, q: np.ndarray, raw_q: np.ndarray, q_key: np.ndarray, key: np.ndarray, ids: np.ndarray, candidates: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows (and cosines) of its k nearest candidates, ties to the smaller id.

        One product of matrices tells which candidates can be among the k nearest, with a margin far above its rounding;
        these are ranked by `cosines` of the vectors that were given.

        Descent finds the longest prefix that each tree shares with the query. All trees then ascend together, a
        bit at a time, and rows join until there are `candidates` different ones.
        """
        low, high = self.ranges(q)
        total = (high - low).sum(1)
        out = []
        for i in range(len(q)):
            # rows come at most once from each tree, so fewer in sum can't be enough
            depth = int(np.flatnonzero(total[:, i] >= min(candidates, len(self.x)))[-1])
            while True:
                a, b = low[depth, :, i], high[depth, :, i]
                seen = np.zeros(len(self.x), bool)
                for t in range(self.trees):
                    seen[self.order[t, a[t] : b[t]]] = True
                rows = np.flatnonzero(seen)
                if len(rows) >= candidates or depth == 0:
                    break
                depth -= 1
            rows = rows[key[rows] != q_key[i]]
            cos = self.x[rows] @ q[i]
            if len(rows) > k:
                worst = np.partition(cos, len(cos) - k)[len(cos) - k]
                rows = rows[cos >= worst - 1e-9]
            cos = cosines(self.raw[rows], raw_q[i])
            best = np.lexsort((ids[rows], -cos))[:k]
            out.append((rows[best], cos[best]))
        return out


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, queries_per_task: int = 2048, trees: int = 48, candidates: float = 0.4, seed: int = 17) -> DataFrame:
    """The k nearest rows (largest cosine) of each row whose id is divisible by `every`: (query_id, rank, vec_id, score).

    All rows are dealt by hash into blocks of about `block`, each with a forest of its own; queries meet every block in
    parts of about queries_per_task, so that a task is bounded in both. A task returns k rows for each query, which are
    ranked over all blocks. `candidates` is the share of a block that a query gathers at least, whatever the number of rows.

    Vectors that are null, zero, or hold null or non-finite components take no part; neither do those of another
    length than the query. A query is not its own candidate, but other rows of the same id are. Rows with a null id can't be
    found or asked for. Equal cosines go to the smaller id. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    valid = materialise(rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector")), "vectors")
    n, n_queries = valid.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    n_blocks, n_parts = max(1, -(-n // block)), max(1, -(-n_queries // queries_per_task))
    at = F.xxhash64("key")
    as_rows = valid.select("key", "id", "vector", "size", F.lit(0).alias("side"), F.pmod(at, F.lit(n_blocks)).alias("ti"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))).alias("tj"))
    as_queries = valid.where(F.col("id") % every == 0).select("key", "id", "vector", "size", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("ti"), F.pmod(at, F.lit(n_parts)).alias("tj"))
    schema = pa.schema([("q_key", pa.int64()), ("query_id", pa.int64()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["size", "ti", "tj"]):
            side, key, ids = group["side"].to_numpy(), group["key"].to_numpy(), group["id"].to_numpy()
            if side.all() or not side.any():
                continue
            x = unit_rows(group["vector"])
            raw = np.asarray(group["vector"].combine_chunks().flatten(), np.float64).reshape(len(x), -1)
            base, query = side == 0, side == 1
            # scaled so that squares neither overflow nor vanish, by a power of two, which changes no digit
            raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])
            own = ids[base]
            forest = PrefixForest(x[base], raw[base], trees, seed)
            got = forest.search(x[query], raw[query], key[query], key[base], own, max(k + 1, int(candidates * base.sum())), k)
            lists = [[{"score": s, "vec_id": i} for s, i in zip(cos.tolist(), own[rows_].tolist(), strict=True)] for rows_, cos in got]
            yield pa.RecordBatch.from_arrays([pa.array(key[query]), pa.array(ids[query]), pa.array(lists, schema.field("found").type)], schema=schema)

    work = as_rows.unionByName(as_queries).repartition(parts, "size", "ti", "tj").sortWithinPartitions("size", "ti", "tj")
    near = work.mapInArrow(run, "q_key long, query_id long, found array<struct<score:double,vec_id:long>>")
    order = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0))
    best = near.groupBy("q_key", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found")), order), 1, k).alias("found"))
    return best.select("query_id", F.posexplode("found").alias("p", "f")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op9_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
