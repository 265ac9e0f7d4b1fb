"""Near-duplicate vectors (operator 7): exact threshold pairs by dual traversal of cover trees, grouped by label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowgroups import runs
from .common import drop_scratch, materialise, table
from .components import components
from .covertree import build, pairs_within

BLOCK = 1024
PIVOTS = 64
#: Labels that get pivots are the largest ones, so many that the driver and broadcasts hold PIVOTS * PIVOTED_LABELS vectors at most.
PIVOTED_LABELS = 300


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors of equally long lists, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _to_cells(pivots: dict, block: int):
    """Give each vector the nearest pivot of its label and size, and the distance to it."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("part", pa.int64()), ("cell", pa.int64()), ("distance", pa.float64()), ("vector", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2).to_numpy()
            for part in np.unique(parts):
                t = batch.filter(pa.array(parts == part))
                x = unit_rows(t.column(3))
                centers = pivots.value.get(int(part))
                if centers is None:
                    cell, d = np.zeros(len(x), np.int64), np.full(len(x), 2.0)
                else:
                    cos = x @ centers.T
                    cell = cos.argmax(1)
                    d = np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(x)), cell]))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.array(cell.astype(np.int64)), pa.array(d), t.column(3).cast(pa.list_(pa.float64()))], schema=schema)

    return run


def _links(cosine: float):
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("least", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["task", "ti", "tj"]):
            key, ids = group["key"].to_numpy(), group["id"].to_numpy()
            side = group["side"].to_numpy()
            x = unit_rows(group["vector"])
            if (side == 0).all():
                tree = build(x, np.arange(len(x)))
                i, j = pairs_within(x, tree, tree, cosine)
            elif (side == 0).any():
                i, j = pairs_within(x, build(x, np.flatnonzero(side == 0)), build(x, np.flatnonzero(side == 1)), cosine)
            else:
                continue
            if not len(i):
                continue
            n = np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x))
            place = np.argsort(ids, kind="stable")  # groups are named by ranks of ids, so that the least id wins
            least = np.empty(len(x), np.int64)
            least[place] = np.arange(len(x))
            while True:
                before = least.copy()
                np.minimum.at(least, i, before[j])
                np.minimum.at(least, j, before[i])
                least = np.minimum(least, least[place][least])
                if (least == before).all():
                    break
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(key[has]), pa.array(ids[has]), pa.array(n[has]), pa.array(ids[place][least[has]])], schema=schema)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, max_pivots: int = PIVOTS) -> DataFrame:
    """Link vectors of equal label whose cosine is `cosine` or more, and group them.

    Returns (id_col, n_links, component_id, kept), a row for each vector. Exact: every pair of a label is either
    compared in double precision or ruled out by covering radii.

    The top of the tree is laid over all executors: at most max_pivots rows of each of the PIVOTED_LABELS largest labels (those of least hash) are cell
    centers, and a pair of cells is dropped if centers and covering radii say that no two of their rows can be near. Cells
    are cut into blocks of about `block` rows by hash, and each remaining pair of blocks is a task, which
    builds cover trees and descends them together. Tasks return counts and each row's least linked row, never pairs, so a group of
    copies of any size costs no more rows than it has members in each task.

    Vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with
    nothing; so do vectors of different lengths, and rows with a null id, which are kept. Repeated ids stay as rows that count
    each other, and belong to one component if linked. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(
        vectors.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
        .select("key", "id", F.when(F.col("label").isNotNull() & usable(F.col("vector")), F.xxhash64(F.col("label"), F.size("vector"))).alias("part"), "vector"),
        "vectors",
    )
    valid = rows.where("part is not null and id is not null")
    sizes = materialise(valid.groupBy("part").count(), "sizes")
    # the largest labels' pivots are the few rows of least hash: bounded by max_pivots for each of PIVOTED_LABELS labels
    hashed = valid.select("part", F.struct(F.xxhash64("key").alias("h"), "key").alias("k"))
    large = sizes.where(F.col("count") > block).orderBy(F.desc("count"), "part").limit(PIVOTED_LABELS)
    bound = F.broadcast(large.select("part", F.least(F.lit(max_pivots), F.ceil(F.col("count") / block)).cast("int").alias("cells"), "count"))
    salted = hashed.join(bound, "part").groupBy("part", "cells", F.pmod(F.col("k.h"), F.lit(max_pivots)).alias("s")).agg(F.min("k").alias("k"))
    chosen = salted.where(F.col("s") < F.col("cells")).select("k.key", "s")
    picked = valid.join(F.broadcast(chosen), "key").select("part", "s", "vector").toArrow()
    pivots: dict[int, np.ndarray] = {}
    if picked.num_rows:
        part_of = picked["part"].to_numpy()
        for part in np.unique(part_of):
            pivots[int(part)] = unit_rows(picked.filter(pa.array(part_of == part)).sort_by("s")["vector"])
    shared = spark.sparkContext.broadcast(pivots)
    celled = materialise(valid.select("key", "id", "part", "vector").mapInArrow(_to_cells(shared, block), "key long, id long, part long, cell long, distance double, vector array<double>"), "cells")
    limit = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    by_part: dict[int, list] = {}
    for c in celled.where(F.col("part").isin(list(pivots))).groupBy("part", "cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect():  # at most max_pivots for each pivoted label
        by_part.setdefault(c["part"], []).append(c)
    plan = []
    for part, own in by_part.items():
        for a in own:
            near = []
            for b in own:
                d = 0.0 if a is b else float(np.linalg.norm(pivots[part][a["cell"]] - pivots[part][b["cell"]]))
                if d - a["radius"] - b["radius"] <= limit:
                    near.append((int(b["cell"]), max(1, -(-int(b["n"]) // block))))
            plan.append((part, int(a["cell"]), max(1, -(-int(a["n"]) // block)), near))
    planned = spark.createDataFrame(plan, "part long, cell long, blocks int, near array<struct<cell:long,blocks:int>>")
    # labels without pivots are one cell; none of them has more than a PIVOTED_LABELS-th of all rows, unless it is a single block
    found_plan = celled.join(F.broadcast(planned), ["part", "cell"], "left")
    blocks = F.ceil(F.col("count") / block).cast("int")
    alone = found_plan.where("blocks is null").drop("blocks", "near").join(sizes, "part").select("key", "id", "part", "cell", "vector", blocks.alias("blocks"), F.array(F.struct(F.lit(0).cast("long").alias("cell"), blocks.alias("blocks"))).alias("near"))
    placed = found_plan.where("blocks is not null").select(alone.columns).union(alone).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("long"))
    own = F.col("cell") * (1 << 32) + F.col("block")
    others = F.flatten(F.transform("near", lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda b: c["cell"] * (1 << 32) + b.cast("long"))))
    tasks = placed.select("key", "id", "vector", F.col("part").alias("task"), own.alias("own"), F.explode(others).alias("other")).select(
        "key", "id", "vector", "task", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    found = materialise(tasks.repartition(parts, "task", "ti", "tj").sortWithinPartitions("task", "ti", "tj").mapInArrow(_links(cosine), "key long, id long, n long, least long"), "links")
    drop_scratch(celled, sizes)
    grouped = components(found.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    out = rows.select("key", "id").join(counts, "key", "left").join(grouped.withColumnRenamed("id", "member"), F.col("id") == F.col("member"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))

