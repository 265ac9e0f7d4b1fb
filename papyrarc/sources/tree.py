"""Snapshots of a table with a tree of checksums, by which two of them are compared without reading all rows.

Rows are dealt into buckets by a hash of their key and stored sorted by bucket. Each bucket has a number of rows and a checksum that doesn't
depend on their order; sixteen buckets make a node of the level above, up to one root. Where two nodes agree, nothing below them is read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Children of a node, and levels below the root.
FAN, LEVELS = 16, 3


def _digest(columns: list[str]) -> Column:
    """A row's checksum, 60 bits of a SHA-256 of all its columns, as a number that sums don't overflow."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def write_tree_snapshot(df: DataFrame, path: str, keys: list[str], levels: int = LEVELS) -> None:
    """Store a table below `path` (rows) with its tree of checksums (tree: level, node, n_rows, checksum). Keys may be null or repeat."""
    buckets = FAN**levels
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    df.withColumn("_bucket", bucket).repartitionByRange(parts, "_bucket", *keys).sortWithinPartitions("_bucket").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/rows")
    leaves = df.sparkSession.read.parquet(f"{path}/rows").groupBy(F.col("_bucket").alias("node")).agg(F.count("*").alias("n_rows"), F.sum(_digest(df.columns)).alias("checksum"))
    nodes = leaves.select("n_rows", "checksum", F.explode(F.array(*(F.struct(F.lit(at).alias("level"), F.expr(f"node div {FAN ** (levels - at)}").cast("int").alias("node")) for at in range(levels + 1)))).alias("x"))
    tree = nodes.groupBy("x.level", "x.node").agg(F.sum("n_rows").alias("n_rows"), F.sum("checksum").alias("checksum"))
    tree.repartitionByRange(1, "level", "node").sortWithinPartitions("level", "node").write.mode("overwrite").parquet(f"{path}/tree")


def differing_buckets(spark: SparkSession, before: str, after: str) -> list[int]:
    """The buckets in which two snapshots differ, found level by level from the root; there are FAN ** levels at most."""
    trees = [spark.read.parquet(f"{p}/tree") for p in (before, after)]
    levels = {t.agg(F.max("level")).first()[0] for t in trees} - {None}
    if len(levels) > 1:
        raise ValueError("snapshots with trees of different depth")
    suspects, depth = [0], max(levels, default=-1)
    for level in range(depth + 1):
        at = [t.where((F.col("level") == level) & F.col("node").isin(suspects)) for t in trees]
        both = at[0].alias("a").join(at[1].alias("b"), "node", "full")
        same = F.col("a.checksum").eqNullSafe(F.col("b.checksum")) & F.col("a.n_rows").eqNullSafe(F.col("b.n_rows"))
        differ = sorted(r.node for r in both.where(~same).select("node").collect())
        if not differ or level == depth:
            return differ
        suspects = [n * FAN + k for n in differ for k in range(FAN)]
    return []


def changed_rows(spark: SparkSession, before: str, after: str, keys: list[str]) -> DataFrame:
    """(keys, state): keys whose rows are added, removed or changed from one snapshot to the other. Only rows of differing buckets are read.

    Rows of one key are compared as a whole, in any order. Snapshots must have the same columns.
    """
    buckets = differing_buckets(spark, before, after)

    def side(path: str, name: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/rows")
        kept = rows.where(F.col("_bucket").isin(buckets) if buckets else F.lit(False))
        return kept.groupBy(*(F.col(k).alias(f"{name}_{k}") for k in keys)).agg(F.struct(F.count("*"), F.sum(_digest([c for c in rows.columns if c != "_bucket"]))).alias(name))

    same = functools.reduce(Column.__and__, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])
    both = side(before, "a").join(side(after, "b"), same, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select(*(F.when(F.col("a").isNull(), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys), state.alias("state"))
