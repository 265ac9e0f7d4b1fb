"""Running numbers, sums and rows before, key by key, for keys of any size.

A window reads each key in one task. Here rows are divided over all tasks by key and order, so that a key lies in as many neighbouring
parts as it needs. Windows run within parts; what lies before a part's first key, at most one row for each part, is carried over.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """`df`, written to the folder that all executors share and read again: a part keeps its number, whichever task reads it."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/parts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(rows: DataFrame, keys: list[str], order: list[str], number: str | None = None, sums: dict[str, str] | None = None, before: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """`rows` with, for each key in this order: the row's number from 1, sums over all earlier rows (0 for the first), and values of the row before (null for the first).

    `sums` and `before` name the new columns and the columns they are of. Rows equal in key and order come in any order. Null keys are one key; nulls
    add nothing to a sum. Hand over the columns that are needed only: rows are shuffled twice and stored in between.
    """
    sums, before = sums or {}, before or {}
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    in_part = Window.partitionBy("_part", *keys).orderBy(*order, "_row")
    earlier = in_part.rowsBetween(Window.unboundedPreceding, -1)
    values = F.struct(F.lit(True).alias("there"), *(F.col(c).alias(name) for name, c in before.items()))
    local = placed.withColumns({"_n": F.row_number().over(in_part).cast("long"), "_before": F.lag(values).over(in_part), **{f"_sum_{n}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()}})

    last = F.max_by(values, F.struct(*order, "_row")).alias("_last")
    totals = placed.groupBy("_part", *keys).agg(F.count("*").alias("_rows"), last, *(F.coalesce(F.sum(c), F.lit(0)).alias(f"_total_{n}") for n, c in sums.items()))
    by_key = Window.partitionBy(*keys).orderBy("_part")
    past = by_key.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_part").alias("_in"), *(F.col(k).alias(f"_of_{k}") for k in keys), F.sum("_rows").over(past).alias("_rows"), F.lag("_last").over(by_key).alias("_last"), *(F.sum(f"_total_{n}").over(past).alias(f"_total_{n}") for n in sums)
    ).where("_rows is not null")
    # parts are in the order of keys, so that only a part's first key goes on from an earlier one: no more rows than parts
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_part") == F.col("_in"))
    joined = local.join(F.broadcast(carried), same, "left")
    new = {n: F.col(f"_sum_{n}") + F.coalesce(F.col(f"_total_{n}"), F.lit(0)) for n in sums}
    new |= {n: F.coalesce("_before", "_last")[n] for n in before}
    if number:
        new[number] = F.col("_n") + F.coalesce("_rows", F.lit(0))
    return joined.select(*rows.columns, *(c.alias(n) for n, c in new.items()))
