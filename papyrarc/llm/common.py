"""What the text and vector operators share: tables, scratch storage, split points."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the warehouse where that is not set."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder (a folder for each value of `by`, a column of few values) and read it back.

    This cuts lineage so that a lost executor costs a re-read, not a re-run, and keeps
    what several later jobs need from being computed again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that no later plan reads."""
    for df in tables:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(hadoop).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand rows with whole texts to Python so many at a time: a batch lies in the memory of both sides, in and out."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: What a process remembers from task to task, by operator: functions that forget it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def forget_others(owner: str) -> None:
    for other, forget in REMEMBERED.items():
        if other != owner:
            forget()


def give_back() -> None:
    """Hand freed memory back to the machine. Allocators hold on to it otherwise, for as long as a worker lives, and tasks of later stages come on top."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 4) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, that forgets what other operators remember in this process and gives freed memory back after every few batches and at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        try:
            for i, batch in enumerate(run(batches), 1):
                yield batch
                del batch
                if i % every == 0:
                    give_back()
        finally:
            give_back()

    return tidied


#: So many ids at most are broadcast.
BROADCAST_IDS = 1_000_000


def rows_of(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of `df` whose `column` is among `ids` (a column of the same name).

    The ids are written and counted first: up to BROADCAST_IDS of them are broadcast, so that the rows stay where they are; more are
    sorted and merged.
    """
    ids = materialise(ids.select(column).distinct(), "ids")
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), column, "left_semi").select(df.columns)


def crc_mod(column: Column | str, modulus: int) -> Column:
    """crc32 of the value as decimal text, modulo `modulus`; the split rule of the learning operators."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


#: Groups that hold more than one in so many of all rows are joined by broadcast; there can't be more of them than this.
HEAVY_GROUPS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Each of `rows` with the row of `groups` that has its `keys` (unique there and not null; `size`: so many rows have them at most).

    Groups of more than total / HEAVY_GROUPS rows, of which there are HEAVY_GROUPS at most as sizes add up to `total`, are broadcast, so that
    no key brings more than that many rows into one task; the other groups are joined by sorting. Rows without a group are left out.
    Both tables are read twice: hand over materialised ones.
    """
    heavy = groups.where(F.col(size) * HEAVY_GROUPS > total)
    light = groups.where(F.col(size) * HEAVY_GROUPS <= total)
    spread = rows.join(F.broadcast(heavy), keys)
    return spread.unionByName(rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti").join(light.hint("merge"), keys))
