"""A search index in segments: each batch of changes adds one, and nothing that was written is changed.

Below an index's folder, `segments/<name>` has the postings and documents of one or more batches, and `log/<batch>` one row that is written
last: which segments make up the index after that batch, and how many live documents and tokens it holds. A batch whose row is there is not
applied again; what a batch that broke off has left is overwritten when it is repeated. A document lives in the newest segment that names it;
that it was deleted is a row of a segment too.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .search import StoredIndex, build_index, forget, read_once

#: A segment is merged with the one before it unless that has more than so many times as many documents, so that there are few segments.
MERGE_FACTOR = 4


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _state(spark: SparkSession, path: str) -> dict | None:
    """The newest row of the log: batch, segments (name and number of documents, oldest first), n, tokens, stems. One row for each batch is listed."""
    if not _exists(spark, f"{path}/log"):
        return None
    newest = spark.read.schema("batch long, state string").json(f"{path}/log/*").orderBy(F.desc("batch")).limit(1).first()
    return newest and json.loads(newest.state) | {"batch": newest.batch}


def _segment(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/segments/{name}/{part}") for part in ("postings", "docs"))


def _live(spark: SparkSession, path: str, names: list[str], part: int) -> DataFrame:
    """Postings or documents of segments, oldest first, without those that a newer one names. Only the documents of newer segments are read for this."""
    found = []
    for k, name in enumerate(names):
        rows = _segment(spark, path, name)[part]
        if newer := names[k + 1 :]:
            named = functools.reduce(DataFrame.unionByName, [_segment(spark, path, x)[1].select("doc") for x in newer])
            rows = rows.join(named, "doc", "left_anti").select(rows.columns)
        found.append(rows)
    return functools.reduce(DataFrame.unionByName, found)


def _write(postings: DataFrame, docs: DataFrame, path: str, name: str) -> None:
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = f"{path}/segments/{name}"
    postings.repartitionByRange(parts, "term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{out}/postings")
    docs.write.mode("overwrite").parquet(f"{out}/docs")


def add_batch(changes: DataFrame, batch: int, path: str, id_col: str, fields: list[str], deleted_col: str | None = None, stems: bool = False) -> bool:
    """Apply a batch of inserts, updates and deletes, whole documents each; false if it has been applied, or a later one.

    A document that a batch holds several times counts as deleted if any of its rows is, else all its rows must have one text: keys are to be unique. Null
    ids are left out. Only the texts of the batch are read; of the index, ids and lengths, and the segments that are merged.
    """
    spark = changes.sparkSession
    state = _state(spark, path)
    if state and batch <= state["batch"]:
        return False
    gone = F.coalesce(F.col(deleted_col).cast("boolean"), F.lit(False)) if deleted_col else F.lit(False)
    rows = changes.where(F.col(id_col).isNotNull()).withColumn("_gone", gone)
    name = f"batch-{batch}"
    postings, doc_stats = read_once(build_index(rows.where(~F.col("_gone")), id_col, fields, stems), f"{path}/segments/{name}/unsorted")
    gone_docs = rows.where("_gone").select(F.col(id_col).alias("doc"), F.lit(0).cast("long").alias("length"), F.lit(True).alias("deleted"))
    _write(postings, doc_stats.withColumn("deleted", F.lit(False)).unionByName(gone_docs).dropDuplicates(["doc"]), path, name)
    forget(spark, f"{path}/segments/{name}/unsorted")

    segments = state["segments"] if state else []
    new = _segment(spark, path, name)[1]
    count = lambda df: df.where("not deleted").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    added = count(new)
    n, tokens = (state["n"], state["tokens"]) if state else (0, 0)
    if segments:
        replaced = count(_live(spark, path, [s[0] for s in segments], 1).join(new.select("doc"), "doc", "left_semi"))
        n, tokens = n - replaced.n, tokens - replaced.tokens
    segments = [*segments, [name, new.count()]]

    merged = [segments.pop()]
    while segments and segments[-1][1] <= MERGE_FACTOR * sum(s[1] for s in merged):
        merged.insert(0, segments.pop())
    if len(merged) > 1:
        names, name = [s[0] for s in merged], f"merged-{batch}"
        docs = _live(spark, path, names, 1)
        # of the oldest segment nothing is left to hide
        _write(_live(spark, path, names, 0), docs if segments else docs.where("not deleted"), path, name)
        merged = [[name, _segment(spark, path, name)[1].count()]]
    after = {"segments": [*segments, *merged], "n": n + added.n, "tokens": tokens + added.tokens, "stems": stems}
    spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(json.dumps(after)).alias("state")).coalesce(1).write.mode("overwrite").json(f"{path}/log/{batch}")
    return True


def read_segments(spark: SparkSession, path: str) -> StoredIndex:
    """The index as the newest batch has left it, for `search`, `bm25` and `phrase`. Raises FileNotFoundError where no batch was applied."""
    state = _state(spark, path)
    if not state:
        raise FileNotFoundError(path)
    names = [s[0] for s in state["segments"]]
    docs = _live(spark, path, names, 1).where("not deleted").select("doc", "length")
    return StoredIndex(_live(spark, path, names, 0), docs, state["stems"], totals=(state["n"], state["tokens"] / state["n"] if state["n"] else 0.0))


def index_stream(changes: DataFrame, path: str, checkpoint: str, id_col: str, fields: list[str], deleted_col: str | None = None, stems: bool = False, **trigger) -> StreamingQuery:
    """Feed an index from a stream: each micro-batch is a batch of the index under its own number, so that one that is repeated changes nothing."""
    apply = lambda df, batch: add_batch(df, batch, path, id_col, fields, deleted_col, stems)
    return changes.writeStream.foreachBatch(lambda df, batch: (apply(df, batch), None)[1]).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
