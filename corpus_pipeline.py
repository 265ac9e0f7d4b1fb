"""A training-data pipeline: language, toxicity, near-duplicates, packing. Each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrarc.llm.common import crc_mod, drop_scratch, materialise, rows_of, small_batches, table
from papyrarc.llm.language_id import keep_determined, train_language_model
from papyrarc.llm.near_dedup import near_duplicates
from papyrarc.llm.packing import pack_documents
from papyrarc.llm.toxicity import keep_harmless, train_toxicity
from papyrarc.shipping import ship


def _prepare(spark: SparkSession) -> None:
    """What every stage needs: the package on the executors, and batches that leave room for the stages' other memory."""
    ship(spark)
    small_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null text, or no letter. The model learns from the language of four fifths of the rows.

    Every row is judged by its own text, so that null and repeated ids keep those of their rows that have a language. Texts of any
    length are read to their end; all columns stay, whatever their names. An empty table gives an empty result.
    """
    _prepare(spark)
    return keep_determined(docs, train_language_model(docs.where(crc_mod("doc_id", 5) != 0), "text", "lang"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic. The lexicon is learned from three fourths of the labelled rows.

    Every row is judged by its own text: of an id with a clean and a toxic text the clean one stays. Null and empty texts stay.
    Texts of any length are read to their end; all columns stay, whatever their names. An empty table gives an empty result.
    """
    _prepare(spark)
    return keep_harmless(docs, train_toxicity(docs.where(crc_mod("doc_id", 4) != 2), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, of a similarity of 0.8 or more over shingles of five words: that of the least id.

    Where ids are null or repeated, rows are numbered and grouped by number: of rows with the same id and similar texts one
    stays, rows with a null id come after all others of their group. Rows without words stay. A pair at the very threshold is missed
    with a probability of (1 - 0.8^5)^32 = 3e-6. Texts of any length are compared whole; all columns stay, whatever their names. An empty table gives an empty result.
    """
    _prepare(spark)
    grouped = lambda rows, by: near_duplicates(rows, id_col=by, percent=80, n_bands=32)
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").take(1):
        return rows_of(docs, grouped(docs, "doc_id").where("kept"), "doc_id")
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    first = rows.select(row, "doc_id").join(grouped(rows, row).select(row, "component_id"), row).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))).alias("first"))
    return rows_of(rows, first.select(F.col("first.row").alias(row)), row).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of 2048 tokens: a row for each piece.

    Null and empty texts hold the closing id alone, and null and repeated ids are documents of their own. Texts of any
    length are cut, never shortened; other columns are not read. An empty table gives an empty result.
    """
    import public_tokenizers

    _prepare(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL has no way to train and apply the models or to encode subwords; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each result is written as Parquet and read by the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        drop_scratch(*before)  # the stage before has been read
        before = [docs]
    return docs
