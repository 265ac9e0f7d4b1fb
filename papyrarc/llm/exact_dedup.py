"""Exact deduplication (operator 12): a two-pass Bloom filter finds texts that may repeat; only their rows are shuffled.

The first pass counts how many rows set each bit of a Bloom filter and keeps the bits that several rows set. In the second pass a row whose
bits are all among these may have a copy; all others have none and go straight to the result. Built-in functions only.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialise, table

#: Bits of the filter for each row, and bits that a row sets. With 16 and 2 some 1.4 % of the rows without a copy are taken for possible ones.
BITS_PER_ROW = 16
BITS_SET = 2

#: Bits in one row of the filter's table, as many as Spark's bitmap functions put into one bitmap.
PAGE = 32_768

#: A filter has at most so many pages (128 MiB); more rows are divided by their hashes into slices that have a filter each.
MOST_PAGES = 32_768


def _normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def _bits(slice_pages: int) -> Column:
    """The bits that a row sets in the filter of its slice: (page, place in the page)."""
    places = [F.pmod(F.xxhash64("text_sha256", F.lit(k)), F.lit(slice_pages * PAGE)) for k in range(BITS_SET)]
    return F.array(*[F.struct(F.floor(p / PAGE).cast("int").alias("page"), (p % PAGE).cast("int").alias("place")) for p in places])


def _is_set(page_bits: Column, place: Column) -> Column:
    """Whether the bit at a place of a page is set; false if there is no such page."""
    byte = F.conv(F.hex(F.substring(page_bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte.cast("long"), place.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def _mark_possible_copies(rows: DataFrame, pages: int) -> DataFrame:
    """`rows` with `possible`: false only if no other row of this slice has the same hash. The filter of `pages` pages is broadcast."""
    rows = rows.withColumn("bits", _bits(pages))
    hits = rows.select(F.explode("bits").alias("b")).groupBy("b.page", "b.place").agg(F.count("*").alias("n"))
    # a row may set one bit twice, so that n counts it twice: this can only make a row a possible copy
    shared = materialise(hits.where("n > 1").groupBy("page").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("page_bits")), "bloom")
    for k in range(BITS_SET):
        lookup = shared.select(F.col("page").alias(f"page{k}"), F.col("page_bits").alias(f"bits{k}"))
        rows = rows.withColumn(f"page{k}", F.col("bits")[k]["page"]).join(F.broadcast(lookup), f"page{k}", "left")
    possible = functools.reduce(Column.__and__, [_is_set(F.col(f"bits{k}"), F.col("bits")[k]["place"]) for k in range(BITS_SET)])
    return rows.withColumn("possible", possible).drop("bits", *[f"{name}{k}" for k in range(BITS_SET) for name in ("page", "bits")])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_pages: int = MOST_PAGES) -> DataFrame:
    """One row for each of `docs`: id_col, keep_id, group_size long, kept boolean, text_sha256.

    Texts are equal when they are identical without spaces, tabs, line breaks, form feeds and vertical tabs; null counts as empty. Of equal texts
    the row with the most code points stays, then that of the least id, nulls last, then any one of rows equal in both, so that one row
    of each group has `kept`. Texts are hashed where they are read, whole, and never shuffled, however long; `group_size` is as large as the
    group. Other columns are ignored, also those with names of the result. An empty table gives an empty result.

    Hashes are counted through a filter of at most `most_pages` pages of 4 KiB, which is broadcast; where the rows need more bits, they are
    divided by hash into slices, one filter after the other. Groups of any size are joined without bringing them into one task.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hashed = materialise(
        texts.select("id", F.sha2(_normalised(F.col("text")), 256).alias("text_sha256"), F.char_length("text").alias("length"), F.monotonically_increasing_id().alias("row")),
        "hashed",
    )
    n = hashed.count()
    pages = max(1, -(-n * BITS_PER_ROW // PAGE))
    slices = -(-pages // most_pages)
    part = F.pmod(F.xxhash64("text_sha256", F.lit("slice")), F.lit(slices))
    marked = [_mark_possible_copies(hashed.where(part == i) if slices > 1 else hashed, -(-pages // slices)) for i in range(slices)]
    marked = materialise(functools.reduce(DataFrame.unionByName, marked), "marked", by="possible")

    maybe = marked.where("possible").drop("possible")
    # the best row is the least: longest, then with an id, then of the least id
    rank = F.struct((-F.col("length")).alias("length"), F.col("id").isNull().alias("no_id"), "id", "row")
    groups = materialise(maybe.groupBy("text_sha256").agg(F.min(rank).alias("best"), F.count("*").alias("group_size")), "groups")
    found = join_groups(maybe, groups, ["text_sha256"], "group_size", n)
    alone = marked.where(~F.col("possible"))
    out = [F.col("id").alias(id_col), F.col("keep_id"), F.col("group_size").cast("long").alias("group_size"), F.col("kept"), F.col("text_sha256")]
    return (
        found.withColumns({"keep_id": F.col("best.id"), "kept": F.col("row") == F.col("best.row")}).select(out)
        .unionByName(alone.withColumns({"keep_id": F.col("id"), "group_size": F.lit(1), "kept": F.lit(True)}).select(out))
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with texts as (select doc_id, length(coalesce(text, '')) as length, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
ranked as (
  select *, count(*) over (partition by text_sha256) as group_size,
    first_value(doc_id) over best as keep_id, row_number() over best = 1 as kept
  from texts window best as (partition by text_sha256 order by length desc, doc_id nulls last)
)
select doc_id, keep_id, group_size, kept, text_sha256 from ranked
"""
