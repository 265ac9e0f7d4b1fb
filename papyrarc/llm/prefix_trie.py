"""Prefix trie of conversations (operator 13) by fixed-length blocks of turns.

Conversations are grouped by the digests of their beginnings at block ends first. Where all conversations that share a block's beginning
share its end too, the turns in between are taken from one of them. Only blocks where they diverge are grouped turn by turn.

A beginning is known by the exclusive or of a hash of each of its turns and their places, two 64-bit numbers. Every node is owned by
its smallest member, so a conversation owns a chain of nodes down to its last turn, and sums over a subtree are
sums over its members of what they own below: one pass over each conversation, and one grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, join_groups, materialise, table

#: Turns in a block.
BLOCK = 4

#: Bytes of ids that are joined to one row before a node's rows are brought together.
PIECE_BYTES = 1 << 16

KEY = ["x1", "x2"]


def digest_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each turn as (conv_id, place from 1, digest, points): the texts end here.

    Turns are in the order of `turn_col`, nulls first, then by digest. Null roles and texts are empty. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("points"))
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(by_turn).alias("place"), "digest", "points")


def rebuild(turns: DataFrame) -> DataFrame:
    """Each conversation c as the first h turns of conversation c - c % 100, then its own without its first h; h = crc32(c) % 6.

    Returns (conv_id, depth, digest, points), and one row of depth 0 for every conversation. A turn is taken by 99 conversations at most.
    """
    head = crc_mod("conv_id", 6).cast("int")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    heads = turns.where((F.col("conv_id") % 100 == 0) & (F.col("place") <= 5)).select(F.col("conv_id").alias("from_id"), "place", "digest", "points")
    members = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("from_id"), head.alias("head"))
    taken = members.join(heads, "from_id").where(F.col("place") <= F.col("head")).select("conv_id", "place", "digest", "points")
    own = turns.where(F.col("place") > head).select("conv_id", "place", "digest", "points")
    start = convs.select("conv_id", F.lit(0).alias("place"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("points"))
    # where the other conversation has fewer than h turns, places leave a gap
    depth = F.row_number().over(Window.partitionBy("conv_id").orderBy("place")) - 1
    return taken.unionByName(own).unionByName(start).select("conv_id", depth.alias("depth"), "digest", "points")


def _beginnings(turns: DataFrame, block: int) -> DataFrame:
    """Turns with the key of the beginning that they end, the last depth of their conversation, their block (from 0, -1 for the root), and whether they end it."""
    conv = Window.partitionBy("conv_id")
    so_far = conv.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)

    def key(seed: int) -> Column:
        hashed = F.when(F.col("depth") > 0, F.xxhash64("digest", "depth", F.lit(seed))).otherwise(F.lit(0).cast("long"))
        return F.bit_xor(hashed).over(so_far)

    rows = turns.select("conv_id", "depth", "points", key(1).alias("x1"), key(2).alias("x2"), F.max("depth").over(conv).alias("last"))
    in_block = F.floor((F.col("depth") - 1) / block).cast("int")
    return rows.withColumns({"block": in_block, "ends_block": (F.col("depth") % block == 0) | (F.col("depth") == F.col("last"))})


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of rows sorted by key and id, in decimal with commas: a row for each run of a key, or several if it is long."""
    for batch in batches:
        x1, x2, ids = (batch.column(c).to_numpy() for c in ("x1", "x2", "conv_id"))
        cuts = [0, *(np.flatnonzero((x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])) + 1).tolist(), len(ids)] if len(ids) else []
        out = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            out += [(x1[at], x2[at], ids[at], ",".join(map(str, ids[at : min(at + PIECE_BYTES // 16, high)].tolist()))) for at in range(low, high, PIECE_BYTES // 16)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["x1", "x2", "first", "joined"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces of ids, sorted by key and first id, a piece at a time."""
    held, state, out = None, None, []
    for batch in batches:
        for x1, x2, joined in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "joined")), strict=True):
            if (x1, x2) == held:
                state.update(b",")
            else:
                if held:
                    out.append((*held, state.hexdigest()))
                held, state = (x1, x2), hashlib.sha256()
            state.update(joined.encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["x1", "x2", "ends_sha256"])
            out = []
    if held:
        out.append((*held, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["x1", "x2", "ends_sha256"])


def hash_members(rows: DataFrame) -> DataFrame:
    """(x1, x2, ends_sha256) of rows (x1, x2, conv_id): the hash of each key's ids, ascending, with commas.

    Rows are sorted over all tasks by key and id, so that a key of many ids is joined to pieces in several tasks. A hash can't be
    divided: one task reads the pieces of a key, a 4096th as many as ids, and holds one at a time.
    """
    pieces = rows.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_joined_ids, "x1 long, x2 long, first long, joined string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed_ids, "x1 long, x2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, depth, digest, points), which have a row of depth 0 each.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, a row for each node:
    conv_id is the smallest conversation that begins with it, parent_conv_id its parent's, null for the root. n_leaves and saved_tokens
    sum up the subtree with its top: nodes without children, and points times the number of other members.
    The result is the same for every length of a block. Groups of any size are counted before they are shuffled and
    joined without bringing them into one task; a conversation's turns are read in order, in constant memory. An empty table gives an empty result.
    """
    rows = materialise(_beginnings(turns, block), "beginnings")
    n = rows.count()

    # block ends: how many conversations share them, and whether all those that share the block's beginning do
    ends = materialise(rows.where("ends_block").select("conv_id", "depth", "block", "last", *KEY), "ends")
    shared = materialise(ends.groupBy(*KEY).agg(F.count("*").alias("members"), F.min("conv_id").alias("owner"), F.max("last").alias("longest")), "shared")
    known = join_groups(ends, shared, KEY, "members", n)
    before = F.lag("members").over(Window.partitionBy("conv_id").orderBy("depth"))
    even = F.coalesce(F.col("members") == before, F.lit(True))
    blocks = known.select("conv_id", "block", even.alias("even"), "members", "owner", "longest")

    # of blocks where nothing diverges, one conversation's turns are enough
    mine = F.col("even") & (F.col("owner") == F.col("conv_id"))
    kept = materialise(rows.join(blocks, ["conv_id", "block"]).withColumn("mine", mine).where("ends_block or mine or not even"), "kept")
    refined = kept.where("not even").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("last").alias("longest"))
    whole = kept.where("mine").select("conv_id", "depth", F.col("members").alias("n_convs"), F.when(F.col("ends_block"), F.col("longest")).otherwise(F.col("last") + 1).alias("longest"))
    owned = whole.unionByName(refined.select(whole.columns)).select("conv_id", "depth", "n_convs", (F.col("longest") == F.col("depth")).cast("long").alias("leaf"))

    # what each conversation owns from a depth on
    conv = Window.partitionBy("conv_id")
    below = conv.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    above, under = conv.orderBy("depth"), conv.orderBy(F.desc("depth"))
    is_owned = F.col("n_convs").isNotNull()
    valued = (
        kept.drop("members", "owner", "longest").join(owned, ["conv_id", "depth"], "left")
        .withColumns({"owned": is_owned, "saved": F.coalesce((F.col("n_convs") - 1) * F.col("points"), F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0))})
        .withColumns({
            "own_saved": F.sum("saved").over(below), "own_leaves": F.sum("leaf").over(below),
            "own_child": (F.coalesce(F.lag("owned").over(under) & (F.lag("depth").over(under) == F.col("depth") + 1), F.lit(False))).cast("long"),
            "parent_owned": F.lag("owned").over(above), **{f"up_{k}": F.lag(k).over(above) for k in KEY},
        })
    )
    valued = materialise(valued.withColumn("inner", F.col("mine") & ~F.col("ends_block")), "valued")
    sums = materialise(
        valued.where("not inner").groupBy(*KEY)
        .agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.sum("own_child").alias("n_children"), F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved_tokens")),
        "sums",
    )

    # nodes inside blocks where nothing diverges have what the block's end has, and what lies between
    nodes = valued.where("owned").join(sums.select("conv_id", "depth", "n_children", "n_leaves", "saved_tokens"), ["conv_id", "depth"], "left")
    to_end = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumns({
        "n_children": F.when(F.col("inner"), F.lit(1)).otherwise(F.col("n_children")),
        "saved_tokens": F.when(F.col("mine"), F.sum(F.when(F.col("inner"), F.col("saved")).otherwise(F.col("saved_tokens"))).over(to_end)).otherwise(F.col("saved_tokens")),
        "n_leaves": F.when(F.col("mine"), F.max("n_leaves").over(to_end)).otherwise(F.col("n_leaves")),
    })

    # the parent of a chain's first node belongs to another conversation
    tops = materialise(valued.where("owned and depth > 0 and not parent_owned").select("conv_id", "depth", F.col("up_x1").alias("x1"), F.col("up_x2").alias("x2")), "tops")
    parents = join_groups(tops, sums.select(*KEY, F.col("conv_id").alias("top_parent"), "n_children"), KEY, "n_children", n)
    nodes = nodes.join(parents.select("conv_id", "depth", "top_parent"), ["conv_id", "depth"], "left")
    nodes = nodes.join(hash_members(rows.where("depth = last").select(*KEY, "conv_id")), KEY, "left")
    parent = F.when(F.col("depth") == 0, F.lit(None).cast("long")).otherwise(F.coalesce("top_parent", "conv_id"))
    longs = [F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), *longs, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialise(digest_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(rebuild(turns))


OP13_SQL = r"""
with recursive turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place
  from conversations where conv_id is not null
),
convs as (
  select conv_id, (xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda crc, d:
    list_reduce(list_prepend(xor(crc, d), range(8)), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)))) % 6 as head
  from (select distinct conv_id from turns)
),
rebuilt as (
  select c.conv_id, t.place, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 100 and t.place <= c.head
  union all
  select c.conv_id, t.place, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.place > c.head
),
steps as (
  select conv_id, row_number() over (partition by conv_id order by place) as depth, text, sha256(strlen(role) || ':' || role || text) as digest from rebuilt
),
paths as (
  select conv_id, 0 as depth, '' as path, '' as up, '' as text from convs
  union all
  select s.conv_id, s.depth, p.path || s.digest, p.path, s.text from paths p join steps s on s.conv_id = p.conv_id and s.depth = p.depth + 1
),
lasts as (select conv_id, max(depth) as last from paths group by conv_id),
nodes as (
  select path, min(up) as up, depth, min(conv_id) as conv_id, count(*) as n_convs, length(min(text)) as points,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = last), '')) as ends_sha256
  from paths join lasts using (conv_id) group by path, depth
),
children as (select up as path, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by up, depth),
counted as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (path, depth)),
subtrees as (
  select t.path, t.depth, sum((b.n_children = 0)::bigint) as n_leaves, sum((b.n_convs - 1) * b.points) as saved_tokens
  from counted b join paths p on p.conv_id = b.conv_id and p.depth <= b.depth join nodes t on t.path = p.path and t.depth = p.depth group by t.path, t.depth
)
select n.conv_id, n.depth::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from counted n join subtrees s using (path, depth) left join nodes u on n.depth > 0 and u.path = n.up and u.depth = n.depth - 1
"""
