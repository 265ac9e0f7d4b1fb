"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialise


#: Nodes are joined apart if they have so many rows, and so many that there can be no more than HOT_NODES of them.
HOT_NODES, HOT_LEAST = 20_000, 1000


def _with_least(edges: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """Each row (a, b) with m of its node a out of `least` (a, m, n: how many rows a has).

    Nodes with so many rows that there can be no more than HOT_NODES of them are few, and so are broadcast; their rows stay where
    they are. All others are joined by key, and none of them fills a task.
    """
    many = max(HOT_LEAST, 1 + n_rows // HOT_NODES)
    hot = F.broadcast(least.where(F.col("n") >= many).select(F.col("a").alias("of"), F.col("m").alias("hot_m")))
    marked = edges.join(hot, F.col("a") == F.col("of"), "left")
    rest = marked.where("of is null").select("a", "b").join(least.where(F.col("n") < many).select("a", "m"), "a")
    return rest.select("a", "b", "m").union(marked.where("of is not null").select("a", "b", F.col("hot_m").alias("m")))


def _large_star(edges: DataFrame, n_rows: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(both, least, 2 * n_rows).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n_rows: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, n_rows).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable, for every id that has an edge to a smaller or larger one.

    `edges` has the columns a and b (longs, a <> b). Each round is two grouped minima and two joins on
    whole edge tables, in which the nodes of most edges are joined apart; nothing is collected but a row count and checksum, which tell that a round has
    changed nothing. Rounds are written to the shared folder, so that a lost executor costs no more
    than the running round. Raises RuntimeError if `max_rounds` do not suffice.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # neither star adds rows
        after = materialise(_small_star(_large_star(now, mark[0]), mark[0]).distinct(), "edges")
        mark_after = _mark(after)
        drop_scratch(now)
        now, done, mark = after, mark_after == mark, mark_after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    star = now.groupBy("a").agg(F.min("b").alias("b"))
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).union(star.select("b", "b").distinct())
