"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .frames import cut, drop


def _counted(links: DataFrame) -> tuple[DataFrame, dict]:
    """The links as a table, with their count and the sum of their hashes, taken while they are written."""
    watched = Observation()
    out = cut(links.observe(watched, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
    return out, watched.get


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Each round points the larger neighbours of every node to its smallest one, then the smaller neighbours and the node
    itself to the smallest of them, until no link changes. The smallest neighbour is found by an aggregate and joined
    back, so a node with very many links is split among tasks. No links give no rows. The result is a table of its own,
    the only one that is left.
    """
    now, state = _counted(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    while state.get("n") and state != before:
        before = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.least("a", "least").alias("b")).where("a != b").distinct()
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        small = large.join(least, F.col("a") == F.col("node")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct(F.col("node").alias("a"), F.col("least").alias("b")))).alias("x")).select("x.a", "x.b")
        last = now
        now, state = _counted(small.where("a != b").distinct())
        drop(last)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots))
    drop(now)
    return out
