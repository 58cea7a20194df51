"""Connected components of a link table, as joins that run on the executors.

Alternates the "large star" and "small star" steps, which link every node to
the smallest node it has seen; the number of rounds grows with the logarithm of
the longest chain. Each round is written to the shared folder. A node with a
large share of all links is split by ``skew.attach``.

Edge cases: links with a null end, and of a node with itself, are left out;
repeated links count once; without links there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwright.llm.skew import attach
from sheetwright.llm.workspace import Workspace


def connected_components(links: DataFrame, space: Workspace, most_rounds: int = 60) -> DataFrame:
    """``links``: a, b. Returns (node, root) for every node of a link; root is the smallest node reachable."""
    edges = space.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = _digest(edges)
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = attach(both, least, "u", "v", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("by"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        nexts = space.save(attach(large, down, "u", "by", 2 * before[0]).select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        after = _digest(nexts)
        space.drop(edges)
        edges = nexts
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError("the components did not settle")


def _digest(edges: DataFrame) -> tuple:
    """Two rounds with the same rows have the same digest."""
    one = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("a"), F.bit_xor(F.xxhash64("v", "u", F.lit(1))).alias("b")).first()
    return tuple(one)
