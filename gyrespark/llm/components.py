"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrespark.llm.common import persisted


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``links``; root is the smallest node reachable.

    Each round points every node to the neighbour (or itself) with the smallest
    hash of that round, follows one pointer further, renames both ends of all
    links and drops those inside a group.  Random order shrinks any graph by a
    constant factor, so the number of rounds is logarithmic.  Only links travel;
    a hub is reduced by partial minima.  Self links and null ends are ignored;
    an empty table gives an empty one.
    """
    edges = persisted(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    ends = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = ends(edges).select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    turn = 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c).alias("v"))  # noqa: E731,B023
        up = ends(edges).groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["v"].alias("p"))
        far = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        up = persisted(up.join(far, "p").select("a", F.col("pp").alias("p")))
        found = persisted(found.join(up.select(F.col("a").alias("root"), "p"), "root", "left").select(
            "node", F.coalesce("p", "root").alias("root")))
        to = up.select(F.col("a").alias("b"), F.col("p").alias("q"))
        edges = edges.join(up, "a").select("b", "p").join(to, "b").where("p <> q")
        edges = persisted(edges.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct())
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))
