"""Connected components of a large graph by alternating large-star and small-star steps.

Every step joins and groups the edges by one end; nothing but counts and checksums reaches the
driver. Edges are written to the shared folder after each round. Nodes with a large share of the
edges (more than E / HUBS of them, so less than 2 HUBS nodes: they are broadcast) have their row
copied SALTS times and their edges dealt among the copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.shared import drop_written, written

HUBS = 500
LEAST_HUB = 1000
SALTS = 32


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"]


def _met(edges: DataFrame, node: str, other: str, total: int, value: DataFrame) -> DataFrame:
    """edges joined with value (node, m): one row for each of their nodes."""
    hubs = F.broadcast(edges.groupBy(node).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > max(LEAST_HUB, total // HUBS)).select(node, F.lit(True).alias("hub")))
    flagged = edges.join(hubs, node, "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0).cast("int")).drop("hub")
    copied = value.join(hubs, node, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hub"), SALTS - 1).otherwise(0)))).drop("hub")
    return flagged.join(copied, [node, "salt"]).drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for every node that has an edge, the smallest node that it is connected with.
    Loops and nulls are ignored; direction and repetition of edges don't matter."""
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = written(_met(now, "v", "u", mark[0], least).select("u", F.col("m").alias("v")).distinct(), "edges")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _met(large, "u", "v", mark[0], smallest).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        was, mark = mark, _mark(after)
        drop_written(now)
        drop_written(large)
        now = after
        if mark == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
