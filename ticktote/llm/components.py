"""Connected components of a table of links, by alternating star contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktote.llm.common import shared_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node that occurs in links: root is the smallest node reachable.

    Each round links every neighbour to the smallest node nearby, first towards larger and then towards smaller
    nodes, until nothing changes. Each round is written to the shared folder. Groups are only ever reduced to their
    minimum before a shuffle; no neighbourhood is gathered.
    """
    edges = shared_table(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        # large star: neighbours larger than u hang on the smallest of u and its neighbours
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        edges = shared_table(small, "stars")
        sign = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        if (sign["n"], sign["s"]) == seen:
            break
        seen = (sign["n"], sign["s"])
    roots = edges.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
