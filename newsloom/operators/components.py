"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialise, remove_dir, shared_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node of its component) of every node that has an edge. Loops and repeated edges count once.

    Each round points every node's larger neighbours at its least neighbour and then its smaller ones; the number of rounds grows with the logarithm of
    the longest path. Nothing but edges is held, and each round's edges are written to the shared folder.
    """
    spark = edges.sparkSession

    def step(e: DataFrame) -> DataFrame:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: of each node, its smaller neighbours and itself point at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return small.where("u <> v").distinct()

    path = shared_dir(spark, "edges")
    cur = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges", path)
    before = None
    while True:
        sign = cur.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if sign == before:
            break
        before = sign
        new_path = shared_dir(spark, "edges")
        new = materialise(step(cur), "edges", new_path)
        remove_dir(spark, path)
        cur, path = new, new_path
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
