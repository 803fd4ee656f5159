"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import drop_tables, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's component; nodes without links are not in it.

    Every round sends a node's neighbours to the smallest of them; the rounds are
    about the square of the logarithm of a component's size. A node with very many
    neighbours is an aggregate (its smallest neighbour) and a join, never a list.
    """
    now = links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter("x > y").distinct()
    now = materialise(now, "links")
    seen = None
    while True:
        # large star: neighbours larger than a node go to the smallest around it
        both = now.select(F.col("x").alias("n"), F.col("y").alias("o")).unionByName(now.select(F.col("y").alias("n"), F.col("x").alias("o")))
        least = both.groupBy("n").agg(F.least(F.col("n"), F.min("o")).alias("m"))
        large = both.join(least, "n").filter("o > n").select(F.col("o").alias("x"), F.col("m").alias("y")).filter("x > y").distinct()
        # small star: a node's smaller neighbours, and itself, go to the smallest of them
        lower = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lower, "x").select(F.explode(F.array(F.struct(F.col("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        small = small.select("e.x", "e.y").filter("x > y").distinct()
        before, now = now, materialise(small, "links")
        drop_tables(before)
        sums = now.agg(F.count("*"), F.sum(F.col("x").cast("decimal(38,0)")), F.sum(F.col("y").cast("decimal(38,0)")), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen = sums
    roots = now.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
    out = materialise(roots, "roots")
    drop_tables(now)
    return out
