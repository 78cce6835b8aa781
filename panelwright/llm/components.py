"""Connected components by repeated contraction, in joins and map-side combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; root is the component's smallest node.

    In a round every node points to its smallest neighbour, or to itself if it
    is smaller; pointers are followed until they end, and the edges are drawn
    anew between the nodes they end at. Each node that is not alone meets
    another, so the number of nodes halves at least. Every round is written to
    the shared folder, so the plan stays short and nothing is done twice.
    """
    left = edges.filter(F.col("a") != F.col("b"))
    done = before = None
    while True:
        left = written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if before is not None:
            free(*before)
        if done is not None and left.isEmpty():
            return done
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"), F.lit(True).alias("moved")), "up")
        while True:
            over = up.select(F.col("node").alias("via"), F.col("root").alias("next"))
            further = written(up.join(over, F.col("root") == F.col("via")).select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "up")
            free(up)
            up = further
            if up.filter("moved").isEmpty():
                break
        step = up.select(F.col("node").alias("via"), F.col("root").alias("next"))
        if done is None:
            done = written(up.select("node", "root"), "roots")
        else:
            further = written(done.join(step, F.col("root") == F.col("via"), "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            free(done)
            done = further
        to_a = step.select(F.col("via").alias("a"), F.col("next").alias("ra"))
        to_b = step.select(F.col("via").alias("b"), F.col("next").alias("rb"))
        before = (left, up)
        left = left.join(to_a, "a").join(to_b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
