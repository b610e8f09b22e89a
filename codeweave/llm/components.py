"""Connected components of an edge table, by alternating large and small stars.

Nothing but whether a round is needed reaches the driver. Each round is written to the
shared folder, which cuts the lineage. Smallest neighbours are found by partial
aggregation, so a node with very many neighbours is one row of the joined side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, passing


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, *, most_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node of the component of every node of edges (u, v), both long. Self edges, repeated
    edges and either direction may occur; nulls are ignored; no edges give an empty table."""
    tables = Tables(edges.sparkSession, "components")
    now = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = tables.put(now, "0")
    for i in range(1, most_rounds + 2):
        # done when all edges point to a root: no node has two smaller neighbours or stands on both sides
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("up")))
        with passing(edges.sparkSession):
            going = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("down")).where("ups > 1 or ups = 1 and down = 0").limit(1).count()
        if not going:
            break
        if i > most_rounds:
            raise RuntimeError(f"no end after {most_rounds} rounds")
        # large star: all larger neighbours of a node point to its smallest one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both).withColumn("m", F.least("m", "u")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours point to the smallest one
        large = large.where("u != v").distinct()
        small = large.join(_least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = tables.put(small, str(i))
        tables.drop(str(i - 1))
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
