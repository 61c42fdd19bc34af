"""Connected components by alternating star contractions, all in DataFrame joins.

Each round replaces the edges by shorter ones: every node first hands its larger
neighbours to its smallest neighbour, then its smaller ones.  Rounds grow with the
logarithm of the longest chain.  No neighbourhood is gathered anywhere: minima are
partially aggregated, and hot hubs meet a one-row side in joins that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that an edge names.

    ``component`` is the smallest node id reachable.  Null ends, loops and repeated edges
    are ignored; no edges give an empty table.
    """
    a, b = F.col(src), F.col(dst)
    e = (
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        far = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        far = far.distinct()
        root = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        shorter = materialize(near.union(root).distinct(), "edges")
        discard(e)
        e = shorter
        total, heads = e.agg(F.count("*"), F.count_distinct("u")).first()
        chained = e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
        if total == heads and chained:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct().toDF("node", "component")
    )
