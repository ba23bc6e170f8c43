"""Connected components of pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut


#: Parts that the neighbours of a node are dealt to before its smallest one is known.
SALTS = 16


def _with_smallest(edges: DataFrame, by: str, of: str) -> DataFrame:
    """edges (by, of) with m, the smallest of a node and its neighbours.  A hub's edges are in SALTS parts, and its one number is copied to each."""
    near = edges.groupBy(F.col(by).alias("near_of")).agg(F.least(F.min(of), F.col(by)).alias("m"))
    near = near.withColumn("near_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int"))
    return salted.join(near, (F.col(by) == F.col("near_of")) & (F.col("salt") == F.col("near_salt"))).select(by, of, "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge table reaches.

    Large and small stars in turn: a node's larger neighbours are linked to the smallest it knows, then its smaller neighbours and itself to
    the smallest of them.  Edges become a star around each component's smallest node, in about the logarithm of its length rounds.  A round joins edges to one number a node, with hubs
    dealt to ``SALTS`` parts, so a component of any share of all nodes is many tasks.  Each round is cut into a table; only sums reach the driver.
    Rows with a null end are ignored; edges of a node to itself make it a component.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = cut(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "node"))
    kept = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = None
    while True:
        both = kept.union(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_with_smallest(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        near = _with_smallest(large, "u", "v")
        kept = cut(near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == was:
            break
        was = now
    stars = kept.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
