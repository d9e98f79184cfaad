"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise, release


def _star(rows: DataFrame, keep) -> DataFrame:
    """Each u's neighbours v are linked to the least of u and all v. Minima are aggregated before the join, so a
    node with very many links is split like any skewed join key."""
    least = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return keep(rows.join(least, "u"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (least node reachable) of every node that edges (u, v) name."""
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = materialise(edges.where("u <> v").select(high, low).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, lambda j: j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()  # its shuffle serves both of its uses
        small = _star(large, lambda j: j.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v"))
        after = materialise(small.distinct(), "edges")
        release(now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._geoloom_path = now._geoloom_path  # for release()
    return out
