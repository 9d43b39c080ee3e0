"""Connected components by alternating large-star and small-star steps, as joins and aggregations.

No group is gathered: each step takes the smallest neighbour by a partial aggregation and joins it back, so a node
with millions of links costs rows, not memory.  Each round is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a long, b long) to (node long, component long), component the smallest node reachable.

    Nodes without links do not appear; nulls and loops are ignored.  Empty links give an empty result.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "links",
    )
    for _ in range(most_rounds):
        if _is_forest(edges):
            break
        edges = stored(_small_star(_large_star(edges)), "stars")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )


def _is_forest(edges: DataFrame) -> bool:
    """True once every node hangs on one centre and no centre hangs on another; no edges are a forest too."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").limit(1).count()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    # written first, so that the join is dealt anew and a node with very many neighbours can be split
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = least.select("u", F.col("m").alias("v"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(moved).distinct()
