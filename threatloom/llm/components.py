"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import beside, stored


def _least_neighbour(edges: DataFrame, most: int) -> DataFrame:
    """node, other, least: each of at most ``most`` edges beside the least of the node and its neighbours.

    The least is taken by a partial aggregate, and ``beside`` spreads the edges of a hub.
    """
    least = edges.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("n"))
    least = least.select("node", F.least("node", "least").alias("least"), "n")
    return beside(edges, least, "node", "n", most, "other").drop("n")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; the component is its least node.

    Every round writes its edges to the shared folder, so the plan stays short. Links of
    a node with itself are ignored; no link gives no row.
    """
    first, second = F.col(a), F.col(b)
    edges = stored(
        links.where(first != second)
        .select(F.greatest(first, second).alias("node"), F.least(first, second).alias("other"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        # Equal sums of the edges before and after a round: every tree is a star.
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))
        ).first()
        if state == seen or state[0] == 0:
            return edges.select("node", F.col("other").alias("component")).union(
                edges.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct()
            )
        seen = state
        back = F.struct(F.col("other").alias("node"), F.col("node").alias("other"))
        both = edges.select(F.explode(F.array(F.struct("node", "other"), back)).alias("e"))
        large = stored(
            _least_neighbour(both.select("e.*"), 2 * state[0])
            .where(F.col("other") > F.col("node"))
            .select(F.col("other").alias("node"), F.col("least").alias("other"))
            .distinct(),
            "large",
        )
        ends = F.explode(F.array("node", "other")).alias("node")
        small = (
            _least_neighbour(large, 2 * state[0])
            .select(ends, F.col("least").alias("other"))
            .where(F.col("node") != F.col("other"))
            .distinct()
        )
        edges = stored(small, "edges")
