"""Connected components of a graph given as edges, by alternating large and small stars.

Each round is two aggregations with partial sums before the shuffle and two joins that adaptive execution
can split where a node has very many neighbours. Rounds are written to the shared folder, so lineage stays
short and a lost executor costs one round at most. The number of rounds grows with the logarithm of a
component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.llm.common import materialize


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them. Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)` for the nodes of `edges(a, b)`; a component is named by its least node.

    The least node of each component is not listed. Loops and repeated edges do no harm; no edges give no rows.
    """
    state = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        sign = tuple(state.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if sign == seen or sign[0] == 0:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = sign
        state = materialize(_small(_large(state)), "edges")
