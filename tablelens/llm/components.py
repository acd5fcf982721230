"""Connected components of a link table by randomised contraction.

Each round gives every node a random priority, points it at the least of its neighbours and itself, and
contracts the links along these pointers; a round removes a constant share of the nodes whatever the shape
(long chains and large stars alike), so rounds grow with the logarithm of the largest component. Minima
combine before they are shuffled, so a node with many links costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import dealt, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; any direction, repeats and loops allowed):
    nodes share a root exactly when links connect them. Roots are arbitrary members."""
    links = links.where("a != b")
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(rounds)
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))
        to = written(edges.groupBy("a").agg(F.min(rank("b")).alias("m"))
                     .select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to")), f"pointers-{k}")
        to = dealt(to, to.count())
        rounds.append(to)
        edges = written(edges.join(to, F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b")
                        .join(to, F.col("b") == F.col("node")).select("a", F.col("to").alias("b"))
                        .where("a != b").distinct(), f"edges-{k}")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[-1].select("node", F.col("to").alias("root"))
    for to in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        out = to.join(later, F.col("to") == F.col("__n"), "left").select("node", F.coalesce("__r", "to").alias("root"))
    return out
