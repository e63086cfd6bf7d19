"""Connected components of links by contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node that has a link in ``a, b``: the smallest node it is connected with.

    Each step hooks every node that has a smaller neighbour to the smallest one,
    shortens the chains by pointer doubling, and goes on with the links between
    the trees' roots. No step gathers a component in one place.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    found = None
    while edges.head(1):
        parents = stage(edges.groupBy("a").agg(F.min("b").alias("p")), "parents")
        while True:
            higher = parents.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
            # many nodes may have the same parent: that side is split if one key fills a partition
            jumped = parents.join(higher, F.col("p") == F.col("_a"), "left").select(
                "a", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")
            )
            jumped = stage(jumped, "parents")
            parents = jumped.select("a", "p")
            if not jumped.filter("moved").head(1):
                break
        roots = parents.select(F.col("a").alias("_a"), F.col("p").alias("_p"))

        def to_root(df: DataFrame, name: str, roots: DataFrame = roots) -> DataFrame:
            joined = df.join(roots, F.col(name) == F.col("_a"), "left")
            return joined.withColumn(name, F.coalesce("_p", name)).drop("_a", "_p")

        found = stage(to_root(found, "p").unionByName(parents) if found is not None else parents, "components")
        up = to_root(to_root(edges, "a"), "b").filter("a <> b")
        edges = stage(up.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    tops = found.select(F.col("p").alias("a"), "p").distinct()
    return found.unionByName(tops).groupBy("a").agg(F.min("p").alias("p")).select(F.col("a").alias("node"), F.col("p").alias("label"))
