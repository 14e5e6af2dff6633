"""Connected components by local contraction, in Spark joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.llm.common import discard, stored


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of every node of links (a, b: long); component is the smallest node reachable.

    Each round ranks the nodes by a hash of their own, maps every node to the one of least rank
    among itself and its neighbours, and contracts the links. In whatever order the ids come, a
    round leaves half of the nodes of a path and fewer of denser graphs, as expected values, so
    rounds grow with the logarithm of the number of nodes. The maps of all rounds are then followed
    from the last to the first. Tables shrink round by round and lie in shared storage, those of
    finished rounds are deleted. Hot nodes are pre-aggregated before any shuffle.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
    maps: list[DataFrame] = []
    while not links.isEmpty():
        rank = lambda c, turn=len(maps): F.xxhash64(F.col(c), F.lit(turn))
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = ends.groupBy("node").agg(F.min_by("other", rank("other")).alias("other"))
        to = stored(least.select("node", F.when(rank("other") < rank("node"), F.col("other")).otherwise(F.col("node")).alias("to")), tag)
        maps.append(to)
        moved = links.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        old, links = links, stored(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), tag)
        discard(old)
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = maps.pop()
    while maps:
        to = maps.pop()
        old = labels
        labels = stored(to.withColumnRenamed("to", "via").join(old.withColumnRenamed("node", "via"), "via", "left").select("node", F.coalesce("to", "via").alias("to")), tag)
        discard(to, old)
    least = stored(labels.groupBy("to").agg(F.min("node").alias("component")), tag)
    out = stored(labels.join(least, "to").select("node", "component"), tag)
    discard(labels, least, links)
    return out
