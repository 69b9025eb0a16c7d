"""Connected components of an edge table, by large-star and small-star rounds (Kiveris et al. 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.storage import stage


def _print(links):
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a="a", b="b") -> DataFrame:
    """(node, component) for every node of an edge that joins two different nodes.

    component is the least node reachable. Edges may repeat, and be in any direction; edges with
    a null end are ignored. Nodes without an edge to another node are left out. Each round is
    a few joins and aggregations on the edge table, kept in the shared folder. So are the
    aggregates before they are joined on their own key: in one stage with that join they would
    keep Spark from splitting a hub's edges over tasks.
    """
    links = stage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "links",
    )
    seen = _print(links)
    while seen[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = stage(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
            .join(least, "u")
            .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")),
            "large-star",
        )
        lowest = stage(large.groupBy("hi").agg(F.min("lo").alias("m")), "lowest")
        small = (
            large.distinct()
            .join(lowest, "hi")
            .where(F.col("lo") != F.col("m"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        links = stage(small.union(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        now = _print(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
