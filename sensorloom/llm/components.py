"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.sources.scratch import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): each node that has a link, with the smallest node of its component.

    links has columns a and b. Rows with a null or with equal ends, and repeated rows, have no effect;
    an empty table gives an empty result. Each step takes minima by partial aggregates and joins
    them to written edges, so that adaptive execution can split the edges of a hub. The number of
    steps grows with the logarithm of the longest chain.
    """
    ends = links.where("a is not null and b is not null and a <> b")
    edges = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy(F.col("a").alias("hub")).agg(F.least(F.min("b"), F.first("a")).alias("low"), F.min("b").alias("next"), F.count(F.lit(1)).alias("n")))
        # Once each node with a smaller neighbour has no other, the smallest node of a component is the only hub.
        if least.where("next < hub and n > 1").isEmpty():
            break
        large = written(edges.join(least, edges["a"] == least["hub"]).select(F.col("low").alias("a"), "b").distinct())
        lower = written(large.groupBy(F.col("b").alias("hub")).agg(F.min("a").alias("low")))
        joined = large.join(lower, large["b"] == lower["hub"]).select("a", "b", "low")
        pairs = joined.select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = written(pairs.where("a <> b").distinct())
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
