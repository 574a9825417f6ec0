"""Sources mixed to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.sources.scratch import written

#: Probabilities of all sources together that a join may broadcast, eight bytes each.
BROADCAST_NUMBERS = 1_000_000
#: A hash is cut to so many hexadecimal digits, which a double holds exactly.
DIGITS = 13


def uniform(seed: str, *parts: str | Column) -> Column:
    """A number from 0 to below 1 by a hash of the seed and the parts."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *texts).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def with_poisson(sources: DataFrame) -> DataFrame:
    """sources (__source, __mean) with __below: the Poisson distribution's cumulative probabilities of 0, 1, 2 and so on.

    As far as they count, and summed from logarithms, so that large means do not vanish. Running sums over
    one row for each number take time in proportion to the mean.
    """
    mean = F.col("__mean")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("long")
    rows = sources.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    so_far = Window.partitionBy("__source").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    term = F.when(F.col("__k") == 0, -mean).otherwise(F.log(mean) - F.log(F.greatest(F.col("__k"), F.lit(1)).cast("double")))
    rows = rows.withColumn("__log", F.sum(term).over(so_far))
    rows = rows.withColumn("__c", F.sum(F.exp("__log")).over(so_far))
    listed = F.sort_array(F.collect_list(F.struct("__k", "__c")))
    return rows.groupBy("__source").agg(F.transform(listed, lambda r: r["__c"]).alias("__below"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, seed: str = "mix") -> DataFrame:
    """docs (doc_id, source, and any others) repeated so that sources come out at target weights.

    A document of a source of weight w and n documents, of the sum W of all present sources' weights,
    comes total * w / W / n times on average (total: all documents if not given). How often it comes is
    the inverse of the Poisson distribution with that mean at a hash of seed and doc_id, so a run
    gives the same rows anywhere. weights None weighs all sources alike, a missing source has weight
    0 and goes, as does a source of negative weight. A null source is a source of its own, of the key
    None in weights. The columns copy (1 to n_copies), n_copies and mix_key are added, in place of
    others of these names. Rows are dealt out over all partitions and sorted within them by mix_key,
    a hash. Rows with one doc_id and source come equally often. An empty table gives an empty result.
    """
    rows = docs.drop("copy", "n_copies", "mix_key")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(max(0.0, value)))).otherwise(weight)
    sizes = written(sizes.withColumn("w", weight))
    whole = sizes.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    goal, sum_w = float(total if total is not None else whole["n"] or 0), float(whole["w"] or 0)
    mean = F.lit(goal) * F.col("w") / F.lit(sum_w or 1.0) / F.col("n")
    sources = sizes.select(F.col("source").alias("__source"), mean.alias("__mean")).where("__mean > 0")
    rates = written(with_poisson(sources))
    numbers = rates.agg(F.sum(F.size("__below"))).first()[0] or 0
    joined = rows.join(F.broadcast(rates) if numbers <= BROADCAST_NUMBERS else rates, rows["source"].eqNullSafe(F.col("__source")))
    u = uniform(seed, "doc_id")
    copies = F.size(F.filter("__below", lambda c: c <= F.col("__u")))
    counted = joined.withColumn("__u", u).withColumn("n_copies", copies).drop("__source", "__below", "__u").where("n_copies > 0")
    out = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy")).cast("binary"))
    return out.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")
