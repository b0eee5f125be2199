"""Exact order statistics of large groups.

A group may hold most of the rows, so it is never collected and never sorted. The rank is searched for by counting: every pass cuts the
interval in which it lies at values that a mergeable sketch proposes, and counts the rows between the cuts and on them. However
good the sketch was, the counts tell exactly where the rank is. A pass leaves one value, or a small part of the interval; cuts are
cells of their own, so a value that repeats does not hold the search up. Once an interval has few rows its values are read in
order. All sizes take this one path, larger groups with more passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacast.session import stage

ACCURACY = 1_000
#: Cuts of an interval in one pass.
CUTS = 64
#: Rows of an interval that are read in order.
FEW = 4_096


def _narrowed(data: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of the intervals that hold their ranks: ``(keys, rank, before, low, high, held)``, from one sketch and one count.

    ``data`` is ``(keys, v)``; an interval holds ``held`` rows from ``low`` to ``high`` behind ``before`` smaller ones.
    """
    names = [*keys, "rank"]
    # intervals: a few per group, and groups are slices and conditions, a short list the caller chose
    inside = data.join(F.broadcast(intervals), keys).where(F.col("v").between(F.col("low"), F.col("high")))
    shares = [i / CUTS for i in range(1, CUTS)]
    edges = inside.groupBy(*names).agg(F.array_distinct(F.percentile_approx("v", shares, ACCURACY)).alias("edges"))
    below = F.size(F.filter("edges", lambda edge: edge < F.col("v")))
    cell = 2 * below + F.array_contains("edges", F.col("v")).cast("int")
    counts = inside.join(F.broadcast(edges), names).groupBy(*names, cell.alias("cell")).agg(
        F.min("before").alias("before"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("held")
    )
    so_far = Window.partitionBy(*names).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.col("before") + F.coalesce(F.sum("held").over(so_far), F.lit(0)))
    return placed.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("held")))


def _valued(data: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, rank, v)``: the values at the ranks, from intervals of one value or of few rows."""
    names = [*keys, "rank"]
    single = intervals.where("low = high").select(*names, F.col("low").alias("v"))
    several = intervals.where("low < high")
    inside = data.join(F.broadcast(several), keys).where(F.col("v").between(F.col("low"), F.col("high")))
    values = inside.groupBy(*names, "before").agg(F.sort_array(F.collect_list("v")).alias("values"))
    return single.unionByName(values.select(*names, F.get("values", (F.col("rank") - F.col("before")).cast("int")).alias("v")))


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, object]]) -> DataFrame:
    """Per group the value at fractional rank, linear between neighbours.

    ``wanted`` maps an output name to ``(p, rank)``: the share near which the rank lies and a function
    from the group size (Column) to the zero-based, possibly fractional rank. Null and NaN values do not count.
    """
    data = stage(df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("v")), "values")
    groups = stage(data.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "groups")
    targets = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("double").alias("at")) for name, (_, rank) in wanted.items()])
    asked = groups.select(*keys, "n", "low", "high", F.inline(targets)).withColumns(
        {"first": F.floor("at"), "second": F.least(F.floor("at") + 1, F.col("n") - 1)}
    )
    ranks = asked.select(*keys, "n", "low", "high", F.explode(F.array("first", "second")).alias("rank")).distinct()
    intervals = stage(ranks.select(*keys, "rank", F.lit(0).cast("long").alias("before"), "low", "high", F.col("n").alias("held")), "intervals")
    large = (F.col("low") < F.col("high")) & (F.col("held") > FEW)
    while intervals.where(large).limit(1).count():
        narrowed = _narrowed(data, intervals.where(large), keys).select(intervals.columns)
        intervals = stage(narrowed.unionByName(intervals.where(~large)), "intervals")
    found = stage(_valued(data, intervals, keys), "found")
    a, b = found.toDF(*keys, "first", "a"), found.toDF(*keys, "second", "b")
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return (
        asked.join(F.broadcast(a), [*keys, "first"])
        .join(F.broadcast(b), [*keys, "second"])
        .groupBy(*keys)
        .agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, value_at)).alias(name) for name in wanted])
    )


def linear_rank(p: float):
    """Rank of the linearly interpolated quantile."""
    return lambda n: (n - 1) * F.lit(p)


def conformal_rank(coverage: float):
    """Finite-sample rank that covers the next value with the given probability."""
    return lambda n: F.least(n - 1, F.greatest(F.lit(0), F.ceil((n + 1) * F.lit(coverage)) - 1))


def deciles() -> dict[str, tuple[float, object]]:
    return {name: (p, linear_rank(p)) for name, p in (("p10", 0.10), ("p50", 0.50), ("p90", 0.90))}
