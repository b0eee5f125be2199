"""Per-campaign history as seen from many origins at once.

Facts, the same facts moved one calendar year ahead, and the edges of every window a probe day needs
go through one shuffle and one sort on the campaign. Running totals are read off at the edges and a
window is the difference of two of them, so the work per fact does not depend on window lengths and
no fact is repeated per origin. Counts of non-zero days decide whether a window is empty, therefore
"no spend" stays an exact zero. After the quality gate a campaign has at most one fact a day, so that
a window partition is bounded by the number of days in history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacast.contracts import CAMPAIGN, HIERARCHY, HORIZONS

FACT, PRIOR, EDGE = 0, 1, 2
OWN_CADENCE, SHARED_CADENCE = "own", "shared"


def campaigns(facts: DataFrame) -> DataFrame:
    """Campaign dimension with first and last observed day.

    Labels are grouping keys: they are unique per campaign once the gate has passed, and only dates
    are aggregated, which keeps this a hash aggregation.
    """
    return facts.groupBy(*CAMPAIGN, *HIERARCHY).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def _landing_days(day: Column) -> Column:
    """The days whose same date one year earlier is ``day``: none for 29 February, two before one."""
    ahead = F.add_months(day, 12)
    return F.filter(F.array(ahead, F.date_add(ahead, 1)), lambda d: F.add_months(d, -12) == day)


def _fact_and_prior(day: Column) -> Column:
    """Where a fact counts: on its own day, and as prior-year evidence on the days it stands for."""

    def at(kind: int, d: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.unix_date(d).alias("day"))

    return F.concat(F.array(at(FACT, day)), F.transform(_landing_days(day), lambda d: at(PRIOR, d)))


def origin_probes(dimension: DataFrame, origins: list) -> DataFrame:
    """Every campaign that already exists at an origin, for a short list of origin dates."""
    days = F.array(*[F.lit(d) for d in sorted(set(origins))])
    return dimension.select(
        *CAMPAIGN, *HIERARCHY, F.explode(F.filter(days, lambda d: d >= F.col("first_date"))).alias("date")
    )


def training_probes(
    dimension: DataFrame, first_day, horizons: tuple[int, ...] = HORIZONS, step: int = 21, shared: bool = True
) -> DataFrame:
    """Cut-off days: each campaign's own 21-day cadence and, if asked, the cadence shared by all."""
    last = F.date_sub("last_date", min(horizons))
    every = F.make_dt_interval(days=F.lit(step))

    def cutoffs(start: Column, cadence: str) -> DataFrame:
        return dimension.where(start <= last).select(
            *CAMPAIGN, *HIERARCHY, F.explode(F.sequence(start, last, every)).alias("date"), F.lit(cadence).alias("cadence")
        )

    own = cutoffs(F.date_add("first_date", 56), OWN_CADENCE)
    if not shared:
        return own
    late = F.ceil(F.datediff("first_date", F.lit(first_day)) / step).cast("int")
    return own.unionByName(cutoffs(F.date_add(F.lit(first_day), 56 + late * step), SHARED_CADENCE))


def campaign_history(
    facts: DataFrame,
    probes: DataFrame,
    horizons: tuple[int, ...] = HORIZONS,
    *,
    spend_totals: bool = False,
    targets: bool = False,
    labels: bool = False,
) -> DataFrame:
    """Probes with what the campaign looked like up to that day and, per horizon, after it.

    ``spend_totals`` adds mean and deviation of the rolling horizon-length spend totals over observed
    days (forecasts), ``targets`` the sums over the following horizon (scoring, training) and
    ``labels`` the day from which those sums are final (training).
    """
    payload = [f for f in probes.schema.fields if f.name not in {*CAMPAIGN, "date"}]
    carried = ["date", *[f.name for f in payload]]
    edges = probes.withColumn("edge", F.explode(F.array(*[F.lit(k) for k in (-56, -28, 0, *horizons)])))
    own = [F.lit(None).cast("date").alias("date"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in payload]]
    # one scan gives a fact and its copy a year ahead
    placed = facts.select(*CAMPAIGN, "spend", "revenue", F.inline(_fact_and_prior(F.col("date"))))
    events = placed.select(
        *CAMPAIGN,
        "kind",
        "day",
        "spend",
        F.when(F.col("kind") == FACT, F.col("revenue")).alias("revenue"),
        F.lit(None).cast("int").alias("edge"),
        *own,
    ).unionByName(
        edges.select(
            *CAMPAIGN,
            F.lit(EDGE).alias("kind"),
            (F.unix_date("date") + F.col("edge")).cast("int").alias("day"),
            F.lit(None).cast("double").alias("spend"),
            F.lit(None).cast("double").alias("revenue"),
            "edge",
            *carried,
        )
    )
    # placed by campaign once; every window and the regrouping below keep that placement
    events = events.repartition(*CAMPAIGN)
    fact, prior = F.col("kind") == FACT, F.col("kind") == PRIOR
    at_edge: dict[str, Column] = {}
    if labels:
        backwards = Window.partitionBy(*CAMPAIGN).orderBy((-F.col("day")).alias("back"))
        events = events.withColumn(
            "next_fact",
            F.min(F.when(fact, F.col("day"))).over(backwards.rangeBetween(Window.unboundedPreceding, 0)),
        )
        at_edge["next_fact"] = F.col("next_fact")
    so_far = Window.partitionBy(*CAMPAIGN).orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    if spend_totals:
        rows = Window.partitionBy(*CAMPAIGN, "kind").orderBy("day")
        running = F.sum("spend").over(rows.rowsBetween(Window.unboundedPreceding, 0))
        events = events.withColumns({"running": running, "nth": F.row_number().over(rows)}).withColumns(
            {
                f"total_{h}": F.when(
                    fact & (F.col("nth") >= h), F.col("running") - F.coalesce(F.lag("running", h).over(rows), F.lit(0.0))
                )
                for h in horizons
            }
        )
        for h in horizons:
            at_edge |= {
                f"total_n_{h}": F.count(f"total_{h}").over(so_far),
                f"total_mean_{h}": F.avg(f"total_{h}").over(so_far),
                f"total_std_{h}": F.stddev_pop(f"total_{h}").over(so_far),
            }
    at_edge |= {
        "spend_sum": F.sum(F.when(fact, F.col("spend"))).over(so_far),
        "spend_days": F.count(F.when(fact & (F.col("spend") > 0), 1)).over(so_far),
        "revenue_sum": F.sum("revenue").over(so_far),
        "revenue_days": F.count(F.when(F.col("revenue") > 0, 1)).over(so_far),
        "days": F.count(F.when(fact, 1)).over(so_far),
        "prior_sum": F.sum(F.when(prior, F.col("spend"))).over(so_far),
        "prior_positive": F.count(F.when(prior & (F.col("spend") > 0), 1)).over(so_far),
        "prior_seen": F.count(F.when(prior, 1)).over(so_far),
    }
    # only what some window below reads, as plain columns, so that the regrouping is a hash aggregation
    sums = ["spend_sum", "spend_days", "revenue_sum", "revenue_days"]
    now, month, two_months = "edge_0", "edge_m28", "edge_m56"
    read = {
        -56: ["spend_sum", "spend_days"],
        -28: [*sums, "days"],
        0: [c for c in at_edge if c != "next_fact"],
    }
    for h in horizons:
        read[h] = ["prior_sum", "prior_positive", "prior_seen"]
        read[h] += [*sums, "days"] if targets else []
        read[h] += ["next_fact"] if labels else []

    def at(edge: int | str, name: str) -> str:
        return f"{edge}_{name}" if isinstance(edge, str) else f"edge_{edge}_{name}".replace("-", "m")

    found = events.withColumns(at_edge).where(F.col("kind") == EDGE)
    wide = found.groupBy(*CAMPAIGN, *carried).agg(
        *[F.max(F.when(F.col("edge") == k, F.col(name))).alias(at(k, name)) for k, names in read.items() for name in names]
    )

    def between(low: str, high: str, total: str, positive: str) -> Column:
        change = F.col(at(high, total)) - F.coalesce(F.col(at(low, total)), F.lit(0.0))
        return F.when(F.col(at(high, positive)) == F.col(at(low, positive)), 0.0).otherwise(change)

    def count(low: str, high: str, name: str) -> Column:
        return F.col(at(high, name)) - F.col(at(low, name))

    columns = {
        "recent_spend": between(month, now, "spend_sum", "spend_days"),
        "recent_revenue": between(month, now, "revenue_sum", "revenue_days"),
        "recent_days": count(month, now, "days"),
        "previous_spend": between(two_months, month, "spend_sum", "spend_days"),
        "history_spend": F.coalesce(F.col(at(now, "spend_sum")), F.lit(0.0)),
        "history_revenue": F.coalesce(F.col(at(now, "revenue_sum")), F.lit(0.0)),
        "history_days": F.col(at(now, "days")),
    }
    for h in horizons:
        end = f"edge_{h}"
        columns |= {
            f"prior_spend_{h}": between(now, end, "prior_sum", "prior_positive"),
            f"prior_days_{h}": count(now, end, "prior_seen"),
        }
        if targets:
            columns |= {
                f"target_days_{h}": count(now, end, "days"),
                f"target_spend_{h}": between(now, end, "spend_sum", "spend_days"),
                f"target_revenue_{h}": between(now, end, "revenue_sum", "revenue_days"),
            }
        if labels:
            # first observed day on or after the end of the target: from then on the label is known
            columns[f"known_on_{h}"] = F.date_from_unix_date(F.col(at(end, "next_fact")))
        if spend_totals:
            columns |= {f"total_{n}_{h}": F.col(at(now, f"total_{n}_{h}")) for n in ("n", "mean", "std")}
    return wide.select(*CAMPAIGN, *carried, *[c.alias(name) for name, c in columns.items()])


def by_horizon(history: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Turn the per-horizon columns of :func:`campaign_history` into one row per horizon."""
    wide = [c for c in history.columns if c.rsplit("_", 1)[-1] in {str(h) for h in horizons}]
    names = list(dict.fromkeys(c.rsplit("_", 1)[0] for c in wide))
    rows = F.array(
        *[F.struct(F.lit(h).alias("horizon_days"), *[F.col(f"{n}_{h}").alias(n) for n in names]) for h in horizons]
    )
    return history.select(*[c for c in history.columns if c not in wide], F.inline(rows))


def delivery_ratios(facts: DataFrame) -> DataFrame:
    """Per campaign, the dated spend-to-configured-budget ratios (at most one a day), smallest first."""
    ratio = F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.col("spend") / F.col("configured_budget")))
    return (
        facts.where((F.col("configured_budget") > 0) & F.col("spend").isNotNull())
        .groupBy(*CAMPAIGN)
        .agg(F.sort_array(F.collect_list(F.struct(ratio.alias("ratio"), "date"))).alias("ratios"))
    )


def with_delivery(history: DataFrame, ratios: DataFrame, least: int = 7) -> DataFrame:
    """Adds ``delivery``: the median ratio dated up to the row's day, null with too few of them.

    Ratios come sorted, so the known ones stay sorted and nothing is sorted per origin.
    """
    n = F.size("known")

    def at(position: Column) -> Column:
        return F.get("known", position.cast("int"))["ratio"]

    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0
    return (
        history.join(ratios, CAMPAIGN, "left")
        .withColumn("known", F.filter("ratios", lambda x: x["date"] <= F.col("date")))
        .withColumn("delivery", F.when(n >= least, middle))
        .drop("ratios", "known")
    )
