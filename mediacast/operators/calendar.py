"""Everything about an origin date that does not depend on a campaign.

The portfolio calendar has one row per calendar day between the first and the last observed day, so
its size is bounded by the length of history, never by the number of campaigns. Model constants as
of any origin, seasonal multipliers and target-window totals are frames over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacast.contracts import HORIZONS
from mediacast.functions.columns import clip
from mediacast.session import stage

MONTHS = range(1, 13)


def daily_portfolio(facts: DataFrame) -> DataFrame:
    """Portfolio totals per observed day; the only shuffle carries one row per day and task."""
    valid = (F.col("spend") > 0) & (F.col("revenue") >= 0)
    log_ratio = F.when(valid, F.log(F.greatest(F.col("revenue") / F.col("spend"), F.lit(1e-5))))
    return facts.groupBy("date").agg(
        F.sum("spend").alias("spend"),
        F.sum("revenue").alias("revenue"),
        F.max(F.when(F.col("spend") > 0, 1).otherwise(0)).alias("active"),
        F.sum(F.when(valid, F.col("spend"))).alias("valid_spend"),
        F.sum(F.when(valid, F.col("revenue"))).alias("valid_revenue"),
        F.count(log_ratio).alias("log_n"),
        F.sum(log_ratio).alias("log_sum"),
        F.sum(log_ratio * log_ratio).alias("log_squares"),
    )


def _future(day: Column, days: int) -> Column:
    return F.sequence(F.date_add(day, 1), F.date_add(day, days))


def mean_over_future(by_month: Column, missing: Column, day: Column, days: int) -> Column:
    """Mean of a 12-value monthly array over the ``days`` calendar days after ``day``."""
    values = F.transform(_future(day, days), lambda d: F.coalesce(F.get(by_month, F.month(d) - 1), missing))
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / float(days)


def portfolio_calendar(facts: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row per calendar day with every quantity known at, or scored after, that day."""
    daily = daily_portfolio(facts)
    spine = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("date")
    )
    days = spine.join(daily, "date", "left").withColumn("day", F.unix_date("date"))
    # one partition on purpose: the rows are calendar days
    order = Window.partitionBy(F.lit(0)).orderBy("day")
    so_far = order.rangeBetween(Window.unboundedPreceding, 0)
    recent = order.rangeBetween(-27, 0)
    month = F.month("date")
    seen = F.col("spend").isNotNull()

    def by_month(value: Column) -> Column:
        return F.array(*[F.sum(F.when(month == m, value)).over(so_far) for m in MONTHS])

    framed = days.select(
        "date",
        "day",
        F.max(F.when(seen, F.col("date"))).over(so_far).alias("as_of"),
        F.min(F.col("date")).over(so_far).alias("first_date"),
        F.count(F.when(seen, 1)).over(so_far).alias("observed_days"),
        F.coalesce(F.max("active").over(recent), F.lit(0)).alias("portfolio_active"),
        (F.coalesce(F.sum("spend").over(recent), F.lit(0.0)) / 28.0).alias("recent_daily_spend"),
        F.sum("valid_spend").over(so_far).alias("valid_spend"),
        F.sum("valid_revenue").over(so_far).alias("valid_revenue"),
        F.sum("log_n").over(so_far).alias("log_n"),
        F.sum("log_sum").over(so_far).alias("log_sum"),
        F.sum("log_squares").over(so_far).alias("log_squares"),
        by_month(F.col("spend")).alias("month_spend"),
        by_month(F.when(seen, 1)).alias("month_days"),
        by_month(F.col("valid_spend")).alias("month_valid_spend"),
        by_month(F.col("valid_revenue")).alias("month_valid_revenue"),
        *[
            column
            for h in horizons
            for frame in [order.rangeBetween(1, h)]
            for column in (
                F.count(F.when(seen, 1)).over(frame).alias(f"target_days_{h}"),
                F.sum("revenue").over(frame).alias(f"target_revenue_{h}"),
                F.sum("spend").over(frame).alias(f"target_spend_{h}"),
            )
        ],
    )
    roas = F.col("valid_revenue") / F.greatest(F.col("valid_spend"), F.lit(1e-9))
    mean_log = F.col("log_sum") / F.col("log_n")
    spread = F.sqrt(F.greatest(F.col("log_squares") / F.col("log_n") - mean_log * mean_log, F.lit(0.0)))
    return framed.withColumns(
        {
            "global_roas": F.when(F.col("log_n") > 0, roas),
            "global_log_sigma": F.when(F.col("log_n") > 0, clip(spread, 0.20, 1.25)),
            "month_means": F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.get("month_spend", i) / F.get("month_days", i)),
            "month_factors": F.transform(
                F.sequence(F.lit(0), F.lit(11)),
                # null for a month without rows: greatest and least skip nulls, so clip has to see one
                lambda i: clip(F.get("month_valid_revenue", i) / F.get("month_valid_spend", i) / roas, 0.55, 1.45),
            ),
        }
    ).withColumns(
        {
            "budget_multiplier_90": F.when(
                F.col("recent_daily_spend") > 0,
                clip(
                    mean_over_future(F.col("month_means"), F.col("recent_daily_spend"), F.col("date"), 90)
                    / F.col("recent_daily_spend"),
                    0.10,
                    2.00,
                ),
            ).otherwise(1.0),
        }
    )


def staged_calendar(facts: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    return stage(portfolio_calendar(facts, horizons), "calendar")


def budget_multiplier(horizon: Column) -> Column:
    """Month-mix adjustment of the run-rate budget: 90-day plans only."""
    return F.when(horizon == 90, F.col("budget_multiplier_90")).otherwise(F.lit(1.0))


def statistical_parameters(calendar: DataFrame, origins: DataFrame) -> DataFrame:
    """Fallback-model constants as of each ``(horizon_days, origin)``; origins without a fit are left out."""
    at = calendar.select(
        F.col("date").alias("origin"), "as_of", "global_roas", "global_log_sigma", "month_factors"
    )
    return origins.join(F.broadcast(at), "origin").where(F.col("global_roas").isNotNull())


def fold_origins(
    calendar: DataFrame, horizons: tuple[int, ...] = HORIZONS, folds: int = 6, step_days: int | None = None
) -> DataFrame:
    """Rolling origins counted back from the last day; needs 90 earlier days and a non-empty target."""
    last = calendar.agg(F.max("date").alias("latest"))
    grid = last.select("latest", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_days")).select(
        "latest", "horizon_days", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    )
    step = F.col("horizon_days") if step_days is None else F.lit(step_days)
    return (
        grid.select(
            "horizon_days",
            "fold",
            F.date_sub("latest", F.col("horizon_days") + (F.col("fold") - 1) * step).alias("origin"),
        )
        .join(eligible(calendar, horizons), ["horizon_days", "origin"])
        .where((F.col("observed_days") >= 90) & (F.col("target_days") > 0))
        .select("horizon_days", "fold", "origin", "as_of")
    )


def eligible(calendar: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Observed days before, and in the target window of, every possible origin."""
    return calendar.select(
        F.col("date").alias("origin"),
        "as_of",
        "observed_days",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(h).alias("horizon_days"),
                        F.col(f"target_days_{h}").alias("target_days"),
                        F.col(f"target_revenue_{h}").alias("target_revenue"),
                        F.col(f"target_spend_{h}").alias("target_spend"),
                    )
                    for h in horizons
                ]
            )
        ),
    )


def calibration_origins(calendar: DataFrame, slices: DataFrame, horizons: tuple[int, ...], keep: int = 12) -> DataFrame:
    """Non-overlapping origins per slice: 90 days after the first day, one horizon apart, the last ``keep``.

    A slice is a ``(horizon_days, origin)`` whose own data ends at ``as_of``. The returned rows pair it
    with ``calibration_origin``; few enough rows to plan with (slices times ``keep``).
    """
    start = calendar.agg(F.date_add(F.min("date"), 90).alias("start"))
    h = F.col("horizon_days")
    span = F.datediff(F.date_sub("as_of", h), F.col("start"))
    steps = F.when(span >= 0, F.floor(span / h).cast("int"))
    grid = (
        slices.join(F.broadcast(start))
        .withColumn("last_step", steps)
        .where(F.col("last_step").isNotNull())
        .select(
            *slices.columns,
            F.explode(F.sequence(F.greatest(F.lit(0), F.col("last_step") - (keep - 1)), "last_step")).alias("k"),
            "start",
        )
        .select(*slices.columns, F.date_add("start", (F.col("k") * h).cast("int")).alias("calibration_origin"))
    )
    ready = eligible(calendar, horizons).select(
        "horizon_days",
        F.col("origin").alias("calibration_origin"),
        F.col("as_of").alias("calibration_as_of"),
        "observed_days",
        "target_days",
        "target_revenue",
    )
    return (
        grid.join(ready, ["horizon_days", "calibration_origin"])
        .where((F.col("observed_days") >= 90) & (F.col("target_days") >= F.greatest(F.lit(1), F.ceil(h * 0.80))))
        .drop("observed_days", "target_days")
    )
