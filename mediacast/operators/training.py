"""Training rows and the purged splits over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacast.contracts import CAMPAIGN, HORIZONS
from mediacast.functions.columns import campaign_key
from mediacast.operators.budget import baseline_columns
from mediacast.operators.history import OWN_CADENCE, by_horizon, campaign_history, campaigns, training_probes
from mediacast.operators.leaves import feature_columns, planned_support

REALIZED, ALIGNED, SHARED = "realized_future", "inference_aligned", "shared_cutoffs"
FEATURES = [
    "log_planned_budget", "recent_roas", "long_roas", "log_recent_spend", "log_recent_revenue",
    "recent_active_days", "trend_ratio", "month_sin", "month_cos",
]
MIN_ROWS, MIN_FIT, MIN_CALIBRATION = 80, 40, 20
MIN_SELECTION = 24
HOLDOUT = 0.20


def training_rows(facts: DataFrame, calendar: DataFrame, first_day, horizons: tuple[int, ...] = HORIZONS, shared: bool = True) -> DataFrame:
    """One row per horizon, budget mode, campaign and cut-off with a known, positive-spend target.

    ``known_on`` is the first day on which the label is final: data up to an origin contains exactly
    the rows with ``known_on <= origin``, so one table serves every origin.
    """
    probes = training_probes(campaigns(facts), first_day, horizons, shared=shared)
    history = campaign_history(facts, probes, horizons, targets=True, labels=True)
    at = calendar.select("date", "budget_multiplier_90")
    rows = (
        by_horizon(history, horizons)
        .join(F.broadcast(at), "date")
        .withColumns(baseline_columns())
        .where(F.col("known_on").isNotNull() & (F.col("history_days") >= 28) & (F.col("target_spend") > 0))
    )
    modes = F.when(
        F.col("cadence") == OWN_CADENCE,
        F.array(
            F.struct(F.lit(REALIZED).alias("mode"), F.col("target_spend").alias("planned_budget")),
            F.struct(F.lit(ALIGNED).alias("mode"), F.col("baseline_budget").alias("planned_budget")),
        ),
    ).otherwise(F.array(F.struct(F.lit(SHARED).alias("mode"), F.col("target_spend").alias("planned_budget"))))
    planned = F.col("planned_budget")
    return rows.select("*", F.inline(modes)).where(planned > 0).select(
        "horizon_days",
        "mode",
        *CAMPAIGN,
        campaign_key().alias("campaign_key"),
        "channel",
        "campaign_type",
        F.col("date").alias("cutoff"),
        F.date_add("date", F.col("horizon_days")).alias("target_end"),
        "known_on",
        "planned_budget",
        planned_support(planned).alias("support_ratio"),
        *[c.alias(name) for name, c in zip(FEATURES, feature_columns(planned))],
        F.log1p(F.greatest("target_revenue", F.lit(0.0))).alias("target_log_revenue"),
    )


def cutoff_counts(rows: DataFrame) -> DataFrame:
    """Row counts per cut-off and day the label became known; size follows the calendar."""
    return rows.groupBy("horizon_days", "mode", "cutoff", "known_on").count()


def _holdout_start(counts: DataFrame, name: str) -> DataFrame:
    """First cut-off of the latest fifth of the distinct cut-offs of each slice."""
    keys = ["horizon_days", "mode", "origin"]
    distinct = counts.select(*keys, "cutoff").distinct()
    latest = Window.partitionBy(*keys).orderBy(F.desc("cutoff"))
    everything = Window.partitionBy(*keys)
    held = F.greatest(F.lit(1), F.ceil(F.count("*").over(everything) * HOLDOUT))
    return (
        distinct.select(*keys, F.col("cutoff").alias(name), F.row_number().over(latest).alias("nth"), held.alias("held"))
        .where(F.col("nth") == F.col("held"))
        .drop("nth", "held")
    )


def purged_splits(counts: DataFrame, slices: DataFrame) -> DataFrame:
    """Per slice and mode: start of the calibration and of the selection window, and all row counts.

    A fit row's whole target has to end before the window it is tested on begins.
    """
    keys = ["horizon_days", "mode", "origin"]
    inside = (
        counts.where(F.col("mode") != SHARED)
        .join(F.broadcast(slices.select("horizon_days", "origin")), "horizon_days")
        .where(F.col("known_on") <= F.col("origin"))
        .withColumn("target_end", F.date_add("cutoff", F.col("horizon_days")))
    )
    with_calibration = inside.join(F.broadcast(_holdout_start(inside, "calibration_start")), keys)
    before = F.col("target_end") < F.col("calibration_start")
    selection = _holdout_start(with_calibration.where(before), "selection_start")
    rows = with_calibration.join(F.broadcast(selection), keys, "left")
    n = F.col("count")

    def total(condition) -> object:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    return rows.groupBy(*keys, "calibration_start", "selection_start").agg(
        F.sum(n).alias("all_rows"),
        total(before).alias("fit_rows"),
        total(F.col("cutoff") >= F.col("calibration_start")).alias("calibration_rows"),
        total(F.col("target_end") < F.col("selection_start")).alias("selection_fit_rows"),
        total(before & (F.col("cutoff") >= F.col("selection_start"))).alias("selection_validation_rows"),
    )


def expert_ready() -> object:
    return (
        (F.col("all_rows") >= MIN_ROWS) & (F.col("fit_rows") >= MIN_FIT) & (F.col("calibration_rows") >= MIN_CALIBRATION)
    )


def selection_ready() -> object:
    return (F.col("selection_fit_rows") >= MIN_FIT) & (F.col("selection_validation_rows") >= MIN_SELECTION)
