"""Back-test scoring: coverage per hierarchy level, WAPE, reliability of the target probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.contracts import ALL
from mediacast.functions.columns import campaign_key, safe_ratio, wilson_bound

FOLD = ["scenario_id", "horizon_days", "origin"]
LEVEL_KEYS = ["level", "channel", "campaign_type", "campaign_key"]
MIN_RELIABILITY = 20
NOMINAL_COVERAGE = 0.80


def target_actuals(facts: DataFrame, folds: DataFrame) -> DataFrame:
    """Outcome of every fold at all four levels.

    Folds become a list of (horizon, origin, day), a calendar-sized table, so facts meet their folds
    in one equality join on the day.
    """
    days = folds.select(
        "horizon_days",
        "origin",
        F.explode(F.sequence(F.date_add("origin", 1), F.date_add("origin", F.col("horizon_days")))).alias("date"),
    )
    # two literal days, so that the scan of the facts skips everything outside all target windows
    first, last = folds.agg(F.min("origin"), F.max(F.date_add("origin", F.col("horizon_days")))).first()
    slices = ["horizon_days", "origin"]
    leaves = (
        facts.where((F.col("date") > F.lit(first)) & (F.col("date") <= F.lit(last))).join(F.broadcast(days), "date")
        .groupBy(*slices, campaign_key().alias("campaign_key"), "channel", "campaign_type")
        .agg(F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"))
    )
    keys = [*slices, "channel", "campaign_type", "campaign_key"]
    sets = [[*slices, "campaign_key"], [*slices, "channel", "campaign_type"], [*slices, "channel"], slices]
    rolled = leaves.groupingSets(sets, *keys).agg(
        F.grouping("campaign_key").alias("no_key"),
        F.grouping("channel").alias("no_channel"),
        F.grouping("campaign_type").alias("no_type"),
        F.sum("revenue").alias("actual_revenue"),
        F.sum("spend").alias("actual_spend"),
    )
    level = (
        F.when(F.col("no_key") == 0, "campaign")
        .when(F.col("no_type") == 0, "campaign_type")
        .when(F.col("no_channel") == 0, "channel")
        .otherwise("overall")
    )
    return rolled.select(
        *slices,
        level.alias("level"),
        *[F.coalesce(c, F.lit(ALL)).alias(c) for c in ("channel", "campaign_type", "campaign_key")],
        "actual_revenue",
        "actual_spend",
    )


def coverage_records(forecast: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecasts and outcomes side by side; an outcome without a forecast counts as not covered."""
    own = F.col("level") == "campaign"
    predicted = forecast.select(
        *FOLD,
        "level",
        F.when(own, ALL).otherwise(F.col("channel")).alias("channel"),
        F.when(own, ALL).otherwise(F.col("campaign_type")).alias("campaign_type"),
        F.coalesce("campaign_key", F.lit(ALL)).alias("campaign_key"),
        "predicted_revenue_p10",
        "predicted_revenue_p90",
        "predicted_roas_p10",
        "predicted_roas_p90",
        F.lit(True).alias("forecast_side"),
    )
    # every forecast set of a fold is scored against the same outcomes
    sets = forecast.select(*FOLD).distinct()
    observed = actuals.join(F.broadcast(sets), ["horizon_days", "origin"]).withColumn("actual_side", F.lit(True))
    joined = predicted.join(observed, [*FOLD, *LEVEL_KEYS], "full_outer")
    has_forecast = F.coalesce("forecast_side", F.lit(False))
    has_actual = F.coalesce("actual_side", F.lit(False))
    roas = safe_ratio(F.col("actual_revenue"), F.col("actual_spend"))

    def inside(value: Column, low: str, high: str) -> Column:
        return F.coalesce(has_forecast & (F.col(low) <= value) & (value <= F.col(high)), F.lit(False))

    return joined.select(
        *FOLD,
        *LEVEL_KEYS,
        F.when(has_forecast & has_actual, "matched").when(has_forecast, "missing_actual").otherwise("missing_forecast").alias("join_status"),
        has_actual.alias("revenue_evaluable"),
        F.when(has_actual, inside(F.col("actual_revenue"), "predicted_revenue_p10", "predicted_revenue_p90")).alias("revenue_covered"),
        roas.isNotNull().alias("roas_evaluable"),
        F.when(roas.isNotNull(), inside(roas, "predicted_roas_p10", "predicted_roas_p90")).alias("roas_covered"),
    )


def coverage_summary(records: DataFrame) -> DataFrame:
    """Counts, coverage and Wilson interval per forecast set, horizon and level."""
    status = F.col("join_status")
    counted = records.groupBy("scenario_id", "horizon_days", "level").agg(
        F.count("*").alias("observations"),
        F.count_if(status == "matched").alias("matched_observations"),
        F.count_if(status == "missing_forecast").alias("missing_forecast_observations"),
        F.count_if(status == "missing_actual").alias("missing_actual_observations"),
        F.count_if("revenue_evaluable").alias("revenue_coverage_observations"),
        F.count_if("revenue_covered").alias("revenue_hits"),
        F.count_if("roas_evaluable").alias("roas_coverage_observations"),
        F.count_if("roas_covered").alias("roas_hits"),
    )

    def rates(name: str) -> list[Column]:
        hits, n = F.col(f"{name}_hits"), F.col(f"{name}_coverage_observations")
        return [
            F.round(safe_ratio(hits, n), 4).alias(f"{name}_interval_coverage"),
            wilson_bound(hits, n, -1).alias(f"{name}_coverage_low"),
            wilson_bound(hits, n, +1).alias(f"{name}_coverage_high"),
        ]

    return counted.select(
        "scenario_id", "horizon_days", "level", "observations", "matched_observations",
        "missing_forecast_observations", "missing_actual_observations", "revenue_coverage_observations",
        *rates("revenue"),
        "roas_coverage_observations",
        (F.col("observations") - F.col("roas_coverage_observations")).alias("roas_unscorable_observations"),
        *rates("roas"),
    )


def fold_results(forecast: DataFrame, folds: DataFrame, actuals: DataFrame) -> DataFrame:
    """One row per forecast set and fold: portfolio outcome against portfolio forecast."""
    overall = forecast.where(F.col("level") == "overall")
    outcome = actuals.where(F.col("level") == "overall").select("horizon_days", "origin", "actual_revenue", "actual_spend")
    joined = (
        overall.join(F.broadcast(folds.select("horizon_days", "origin", "fold")), ["horizon_days", "origin"])
        .join(F.broadcast(outcome), ["horizon_days", "origin"])
        .withColumn("actual_roas", safe_ratio(F.col("actual_revenue"), F.col("actual_spend")))
    )
    return joined.select(
        *FOLD,
        "fold",
        "actual_revenue",
        "actual_spend",
        "actual_roas",
        *[f"predicted_{m}_{q}" for m in ("revenue", "roas") for q in ("p10", "p50", "p90")],
        "model_version",
        "target_roas",
        F.col("probability_roas_above_target").alias("modeled_target_probability"),
        (F.col("actual_roas") >= F.col("target_roas")).alias("actual_target_hit"),
    )


def target_reliability(results: DataFrame) -> DataFrame:
    """Brier score and calibration error of the target draw share per forecast set and horizon.

    Rounded half up; the nudge keeps sums in another order on the same side of a tie.
    """
    keys = ["scenario_id", "horizon_days"]
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "modeled_target_probability"))
    events = results.where(F.col("actual_target_hit").isNotNull()
        & F.col("modeled_target_probability").isNotNull()
        & ~F.isnan("modeled_target_probability")).select(
        *keys,
        p.alias("p"),
        F.col("actual_target_hit").cast("double").alias("hit"),
    )
    bins = reliability_bins(events, keys)
    error = F.sum(F.col("observations") * F.abs(F.col("mean_p") - F.col("hit_rate"))) / F.sum("observations")
    return bins.groupBy(*keys).agg(
        F.when(F.sum("observations") >= MIN_RELIABILITY, "evaluated").otherwise("insufficient_evidence").alias("status"),
        F.sum("observations").alias("observations"),
        F.round(F.sum("squared_error") / F.sum("observations") + 1e-9, 4).alias("brier_score"),
        F.round(error + 1e-9, 4).alias("expected_calibration_error"),
    )


def reliability_bins(events: DataFrame, keys: list[str]) -> DataFrame:
    p = F.col("p")
    lower = F.when(p < 0.25, 0.0).when(p < 0.50, 0.25).when(p < 0.75, 0.50).otherwise(0.75)
    return events.groupBy(*keys, lower.alias("bin_start")).agg(
        F.count("*").alias("observations"),
        F.avg("p").alias("mean_p"),
        F.avg("hit").alias("hit_rate"),
        F.sum((p - F.col("hit")) * (p - F.col("hit"))).alias("squared_error"),
    )


def horizon_report(results: DataFrame, requested_folds: int, step_days: int | None = None) -> DataFrame:
    """One row per forecast set and horizon: coverage, WAPE and evidence volume."""
    hit = F.coalesce(F.col("actual_revenue").between(F.col("predicted_revenue_p10"), F.col("predicted_revenue_p90")), F.lit(False))
    roas_hit = F.coalesce(F.col("actual_roas").between(F.col("predicted_roas_p10"), F.col("predicted_roas_p90")), F.lit(False))
    error = F.sum(F.abs(F.col("actual_revenue") - F.col("predicted_revenue_p50"))) / F.greatest(F.sum(F.abs("actual_revenue")), F.lit(1e-9))
    step = F.col("horizon_days") if step_days is None else F.lit(step_days)
    counted = results.groupBy("scenario_id", "horizon_days").agg(
        F.count("*").alias("folds"),
        F.count_if(hit).alias("revenue_hits"),
        F.count_if(roas_hit).alias("roas_hits"),
        F.round(error, 4).alias("revenue_wape"),
        F.array_join(F.sort_array(F.collect_set("model_version")), ",").alias("model_versions_observed"),
    )
    n = F.col("folds")
    return counted.select(
        "scenario_id",
        "horizon_days",
        F.lit(requested_folds).alias("requested_folds"),
        step.alias("step_days"),
        (step >= F.col("horizon_days")).alias("fold_windows_non_overlapping"),
        "folds",
        *[
            c
            for name in ("revenue", "roas")
            for c in (
                F.round(F.col(f"{name}_hits") / n, 4).alias(f"{name}_interval_coverage"),
                wilson_bound(F.col(f"{name}_hits"), n, -1).alias(f"{name}_coverage_low"),
                wilson_bound(F.col(f"{name}_hits"), n, +1).alias(f"{name}_coverage_high"),
            )
        ],
        F.lit(NOMINAL_COVERAGE).alias("nominal_interval_coverage"),
        "revenue_wape",
        "model_versions_observed",
    )
