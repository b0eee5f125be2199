"""Interval calibration of the statistical model from non-overlapping past origins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.operators.quantiles import conformal_rank, order_statistics

MIN_ORIGINS, MIN_SAMPLES, MAX_WIDTH = 5, 30, 4.0
TAIL_COVERAGE = 0.90
# Names by which a stored profile is recognised.
WIDTH_METHOD = "expanding_window_oof_statistical_campaign_interval_width_conformal_v1"
PORTFOLIO_METHOD = "expanding_window_oof_statistical_portfolio_log_residual_quantiles_v1"
PORTFOLIO_PURPOSE = "revenue_interval_only_not_roas_probability_calibration"
AVAILABLE = "available"
KEYS = ["horizon_days", "origin"]


def _usable(actual: str) -> Column:
    p10, p50, p90 = (F.col(f"predicted_revenue_{q}") for q in ("p10", "p50", "p90"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))) for c in (actual, "predicted_revenue_p10", "predicted_revenue_p50", "predicted_revenue_p90")]
    return reduce(lambda a, b: a & b, [*finite, F.col(actual) >= 0, p10 >= 0, p10 <= p50, p50 <= p90, p50 > 0])


def interval_samples(leaves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Campaign forecasts at calibration origins with outcome and the log-space widths they needed.

    ``pairs`` says which calibration origins belong to which slice; a forecast is made once and used
    by every slice that needs it.
    """
    scored = leaves.where(F.col("target_days") > 0).withColumnRenamed("origin", "calibration_origin")
    log50 = F.log1p("predicted_revenue_p50")
    actual = F.log1p(F.greatest("target_revenue", F.lit(0.0)))
    low = F.greatest(log50 - F.log1p("predicted_revenue_p10"), F.lit(1e-12))
    high = F.greatest(F.log1p("predicted_revenue_p90") - log50, F.lit(1e-12))
    # pairs: slices times at most twelve origins
    return (
        scored.join(F.broadcast(pairs.select(*KEYS, "calibration_origin")), ["horizon_days", "calibration_origin"])
        .where(_usable("target_revenue"))
        .select(
            *KEYS,
            "calibration_origin",
            "campaign_key",
            F.col("target_revenue").alias("actual_revenue"),
            "predicted_revenue_p10",
            "predicted_revenue_p50",
            "predicted_revenue_p90",
            F.greatest(F.lit(0.0), (log50 - actual) / low).alias("lower_required"),
            F.greatest(F.lit(0.0), (actual - log50) / high).alias("upper_required"),
        )
    )


def widened(edge: str, width: Column) -> Column:
    middle = F.log1p("predicted_revenue_p50")
    return F.expm1(middle + (F.log1p(F.greatest(edge, F.lit(0.0))) - middle) * width)


def width_profiles(samples: DataFrame) -> DataFrame:
    """Per slice: conformal width multipliers, their status and coverage before and after."""
    keys = ["horizon_days", "origin"]

    def width(column: str, name: str) -> DataFrame:
        wanted = {name: (TAIL_COVERAGE, conformal_rank(TAIL_COVERAGE))}
        return order_statistics(samples, keys, column, wanted).select(
            *keys, F.least(F.lit(MAX_WIDTH), F.greatest(F.lit(1.0), name)).alias(name)
        )

    widths = width("lower_required", "lower").join(width("upper_required", "upper"), keys)
    rows = samples.join(F.broadcast(widths), keys)
    actual = F.col("actual_revenue")
    low10 = F.greatest(F.lit(0.0), widened("predicted_revenue_p10", F.col("lower")))
    high90 = F.greatest(widened("predicted_revenue_p90", F.col("upper")), F.col("predicted_revenue_p50"))
    above, below = actual >= F.col("predicted_revenue_p10"), actual <= F.col("predicted_revenue_p90")
    calibrated_above, calibrated_below = actual >= low10, actual <= high90

    def share(condition: Column) -> Column:
        return F.round(F.avg(condition.cast("double")), 8)

    # origins first, so that no group has to hold all rows to count distinct ones
    stats = rows.groupBy(*keys, "lower", "upper").agg(
        F.count("*").alias("sample_count"),
        share(above).alias("base_lower_coverage"),
        share(below).alias("base_upper_coverage"),
        share(above & below).alias("base_joint_coverage"),
        share(calibrated_above).alias("calibrated_lower_coverage"),
        share(calibrated_below).alias("calibrated_upper_coverage"),
        share(calibrated_above & calibrated_below).alias("calibrated_joint_coverage"),
    )
    origins = samples.groupBy(*keys, "calibration_origin").count().groupBy(*keys).agg(F.count("*").alias("origin_count"))
    status = (
        F.when(F.col("origin_count") < MIN_ORIGINS, "insufficient_non_overlapping_oof_origins")
        .when(F.col("sample_count") < MIN_SAMPLES, "insufficient_oof_campaign_observations")
        .otherwise(AVAILABLE)
    )
    return stats.join(origins, keys).select(
        *keys,
        status.alias("status"),
        F.when(status == AVAILABLE, WIDTH_METHOD).otherwise("unavailable").alias("method"),
        "origin_count",
        "sample_count",
        F.when(status == AVAILABLE, F.round("lower", 8)).alias("lower_width_multiplier"),
        F.when(status == AVAILABLE, F.round("upper", 8)).alias("upper_width_multiplier"),
        "base_lower_coverage",
        "base_upper_coverage",
        "base_joint_coverage",
        "calibrated_lower_coverage",
        "calibrated_upper_coverage",
        "calibrated_joint_coverage",
    )


def portfolio_profiles(overall: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per slice: deciles of the portfolio log residual over its calibration origins (twelve at most)."""
    rows = (
        pairs.select(*KEYS, "calibration_origin", F.col("target_revenue").alias("actual_revenue"))
        .join(
            overall.select(
                "horizon_days",
                F.col("origin").alias("calibration_origin"),
                "predicted_revenue_p10",
                "predicted_revenue_p50",
                "predicted_revenue_p90",
            ),
            ["horizon_days", "calibration_origin"],
        )
        .where(_usable("actual_revenue"))
        .withColumn("residual", F.log1p("actual_revenue") - F.log1p("predicted_revenue_p50"))
    )
    deciles = F.percentile("residual", F.array(F.lit(0.10), F.lit(0.50), F.lit(0.90)))
    fitted = rows.groupBy(*KEYS).agg(F.count("*").alias("origin_count"), deciles.alias("q"))
    status = F.when(F.col("origin_count") < MIN_ORIGINS, "insufficient_non_overlapping_oof_origins").otherwise(AVAILABLE)
    return fitted.select(
        *KEYS,
        status.alias("status"),
        F.when(status == AVAILABLE, PORTFOLIO_METHOD).otherwise("unavailable").alias("method"),
        F.lit(PORTFOLIO_PURPOSE).alias("calibration_purpose"),
        "origin_count",
        *[F.round(F.get("q", F.lit(i)), 8).alias(f"residual_{name}") for i, name in enumerate(("p10", "p50", "p90"))],
    )


def valid_widths(profiles: DataFrame) -> DataFrame:
    """Profiles a forecast may use: right method, enough evidence, finite and never narrowing."""
    low, high = F.col("lower_width_multiplier"), F.col("upper_width_multiplier")
    return profiles.where(
        (F.col("method") == WIDTH_METHOD)
        & (F.col("status") == AVAILABLE)
        & (F.col("origin_count") >= MIN_ORIGINS)
        & (F.col("sample_count") >= MIN_SAMPLES)
        & low.between(1.0, MAX_WIDTH)
        & high.between(1.0, MAX_WIDTH)
    ).select(*KEYS, low.alias("lower_width"), high.alias("upper_width"))


def valid_portfolio(profiles: DataFrame) -> DataFrame:
    p10, p50, p90 = F.col("residual_p10"), F.col("residual_p50"), F.col("residual_p90")
    return profiles.where(
        (F.col("method") == PORTFOLIO_METHOD)
        & (F.col("status") == AVAILABLE)
        & (F.col("calibration_purpose") == PORTFOLIO_PURPOSE)
        & (F.col("origin_count") >= MIN_ORIGINS)
        & (p10 <= p50)
        & (p50 <= p90)
        & (F.abs(p10) < float("inf"))
        & (F.abs(p90) < float("inf"))
    ).select(*KEYS, p10.alias("portfolio_p10"), p50.alias("portfolio_p50"), p90.alias("portfolio_p90"))
