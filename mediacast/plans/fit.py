"""Training job: model tables for any set of slices at once.

A slice is a ``(horizon_days, origin)``; serving has one origin, a back-test has many. Statistical
constants, ridge fits, tournaments, calibration and dependence of all slices are computed together,
as joins and aggregations over shared tables. Tables several steps read are staged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacast.contracts import (
    DIRECT,
    HORIZONS,
    MODEL_VERSION_DIRECT,
    MODEL_VERSION_STATISTICAL,
    STATISTICAL,
)
from mediacast.operators.calendar import calibration_origins, eligible, staged_calendar, statistical_parameters
from mediacast.operators.calibrate import (
    interval_samples,
    portfolio_profiles,
    valid_portfolio,
    valid_widths,
    width_profiles,
)
from mediacast.operators.dependence import block_portfolio_profile, factor_weights, normalised
from mediacast.operators.leaves import leaf_forecasts, serving_history, serving_rows
from mediacast.operators.model_table import FACTOR_COPULA, INDEPENDENT, complete
from mediacast.operators.ridge import (
    blend_weights,
    expert_fits,
    experts,
    fit_statistics,
    gram_cells,
    held_out_residuals,
    out_of_fold_fits,
    out_of_fold_residuals,
    residual_profiles,
    solve_fits,
    solve_out_of_fold,
)
from mediacast.operators.rollup import upper_forecast
from mediacast.operators.training import cutoff_counts, purged_splits, training_rows
from mediacast.session import stage

KEYS = ["horizon_days", "origin"]


@dataclass
class Fit:
    """Model tables of both families and the evidence behind them."""

    calendar: DataFrame
    history: DataFrame
    models: DataFrame
    selection: DataFrame
    width_profiles: DataFrame
    portfolio_profiles: DataFrame
    dependence: DataFrame | None = None
    experts: DataFrame | None = None


def _days(slices: DataFrame, column: str) -> list:
    """Distinct days of a slice table: origins the caller asked for, never data-sized."""
    return [r[0] for r in slices.select(column).distinct().where(F.col(column).isNotNull()).collect()]


def plain_leaves(history: DataFrame, calendar: DataFrame, models: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Leaf forecasts of every model row at its own as-of day, without scenarios."""
    rows = serving_rows(history, calendar, models, horizons)
    return leaf_forecasts(
        rows.withColumns({"scenario_id": F.col("model_set"), "override": F.lit(None).cast("double")})
    )


def calibration_tables(
    history: DataFrame, calendar: DataFrame, pairs: DataFrame, horizons: tuple[int, ...]
) -> tuple[DataFrame, DataFrame]:
    """Width and portfolio profiles of the statistical model for each slice."""
    # origins sit on one grid, so slices share most of them and each is forecast once
    origins = pairs.select("horizon_days", F.col("calibration_origin").alias("origin")).distinct()
    models = stage(complete(statistical_parameters(calendar, origins)), "calibration_models")
    leaves = stage(plain_leaves(history, calendar, models, horizons), "calibration_leaves")
    overall = upper_forecast(leaves).where(F.col("level") == "overall")
    samples = stage(interval_samples(leaves, pairs), "interval_samples")
    return stage(width_profiles(samples), "width_profiles"), stage(portfolio_profiles(overall, pairs), "portfolio_profiles")


def tournament_slices(calendar: DataFrame, slices: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """For each slice the terminal origin one horizon earlier, with its outcome when it may be used."""
    ready = eligible(calendar, horizons).withColumnRenamed("origin", "tournament_origin").withColumnRenamed("as_of", "tournament_as_of")
    return (
        slices.withColumn("tournament_origin", F.date_sub("as_of", F.col("horizon_days")))
        .join(ready, ["horizon_days", "tournament_origin"], "left")
        .select(
            *KEYS,
            "tournament_origin",
            "tournament_as_of",
            F.coalesce((F.col("observed_days") >= 90) & (F.col("target_days") > 0), F.lit(False)).alias("eligible"),
            F.col("target_revenue").alias("actual_revenue"),
        )
    )


def run_tournament(
    history: DataFrame, calendar: DataFrame, bouts: DataFrame, fitted: DataFrame, horizons: tuple[int, ...]
) -> DataFrame:
    """Direct against statistical on the terminal holdout; direct has to be strictly better."""
    origins = (
        bouts.where("eligible")
        .select("horizon_days", F.col("tournament_origin").alias("origin"))
        .distinct()
    )
    bare = statistical_parameters(calendar, origins)
    contenders = complete(bare.withColumn("model_set", F.lit(STATISTICAL))).unionByName(
        complete(
            bare.withColumns({"model_set": F.lit(DIRECT), "family": F.lit(DIRECT)}).join(fitted, KEYS)
        )
    )
    leaves = plain_leaves(history, calendar, stage(contenders, "contenders"), horizons)
    totals = leaves.groupBy("horizon_days", F.col("origin").alias("tournament_origin")).agg(
        F.sum(F.when(F.col("scenario_id") == STATISTICAL, F.col("predicted_revenue_p50"))).alias("statistical_p50"),
        F.sum(F.when(F.col("scenario_id") == DIRECT, F.col("predicted_revenue_p50"))).alias("direct_p50"),
    )
    scored = bouts.join(totals, ["horizon_days", "tournament_origin"], "left").withColumns(
        {
            "statistical_absolute_error": F.abs(F.col("actual_revenue") - F.col("statistical_p50")),
            "direct_absolute_error": F.abs(F.col("actual_revenue") - F.col("direct_p50")),
        }
    )
    played = F.col("eligible") & F.col("direct_p50").isNotNull()
    return scored.select(
        *KEYS,
        "tournament_origin",
        F.when(~F.col("eligible"), "fallback_insufficient_selection_history")
        .when(F.col("direct_p50").isNull(), "fallback_direct_candidate_unavailable")
        .otherwise("purged_terminal_tournament")
        .alias("status"),
        F.when(played & (F.col("direct_absolute_error") < F.col("statistical_absolute_error")), DIRECT)
        .otherwise(STATISTICAL)
        .alias("selected_family"),
        *[
            F.when(F.col("eligible"), F.col(c)).alias(c)
            for c in ("actual_revenue", "statistical_p50", "direct_p50", "statistical_absolute_error", "direct_absolute_error")
        ],
    )


def fit(
    facts: DataFrame,
    slices: DataFrame | None = None,
    *,
    calendar: DataFrame | None = None,
    horizons: tuple[int, ...] = HORIZONS,
    train_direct: bool = True,
    train_dependence: bool = True,
    with_baseline: bool = False,
) -> Fit:
    """Fit every slice; with ``with_baseline`` a statistical-only model set is returned as well.

    ``facts`` is read many times: pass a stored or staged table.
    """
    from mediacast.plans.forecast import latest_slices

    calendar = calendar if calendar is not None else staged_calendar(facts, horizons)
    slices = stage(slices if slices is not None else latest_slices(calendar, horizons), "slices")
    bare = stage(statistical_parameters(calendar, slices.drop("as_of")), "statistical_parameters")
    pairs = stage(calibration_origins(calendar, slices, horizons), "calibration_pairs")
    bouts = stage(tournament_slices(calendar, slices, horizons), "tournament_slices")
    # the one pass over the facts for calibration, tournament and serving origins
    days = {*_days(slices, "as_of"), *_days(pairs, "calibration_as_of"), *(_days(bouts, "tournament_as_of") if train_direct else [])}
    history = stage(serving_history(facts, sorted(days), horizons, targets=True), "history")
    widths, portfolios = calibration_tables(history, calendar, pairs, horizons)
    calibrated = (
        bare.join(valid_widths(widths), KEYS, "left")
        .join(valid_portfolio(portfolios), KEYS, "left")
        .withColumn("model_version", F.lit(MODEL_VERSION_STATISTICAL))
    )
    baseline = complete(calibrated.withColumn("model_set", F.lit("baseline")))
    if not train_direct:
        selection = slices.select(
            *KEYS, F.lit("direct_training_disabled").alias("status"), F.lit(STATISTICAL).alias("selected_family")
        )
        models = complete(calibrated.withColumn("model_set", F.lit("candidate")))
        models = models.unionByName(baseline) if with_baseline else models
        return Fit(calendar, history, stage(models, "models"), selection, widths, portfolios)

    first_day = calendar.agg(F.min("date")).first()[0]
    trained = stage(
        slices.select(*KEYS)
        .unionByName(bouts.where("eligible").select("horizon_days", F.col("tournament_origin").alias("origin")))
        .distinct(),
        "trained_slices",
    )
    rows = stage(training_rows(facts, calendar, first_day, horizons, shared=train_dependence), "training_rows")
    counts = stage(cutoff_counts(rows), "cutoff_counts")
    splits = stage(purged_splits(counts, trained), "splits")
    cells = stage(gram_cells(rows), "gram_cells")
    coefficients = stage(solve_fits(fit_statistics(cells, expert_fits(splits))), "coefficients")
    residuals = held_out_residuals(rows, splits, coefficients).select(
        "horizon_days", "mode", "origin", "recent_active_days", "support_ratio", "residual_log_revenue"
    )
    profiles = residual_profiles(stage(residuals, "held_out_residuals"))
    fitted = stage(experts(coefficients, profiles, blend_weights(rows, splits, coefficients)), "experts")
    selection = stage(run_tournament(history, calendar, bouts, fitted, horizons), "selection")

    # without any direct model in a fit every slice is served statistically
    chosen = calibrated.join(selection.select(*KEYS, F.col("selected_family").alias("family")), KEYS).join(
        fitted.select(*KEYS, "scenario_weight", "scenario_expert", "aligned_expert"), KEYS, "left"
    )
    has_expert = F.col("scenario_expert").isNotNull() | F.col("aligned_expert").isNotNull()
    direct_now = F.col("family") == DIRECT
    chosen = chosen.withColumns(
        {
            "model_version": F.when(has_expert, MODEL_VERSION_DIRECT).otherwise(MODEL_VERSION_STATISTICAL),
            "family": F.when(direct_now & has_expert, DIRECT).otherwise(STATISTICAL),
        }
    )
    dependence = None
    statistical_only = F.col("family") == STATISTICAL
    cleared = {c: F.when(statistical_only, F.col(c)) for c in ("lower_width", "upper_width", "portfolio_p10", "portfolio_p50", "portfolio_p90")}
    chosen = chosen.withColumns(cleared)
    if train_dependence:
        served_direct = selection.where(F.col("selected_family") == DIRECT).join(fitted.select(*KEYS), KEYS, "left_semi").select(*KEYS)
        fits = out_of_fold_fits(counts, served_direct)
        residuals = stage(out_of_fold_residuals(rows, solve_out_of_fold(cells, fits)), "out_of_fold_residuals")
        weights = normalised(factor_weights(residuals))
        blocks = block_portfolio_profile(residuals).select(
            *KEYS, *[F.col(f"residual_{q}").alias(f"block_{q}") for q in ("p10", "p50", "p90")]
        )
        dependence = stage(weights.join(blocks, KEYS, "left"), "dependence")
        copula = F.coalesce(F.col("dependence_method") == FACTOR_COPULA, F.lit(False)) & (F.col("family") == DIRECT)
        chosen = chosen.join(dependence.drop("sample_count", "block_count"), KEYS, "left").withColumns(
            {
                **{f"portfolio_{q}": F.when(copula, F.col(f"block_{q}")).otherwise(F.col(f"portfolio_{q}")) for q in ("p10", "p50", "p90")},
                **{
                    f"weight_{name}": F.when(copula, F.col(f"weight_{name}")).otherwise(1.0 if name == "idiosyncratic" else 0.0)
                    for name in ("global", "channel", "campaign_type", "idiosyncratic")
                },
                "dependence_method": F.when(copula, FACTOR_COPULA).otherwise(INDEPENDENT),
            }
        )
    models = complete(chosen.withColumn("model_set", F.lit("candidate")))
    models = models.unionByName(baseline) if with_baseline else models
    return Fit(calendar, history, stage(models, "models"), selection, widths, portfolios, dependence, fitted)
