"""Rolling-origin back-test of all horizons, folds and both model sets in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacast.contracts import HORIZONS
from mediacast.operators.calendar import fold_origins, staged_calendar
from mediacast.operators.evaluate import (
    coverage_records,
    coverage_summary,
    fold_results,
    horizon_report,
    target_actuals,
    target_reliability,
)
from mediacast.operators.rollup import hierarchy_forecast
from mediacast.plans.fit import Fit, fit, plain_leaves
from mediacast.session import stage
from mediacast.sources.store import manifest, report_document

DEFAULT_FOLDS = 6


@dataclass
class Backtest:
    folds: DataFrame
    fit: Fit
    forecast: DataFrame
    results: DataFrame
    records: DataFrame
    report: DataFrame
    coverage: DataFrame
    reliability: DataFrame


def calibration_samples(models: DataFrame) -> DataFrame:
    """Rows behind the direct intervals per forecast set and horizon: the median over its folds."""
    per_fold = models.select(
        F.col("model_set").alias("scenario_id"),
        "horizon_days",
        "origin",
        F.least("scenario_expert.calibration_sample_count", "aligned_expert.calibration_sample_count").alias("samples"),
    )
    return per_fold.groupBy("scenario_id", "horizon_days").agg(
        F.coalesce(F.floor(F.median("samples")).cast("int"), F.lit(0)).alias("median_calibration_samples")
    )


def backtest_document(result: Backtest, facts: DataFrame, report_id: str, model_id: str) -> DataFrame:
    """The back-test as one document with the provenance of its data and models, to be saved with ``store.save_report``."""
    tables = {"horizons": result.report, "coverage": result.coverage, "reliability": result.reliability}
    return report_document(tables, stage(manifest(result.fit.models, facts), "manifest"), report_id, model_id)


def backtest(
    facts: DataFrame,
    *,
    horizons: tuple[int, ...] = HORIZONS,
    folds: int = DEFAULT_FOLDS,
    step_days: int | None = None,
    train_direct: bool = True,
) -> Backtest:
    """Every fold refits on data up to its origin; the baseline is scored on the same folds."""
    calendar = staged_calendar(facts, horizons)
    fold_table = stage(fold_origins(calendar, horizons, folds, step_days), "folds")
    slices = fold_table.select("horizon_days", "origin", "as_of")
    fitted = fit(facts, slices, calendar=calendar, horizons=horizons, train_direct=train_direct, with_baseline=True)
    leaves = stage(plain_leaves(fitted.history, calendar, fitted.models, horizons), "fold_leaves")
    forecast = stage(hierarchy_forecast(leaves), "fold_forecast")
    actuals = stage(target_actuals(facts, fold_table), "fold_actuals")
    records = coverage_records(forecast, actuals)
    results = stage(fold_results(forecast, fold_table, actuals), "fold_results")
    report = horizon_report(results, folds, step_days).join(
        calibration_samples(fitted.models), ["scenario_id", "horizon_days"], "left"
    )
    return Backtest(
        fold_table, fitted, forecast, results, records, report, coverage_summary(records), target_reliability(results)
    )
