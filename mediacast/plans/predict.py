"""Upload folder to predictions file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediacast.operators.canonical import canonical_days
from mediacast.operators.quality import quality_rules, raise_if_blocking
from mediacast.plans.forecast import forecast
from mediacast.session import stage
from mediacast.sources.exports import Upload, budget_overrides, read_upload
from mediacast.sources.predictions import write_prediction_table, write_predictions
from mediacast.sources.store import load_model


def checked_facts(spark: SparkSession, folder: str) -> tuple[Upload, DataFrame, list[str]]:
    """Canonical facts of an upload, staged, after the quality gate; nothing costly runs before it."""
    upload = read_upload(spark, folder)
    facts = stage(canonical_days(upload.exports, upload.taxonomy, upload.semantics), "canonical")
    return upload, facts, raise_if_blocking(quality_rules(facts))


def predict_folder(
    spark: SparkSession, folder: str, model_folder: str | None, target: str, as_table: bool = False
) -> tuple[int, list[str]]:
    """Read, check, forecast and publish; returns the number of rows and the warnings.

    Without a stored model the statistical constants of the upload itself are used.
    """
    upload, facts, warnings = checked_facts(spark, folder)
    models, artifact = None, "unhashed-artifact"
    if model_folder is not None:
        models, card = load_model(spark, model_folder)
        artifact = card["artifact_sha256"]
    plan = None
    if upload.media_plan is not None and not upload.media_plan.isEmpty():
        plan = stage(budget_overrides(upload.media_plan), "media_plan")
    rows = stage(forecast(facts, models, plan=plan, artifact=artifact), "forecast")
    write = write_prediction_table if as_table else write_predictions
    return write(rows, target).count(), warnings
