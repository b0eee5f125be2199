"""Model tables on disk with provenance, evaluation reports, decision ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacast.contracts import ContractError
from mediacast.operators.fingerprint import canonical_fingerprint, table_fingerprint
from mediacast.operators.training import FEATURES
from mediacast.sources.files import current_version, new_version, put_in_place, replace_folder

MANIFEST_COLUMNS = [
    "artifact_sha256", "model_version", "training_data_fingerprint", "feature_schema_fingerprint",
    "training_rows", "training_date_start", "training_date_end",
]


def feature_schema_fingerprint(models: DataFrame) -> DataFrame:
    """Identity of feature order and label vocabularies."""
    labels = models.select(
        "horizon_days",
        "scenario_weight",
        *[
            F.to_json(F.sort_array(F.map_keys(f"{expert}.{labels}"))).alias(f"{expert}_{labels}")
            for expert in ("scenario_expert", "aligned_expert")
            for labels in ("channels", "types")
        ],
        F.lit(",".join(FEATURES)).alias("features"),
    )
    return table_fingerprint(labels).select(F.col("fingerprint").alias("feature_schema_fingerprint"))


def model_fingerprint(models: DataFrame) -> DataFrame:
    """Content identity of a parameter table."""
    maps = {
        expert: F.to_json(F.struct(*[
            (F.sort_array(F.map_entries(f"{expert}.{f}")) if f in ("channels", "types") else F.col(f"{expert}.{f}")).alias(f)
            for f in models.schema[expert].dataType.fieldNames()
        ]))
        for expert in ("scenario_expert", "aligned_expert")
    }
    return table_fingerprint(models.withColumns(maps)).select(F.col("fingerprint").alias("artifact_sha256"))


def manifest(models: DataFrame, facts: DataFrame) -> DataFrame:
    """One row that binds a parameter table to its training data and feature schema."""
    span = facts.agg(
        F.count("*").alias("training_rows"),
        F.min("date").cast("string").alias("training_date_start"),
        F.max("date").cast("string").alias("training_date_end"),
    )
    data = canonical_fingerprint(facts).select(F.col("fingerprint").alias("training_data_fingerprint"))
    version = models.agg(F.max("model_version").alias("model_version"))
    # five one-row tables side by side
    joined = model_fingerprint(models)
    for part in (version, data, feature_schema_fingerprint(models), span):
        joined = joined.join(F.broadcast(part))
    return joined.select(*MANIFEST_COLUMNS)


def _checked_model(spark: SparkSession, version: str) -> tuple[DataFrame, dict[str, str]]:
    models = spark.read.parquet(f"{version}/models")
    declared = spark.read.parquet(f"{version}/manifest").first().asDict()
    actual = {
        "artifact_sha256": model_fingerprint(models).first()[0],
        "model_version": models.agg(F.max("model_version")).first()[0],
        "feature_schema_fingerprint": feature_schema_fingerprint(models).first()[0],
    }
    wrong = [name for name, value in actual.items() if declared[name] != value]
    if wrong:
        raise ContractError(f"model table does not match its manifest: {', '.join(wrong)}")
    return models, declared


def save_model(models: DataFrame, facts: DataFrame, folder: str) -> None:
    """Write a candidate with its manifest, read it back, check it, then put both in place in one step."""
    spark, version = models.sparkSession, new_version(folder)
    models.write.parquet(f"{version}/models")
    candidate = spark.read.parquet(f"{version}/models")
    if candidate.isEmpty():
        raise ContractError("a model table needs at least one row")
    manifest(candidate, facts).write.parquet(f"{version}/manifest")
    _checked_model(spark, version)
    put_in_place(spark, folder, version)


def load_model(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, str]]:
    """The parameter table, after its content still matches the manifest."""
    return _checked_model(spark, current_version(spark, folder))


def _document_mark(document: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[c for c in document.columns if c != "document_fingerprint"]), {"ignoreNullFields": "false"}), 256)


def report_document(tables: dict[str, DataFrame], card: DataFrame, report_id: str, model_id: str) -> DataFrame:
    """One row: result tables as sorted arrays of rows, with the provenance of :func:`manifest` and a mark of the whole.

    The tables have a row per forecast set, slice and level at most, so they are small whatever the data is.
    """
    document = card.select(
        F.lit(report_id).alias("report_id"), F.lit(model_id).alias("model_id"), F.col("training_data_fingerprint").alias("data_fingerprint"), *MANIFEST_COLUMNS
    )
    for name, table in tables.items():
        # one row each
        document = document.join(F.broadcast(table.agg(F.sort_array(F.collect_list(F.struct(*table.columns))).alias(name))))
    return document.withColumn("document_fingerprint", _document_mark(document))


def save_report(document: DataFrame, folder: str) -> None:
    """Publish a report document."""
    replace_folder(document, folder)


def load_report(spark: SparkSession, folder: str, data_fingerprint: str | None = None) -> DataFrame:
    """The document published last; refused when its content, or the data it is asked for, has another mark."""
    document = spark.read.parquet(current_version(spark, folder))
    found = document.select("document_fingerprint", "data_fingerprint", _document_mark(document).alias("actual")).first()
    if found.document_fingerprint != found.actual:
        raise ContractError("the report differs from its fingerprint")
    if data_fingerprint is not None and found.data_fingerprint != data_fingerprint:
        raise ContractError("the report is about other data")
    return document


def report_table(document: DataFrame, name: str) -> DataFrame:
    """A result table of a document as rows again."""
    return document.select(F.inline(name))


def record_decisions(decisions: DataFrame, folder: str) -> None:
    """Append decisions: ``action, forecast_id, scenario, summary`` with the last two as structs."""
    wrong = decisions.where(~F.col("action").isin("draft", "approved", "revised")).select("action").limit(1).collect()
    if wrong:
        raise ContractError(f"unknown action {wrong[0].action!r}")
    decisions.select(
        F.current_timestamp().alias("created_at"),
        "action",
        "forecast_id",
        F.to_json("scenario").alias("scenario_json"),
        F.to_json("summary").alias("summary_json"),
    ).write.mode("append").parquet(folder)


def recent_decisions(spark: SparkSession, folder: str, limit: int = 10) -> DataFrame:
    """The last decisions, newest first."""
    return (
        spark.read.parquet(folder)
        .orderBy(F.desc("created_at"), F.desc("forecast_id"))
        .limit(limit)
        .select("created_at", "action", "forecast_id", "summary_json")
    )


