"""Order-free identity of a table, and provenance rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.contracts import CAMPAIGN, CANONICAL_COLUMNS

_PIECES, _DIGITS = 4, 15


def cell_text(df: DataFrame, name: str) -> Column:
    """Cell as text; numbers with twelve significant digits, a missing value unlike any other."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind in ("double", "float"):
        text = F.format_string("%.11e", c)
    elif kind.startswith(("struct", "array", "map")):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "\u0001").otherwise(text)


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[cell_text(df, c) for c in columns]), 256)


def table_fingerprint(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """``fingerprint`` and ``rows``, per group if asked.

    Row digests are added up piece by piece. Sums do not depend on order, keep the number of copies
    and merge before the shuffle, so nothing is sorted or collected however large the table is.
    """
    columns = columns or [c for c in df.columns if c not in (by or [])]
    digest = df.select(*(by or []), row_digest(df, columns).alias("digest"))
    pieces = [
        F.sum(F.conv(F.substring("digest", 1 + _DIGITS * i, _DIGITS), 16, 10).cast("decimal(28,0)")).alias(f"p{i}")
        for i in range(_PIECES)
    ]
    summed = digest.groupBy(*(by or [])).agg(F.count("*").alias("rows"), *pieces)
    text = F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"p{i}"), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(_PIECES)])
    return summed.select(*(by or []), "rows", F.sha2(text, 256).alias("fingerprint"))


def canonical_fingerprint(facts: DataFrame) -> DataFrame:
    return table_fingerprint(facts, CANONICAL_COLUMNS)


def provenance(facts: DataFrame) -> DataFrame:
    """One row: rows, campaigns, dates and sources behind a report."""
    per_campaign = facts.groupBy(*CAMPAIGN).agg(
        F.count("*").alias("rows"), F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    per_source = per_campaign.groupBy("source_system").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("campaigns"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    return per_source.agg(
        F.sum("rows").alias("canonical_rows"),
        F.min("lo").cast("string").alias("canonical_date_start"),
        F.max("hi").cast("string").alias("canonical_date_end"),
        F.sum("campaigns").alias("campaign_count"),
        F.array_join(F.sort_array(F.collect_list("source_system")), ",").alias("source_systems"),
    )


def forecast_identity(
    forecast: DataFrame, data_fingerprint: Column, artifact: Column, plan_fingerprints: DataFrame | None = None
) -> DataFrame:
    """Adds ``forecast_id``: model, data, horizon and scenario in sixteen hex digits."""
    keys = ["scenario_id", "horizon_days"]
    if plan_fingerprints is None:
        rows = forecast.withColumn("plan_fingerprint", F.lit(None).cast("string"))
    else:
        rows = forecast.join(plan_fingerprints.select(*keys, F.col("fingerprint").alias("plan_fingerprint")), keys, "left")
    scenario = F.to_json(
        F.struct(
            F.coalesce("plan_fingerprint", F.lit("no overrides")).alias("budget_overrides"),
            F.col("portfolio_calibrated").alias("portfolio_oof_residual_calibration"),
            "target_roas",
            F.col("dependence_method").alias("uncertainty"),
        )
    )
    text = F.concat_ws("|", "model_version", artifact, data_fingerprint, F.col("horizon_days").cast("string"), scenario)
    return rows.withColumn("forecast_id", F.substring(F.sha2(text, 256), 1, 16)).drop("plan_fingerprint")
