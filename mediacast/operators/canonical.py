"""Platform exports to the canonical campaign-day table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.contracts import (
    CANONICAL_COLUMNS,
    META_NAME_LABELS,
    META_UNKNOWN_TYPE,
    MICROSOFT_TYPES,
    REVIEW_STATUS,
)
from mediacast.functions.columns import day, joined_flags, number, present_text, strip


def meta_name_type(name: Column) -> Column:
    """First matching label of the ordered needle list, ``Generic`` when none matches."""
    text = F.lower(F.coalesce(name, F.lit("")))
    (needle, label), *rest = META_NAME_LABELS
    found = F.when(text.contains(needle), label)
    for needle, label in rest:
        found = found.when(text.contains(needle), label)
    return found.otherwise(META_UNKNOWN_TYPE)


def microsoft_type(label: Column) -> Column:
    """Known presentation spellings to canonical labels, anything else to upper snake case."""
    raw = strip(label)
    key = strip(F.regexp_replace(F.lower(raw), r"[\s_-]+", " "))
    known = F.create_map(*[F.lit(x) for pair in MICROSOFT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.regexp_replace(F.upper(raw), r"[\s-]+", "_"))


def name_or_identifier(name: Column, identifier: Column) -> Column:
    text = strip(present_text(name))
    return F.when(text.isNotNull() & (text != ""), text).otherwise(strip(identifier))


def semantics_review(semantics: DataFrame | None) -> DataFrame | None:
    """One row: are all semantics rows reviewed, and does Meta's row attest ``conversion``."""
    if semantics is None or REVIEW_STATUS not in semantics.columns:
        return None
    reviewed = F.lower(strip(F.coalesce(F.col(REVIEW_STATUS), F.lit("")))) == "reviewed"
    meta = strip(F.col("source_system")) == "meta_ads"
    return semantics.agg(
        F.coalesce(F.bool_and(reviewed), F.lit(False)).alias("all_reviewed"),
        (
            F.coalesce(F.bool_and(reviewed), F.lit(False))
            & (F.count_if(meta) == 1)
            & (F.count_if(meta & (strip(F.col("revenue_field")) == "conversion")) == 1)
        ).alias("meta_reviewed"),
    )


def _with_review(df: DataFrame, semantics: DataFrame | None) -> DataFrame:
    review = semantics_review(semantics)
    if review is None:
        return df.withColumns({"all_reviewed": F.lit(False), "meta_reviewed": F.lit(False)})
    # one row by construction, so pairing it with every row adds nothing but two columns
    return df.join(F.broadcast(review))


def _semantics_flag() -> Column:
    return F.when(F.col("all_reviewed"), "source_semantics_reviewed").otherwise("source_semantics_unreviewed")


def google_days(export: DataFrame, semantics: DataFrame | None = None) -> DataFrame:
    channel = strip(present_text(F.col("campaign_advertising_channel_type")))
    return _with_review(export, semantics).select(
        F.lit("google_ads").alias("source_system"),
        F.col("campaign_id").alias("source_campaign_id"),
        day(F.col("segments_date")).alias("date"),
        channel.alias("channel"),
        channel.alias("campaign_type"),
        name_or_identifier(F.col("campaign_name"), F.col("campaign_id")).alias("campaign_name"),
        (number(F.col("metrics_cost_micros")) / 1_000_000.0).alias("spend"),
        number(F.col("metrics_conversions_value")).alias("revenue"),
        number(F.col("metrics_clicks")).alias("clicks"),
        number(F.col("metrics_impressions")).alias("impressions"),
        number(F.col("metrics_conversions")).alias("conversions"),
        number(F.col("campaign_budget_amount")).alias("configured_budget"),
        joined_flags(F.lit("google_cost_micros_normalized"), _semantics_flag()).alias("quality_flags"),
    )


def microsoft_days(export: DataFrame, semantics: DataFrame | None = None) -> DataFrame:
    raw = strip(present_text(F.col("CampaignType")))
    kind = microsoft_type(present_text(F.col("CampaignType")))
    return _with_review(export, semantics).select(
        F.lit("microsoft_ads").alias("source_system"),
        F.col("CampaignId").alias("source_campaign_id"),
        day(F.col("TimePeriod")).alias("date"),
        F.lit("MICROSOFT_ADS").alias("channel"),
        kind.alias("campaign_type"),
        name_or_identifier(F.col("CampaignName"), F.col("CampaignId")).alias("campaign_name"),
        number(F.col("Spend")).alias("spend"),
        number(F.col("Revenue")).alias("revenue"),
        number(F.col("Clicks")).alias("clicks"),
        number(F.col("Impressions")).alias("impressions"),
        number(F.col("Conversions")).alias("conversions"),
        number(F.col("DailyBudget")).alias("configured_budget"),
        joined_flags(
            F.when(kind != raw, "microsoft_campaign_type_normalized").otherwise("microsoft_campaign_type_canonical"),
            _semantics_flag(),
        ).alias("quality_flags"),
    )


def meta_days(
    export: DataFrame, taxonomy: DataFrame | None = None, semantics: DataFrame | None = None
) -> DataFrame:
    """Meta has no type column: a reviewed taxonomy row wins, else the name decides."""
    rows = _with_review(export, semantics)
    if taxonomy is None:
        rows = rows.withColumns({"mapped": F.lit(None).cast("string"), "declared": F.lit(False)})
    else:
        reviewed = (
            F.lower(strip(F.coalesce(F.col(REVIEW_STATUS), F.lit("")))) == "reviewed"
            if REVIEW_STATUS in taxonomy.columns
            else F.lit(False)
        )
        declared = taxonomy.where(F.col("source_system") == "meta_ads").select(
            F.col("source_campaign_id").alias("campaign_id"),
            F.when(reviewed, F.col("campaign_type")).alias("mapped"),
            F.lit(True).alias("declared"),
        )
        # no hint: one row per campaign, so Spark broadcasts it only while it is small
        rows = rows.join(declared, "campaign_id", "left")
    inferred = meta_name_type(present_text(F.col("campaign_name")))
    how = F.when(inferred == META_UNKNOWN_TYPE, "meta_campaign_type_unknown").otherwise("meta_campaign_type_inferred")
    mapped = F.col("mapped").isNotNull()
    declared_only = ~mapped & F.coalesce(F.col("declared"), F.lit(False))
    return rows.select(
        F.lit("meta_ads").alias("source_system"),
        F.col("campaign_id").alias("source_campaign_id"),
        day(F.col("date_start")).alias("date"),
        F.lit("META_ADS").alias("channel"),
        F.coalesce("mapped", inferred).alias("campaign_type"),
        name_or_identifier(F.col("campaign_name"), F.col("campaign_id")).alias("campaign_name"),
        number(F.col("spend")).alias("spend"),
        number(F.col("conversion")).alias("revenue"),
        number(F.col("clicks")).alias("clicks"),
        number(F.col("impressions")).alias("impressions"),
        number(F.col("conversion")).alias("conversions"),
        number(F.col("daily_budget")).alias("configured_budget"),
        joined_flags(
            F.when(mapped, "meta_campaign_type_mapped_reviewed").otherwise(how),
            F.when(declared_only, "meta_campaign_type_mapping_unreviewed_fallback").when(
                ~mapped, "meta_campaign_type_taxonomy_unreviewed_fallback"
            ),
            F.when(F.col("meta_reviewed"), "meta_conversion_semantics_reviewed").otherwise(
                "meta_conversion_treated_as_attributed_revenue"
            ),
            _semantics_flag(),
        ).alias("quality_flags"),
    )


def canonical_days(
    exports: dict[str, DataFrame], taxonomy: DataFrame | None = None, semantics: DataFrame | None = None
) -> DataFrame:
    """All three platforms in one campaign-day table."""
    parts = [
        google_days(exports["google_ads"], semantics),
        microsoft_days(exports["microsoft_ads"], semantics),
        meta_days(exports["meta_ads"], taxonomy, semantics),
    ]
    return reduce(DataFrame.unionByName, parts).select(*CANONICAL_COLUMNS)
