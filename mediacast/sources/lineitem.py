"""Campaign-day facts and raw exports derived from the TPC-H-like sample tables.

``lineitem`` rows stand in for ad deliveries: a supplier bucket is a campaign, the ship date the
day. The columns and amounts are defined in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacast.contracts import CANONICAL_COLUMNS

# One bucket has no delivery after the first day, one none before the second; their rows count for larger buckets then.
DORMANT, DORMANT_FROM = 13, "2001-04-05"
NEW, NEW_FROM = 12, "2001-10-09"


def _bucket(day: Column) -> Column:
    k = F.col("l_suppkey") % 20
    plain = F.when(k < 4, 0).when(k < 7, 1).when(k < 9, 2).otherwise(k.cast("int") - 6)
    return (
        F.when((plain == DORMANT) & (day >= F.lit(DORMANT_FROM).cast("date")), 0)
        .when((plain == NEW) & (day < F.lit(NEW_FROM).cast("date")), 1)
        .otherwise(plain)
    )


def campaign_days(spark: SparkSession, folder: str, by_supplier: bool = False) -> DataFrame:
    """Canonical campaign-day table of all lines; ``by_supplier`` makes every supplier a campaign of its own."""
    ship = F.col("l_shipdate").cast("date")
    lines = (
        spark.read.parquet(f"{folder}/lineitem.parquet")
        .select(
            (F.col("l_suppkey").cast("int") if by_supplier else _bucket(ship)).alias("b"),
            ship.alias("date"),
            "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        )
    )
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    days = lines.groupBy("b", "date").agg(
        F.sum(price * discount).alias("spend"),
        F.sum(price * (1 - discount) * 0.2).alias("revenue"),
        F.sum("l_quantity").alias("clicks"),
        (F.sum("l_quantity") * 20).alias("impressions"),
        F.count("*").cast("double").alias("conversions"),
        F.when(F.max("l_tax") != 0, F.sum(price) * 0.06).alias("configured_budget"),
    )
    b = F.col("b")
    even = b % 2 == 0
    google_type = F.when(even, "SEARCH").otherwise("SHOPPING")
    return days.select(
        F.when(b % 3 == 0, "google_ads").when(b % 3 == 1, "microsoft_ads").otherwise("meta_ads").alias("source_system"),
        F.lpad(b.cast("string"), 6, "0").alias("source_campaign_id"),
        "date",
        F.when(b % 3 == 0, google_type).when(b % 3 == 1, "MICROSOFT_ADS").otherwise("META_ADS").alias("channel"),
        F.when(b % 3 == 0, google_type)
        .when(b % 3 == 1, F.when(even, "DISPLAY").otherwise("PERFORMANCE_MAX"))
        .otherwise(F.when(even, "META_PROSPECTING").otherwise("META_REMARKETING"))
        .alias("campaign_type"),
        F.concat(F.lit("Campaign "), F.lpad(b.cast("string"), 6, "0")).alias("campaign_name"),
        "spend", "revenue", "clicks", "impressions", "conversions", "configured_budget",
        F.lit("").alias("quality_flags"),
    ).select(*CANONICAL_COLUMNS)


def raw_exports(facts: DataFrame) -> dict[str, DataFrame]:
    """The three platform exports, all text, behind the given campaign days.

    Labels get the spellings platforms use, some names are blank and some dates carry a time, so
    that cleaning has something to do.
    """
    b = F.col("source_campaign_id").cast("int")
    text = {c: F.col(c).cast("string") for c in [*CANONICAL_COLUMNS]}
    named = F.when(b % 4 != 3, F.col("campaign_name")).otherwise("  ")
    google = facts.where(F.col("source_system") == "google_ads").select(
        F.col("source_campaign_id").alias("campaign_id"),
        text["date"].alias("segments_date"),
        F.concat(F.lit(" "), F.col("channel"), F.lit("\t")).alias("campaign_advertising_channel_type"),
        named.alias("campaign_name"),
        F.round(F.col("spend") * 1e6, 0).cast("decimal(30,0)").cast("string").alias("metrics_cost_micros"),
        text["revenue"].alias("metrics_conversions_value"),
        text["clicks"].alias("metrics_clicks"),
        text["impressions"].alias("metrics_impressions"),
        text["conversions"].alias("metrics_conversions"),
        text["configured_budget"].alias("campaign_budget_amount"),
    )
    microsoft = facts.where(F.col("source_system") == "microsoft_ads").select(
        F.col("source_campaign_id").alias("CampaignId"),
        F.concat(text["date"], F.lit(" 00:00:00")).alias("TimePeriod"),
        F.when(b % 15 == 1, "PerformanceMax")
        .when(b % 15 == 4, "Audience")
        .when(b % 15 == 7, "performance_max ")
        .when(b % 15 == 10, "SEARCH")
        .otherwise("Brand new-type")
        .alias("CampaignType"),
        named.alias("CampaignName"),
        text["revenue"].alias("Revenue"),
        text["spend"].alias("Spend"),
        text["clicks"].alias("Clicks"),
        text["impressions"].alias("Impressions"),
        text["conversions"].alias("Conversions"),
        text["configured_budget"].alias("DailyBudget"),
    )
    meta = facts.where(F.col("source_system") == "meta_ads").select(
        F.col("source_campaign_id").alias("campaign_id"),
        text["date"].alias("date_start"),
        F.when(b % 12 == 2, "Spring DPA push")
        .when(b % 12 == 5, "Retarget visitors")
        .when(b % 12 == 8, "Wide PROSPECTING video")
        .otherwise("")
        .alias("campaign_name"),
        text["revenue"].alias("conversion"),
        text["spend"].alias("spend"),
        text["clicks"].alias("clicks"),
        text["impressions"].alias("impressions"),
        text["configured_budget"].alias("daily_budget"),
    )
    return {"google_ads": google, "microsoft_ads": microsoft, "meta_ads": meta}
