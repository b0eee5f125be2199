"""Names, limits and schemas shared by every job.

Fixed values: column names, file names, vocabularies and limits below are part of the data
contract and have to stay as they are for results to be comparable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("source_system", T.StringType()),
        T.StructField("source_campaign_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("channel", T.StringType()),
        T.StructField("campaign_type", T.StringType()),
        T.StructField("campaign_name", T.StringType()),
        T.StructField("spend", T.DoubleType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("clicks", T.DoubleType()),
        T.StructField("impressions", T.DoubleType()),
        T.StructField("conversions", T.DoubleType()),
        T.StructField("configured_budget", T.DoubleType()),
        T.StructField("quality_flags", T.StringType()),
    ]
)
CANONICAL_COLUMNS = CANONICAL_SCHEMA.fieldNames()
CAMPAIGN = ["source_system", "source_campaign_id"]
HIERARCHY = ["channel", "campaign_type", "campaign_name"]
MEASURES = ["spend", "revenue", "clicks", "impressions", "conversions"]
HORIZONS = (30, 60, 90)
ALL = "ALL"


@dataclass(frozen=True)
class ExportContract:
    """One advertising platform's export: how it is recognised and what it must hold."""

    source: str
    id_column: str
    date_column: str
    revenue_column: str
    identity: tuple[str, ...]
    others: tuple[str, ...]

    @property
    def required(self) -> set[str]:
        return {*self.identity, *self.others}


# Export headers.
EXPORTS = {
    contract.source: contract
    for contract in (
        ExportContract(
            "google_ads",
            "campaign_id",
            "segments_date",
            "metrics_conversions_value",
            ("campaign_id", "segments_date", "metrics_cost_micros", "metrics_conversions_value"),
            (
                "campaign_advertising_channel_type",
                "campaign_name",
                "metrics_clicks",
                "metrics_impressions",
                "metrics_conversions",
                "campaign_budget_amount",
            ),
        ),
        ExportContract(
            "microsoft_ads",
            "CampaignId",
            "TimePeriod",
            "Revenue",
            ("CampaignId", "TimePeriod", "Revenue", "Spend"),
            ("CampaignType", "CampaignName", "Clicks", "Impressions", "Conversions", "DailyBudget"),
        ),
        ExportContract(
            "meta_ads",
            "campaign_id",
            "date_start",
            "conversion",
            ("campaign_id", "date_start", "spend", "conversion"),
            ("campaign_name", "clicks", "impressions", "daily_budget"),
        ),
    )
}

# Optional metadata files.
TAXONOMY_FILE = "campaign_taxonomy.csv"
TAXONOMY_COLUMNS = ["source_system", "source_campaign_id", "campaign_type"]
TAXONOMY_SOURCES = ["meta_ads"]
SEMANTICS_FILE = "source_semantics.csv"
SEMANTICS_COLUMNS = ["source_system", "currency", "timezone", "attribution_method", "revenue_field"]
PLAN_FILE = "media_plan.csv"
PLAN_COLUMNS = ["source_system", "source_campaign_id", "horizon_days", "planned_budget"]
OPTIONAL_FILES = {TAXONOMY_FILE, SEMANTICS_FILE, PLAN_FILE}
REVIEW_STATUS = "review_status"
REVIEW_STATUSES = ["reviewed", "unreviewed"]

# Text that counts as a missing cell in a CSV export.
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Platform label vocabularies.
MICROSOFT_TYPES = {
    "audience": "DISPLAY",
    "performance max": "PERFORMANCE_MAX",
    "performancemax": "PERFORMANCE_MAX",
    "search": "SEARCH",
    "shopping": "SHOPPING",
}
META_NAME_LABELS = [
    ("dpa", "META_REMARKETING_DPA"),
    ("dynamic product", "META_REMARKETING_DPA"),
    ("remarketing", "META_REMARKETING"),
    ("retarget", "META_REMARKETING"),
    ("prospecting", "META_PROSPECTING"),
    ("acquisition", "META_PROSPECTING"),
    ("shopping", "META_SHOPPING"),
    ("video", "META_VIDEO"),
    ("display", "META_DISPLAY"),
]
META_UNKNOWN_TYPE = "Generic"

# Model constants.
TARGET_ROAS = 4.0
MIN_HISTORY_DAYS = 28
RIDGE_ALPHA = 4.0
Z80 = 1.28155
DIRECT = "direct_ensemble"
STATISTICAL = "statistical_fallback"
MODEL_VERSION_DIRECT = "temporal-tournament-calendar-plan-oof-intervals"
MODEL_VERSION_STATISTICAL = "statistical-calendar-plan-oof-intervals"


class ContractError(ValueError):
    """Input, output or request breaks its declared contract."""
