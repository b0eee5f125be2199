"""Data-quality gate and health summary of the canonical table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.contracts import (
    CAMPAIGN,
    CANONICAL_COLUMNS,
    HIERARCHY,
    MEASURES,
    META_UNKNOWN_TYPE,
    ContractError,
)
from mediacast.functions.columns import is_finite, strip

BLOCKER, WARNING = "blocker", "warning"
RULE_SCHEMA = "rule string, severity string, column_name string, violations bigint"
_UNREVIEWED_TYPES = (
    "meta_campaign_type_unknown|meta_campaign_type_mapped_unreviewed|"
    "meta_campaign_type_taxonomy_unreviewed_fallback|meta_campaign_type_mapping_unreviewed_fallback"
)


def _rules(facts: DataFrame) -> list[tuple[str, str, str, Column]]:
    types = dict(facts.dtypes)
    measure = {
        c: F.nanvl(F.col(c), F.lit(None).cast("double")) if types[c] in ("double", "float") else F.col(c).try_cast("double")
        for c in [*MEASURES, "configured_budget"]
    }
    flags = F.coalesce("quality_flags", F.lit(""))
    rules = [("no_rows", BLOCKER, "*", (F.count("*") == 0).cast("bigint"))]
    rules += [("null", BLOCKER, c, F.count_if(F.col(c).isNull())) for c in ("date", "source_campaign_id")]
    rules += [
        ("blank", BLOCKER, c, F.count_if(strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""))
        for c in [*CAMPAIGN, *HIERARCHY]
    ]
    for c in MEASURES:
        rules += [
            ("null_or_non_numeric", BLOCKER, c, F.count_if(measure[c].isNull())),
            ("non_finite", BLOCKER, c, F.count_if(measure[c].isNotNull() & ~is_finite(measure[c]))),
            ("negative", BLOCKER, c, F.count_if(measure[c] < 0)),
        ]
    budget = measure["configured_budget"]
    rules += [
        ("non_finite", BLOCKER, "configured_budget", F.count_if(budget.isNotNull() & ~is_finite(budget))),
        ("negative", BLOCKER, "configured_budget", F.count_if(budget < 0)),
        ("missing_budget", WARNING, "configured_budget", F.count_if(budget.isNull())),
        ("taxonomy_unreviewed", WARNING, "quality_flags", F.count_if(flags.rlike(f"(?i){_UNREVIEWED_TYPES}"))),
        (
            "meta_revenue_unreviewed",
            WARNING,
            "quality_flags",
            F.count_if(F.lower(flags).contains("meta_conversion_treated_as_attributed_revenue")),
        ),
        (
            "semantics_unreviewed",
            WARNING,
            "quality_flags",
            F.count_if(F.lower(flags).contains("source_semantics_unreviewed")),
        ),
    ]
    return rules


def quality_rules(facts: DataFrame) -> DataFrame:
    """One row per rule with the number of rows (or campaigns) that break it."""
    missing = sorted(set(CANONICAL_COLUMNS) - set(facts.columns))
    if missing:
        return facts.sparkSession.createDataFrame([("missing_column", BLOCKER, c, 1) for c in missing], RULE_SCHEMA)
    rules = _rules(facts)
    # every row-level rule in one scan and one row of counters
    counted = facts.agg(*[count.alias(f"r{i}") for i, (*_, count) in enumerate(rules)])
    tidy = counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(rule).alias("rule"),
                        F.lit(severity).alias("severity"),
                        F.lit(column).alias("column_name"),
                        F.col(f"r{i}").cast("bigint").alias("violations"),
                    )
                    for i, (rule, severity, column, _) in enumerate(rules)
                ]
            )
        )
    )
    return tidy.unionByName(duplicate_days(facts)).unionByName(inconsistent_campaigns(facts))


def duplicate_days(facts: DataFrame) -> DataFrame:
    """All rows of campaign days that occur more than once; copies collapse before the shuffle."""
    return (
        facts.groupBy(*CAMPAIGN, "date")
        .count()
        .agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("violations"))
        .select(
            F.lit("duplicate_campaign_day").alias("rule"),
            F.lit(BLOCKER).alias("severity"),
            F.lit("date").alias("column_name"),
            "violations",
        )
    )


def inconsistent_campaigns(facts: DataFrame) -> DataFrame:
    """Campaigns with more than one channel, type or name; null counts as a value of its own."""
    return (
        facts.select(*CAMPAIGN, *HIERARCHY)
        .distinct()
        .groupBy(*CAMPAIGN)
        .count()
        .agg(F.count_if(F.col("count") > 1).alias("violations"))
        .select(
            F.lit("inconsistent_hierarchy").alias("rule"),
            F.lit(BLOCKER).alias("severity"),
            F.lit(",".join(HIERARCHY)).alias("column_name"),
            "violations",
        )
    )


def raise_if_blocking(rules: DataFrame) -> list[str]:
    """Stop on any broken blocker; returns the warnings. The table has one row per rule."""
    broken = rules.where("violations > 0").collect()
    blockers = sorted(f"{r.rule} in {r.column_name}: {r.violations}" for r in broken if r.severity == BLOCKER)
    if blockers:
        raise ContractError("data quality blockers: " + " | ".join(blockers))
    return sorted(f"{r.rule} in {r.column_name}: {r.violations}" for r in broken)


def health_lists(rules: DataFrame) -> DataFrame:
    """One row from the rule table: the status, and as sorted lists what warns, what blocks and where planning falls back on defaults."""
    entry = F.concat(F.col("rule"), F.lit(" in "), F.col("column_name"), F.lit(": "), F.col("violations").cast("string"))

    def listed(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when((F.col("violations") > 0) & condition, entry)))

    blocks, warns = F.col("severity") == BLOCKER, F.col("severity") == WARNING
    lists = rules.agg(
        listed(warns).alias("warnings"), listed(blocks).alias("blockers"), listed(warns & (F.col("rule") == "missing_budget")).alias("planning_defaults")
    )
    status = F.when(F.size("blockers") > 0, "blocked").when(F.size("warnings") > 0, "warning").otherwise("healthy")
    return lists.withColumn("status", status)


def health_summary(facts: DataFrame) -> DataFrame:
    """One row: size, dates, unclassified Meta rows, revenue semantics, planning defaults."""
    meta = F.col("source_system") == "meta_ads"
    flags = F.lower(F.coalesce("quality_flags", F.lit("")))
    per_campaign = facts.groupBy(*CAMPAIGN).agg(
        F.count("*").alias("rows"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count_if(meta).alias("meta_rows"),
        F.count_if(meta & (F.col("campaign_type") == META_UNKNOWN_TYPE)).alias("untyped"),
        F.count_if(meta & flags.contains("meta_conversion_semantics_reviewed")).alias("reviewed"),
        F.count_if(meta & flags.contains("meta_conversion_treated_as_attributed_revenue")).alias("proxy"),
        F.count_if(F.col("configured_budget").isNull()).alias("no_budget"),
        F.count_if(flags.rlike(_UNREVIEWED_TYPES)).alias("type_warnings"),
        F.count_if(flags.contains("source_semantics_unreviewed")).alias("semantics_warnings"),
        F.count_if(flags.contains("meta_conversion_treated_as_attributed_revenue")).alias("revenue_warnings"),
    )
    return per_campaign.agg(
        F.sum("rows").alias("rows"),
        F.count("*").alias("campaigns"),
        F.min("first_day").alias("date_start"),
        F.max("last_day").alias("date_end"),
        F.sum("untyped").alias("meta_taxonomy_unknown_rows"),
        F.when(F.sum("meta_rows") == 0, "not_applicable")
        .when(F.sum("reviewed") == F.sum("meta_rows"), "reviewed")
        .when(F.sum("proxy") > 0, "assumed_proxy")
        .otherwise("unknown")
        .alias("meta_revenue_semantics_status"),
        F.sum("no_budget").alias("missing_budget_rows"),
        F.when(
            F.sum(F.col("no_budget") + F.col("type_warnings") + F.col("semantics_warnings") + F.col("revenue_warnings")) > 0,
            "warning",
        )
        .otherwise("healthy")
        .alias("status"),
    )
