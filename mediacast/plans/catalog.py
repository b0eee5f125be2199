"""Queries over the sample tables, one per operator or job.

Each takes a session and a folder of parquet tables and returns a DataFrame. Money is rounded to
cents or finer and ratios to six or more digits, so that sums added up in another order compare equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacast.contracts import DIRECT, HORIZONS
from mediacast.functions.columns import campaign_key
from mediacast.functions.draws import hash_ranks
from mediacast.operators import calendar as cal
from mediacast.operators import canonical, evidence, quality
from mediacast.operators.allocate import Allocation, AllocationRequest, allocate, allocation_plan, allocation_summary, candidates, full_steps, top_allocations
from mediacast.operators.calibrate import interval_samples, portfolio_profiles, width_profiles
from mediacast.operators.dependence import block_portfolio_profile, factor_weights
from mediacast.operators.evaluate import (
    coverage_records,
    coverage_summary,
    fold_results,
    horizon_report,
    target_actuals,
    target_reliability,
)
from mediacast.operators.fingerprint import canonical_fingerprint, provenance
from mediacast.operators.history import campaigns
from mediacast.operators.leaves import BASELINE, plan_problems, predicted_log, resolve_plan, serving_history
from mediacast.operators.model_table import complete
from mediacast.operators.quantiles import conformal_rank, deciles, order_statistics
from mediacast.operators.ridge import (
    FINAL,
    FIT,
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
from mediacast.operators.requests import request_violations
from mediacast.operators.rollup import hierarchy_forecast, upper_forecast
from mediacast.operators.training import FEATURES, SHARED, cutoff_counts, purged_splits, training_rows
from mediacast.plans.backtest import backtest
from mediacast.plans.fit import fit, plain_leaves
from mediacast.plans.forecast import channel_plan, forecast, latest_slices, scenario_leaves, statistical_models
from mediacast.session import stage, staging_folder
from mediacast.sources import store
from mediacast.sources.exports import recent_window
from mediacast.sources.lineitem import campaign_days, raw_exports
from mediacast.sources.predictions import FORECAST_V1, as_text, ordered, validated

Query = Callable[[SparkSession, str], DataFrame]


def cents(c: Column | str) -> Column:
    """Money to cents. The nudge keeps sums of cents times per cents, which are exact, off rounding ties."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 3e-6, 2)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: cents(c) if d == 2 else F.round(c, d) for c, d in digits.items()})


def facts_of(spark: SparkSession, folder: str, by_supplier: bool = False) -> DataFrame:
    """Campaign days as a stored table, the way the jobs expect them."""
    return stage(campaign_days(spark, folder, by_supplier), "facts")


_FACT_DIGITS = {"spend": 5, "revenue": 5, "configured_budget": 5}
_LEVELS = {
    "planned_budget": 2,
    **{f"predicted_{m}_{q}": 2 for m in ("revenue", "spend") for q in ("p10", "p50", "p90")},
    **{f"predicted_roas_{q}": 6 for q in ("p10", "p50", "p90")},
}


# canonical table and gates -------------------------------------------------------------------


def canonical_campaign_days(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(campaign_days(spark, folder), _FACT_DIGITS)


def canonicalize_google(spark: SparkSession, folder: str) -> DataFrame:
    exports = raw_exports(campaign_days(spark, folder))
    return rounded(canonical.google_days(exports["google_ads"]), {**_FACT_DIGITS, "clicks": 2, "impressions": 2, "conversions": 5})


def canonicalize_microsoft(spark: SparkSession, folder: str) -> DataFrame:
    exports = raw_exports(campaign_days(spark, folder))
    return rounded(canonical.microsoft_days(exports["microsoft_ads"]), {**_FACT_DIGITS, "clicks": 2, "impressions": 2, "conversions": 5})


def canonicalize_meta(spark: SparkSession, folder: str) -> DataFrame:
    exports = raw_exports(campaign_days(spark, folder))
    return rounded(canonical.meta_days(exports["meta_ads"]), {**_FACT_DIGITS, "clicks": 2, "impressions": 2, "conversions": 5})


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.canonical_days(raw_exports(campaign_days(spark, folder)))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(_cleaned(spark, folder)).where("violations > 0")


def health_summary(spark: SparkSession, folder: str) -> DataFrame:
    return quality.health_summary(_cleaned(spark, folder))


def delivery_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The gate on single deliveries, where a supplier has many rows a day and changing labels."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    facts = lines.select(
        F.lit("google_ads").alias("source_system"),
        F.col("l_suppkey").cast("string").alias("source_campaign_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.lit("SEARCH").alias("channel"),
        F.col("l_returnflag").alias("campaign_type"),
        F.lit("line").alias("campaign_name"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("spend"),
        F.col("l_extendedprice").alias("revenue"),
        F.col("l_quantity").alias("clicks"),
        F.col("l_quantity").alias("impressions"),
        F.lit(1.0).alias("conversions"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("configured_budget"),
        F.lit("").alias("quality_flags"),
    )
    return quality.quality_rules(facts).where("violations > 0")


def _damaged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Single deliveries that are damaged by place, so that every rule on rows is broken."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    k = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 40
    text = F.lit(None).cast("string")

    def measure(first: int, value: Column) -> Column:
        return (
            F.when(k == first, F.lit(float("nan"))).when(k == first + 1, F.lit(float("inf"))).when(k == first + 2, F.lit(-1.5)).otherwise(value)
        )

    facts = lines.select(
        F.when(k == 3, " ").when(k == 23, text).otherwise("google_ads").alias("source_system"),
        F.when(k == 1, text).when(k == 2, "\t ").otherwise(F.col("l_suppkey").cast("string")).alias("source_campaign_id"),
        F.when(k != 0, F.col("l_shipdate").cast("date")).alias("date"),
        F.when(k == 4, "").otherwise("SEARCH").alias("channel"),
        F.when(k == 5, "\n").otherwise(F.col("l_returnflag")).alias("campaign_type"),
        F.when(k != 6, "line").alias("campaign_name"),
        measure(7, F.col("l_extendedprice") * F.col("l_discount")).alias("spend"),
        measure(10, F.col("l_extendedprice")).alias("revenue"),
        F.when(k == 13, "many").when(k == 14, "Infinity").when(k == 15, "-2").otherwise(F.col("l_quantity").cast("string")).alias("clicks"),
        measure(16, F.col("l_quantity")).alias("impressions"),
        measure(19, F.lit(1.0)).alias("conversions"),
        measure(29, F.col("l_tax")).alias("configured_budget"),
        F.when(k == 33, "Meta_Campaign_Type_Unknown")
        .when(k == 34, "x|meta_conversion_treated_as_attributed_revenue")
        .when(k == 35, "SOURCE_SEMANTICS_UNREVIEWED")
        .when(k == 36, text)
        .otherwise("")
        .alias("quality_flags"),
    )
    return facts


def damaged_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    """All rules of the gate on damaged deliveries."""
    return quality.quality_rules(_damaged_lines(spark, folder))


def health_lists(spark: SparkSession, folder: str) -> DataFrame:
    """What warns, blocks and is planned by default, one row per entry, with the status of the whole."""
    lists = quality.health_lists(quality.quality_rules(_damaged_lines(spark, folder)))
    entries = F.flatten(
        F.array(*[F.arrays_zip(F.array_repeat(F.lit(c), F.size(c)).alias("list"), F.col(c).alias("entry")) for c in ("warnings", "blockers", "planning_defaults")])
    )
    return lists.select("status", F.inline(entries))


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Planning requests written from the orders, most of them with a fault; FIXTURES.md has the list."""
    k, total = F.col("o_orderkey") % 18, F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")
    fixed = [
        '{"horizon_days": 30, "target_roas": 2.5}', '{"horizon_days": 45, "total_budget": 10}', '{"horizon_days": "30"}', '{"target_roas": -1}',
        '{"target_roas": true, "total_budget": 0}', '{"zeta": 1, "alpha": 2, "total_budget": 5}', '{"channel_budgets": [1], "channel_minimums": [1]}',
        '{"channel_budgets": {"SEARCH": -5}, "channel_maximums": {"SEARCH": -5}}', '{"channel_budgets": {" ": 5}, "channel_minimums": {" ": 5}}',
        '{"channel_budgets": {"SEARCH": "x"}, "channel_minimums": {"SEARCH": "x"}}', '{"campaign_budgets": 3, "total_budget": "5"}', "not json", "[1, 2]",
        '{"horizon_days": null, "target_roas": 0, "campaign_budgets": {"a:b": null}, "other": {}}', "{}", '{"horizon_days": 60.0, "total_budget": 1e3}',
    ]
    payload = F.concat(F.lit('{"horizon_days": 90, "channel_budgets": {"SEARCH": '), total, F.lit('}, "total_budget": '), total, F.lit("}"))
    for i, one in enumerate(fixed):
        payload = F.when(k == i, one).otherwise(payload)
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("request_id"), F.when(k != 17, payload).alias("payload"))


def forecast_request_violations(spark: SparkSession, folder: str) -> DataFrame:
    return request_violations(_payloads(spark, folder))


def allocation_request_violations(spark: SparkSession, folder: str) -> DataFrame:
    return request_violations(_payloads(spark, folder), allocation=True)


def data_provenance(spark: SparkSession, folder: str) -> DataFrame:
    return provenance(campaign_days(spark, folder))


def data_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_fingerprint(campaign_days(spark, folder))


def recent_window_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("order_day"), "o_totalprice"
    )
    return recent_window(orders, "order_day")


# calendar and budgets ------------------------------------------------------------------------


def _fold_setting(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = facts_of(spark, folder)
    calendar = cal.staged_calendar(facts)
    folds = stage(cal.fold_origins(calendar), "folds")
    return facts, calendar, folds


def _slices(folds: DataFrame) -> DataFrame:
    return folds.select("horizon_days", "origin", "as_of")


def statistical_components(spark: SparkSession, folder: str) -> DataFrame:
    _, calendar, folds = _fold_setting(spark, folder)
    at = calendar.select(F.col("date").alias("origin"), "budget_multiplier_90")
    rows = cal.statistical_parameters(calendar, folds.select("horizon_days", "origin")).join(F.broadcast(at), "origin")
    season = F.lit(None).cast("double")
    for h in HORIZONS:
        season = F.when(
            F.col("horizon_days") == h, cal.mean_over_future(F.col("month_factors"), F.lit(1.0), F.col("origin"), h)
        ).otherwise(season)
    return rows.select(
        "horizon_days",
        "origin",
        F.round("global_roas", 8).alias("global_roas"),
        F.round("global_log_sigma", 8).alias("global_log_sigma"),
        F.round(season, 8).alias("seasonal_roas"),
        F.round(cal.budget_multiplier(F.col("horizon_days")), 8).alias("budget_multiplier"),
    )


def month_roas_factors(spark: SparkSession, folder: str) -> DataFrame:
    calendar = cal.portfolio_calendar(campaign_days(spark, folder))
    last = calendar.agg(F.max_by("month_factors", "date").alias("factors"))
    return last.select(F.posexplode("factors").alias("month", "factor")).select(
        (F.col("month") + 1).alias("month"), F.round("factor", 8).alias("factor")
    ).where(F.col("factor").isNotNull())


def baseline_budgets(spark: SparkSession, folder: str) -> DataFrame:
    from mediacast.operators.budget import baseline_columns
    from mediacast.operators.history import by_horizon, campaign_history, origin_probes

    facts, calendar, folds = _fold_setting(spark, folder)
    days = [r[0] for r in folds.select("as_of").distinct().collect()]
    history = by_horizon(campaign_history(facts, origin_probes(campaigns(facts), days)))
    wanted = folds.select("horizon_days", F.col("as_of").alias("date"), "origin")
    rows = (
        history.join(F.broadcast(wanted), ["horizon_days", "date"])
        .join(F.broadcast(calendar.select("date", "budget_multiplier_90")), "date")
        .withColumns(baseline_columns())
    )
    return rows.select(
        "horizon_days",
        "origin",
        campaign_key().alias("campaign_key"),
        F.round("recent_spend", 4).alias("recent_spend"),
        "recent_days",
        "prior_coverage",
        F.round("prior_spend", 4).alias("prior_spend"),
        cents("baseline_budget").alias("baseline_budget"),
        "baseline_method",
    )


# leaves, draws, roll-up ----------------------------------------------------------------------


def _bare_leaves(facts: DataFrame, calendar: DataFrame, slices: DataFrame, targets: bool = False) -> DataFrame:
    """Uncalibrated statistical leaf forecasts of every slice."""
    models = stage(statistical_models(calendar, slices), "models")
    days = [r[0] for r in models.select("as_of").distinct().collect()]
    return plain_leaves(serving_history(facts, days, targets=targets), calendar, models)


def spend_intervals(spark: SparkSession, folder: str) -> DataFrame:
    facts, calendar, folds = _fold_setting(spark, folder)
    leaves = _bare_leaves(facts, calendar, _slices(folds))
    return leaves.select(
        "horizon_days", "origin", "campaign_key", *[cents(f"predicted_spend_{q}").alias(f"predicted_spend_{q}") for q in ("p10", "p50", "p90")]
    )


def _latest_leaves(spark: SparkSession, folder: str) -> DataFrame:
    facts = facts_of(spark, folder)
    calendar = cal.staged_calendar(facts)
    return _bare_leaves(facts, calendar, latest_slices(calendar))


def statistical_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        _latest_leaves(spark, folder).select(
            "horizon_days", "origin", "campaign_key", "channel", "campaign_type", "planned_budget",
            "predicted_revenue_p10", "predicted_revenue_p50", "predicted_revenue_p90", "quality_flags",
        ),
        {"planned_budget": 2, "predicted_revenue_p10": 2, "predicted_revenue_p50": 2, "predicted_revenue_p90": 2},
    )


def factor_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Draw order of every campaign, by the hash of its label."""
    dimension = campaigns(campaign_days(spark, folder)).select(campaign_key().alias("campaign_key"))
    ranks = hash_ranks(F.concat(F.lit("campaign:"), F.col("campaign_key")))
    return dimension.select("campaign_key", F.posexplode(ranks).alias("draw", "rank"))


_LEVEL_COLUMNS = [
    "horizon_days", "origin", "level", "channel", "campaign_type", "campaign_id", "campaign_name", "planned_budget",
    *[f"predicted_{m}_{q}" for m in ("revenue", "spend", "roas") for q in ("p10", "p50", "p90")],
    "probability_roas_above_target", "risk_score", "quality_flags",
]


def hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    leaves = stage(_latest_leaves(spark, folder), "leaves")
    return rounded(hierarchy_forecast(leaves).select(*_LEVEL_COLUMNS), _LEVELS)


def fold_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        _fold_forecast(spark, folder)[2].select(
            "horizon_days", "origin", "level", "channel", "campaign_type", "campaign_id",
            "predicted_revenue_p10", "predicted_revenue_p50", "predicted_revenue_p90",
            "probability_roas_above_target", "risk_score",
        ),
        {f"predicted_revenue_{q}": 2 for q in ("p10", "p50", "p90")},
    )


def _scenario_plan(leaves: DataFrame) -> DataFrame:
    """Some campaigns switched off, some scaled up; one half named by bare id, one by full key."""
    last = F.substring("campaign_key", -1, 1)
    chosen = leaves.where((F.col("scenario_id") == BASELINE) & last.isin("0", "1", "4", "5"))
    return chosen.select(
        F.lit("plan").alias("scenario_id"),
        "horizon_days",
        F.when(last.isin("0", "1"), F.col("campaign_key")).otherwise(F.col("source_campaign_id")).alias("override_key"),
        F.when(last.isin("0", "4"), 0.0).otherwise(F.col("baseline_budget") * 2.5).alias("planned_budget"),
    )


def _scenario_forecast(spark: SparkSession, folder: str) -> DataFrame:
    facts = facts_of(spark, folder)
    calendar = cal.staged_calendar(facts)
    models = stage(statistical_models(calendar, latest_slices(calendar)), "models")
    base = scenario_leaves(facts, calendar, models)
    plan = stage(_scenario_plan(base), "plan")
    leaves = scenario_leaves(facts, calendar, models, plan=plan, scenarios=[(BASELINE, None), ("plan", 3.5)])
    return hierarchy_forecast(leaves)


def budget_scenario(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scenario_forecast(spark, folder).where(F.col("scenario_id") == "plan")
    return rounded(rows.select(*_LEVEL_COLUMNS), _LEVELS)


def scenario_delta(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.scenario_delta(_scenario_forecast(spark, folder), "plan").where(F.col("level") == "channel")
    return rounded(
        rows.select("horizon_days", "channel", "predicted_revenue_p50", "baseline_revenue_p50", "revenue_p50_change"),
        {"predicted_revenue_p50": 2, "baseline_revenue_p50": 2, "revenue_p50_change": 2},
    )


def channel_budget_spread(spark: SparkSession, folder: str) -> DataFrame:
    leaves = _latest_leaves(spark, folder).withColumn("scenario_id", F.lit(BASELINE))
    requests = leaves.select("horizon_days", "channel").distinct().where(F.col("channel").isin("SEARCH", "META_ADS")).select(
        F.lit("channels").alias("scenario_id"), "horizon_days", "channel", (F.col("horizon_days") / 30 * 100000.0).alias("channel_budget")
    )
    return channel_plan(leaves, requests).select("horizon_days", "override_key", cents("planned_budget").alias("planned_budget"))


def budget_plan_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Plan rows for every supplier of the sample: most of them are no campaign."""
    facts = facts_of(spark, folder)
    leaves = stage(_latest_leaves(spark, folder).withColumn("scenario_id", F.lit(BASELINE)), "leaves")
    suppliers = spark.read.parquet(f"{folder}/supplier.parquet")
    plan = suppliers.select(
        F.lit(BASELINE).alias("scenario_id"),
        F.lit(30).alias("horizon_days"),
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("override_key"),
        F.lit(100.0).alias("planned_budget"),
    )
    return plan_problems(resolve_plan(plan, campaigns(facts)), leaves)


def top_channels(spark: SparkSession, folder: str) -> DataFrame:
    rows = hierarchy_forecast(stage(_latest_leaves(spark, folder), "leaves"))
    return evidence.top_rows(rows, "channel", 3).select(
        "horizon_days", "position", "channel", cents("predicted_revenue_p50").alias("expected_revenue")
    )


def top_campaigns(spark: SparkSession, folder: str) -> DataFrame:
    rows = hierarchy_forecast(stage(_latest_leaves(spark, folder), "leaves"))
    return evidence.top_rows(rows, "campaign", 10).select(
        "horizon_days", "position", "campaign_key", cents("predicted_revenue_p50").alias("expected_revenue")
    )


# training ------------------------------------------------------------------------------------


def _training(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = facts_of(spark, folder)
    calendar = cal.staged_calendar(facts)
    first = calendar.agg(F.min("date")).first()[0]
    return facts, calendar, training_rows(facts, calendar, first)


def _training_frame(horizon: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = _training(spark, folder)[2].where(F.col("horizon_days") == horizon)
        digits = {"planned_budget": 2, "support_ratio": 7, "target_log_revenue": 7, **{f: 7 for f in FEATURES if f != "recent_active_days"}}
        return rounded(rows.drop("horizon_days", "source_system", "source_campaign_id"), digits)

    return query


def gram(spark: SparkSession, folder: str) -> DataFrame:
    cells = gram_cells(_training(spark, folder)[2])
    return cells.groupBy("horizon_days", "mode", "channel", "campaign_type").agg(
        F.sum("n").cast("bigint").alias("n"),
        F.round(F.sum("y"), 5).alias("sum_label"),
        F.round(F.sum("s_log_planned_budget"), 5).alias("sum_budget"),
        F.round(F.sum("y_log_planned_budget"), 4).alias("budget_label"),
        F.round(F.sum("q_log_planned_budget_log_recent_spend"), 4).alias("budget_spend"),
        F.round(F.sum("q_recent_active_days_recent_active_days"), 4).alias("days_squared"),
    )


def splits(spark: SparkSession, folder: str) -> DataFrame:
    _, calendar, rows = _training(spark, folder)
    found = purged_splits(cutoff_counts(rows), latest_slices(calendar))
    return found.drop("origin")


def ridge_normal_equations(spark: SparkSession, folder: str) -> DataFrame:
    """Largest component of the penalised gradient at the solution of every final fit: zero."""
    _, calendar, rows = _training(spark, folder)
    rows = stage(rows, "training_rows")
    found = purged_splits(cutoff_counts(rows), latest_slices(calendar))
    fits = stage(solve_fits(fit_statistics(gram_cells(rows), expert_fits(found))).where(F.col("role") == FINAL), "fits")
    fit_rows = rows.where(F.col("mode") != SHARED).join(F.broadcast(fits.select("horizon_days", "mode", "fit", "sample_count")), ["horizon_days", "mode"])
    error = F.col("target_log_revenue") - predicted_log(F.col("fit"), [F.col(f) for f in FEATURES], F.col("channel"), F.col("campaign_type"))
    scored = fit_rows.withColumn("error", error)
    u = [(F.col(f) - F.get("fit.means", F.lit(i))) / F.get("fit.scales", F.lit(i)) for i, f in enumerate(FEATURES)]
    keys = ["horizon_days", "mode", "sample_count"]
    numeric = scored.groupBy(*keys).agg(
        F.abs(F.sum("error")).alias("g_intercept"),
        *[
            F.abs(F.sum(x * F.col("error")) - 4.0 * F.first(F.get("fit.coefficients", F.lit(i)))).alias(f"g_{f}")
            for i, (f, x) in enumerate(zip(FEATURES, u))
        ],
    ).select(*keys, F.greatest("g_intercept", *[f"g_{f}" for f in FEATURES]).alias("gradient"))

    def labelled(column: str, values: str) -> DataFrame:
        return scored.groupBy(*keys, column).agg(
            F.abs(F.sum("error") - 4.0 * F.first(F.try_element_at(f"fit.{values}", F.col(column)))).alias("gradient")
        ).select(*keys, "gradient")

    every = numeric.unionByName(labelled("channel", "channels")).unionByName(labelled("campaign_type", "types"))
    # a gradient of 1e-7 over a thousand rows of size ten is rounding
    return every.groupBy(*keys).agg(F.abs(F.round(F.max("gradient"), 5)).alias("largest_gradient"))


def _expert_coefficients(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows, their splits, and the coefficients of all expert fits."""
    _, calendar, rows = _training(spark, folder)
    rows = stage(rows, "training_rows")
    found = stage(purged_splits(cutoff_counts(rows), latest_slices(calendar)), "splits")
    return rows, found, stage(solve_fits(fit_statistics(gram_cells(rows), expert_fits(found))), "coefficients")


def _expanding_coefficients(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and the coefficients of the shared cut-offs, each from rows that ended before it."""
    _, calendar, rows = _training(spark, folder)
    rows = stage(rows, "training_rows")
    fits = stage(out_of_fold_fits(cutoff_counts(rows), latest_slices(calendar)), "out_of_fold_fits")
    return rows, stage(solve_out_of_fold(gram_cells(rows), fits), "coefficients")


def _terms(coefficients: DataFrame) -> DataFrame:
    """One row per fit and unknown."""
    values = F.col("fit.coefficients")

    def named(kind: str) -> Column:
        return F.transform(F.map_entries(f"fit.{kind}"), lambda e: F.struct(F.concat(F.lit(f"{kind}:"), e["key"]).alias("term"), e["value"].alias("value")))

    entries = F.flatten(
        F.array(
            F.array(F.struct(F.lit("intercept").alias("term"), F.col("fit.intercept").alias("value"))),
            F.array(*[F.struct(F.lit(f).alias("term"), F.get(values, F.lit(i)).alias("value")) for i, f in enumerate(FEATURES)]),
            named("channels"),
            named("types"),
        )
    )
    return coefficients.select(*[c for c in FIT if c != "origin"], "sample_count", F.inline(entries)).withColumn("value", F.round("value", 6))


def ridge_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(_expert_coefficients(spark, folder)[2])


def expanding_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(_expanding_coefficients(spark, folder)[1])


def expert_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Residual quantiles and widenings of both experts on their held-out window."""
    rows, found, coefficients = _expert_coefficients(spark, folder)
    profiles = residual_profiles(held_out_residuals(rows, found, coefficients)).drop("origin")
    return rounded(profiles, {c: 6 for c in ("residual_p10", "residual_p50", "residual_p90", "sparse_multiplier", "extrapolation_multiplier")})


def expert_blend(spark: SparkSession, folder: str) -> DataFrame:
    return blend_weights(*_expert_coefficients(spark, folder)).drop("origin")


def direct_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """The trained experts served on a plan: campaigns switched off, scaled up and left alone."""
    rows, found, coefficients = _expert_coefficients(spark, folder)
    profiles = stage(residual_profiles(held_out_residuals(rows, found, coefficients)), "profiles")
    fitted = stage(experts(coefficients, profiles, blend_weights(rows, found, coefficients)), "experts")
    facts = facts_of(spark, folder)
    calendar = cal.staged_calendar(facts)
    slices = latest_slices(calendar)
    base = scenario_leaves(facts, calendar, stage(statistical_models(calendar, slices), "models"))
    bare = cal.statistical_parameters(calendar, slices.drop("as_of")).withColumn("family", F.lit(DIRECT))
    models = stage(complete(bare.join(fitted, ["horizon_days", "origin"])), "models")
    leaves = scenario_leaves(facts, calendar, models, plan=stage(_scenario_plan(base), "plan"), scenarios=[("plan", 3.5)])
    quantiles = [f"predicted_revenue_{q}" for q in ("p10", "p50", "p90")]
    return leaves.select(
        "horizon_days", "campaign_key", cents("planned_budget").alias("planned_budget"), *[F.round(c, 1).alias(c) for c in quantiles], "quality_flags"
    )


def out_of_fold_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Every shared row with what a fit on earlier targets says about it."""
    rows, coefficients = _expanding_coefficients(spark, folder)
    found = out_of_fold_residuals(rows, coefficients)
    return found.select(
        "horizon_days", "cutoff", "campaign_key", F.round("predicted_log_revenue", 6).alias("predicted"), F.round("residual_log_revenue", 6).alias("residual")
    )


def _residual_proxy(spark: SparkSession, folder: str) -> DataFrame:
    """Label minus what the plan would earn at a return of four: a residual without a model."""
    rows = _training(spark, folder)[2].where(F.col("mode") == SHARED)
    predicted = F.log1p(4.0 * F.col("planned_budget"))
    return rows.select(
        "horizon_days", F.lit("1970-01-01").cast("date").alias("origin"), "cutoff", "campaign_key", "channel", "campaign_type",
        "target_log_revenue", predicted.alias("predicted_log_revenue"), (F.col("target_log_revenue") - predicted).alias("residual_log_revenue"),
    )


def residual_dependence_weights(spark: SparkSession, folder: str) -> DataFrame:
    weights = factor_weights(_residual_proxy(spark, folder)).drop("origin")
    return rounded(weights, {c: 6 for c in weights.columns if c.startswith("weight_")})


def block_portfolio_residuals(spark: SparkSession, folder: str) -> DataFrame:
    profile = block_portfolio_profile(_residual_proxy(spark, folder)).drop("origin")
    return rounded(profile, {f"residual_{q}": 6 for q in ("p10", "p50", "p90")})


def label_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = _training(spark, folder)[2]
    stats = order_statistics(rows, ["horizon_days", "mode"], "target_log_revenue", deciles())
    return rounded(stats, {"p10": 7, "p50": 7, "p90": 7})


# calibration and evaluation ------------------------------------------------------------------


def _calibration(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = facts_of(spark, folder)
    calendar = cal.staged_calendar(facts)
    pairs = stage(cal.calibration_origins(calendar, latest_slices(calendar), HORIZONS), "pairs")
    origins = pairs.select("horizon_days", F.col("calibration_origin").alias("origin"), F.col("calibration_as_of").alias("as_of"))
    return calendar, pairs, stage(_bare_leaves(facts, calendar, origins, targets=True), "calibration_leaves")


def conformal_widths(spark: SparkSession, folder: str) -> DataFrame:
    _, pairs, leaves = _calibration(spark, folder)
    found = width_profiles(stage(interval_samples(leaves, pairs), "samples"))
    columns = ["lower_width_multiplier", "upper_width_multiplier", "base_lower_coverage", "base_upper_coverage"]
    return rounded(found.select("horizon_days", "status", "origin_count", "sample_count", *columns), {c: 6 for c in columns})


def conformal_order_statistics(spark: SparkSession, folder: str) -> DataFrame:
    _, pairs, leaves = _calibration(spark, folder)
    samples = stage(interval_samples(leaves, pairs), "samples")

    def at(column: str) -> DataFrame:
        return order_statistics(samples, ["horizon_days"], column, {column: (0.9, conformal_rank(0.9))})

    both = at("lower_required").join(at("upper_required").drop("n"), "horizon_days")
    return rounded(both, {"lower_required": 6, "upper_required": 6})


def portfolio_residual_profile(spark: SparkSession, folder: str) -> DataFrame:
    _, pairs, leaves = _calibration(spark, folder)
    overall = upper_forecast(leaves).where(F.col("level") == "overall")
    found = portfolio_profiles(overall, pairs)
    columns = [f"residual_{q}" for q in ("p10", "p50", "p90")]
    return rounded(found.select("horizon_days", "origin_count", *columns), {c: 6 for c in columns})


def _fold_forecast(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts, calendar, folds = _fold_setting(spark, folder)
    leaves = stage(_bare_leaves(facts, calendar, _slices(folds)), "leaves")
    return facts, folds, hierarchy_forecast(leaves)


def backtest_coverage(spark: SparkSession, folder: str) -> DataFrame:
    facts, folds, rows = _fold_forecast(spark, folder)
    rows = stage(rows, "fold_forecast")
    return coverage_summary(coverage_records(rows, target_actuals(facts, folds))).drop("scenario_id")


def _fold_results(spark: SparkSession, folder: str) -> DataFrame:
    facts, folds, rows = _fold_forecast(spark, folder)
    return fold_results(rows, folds, target_actuals(facts, folds))


def results_per_fold(spark: SparkSession, folder: str) -> DataFrame:
    columns = {"actual_revenue": 4, "actual_roas": 6, "predicted_revenue_p10": 2, "predicted_revenue_p50": 2, "predicted_revenue_p90": 2}
    rows = _fold_results(spark, folder)
    return rounded(rows.select("horizon_days", "origin", "fold", *columns, "modeled_target_probability", "actual_target_hit"), columns)


_REPORT_COLUMNS = [
    "horizon_days", "folds", "revenue_interval_coverage", "revenue_coverage_low", "revenue_coverage_high", "roas_interval_coverage", "revenue_wape",
]


def report_per_horizon(spark: SparkSession, folder: str) -> DataFrame:
    return horizon_report(_fold_results(spark, folder), 6).select(*_REPORT_COLUMNS)


def evaluation_document(spark: SparkSession, folder: str) -> DataFrame:
    """The report per horizon from a document that was published, read back and found to be about this data and model."""
    facts, folds, rows = _fold_forecast(spark, folder)
    results = stage(fold_results(rows, folds, target_actuals(facts, folds)), "fold_results")
    calendar = cal.staged_calendar(facts)
    card = stage(store.manifest(stage(statistical_models(calendar, latest_slices(calendar)), "models"), facts), "manifest")
    document = store.report_document({"horizons": horizon_report(results, 6), "reliability": target_reliability(results)}, card, "report", "served")
    target = f"{staging_folder(spark)}/report-{uuid.uuid4().hex}"
    store.save_report(document, target)
    loaded = store.load_report(spark, target, card.first().training_data_fingerprint)
    in_use = card.select(F.lit("served").alias("model_id"), F.col("training_data_fingerprint").alias("data_fingerprint"), *evidence.PROVENANCE)
    # one row
    status = evidence.trust(loaded, in_use).select("status")
    return store.report_table(loaded, "horizons").select(*_REPORT_COLUMNS).join(F.broadcast(status))


def reliability(spark: SparkSession, folder: str) -> DataFrame:
    return target_reliability(_fold_results(spark, folder)).drop("scenario_id")


# decisions and allocation --------------------------------------------------------------------


def ordered_levels(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.ordered_levels(hierarchy_forecast(stage(_latest_leaves(spark, folder), "leaves")))
    return rows.select("horizon_days", "level", "position", "channel", "campaign_type", "campaign_id", cents("predicted_revenue_p50").alias("expected_revenue"))


def decision_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = hierarchy_forecast(stage(_latest_leaves(spark, folder), "leaves"))
    found = evidence.decisions(rows, evidence.unavailable_posture("no matching evaluation report", spark))
    return found.select("horizon_days", "probability_roas_above_target", "risk_score", "model_guardrail_passed", "posture", "decision")


def allocation_steps(spark: SparkSession, folder: str) -> DataFrame:
    leaves = _latest_leaves(spark, folder).where(F.col("horizon_days") == 30)
    state = candidates(leaves)
    steps = full_steps(state, 10000.0, F.col("cap") - F.col("allocated"), 3.5)
    return steps.select(
        "campaign_key", "nth", cents("addition").alias("addition"), "phase", F.round("score", 6).alias("score")
    )


def _allocated(spark: SparkSession, folder: str, limited: bool = False) -> tuple[DataFrame, DataFrame, object, float]:
    """Nine tenths of the planned budgets given anew; ``limited`` adds minimums and maximums as shares of a channel's plan."""
    facts = facts_of(spark, folder)
    calendar = cal.staged_calendar(facts)
    models = stage(statistical_models(calendar, latest_slices(calendar)), "models")
    base = scenario_leaves(facts, calendar, models).where(F.col("horizon_days") == 30)
    planned = {r.channel: r.planned for r in base.groupBy("channel").agg(F.sum("planned_budget").alias("planned")).collect()}

    def bounds(shares: dict[str, float]) -> tuple[tuple[str, float], ...]:
        return tuple((c, round(share * planned[c], 2)) for c, share in shares.items() if limited and c in planned)

    request = AllocationRequest(
        30, round(0.9 * sum(planned.values()), 2), 3.5,
        bounds({"META_ADS": 0.7, "MICROSOFT_ADS": 0.4}), bounds({"SEARCH": 0.8, "MICROSOFT_ADS": 1.1}),
    )
    return facts, models, allocate(base, request), calendar


def _given(found: Allocation) -> DataFrame:
    return found.plan.select("campaign_key", "channel", "guarded", cents("cap").alias("cap"), cents("allocated").alias("allocated"))


def allocation(spark: SparkSession, folder: str) -> DataFrame:
    return _given(_allocated(spark, folder)[2])


def allocation_limits(spark: SparkSession, folder: str) -> DataFrame:
    return _given(_allocated(spark, folder, limited=True)[2])


def largest_allocations(spark: SparkSession, folder: str) -> DataFrame:
    found = top_allocations(_allocated(spark, folder, limited=True)[2])
    return found.withColumn("allocated", cents("allocated"))


def allocation_result(spark: SparkSession, folder: str) -> DataFrame:
    facts, models, found, calendar = _allocated(spark, folder)
    plan = stage(allocation_plan(found, 30), "allocation_plan")
    leaves = scenario_leaves(facts, calendar, models, plan=plan, scenarios=[("allocation", 3.5)], check_plan=False)
    rows = hierarchy_forecast(leaves.where(F.col("horizon_days") == 30))
    return rounded(allocation_summary(rows, found, 3.5), {"achieved_roas_p50": 4, "target_gap_p50": 4})


def evidence_briefs(spark: SparkSession, folder: str) -> DataFrame:
    rows = stage(hierarchy_forecast(stage(_latest_leaves(spark, folder), "leaves")), "forecast")
    found = evidence.evidence(rows, evidence.unavailable_posture("no matching evaluation report", spark))
    keys = ["scenario_id", "horizon_days"]
    return evidence.briefs(found).join(evidence.evidence_packets(found), keys).drop("signal_ids")


# whole jobs ----------------------------------------------------------------------------------


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Every horizon and level in the output contract, numbers as text."""
    rows = validated(forecast(facts_of(spark, folder)))
    return as_text(ordered(rows, FORECAST_V1), FORECAST_V1)


def fitted_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Train everything on the facts, then serve it."""
    facts = facts_of(spark, folder)
    fitted = fit(facts)
    return rounded(forecast(facts, fitted.models, calendar=fitted.calendar).select("forecast_id", *_LEVEL_COLUMNS), _LEVELS)


def model_selection(spark: SparkSession, folder: str) -> DataFrame:
    facts = facts_of(spark, folder)
    fitted = fit(facts, train_dependence=False)
    return fitted.selection.select(
        "horizon_days", "status", "selected_family",
        *[cents(c).alias(c) for c in ("actual_revenue", "statistical_p50", "direct_p50")],
    )


def backtest_report(spark: SparkSession, folder: str) -> DataFrame:
    return backtest(facts_of(spark, folder)).report


def queries() -> dict[str, Query]:
    return {
        "canonical_campaign_days": canonical_campaign_days,
        "canonicalize_google": canonicalize_google,
        "canonicalize_microsoft": canonicalize_microsoft,
        "canonicalize_meta": canonicalize_meta,
        "quality_rules": quality_rules,
        "delivery_line_quality": delivery_line_quality,
        "damaged_line_quality": damaged_line_quality,
        "forecast_request_violations": forecast_request_violations,
        "allocation_request_violations": allocation_request_violations,
        "health_summary": health_summary,
        "health_lists": health_lists,
        "data_provenance": data_provenance,
        "data_fingerprint": data_fingerprint,
        "recent_window": recent_window_orders,
        "statistical_components": statistical_components,
        "month_roas_factors": month_roas_factors,
        "baseline_budgets": baseline_budgets,
        "spend_intervals": spend_intervals,
        "statistical_leaves": statistical_leaves,
        "factor_paths": factor_paths,
        "hierarchy_forecast": hierarchy,
        "fold_forecasts": fold_forecasts,
        "budget_scenario": budget_scenario,
        "scenario_delta": scenario_delta,
        "channel_budget_spread": channel_budget_spread,
        "budget_plan_problems": budget_plan_problems,
        "top_channels": top_channels,
        "top_campaigns": top_campaigns,
        "training_frame_30": _training_frame(30),
        "training_frame_60": _training_frame(60),
        "training_frame_90": _training_frame(90),
        "gram_cells": gram,
        "purged_splits": splits,
        "ridge_normal_equations": ridge_normal_equations,
        "ridge_coefficients": ridge_coefficients,
        "expanding_coefficients": expanding_coefficients,
        "expert_profiles": expert_profiles,
        "expert_blend": expert_blend,
        "out_of_fold_errors": out_of_fold_errors,
        "direct_leaves": direct_leaves,
        "residual_dependence_weights": residual_dependence_weights,
        "block_portfolio_residuals": block_portfolio_residuals,
        "label_quantiles": label_quantiles,
        "conformal_widths": conformal_widths,
        "conformal_order_statistics": conformal_order_statistics,
        "portfolio_residual_profile": portfolio_residual_profile,
        "backtest_coverage": backtest_coverage,
        "fold_results": results_per_fold,
        "horizon_report": report_per_horizon,
        "evaluation_document": evaluation_document,
        "target_reliability": reliability,
        "ordered_levels": ordered_levels,
        "decision_rows": decision_rows,
        "allocation_steps": allocation_steps,
        "allocation": allocation,
        "allocation_limits": allocation_limits,
        "largest_allocations": largest_allocations,
        "allocation_result": allocation_result,
        "evidence_briefs": evidence_briefs,
        "predictions": predictions,
        "fitted_forecast": fitted_forecast,
        "model_selection": model_selection,
        "backtest_report": backtest_report,
    }
