"""Campaign-level forecasts from history rows, model rows and an optional media plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.contracts import CAMPAIGN, DIRECT, HIERARCHY, HORIZONS, STATISTICAL, Z80, ContractError
from mediacast.functions.columns import campaign_key, clip, joined_flags, response_revenue
from mediacast.operators.budget import PRIOR_YEAR, RUN_RATE, baseline_columns
from mediacast.operators.calendar import budget_multiplier, mean_over_future
from mediacast.operators.history import by_horizon, campaign_history, campaigns, delivery_ratios, origin_probes, with_delivery

BASELINE = "baseline"
SLICE = ["scenario_id", "horizon_days", "origin"]


def feature_columns(planned: Column) -> list[Column]:
    """The nine numeric model features of a history row, in model order."""
    h = F.col("horizon_days")
    angle = 2 * math.pi * (F.month("date") + h / 60.0) / 12.0
    return [
        F.log1p(F.greatest(planned, F.lit(0.0))),
        F.col("recent_revenue") / F.greatest("recent_spend", F.lit(1e-9)),
        F.col("history_revenue") / F.greatest("history_spend", F.lit(1e-9)),
        F.log1p(F.greatest("recent_spend", F.lit(0.0))),
        F.log1p(F.greatest("recent_revenue", F.lit(0.0))),
        F.col("recent_days").cast("double"),
        F.col("recent_spend") / F.greatest("previous_spend", F.lit(1.0)),
        F.sin(angle),
        F.cos(angle),
    ]


def planned_support(planned: Column) -> Column:
    """Planned budget relative to the horizon total the whole history supports."""
    daily = F.col("history_spend") / F.greatest(F.col("history_days"), F.lit(1))
    return F.greatest(planned, F.lit(0.0)) / F.greatest(daily * F.col("horizon_days"), F.lit(1.0))


def predicted_log(expert: Column, features: list[Column], channel: Column, campaign_type: Column) -> Column:
    """Linear score; a label the expert has never seen adds nothing."""
    score = expert["intercept"]
    for i, x in enumerate(features):
        score = score + (x - F.get(expert["means"], F.lit(i))) / F.get(expert["scales"], F.lit(i)) * F.get(expert["coefficients"], F.lit(i))
    for labels, label in ((expert["channels"], channel), (expert["types"], campaign_type)):
        score = score + F.coalesce(F.try_element_at(labels, label), F.lit(0.0))
    return score


def _expert_width(expert: Column, support: Column) -> Column:
    """Interval multiplier of a row with thin recent history or a plan beyond its support."""

    def widen(multiplier: Column, applies: Column) -> Column:
        return F.when(applies & (multiplier > 1.0), F.least(multiplier, F.lit(3.0))).otherwise(1.0)

    return clip(
        widen(expert["sparse_multiplier"], F.col("recent_days") < 28)
        * widen(expert["extrapolation_multiplier"], support > 1.5),
        1.0,
        4.0,
    )


def _expert_quantiles(expert: Column, log_mean: Column, width: Column) -> Column:
    middle = expert["residual_p50"]

    def level(residual: Column) -> Column:
        return F.greatest(F.lit(0.0), F.expm1(log_mean + middle + (residual - middle) * width))

    return F.struct(
        level(expert["residual_p10"]).alias("p10"),
        F.greatest(F.lit(0.0), F.expm1(log_mean + middle)).alias("p50"),
        level(expert["residual_p90"]).alias("p90"),
    )


def _blend(weight: Column, scenario: Column, aligned: Column) -> Column:
    """Weighted experts, widened by a bounded quarter of their disagreement."""

    def mix(name: str) -> Column:
        return weight * scenario[name] + (1.0 - weight) * aligned[name]

    middle = mix("p50")
    spread = F.least(F.abs(scenario["p50"] - aligned["p50"]), F.greatest(middle * 3.0, F.lit(1.0)))
    return F.struct(
        F.least(F.greatest(F.lit(0.0), mix("p10") - 0.25 * spread), middle).alias("p10"),
        middle.alias("p50"),
        F.greatest(middle, mix("p90") + 0.25 * spread).alias("p90"),
    )


def _unsupported(expert: Column) -> Column:
    """The expert exists but lacks this campaign's channel or type."""
    return expert.isNotNull() & (
        F.try_element_at(expert["channels"], F.col("channel")).isNull()
        | F.try_element_at(expert["types"], F.col("campaign_type")).isNull()
    )


def _with_season(models: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Mean monthly ROAS factor over the horizon, once per model row."""
    season = F.lit(None).cast("double")
    for h in horizons:
        season = F.when(
            F.col("horizon_days") == h, mean_over_future(F.col("month_factors"), F.lit(1.0), F.col("as_of"), h)
        ).otherwise(season)
    return models.withColumn("seasonal_roas", season)


def serving_history(
    facts: DataFrame, as_of_days: list, horizons: tuple[int, ...] = HORIZONS, targets: bool = False
) -> DataFrame:
    """Per campaign, as-of day and horizon everything a leaf forecast needs from the facts.

    ``as_of_days`` is the short list of days models are served at. One pass covers all of them, so a
    job with many origins asks once and stages the result.
    """
    history = campaign_history(
        facts, origin_probes(campaigns(facts), as_of_days), horizons, spend_totals=True, targets=targets
    )
    # both sides are placed by campaign already
    return by_horizon(with_delivery(history, delivery_ratios(facts)), horizons)


def serving_rows(
    history: DataFrame, calendar: DataFrame, models: DataFrame, horizons: tuple[int, ...] = HORIZONS
) -> DataFrame:
    """History rows with their calendar day and every model served at that day.

    Calendar and model table are bounded by history length and by the list of origins.
    """
    at = calendar.select("date", "portfolio_active", "budget_multiplier_90")
    return (
        history.join(F.broadcast(at), "date")
        .join(F.broadcast(_with_season(models, horizons).withColumnRenamed("as_of", "date")), ["horizon_days", "date"])
        .where((F.col("recent_spend") > 0) | (F.col("portfolio_active") == 0))
        .withColumn("campaign_key", campaign_key())
    )


def resolve_plan(plan: DataFrame, dimension: DataFrame) -> DataFrame:
    """Plan rows bound to campaigns: by qualified key, else by a bare id that only one source uses.

    ``campaign_key`` stays null for a row that names no campaign, ``ambiguous`` marks a bare id shared
    by several sources.
    """
    keys = dimension.select(campaign_key().alias("campaign_key"), "source_system", "source_campaign_id").distinct()
    bare = keys.groupBy(F.col("source_campaign_id").alias("override_key")).agg(
        F.min("campaign_key").alias("bare_key"), F.count_distinct("source_system").alias("sources")
    )
    exact = keys.select(F.col("campaign_key").alias("override_key"), F.col("campaign_key").alias("exact_key"))
    return (
        plan.join(exact, "override_key", "left")
        .join(bare, "override_key", "left")
        .select(
            "scenario_id",
            "horizon_days",
            "override_key",
            F.coalesce("exact_key", "bare_key").alias("campaign_key"),
            F.col("exact_key").isNotNull().alias("qualified"),
            (F.col("sources") > 1).alias("ambiguous"),
            "planned_budget",
        )
    )


def plan_problems(resolved: DataFrame, leaves: DataFrame) -> DataFrame:
    """Plan rows that are ambiguous or reach no active campaign."""
    reached = leaves.select("scenario_id", "horizon_days", "campaign_key").distinct()
    unused = resolved.join(reached, ["scenario_id", "horizon_days", "campaign_key"], "left_anti")
    columns = ["scenario_id", "horizon_days", "override_key"]
    return (
        resolved.where("ambiguous")
        .select(*columns, F.lit("ambiguous_unqualified_key").alias("problem"))
        .unionByName(
            unused.where(~F.coalesce("ambiguous", F.lit(False))).select(*columns, F.lit("no_active_campaign").alias("problem"))
        )
    )


def raise_on_plan_problems(problems: DataFrame) -> None:
    first = problems.orderBy("scenario_id", "horizon_days", "override_key").limit(1).collect()
    if first:
        raise ContractError(f"budget override {first[0].override_key!r}: {first[0].problem}")


def with_scenarios(
    rows: DataFrame, scenarios: list[tuple[str, float | None]] | None = None, resolved_plan: DataFrame | None = None
) -> DataFrame:
    """One copy of the serving rows per scenario, with its budget override and ROAS target."""
    chosen = F.array(
        *[
            F.struct(F.lit(name).alias("scenario_id"), F.lit(target).cast("double").alias("scenario_target"))
            for name, target in (scenarios or [(BASELINE, None)])
        ]
    )
    rows = rows.select("*", F.inline(chosen)).withColumn("target_roas", F.coalesce("scenario_target", "target_roas"))
    if resolved_plan is None:
        return rows.drop("scenario_target").withColumn("override", F.lit(None).cast("double"))
    # a qualified key wins over a bare id for the same campaign
    overrides = resolved_plan.groupBy("scenario_id", "horizon_days", "campaign_key").agg(
        F.max_by("planned_budget", "qualified").alias("override")
    )
    return rows.drop("scenario_target").join(overrides, ["scenario_id", "horizon_days", "campaign_key"], "left")


def spend_quantiles(planned: Column) -> dict[str, Column]:
    """Spend interval from the spread of past horizon totals and the usual share of budget delivered."""
    measured = (F.col("total_n") >= 3) & (F.col("total_mean") > 0)
    variation = F.when(measured, clip(F.col("total_std") / F.col("total_mean"), 0.05, 0.45)).otherwise(0.12)
    delivered = F.coalesce(clip(F.col("delivery"), 0.55, 1.25), F.lit(1.0))
    centre = planned * delivered
    none = planned <= 0
    return {
        "predicted_spend_p10": F.when(none, 0.0).otherwise(
            F.least(F.greatest(F.lit(0.0), centre * (1.0 - Z80 * variation)), planned)
        ),
        "predicted_spend_p50": F.when(none, 0.0).otherwise(planned),
        "predicted_spend_p90": F.when(none, 0.0).otherwise(F.greatest(centre * (1.0 + Z80 * variation), planned)),
    }


def leaf_forecasts(rows: DataFrame) -> DataFrame:
    """P10/P50/P90 of revenue and spend per scenario, horizon, origin and campaign. No shuffle."""
    h = F.col("horizon_days")
    planned = F.col("planned_budget")
    rows = rows.withColumns(baseline_columns()).withColumns(
        {
            "planned_budget": F.coalesce("override", "baseline_budget"),
            "reliability": F.least(F.lit(1.0), F.col("recent_days") / F.col("min_history_days")),
        }
    )
    historic = F.col("history_revenue") / F.greatest("history_spend", F.lit(1e-9))
    recent = F.when(F.col("recent_spend") > 0, F.col("recent_revenue") / F.greatest("recent_spend", F.lit(1e-9))).otherwise(historic)
    reliability = F.col("reliability")
    support = planned_support(planned)
    direct = F.col("family") == DIRECT
    members = {"scenario": F.col("scenario_expert"), "aligned": F.col("aligned_expert")}
    scenario, aligned = members.values()
    fitted = direct & (scenario.isNotNull() | aligned.isNotNull())
    # one feature array, one score per expert: each is read several times further down
    rows = rows.withColumn("features", F.when(fitted, F.array(*feature_columns(planned))))
    features = [F.get("features", F.lit(i)) for i in range(9)]
    rows = rows.withColumns(
        {
            "roas": (0.70 * (reliability * recent + (1.0 - reliability) * historic) + 0.30 * F.col("global_roas"))
            * F.col("seasonal_roas"),
            "extrapolation": planned > 1.5 * F.greatest(
                F.col("history_spend") / F.greatest(F.col("history_days"), F.lit(1)) * h, F.lit(1.0)
            ),
            "oov": fitted & (_unsupported(scenario) | _unsupported(aligned)) & (planned > 0),
            **{
                f"{name}_log": predicted_log(expert, features, F.col("channel"), F.col("campaign_type"))
                for name, expert in members.items()
            },
            **{f"{name}_width": _expert_width(expert, support) for name, expert in members.items()},
        }
    ).withColumns(
        {
            "sigma": F.col("global_log_sigma")
            * (1.0 + (1.0 - reliability) + F.when(F.col("extrapolation"), 0.55).otherwise(0.0)),
            "curve_p50": response_revenue(F.col("baseline_budget"), F.col("roas"), planned),
            **{
                f"{name}_quantiles": F.when(
                    fitted & ~F.col("oov") & expert.isNotNull(),
                    _expert_quantiles(expert, F.col(f"{name}_log"), F.col(f"{name}_width")),
                )
                for name, expert in members.items()
            },
        }
    ).withColumn(
        "direct",
        F.coalesce(
            F.when(
                F.col("scenario_quantiles").isNotNull() & F.col("aligned_quantiles").isNotNull(),
                _blend(clip(F.col("scenario_weight"), 0.0, 1.0), F.col("scenario_quantiles"), F.col("aligned_quantiles")),
            ),
            "scenario_quantiles",
            "aligned_quantiles",
        ),
    )
    cap = F.greatest(F.col("curve_p50") * 2.0, planned * F.col("global_roas") * 2.0, F.lit(1.0))
    d50 = F.col("direct.p50")
    capped = F.col("direct").isNotNull() & (d50 > cap)
    shrink = F.when(capped, cap / F.greatest(d50, F.lit(1e-9))).otherwise(1.0)
    p50 = F.col("curve_p50")
    raw10, raw90 = p50 * F.exp(-Z80 * F.col("sigma")), p50 * F.exp(Z80 * F.col("sigma"))
    widths = (F.col("family") == STATISTICAL) & F.col("lower_width").isNotNull() & F.col("upper_width").isNotNull()
    calibrated = widths & (p50 > 0)

    def widened(edge: Column, width: Column) -> Column:
        return F.expm1(F.log1p(p50) + (F.log1p(F.greatest(edge, F.lit(0.0))) - F.log1p(p50)) * width)

    curve10 = F.when(calibrated & (F.col("lower_width") > 1.0), F.greatest(F.lit(0.0), widened(raw10, F.col("lower_width")))).otherwise(raw10)
    curve90 = F.when(calibrated & (F.col("upper_width") > 1.0), F.greatest(p50, widened(F.greatest(raw90, p50), F.col("upper_width")))).otherwise(raw90)
    none, uses_direct = planned <= 0, F.col("direct").isNotNull()

    def choose(name: str, curve: Column) -> Column:
        return F.when(none, 0.0).when(uses_direct, F.col(f"direct.{name}") * shrink).otherwise(curve)

    free = F.col("override").isNull()
    flags = joined_flags(
        F.when(F.col("recent_days") < F.col("min_history_days"), "sparse_recent_history"),
        F.when(F.col("recent_spend") <= 0, "portfolio_dormant_zero_plan"),
        F.when(F.col("extrapolation"), "budget_extrapolation"),
        F.when(planned > 1.25 * F.col("baseline_budget"), "diminishing_returns"),
        F.when(free & (F.col("baseline_method") == PRIOR_YEAR), "calendar_matched_prior_year_budget"),
        F.when(free & (F.col("baseline_method") == RUN_RATE), "recent_run_rate_baseline_budget"),
        F.when(free & (budget_multiplier(h) != 1.0), "seasonally_adjusted_baseline_budget"),
        F.when(F.col("oov"), "direct_model_category_oov_fallback"),
        F.when(~none & uses_direct & capped, "direct_model_response_capped"),
        F.when(~none & ~uses_direct & calibrated, "fallback_oof_interval_calibrated"),
    )
    forecasts = rows.withColumns(
        {
            "predicted_revenue_p10": choose("p10", curve10),
            "predicted_revenue_p50": choose("p50", p50),
            "predicted_revenue_p90": choose("p90", curve90),
            **spend_quantiles(planned),
            "quality_flags": flags,
        }
    )
    extra = [c for c in ("target_days", "target_spend", "target_revenue") if c in rows.columns]
    return forecasts.select(
        *SLICE, F.col("date").alias("as_of"), *CAMPAIGN, "campaign_key", *HIERARCHY,
        "model_version", "target_roas", "family",
        "planned_budget", "baseline_budget", "baseline_method", "prior_coverage",
        "predicted_revenue_p10", "predicted_revenue_p50", "predicted_revenue_p90",
        "predicted_spend_p10", "predicted_spend_p50", "predicted_spend_p90", "quality_flags",
        "dependence_method", "weight_global", "weight_channel", "weight_campaign_type", "weight_idiosyncratic",
        "portfolio_p10", "portfolio_p50", "portfolio_p90", *extra,
    )
