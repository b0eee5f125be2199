"""Joint draws, hierarchy roll-up, portfolio calibration and summary rows.

Draws stay arrays inside a leaf row and are added up place by place into one row per channel and type, so what is shuffled
grows neither with the number of campaigns nor with that of draws. Everything above works on that small table. Campaign rows
are summarised inside their own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.contracts import ALL, STATISTICAL
from mediacast.functions.columns import joined_flags
from mediacast.functions.draws import (
    DRAWS,
    centred_residual,
    factor_path,
    grid_quantile,
    hash_ranks,
    interpolated,
    share_at_least,
    value_ranks,
    weighted_latent,
)
from mediacast.operators.leaves import SLICE
from mediacast.operators.model_table import FACTOR_COPULA
from mediacast.session import stage

_MODEL = ["model_version", "target_roas", "family", "dependence_method", "portfolio_p10", "portfolio_p50", "portfolio_p90"]
MEDIAN_RANK = 50


def shared_shocks(leaves: DataFrame) -> DataFrame:
    """Weighted global, channel and type factors, once per slice and campaign type that uses a copula."""
    keys = [*SLICE, "channel", "campaign_type"]
    weights = ["weight_global", "weight_channel", "weight_campaign_type"]
    labels = [
        F.lit("global"),
        F.concat(F.lit("channel:"), F.col("channel")),
        F.concat(F.lit("campaign_type:"), F.col("channel"), F.lit(":"), F.col("campaign_type")),
    ]
    groups = leaves.where(F.col("dependence_method") == FACTOR_COPULA).select(*keys, *weights).distinct()
    latent = weighted_latent([(F.col(w), factor_path(label)) for w, label in zip(weights, labels)])
    return groups.select(*keys, latent.alias("shared"))


def leaf_draws(leaves: DataFrame) -> DataFrame:
    """Adds 99 revenue and spend draws that share one percentile path.

    Ranks follow the factor copula where weights exist, else the leaf's own hash order.
    """
    own = F.concat(F.lit("campaign:"), F.col("campaign_key"))
    # staged, so that its true size decides how it is joined
    shocks = stage(shared_shocks(leaves), "shared_shocks")
    joint = F.zip_with("shared", weighted_latent([(F.col("weight_idiosyncratic"), factor_path(own))]), lambda a, b: a + b)
    ranks = F.when(F.col("dependence_method") == FACTOR_COPULA, value_ranks(joint)).otherwise(hash_ranks(own))
    return (
        leaves.join(shocks, [*SLICE, "channel", "campaign_type"], "left")
        .withColumn("ranks", ranks)
        .withColumns(
            {
                f"{name}_draws": interpolated(F.col("ranks"), *[F.col(f"predicted_{name}_{q}") for q in ("p10", "p50", "p90")])
                for name in ("revenue", "spend")
            }
        )
        .drop("ranks", "shared")
    )


def draw_totals(draws: DataFrame) -> DataFrame:
    """Sums per draw at campaign-type, channel and overall level, as arrays.

    A group is one row with a partial sum per draw and metric, so neither the rows that are combined nor those that are
    shuffled follow the number of draws.
    """
    sums = [(f"{name}_{i}", F.get(f"{name}_draws", F.lit(i))) for name in ("revenue", "spend") for i in range(DRAWS)]
    by_type = draws.groupBy(*SLICE, "channel", "campaign_type").agg(
        *[F.sum(value).alias(name) for name, value in sums],
        F.sum("planned_budget").alias("planned_budget"),
        F.sum("predicted_revenue_p50").alias("predicted_revenue_p50"),
        F.count("*").alias("leaves"),
    )
    sets = [[*SLICE, "channel", "campaign_type"], [*SLICE, "channel"], [*SLICE]]
    rolled = by_type.groupingSets(sets, *SLICE, "channel", "campaign_type").agg(
        (F.grouping("channel") * 2 + F.grouping("campaign_type")).alias("rolled"),
        *[F.sum(c).alias(c) for c in (*(name for name, _ in sums), "planned_budget", "predicted_revenue_p50", "leaves")],
    )
    return rolled.select(
        *SLICE, "rolled", "channel", "campaign_type", "planned_budget", "predicted_revenue_p50", "leaves",
        *[F.array(*[F.col(f"{name}_{i}") for i in range(DRAWS)]).alias(f"{name}_draws") for name in ("revenue", "spend")],
    )


def level_draws(draws: DataFrame) -> DataFrame:
    """Upper-level rows with their draw sums."""
    # one row per scenario, horizon and origin; kept out of the roll-up, whose buffers are numbers only
    models = draws.select(*SLICE, *_MODEL).distinct()
    return (
        draw_totals(draws)
        .join(F.broadcast(models), SLICE)
        .select(
            *SLICE,
            F.when(F.col("rolled") == 3, "overall").when(F.col("rolled") == 1, "channel").otherwise("campaign_type").alias("level"),
            F.when(F.col("rolled") == 3, ALL).otherwise(F.col("channel")).alias("channel"),
            F.when(F.col("rolled") >= 1, ALL).otherwise(F.col("campaign_type")).alias("campaign_type"),
            *_MODEL, "revenue_draws", "spend_draws", "planned_budget", "predicted_revenue_p50", "leaves",
        )
    )


def portfolio_calibration(levels: DataFrame) -> DataFrame:
    """Per slice: portfolio total and calibrated target of each draw, null arrays where no profile applies."""
    point = F.col("predicted_revenue_p50")
    applies = F.col("portfolio_p50").isNotNull() & (point > 0)
    targets = F.transform(
        value_ranks(F.col("revenue_draws")),
        lambda r: F.greatest(
            F.lit(0.0),
            F.expm1(F.log1p(point) + centred_residual(r, F.col("portfolio_p10"), F.col("portfolio_p50"), F.col("portfolio_p90"))),
        ),
    )
    return levels.where(F.col("level") == "overall").select(
        *SLICE,
        F.when(applies, F.col("revenue_draws")).alias("totals"),
        F.when(applies, targets).alias("targets"),
        F.col("leaves").alias("all_leaves"),
    )


def _reconciled() -> Column:
    """Scale a row's draws to the calibrated portfolio totals; shares decide where the total is zero."""
    median_total = F.element_at("totals", MEDIAN_RANK)
    share = F.when(
        median_total > 1e-12, F.element_at("revenue_draws", MEDIAN_RANK) / median_total
    ).otherwise(F.col("leaves") / F.col("all_leaves"))
    cells = F.arrays_zip("revenue_draws", "totals", "targets")
    return F.when(
        F.col("targets").isNotNull(),
        F.transform(
            cells,
            lambda x: F.when(x["totals"] > 1e-12, x["revenue_draws"] * (x["targets"] / x["totals"]))
            .when(x["targets"] > 0, share * x["targets"])
            .otherwise(0.0),
        ),
    ).otherwise(F.col("revenue_draws"))


def _as_rows(levels: DataFrame) -> DataFrame:
    return levels.withColumns(
        {
            "campaign_id": F.lit(ALL),
            "campaign_name": F.lit(ALL),
            "campaign_key": F.lit(None).cast("string"),
            "quality_flags": F.lit(None).cast("string"),
        }
    )


def upper_forecast(leaves: DataFrame) -> DataFrame:
    """Summary rows for campaign types, channels and the portfolio only."""
    levels = stage(level_draws(leaf_draws(leaves)), "levels")
    return summarise(_as_rows(levels).join(F.broadcast(portfolio_calibration(levels)), SLICE))


def hierarchy_forecast(leaves: DataFrame) -> DataFrame:
    """Summary rows for campaigns, campaign types, channels and the portfolio.

    Draws are read twice, for the roll-up and, once the portfolio is calibrated, for the campaigns
    themselves. Building them costs far more than storing them, so they are staged.
    """
    draws = stage(leaf_draws(leaves), "draws")
    levels = stage(level_draws(draws), "levels")
    upper = _as_rows(levels)
    leaf_rows = draws.withColumns(
        {"level": F.lit("campaign"), "leaves": F.lit(1).cast("bigint"), "campaign_id": F.col("source_campaign_id")}
    ).select(*upper.columns)
    # one calibration row per scenario, horizon and origin that was asked for
    return summarise(leaf_rows.unionByName(upper).join(F.broadcast(portfolio_calibration(levels)), SLICE))


def summarise(rows: DataFrame) -> DataFrame:
    applied = F.col("targets").isNotNull()
    rows = rows.withColumn("revenue_draws", _reconciled()).withColumn(
        "roas_draws", F.zip_with("revenue_draws", "spend_draws", lambda r, s: r / F.greatest(s, F.lit(1e-9)))
    )
    p50 = F.greatest(F.lit(0.0), F.col("predicted_revenue_p50"))
    spend50 = grid_quantile(F.col("spend_draws"), 50)
    roas50 = p50 / F.greatest(spend50, F.lit(1e-9))
    leaf = F.col("level") == "campaign"
    flags = joined_flags(
        F.when(leaf & (F.col("quality_flags") != ""), F.col("quality_flags")),
        F.when(
            ~leaf,
            F.when(F.col("dependence_method") == FACTOR_COPULA, "historical_residual_factor_copula_rollup").otherwise(
                "independent_rank_rollup_fallback"
            ),
        ),
        F.when(
            applied,
            F.when(F.col("family") == STATISTICAL, "fallback_portfolio_oof_revenue_interval_calibration").otherwise(
                "portfolio_oof_residual_calibration"
            ),
        ),
        F.lit("additive_p50_reconciled"),
    )
    summary = rows.select(
        *SLICE,
        "level", "channel", "campaign_type", "campaign_id", "campaign_name", "campaign_key",
        "planned_budget",
        F.least(grid_quantile(F.col("revenue_draws"), 10), p50).alias("predicted_revenue_p10"),
        p50.alias("predicted_revenue_p50"),
        F.greatest(grid_quantile(F.col("revenue_draws"), 90), p50).alias("predicted_revenue_p90"),
        grid_quantile(F.col("spend_draws"), 10).alias("predicted_spend_p10"),
        spend50.alias("predicted_spend_p50"),
        grid_quantile(F.col("spend_draws"), 90).alias("predicted_spend_p90"),
        F.least(grid_quantile(F.col("roas_draws"), 10), roas50).alias("predicted_roas_p10"),
        roas50.alias("predicted_roas_p50"),
        F.greatest(grid_quantile(F.col("roas_draws"), 90), roas50).alias("predicted_roas_p90"),
        F.round(share_at_least(F.col("roas_draws"), F.col("target_roas")), 4).alias("probability_roas_above_target"),
        flags.alias("quality_flags"),
        "model_version", "target_roas", "dependence_method", applied.alias("portfolio_calibrated"),
    )
    return summary.withColumn("risk_score", risk_score())


def risk_score() -> Column:
    """0..100 from the chance to miss the target, the relative interval width and extrapolation."""
    width = (F.col("predicted_revenue_p90") - F.col("predicted_revenue_p10")) / F.greatest("predicted_revenue_p50", F.lit(1e-9))
    raw = (
        0.55 * (1.0 - F.col("probability_roas_above_target"))
        + 0.25 * F.least(width / 3.0, F.lit(1.0))
        + F.when(F.col("quality_flags").contains("extrapolation"), 0.20).otherwise(0.0)
    )
    return F.least(F.lit(100.0), F.round(100.0 * F.least(F.lit(1.0), raw), 1))
