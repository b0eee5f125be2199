"""Shared shocks between campaigns, from out-of-fold residuals at shared cut-offs.

Everything is a function of counts, sums and sums of squares per (cut-off, channel, campaign type), so
a cut-off with very many campaigns is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.operators.model_table import FACTOR_COPULA, INDEPENDENT

KEYS = ["horizon_days", "origin"]
MIN_BLOCKS, MIN_ROWS, MIN_OWN_WEIGHT = 6, 80, 0.15
FACTORS = ("global", "channel", "campaign_type", "idiosyncratic")


def effect_cells(residuals: DataFrame) -> DataFrame:
    """Per (cut-off, channel, type): size and residual moments with the effects of all three levels."""
    block = [*KEYS, "cutoff"]
    r = F.col("residual_log_revenue")
    cells = residuals.where(r.isNotNull() & ~F.isnan(r)).groupBy(*block, "channel", "campaign_type").agg(
        F.count("*").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("ss")
    )

    def level(*extra: str) -> DataFrame:
        name = "_".join(("block", *extra))
        return cells.groupBy(*block, *extra).agg(F.sum("n").alias(f"{name}_n"), (F.sum("s") / F.sum("n")).alias(f"{name}_mean"))

    # one-campaign blocks say nothing about dependence
    return (
        cells.join(level(), block)
        .join(level("channel"), [*block, "channel"])
        .where(F.col("block_n") >= 2)
        .withColumns(
            {
                "global_level": F.col("block_mean"),
                "channel_effect": F.when(F.col("block_channel_n") >= 2, F.col("block_channel_mean") - F.col("block_mean")).otherwise(0.0),
                "type_effect": F.when(F.col("n") >= 2, F.col("s") / F.col("n") - F.col("block_channel_mean")).otherwise(0.0),
            }
        )
        .withColumn("offset", F.col("global_level") + F.col("channel_effect") + F.col("type_effect"))
        .select(*block, "channel", "campaign_type", "n", "s", "ss", "global_level", "channel_effect", "type_effect", "offset")
    )


def _variance(n: Column, total: Column, squares: Column) -> Column:
    mean = F.sum(total) / F.sum(n)
    return F.when(F.sum(n) > 1, F.greatest(F.lit(0.0), F.sum(squares) / F.sum(n) - mean * mean)).otherwise(0.0)


def factor_weights(residuals: DataFrame) -> DataFrame:
    """Per slice: method, evidence and latent factor weights; independent ranks when evidence is thin."""
    cells = effect_cells(residuals)
    n, c = F.col("n"), F.col("offset")

    def constant(effect: str) -> Column:
        e = F.col(effect)
        return _variance(n, n * e, n * e * e)

    raw = cells.groupBy(*KEYS).agg(
        F.sum(n).alias("sample_count"),
        F.count_distinct("cutoff").alias("block_count"),
        constant("global_level").alias("global"),
        constant("channel_effect").alias("channel"),
        constant("type_effect").alias("campaign_type"),
        _variance(n, F.col("s") - n * c, F.col("ss") - 2.0 * c * F.col("s") + n * c * c).alias("idiosyncratic"),
    )
    common = F.col("global") + F.col("channel") + F.col("campaign_type")
    total = common + F.col("idiosyncratic")
    enough = (F.col("sample_count") >= MIN_ROWS) & (F.col("block_count") >= MIN_BLOCKS) & (total > 1e-12)
    shared = F.least(F.lit(1.0 - MIN_OWN_WEIGHT), common / F.when(total > 1e-12, total))

    def weight(name: str) -> Column:
        usable = enough & (common > 1e-12)
        return F.when(usable, F.round(F.greatest(shared * F.col(name) / F.when(common > 1e-12, common), F.lit(0.0)), 8)).otherwise(0.0)

    return (
        raw.withColumns({f"weight_{name}": weight(name) for name in FACTORS[:3]})
        .withColumns(
            {
                "weight_idiosyncratic": F.round(
                    F.greatest(
                        F.lit(0.0),
                        1.0 - F.col("weight_global") - F.col("weight_channel") - F.col("weight_campaign_type"),
                    ),
                    8,
                ),
                "dependence_method": F.when(enough, FACTOR_COPULA).otherwise(INDEPENDENT),
            }
        )
        .select(*KEYS, "dependence_method", "sample_count", "block_count", *[f"weight_{name}" for name in FACTORS])
    )


def normalised(weights: DataFrame) -> DataFrame:
    """Weights that add up to one."""
    total = sum((F.col(f"weight_{name}") for name in FACTORS[1:]), F.col(f"weight_{FACTORS[0]}"))
    return weights.withColumns({f"weight_{name}": F.col(f"weight_{name}") / total for name in FACTORS})


def block_portfolio_profile(residuals: DataFrame) -> DataFrame:
    """Per slice: deciles of the portfolio log residual over cut-off blocks (a calendar-sized group)."""
    actual = F.sum(F.greatest(F.lit(0.0), F.expm1("target_log_revenue")))
    predicted = F.sum(F.greatest(F.lit(0.0), F.expm1("predicted_log_revenue")))
    blocks = residuals.groupBy(*KEYS, "cutoff").agg((F.log1p(actual) - F.log1p(predicted)).alias("residual"))
    return (
        blocks.groupBy(*KEYS)
        .agg(
            F.count("*").alias("block_count"),
            F.percentile("residual", F.array(F.lit(0.10), F.lit(0.50), F.lit(0.90))).alias("q"),
        )
        .where(F.col("block_count") >= MIN_BLOCKS)
        .select(
            *KEYS,
            "block_count",
            *[F.round(F.get("q", F.lit(i)), 8).alias(f"residual_{name}") for i, name in enumerate(("p10", "p50", "p90"))],
        )
    )
