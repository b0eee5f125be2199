"""The model as a table: one row per ``(horizon_days, origin)``.

A row holds the statistical constants, the serving family, interval calibration, dependence weights
and up to two ridge experts. Its size follows the number of origins, which the caller chooses, so it
is safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacast.contracts import MIN_HISTORY_DAYS, MODEL_VERSION_STATISTICAL, STATISTICAL, TARGET_ROAS

INDEPENDENT = "independent_rank_fallback_v1"
FACTOR_COPULA = "hierarchical_residual_factor_copula_v1"

EXPERT = T.StructType(
    [
        T.StructField("intercept", T.DoubleType()),
        T.StructField("means", T.ArrayType(T.DoubleType())),
        T.StructField("scales", T.ArrayType(T.DoubleType())),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("channels", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("types", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("residual_p10", T.DoubleType()),
        T.StructField("residual_p50", T.DoubleType()),
        T.StructField("residual_p90", T.DoubleType()),
        T.StructField("sparse_multiplier", T.DoubleType()),
        T.StructField("extrapolation_multiplier", T.DoubleType()),
        T.StructField("sample_count", T.LongType()),
        T.StructField("calibration_sample_count", T.LongType()),
    ]
)


def model_defaults() -> dict[str, object]:
    """Columns beyond ``horizon_days``, ``origin`` and ``as_of``, with the values of a bare statistical model."""
    none = F.lit(None)
    return {
        "model_set": F.lit("selected"),
        "model_version": F.lit(MODEL_VERSION_STATISTICAL),
        "global_roas": none.cast("double"),
        "global_log_sigma": none.cast("double"),
        "month_factors": none.cast("array<double>"),
        "target_roas": F.lit(TARGET_ROAS),
        "min_history_days": F.lit(MIN_HISTORY_DAYS),
        "family": F.lit(STATISTICAL),
        "lower_width": none.cast("double"),
        "upper_width": none.cast("double"),
        "portfolio_p10": none.cast("double"),
        "portfolio_p50": none.cast("double"),
        "portfolio_p90": none.cast("double"),
        "dependence_method": F.lit(INDEPENDENT),
        "weight_global": F.lit(0.0),
        "weight_channel": F.lit(0.0),
        "weight_campaign_type": F.lit(0.0),
        "weight_idiosyncratic": F.lit(1.0),
        "scenario_weight": none.cast("double"),
        "scenario_expert": none.cast(EXPERT),
        "aligned_expert": none.cast(EXPERT),
    }


def complete(models: DataFrame) -> DataFrame:
    """Fill in the model columns a table does not have, in one fixed order."""
    defaults = model_defaults()
    return models.select(
        "horizon_days",
        "origin",
        "as_of",
        *[F.col(c).alias(c) if c in models.columns else value.alias(c) for c, value in defaults.items()],
    )
