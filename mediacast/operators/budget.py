"""Baseline media plan per campaign, origin and horizon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacast.operators.calendar import budget_multiplier

MINIMUM_COVERAGE = 0.80
PRIOR_YEAR = "calendar_matched_prior_year_budget"
RUN_RATE = "recent_run_rate_budget"
NO_DELIVERY = "no_recent_delivery"


def baseline_columns() -> dict[str, Column]:
    """Expressions over a campaign-history row joined to its calendar day."""
    h = F.col("horizon_days")
    delivering = (F.col("recent_days") > 0) & (F.col("recent_spend") > 0)
    coverage = F.col("prior_days") / h
    run_rate = F.col("recent_spend") / F.col("recent_days") * h * budget_multiplier(h)
    prior_usable = (coverage >= MINIMUM_COVERAGE) & (F.col("prior_spend") > 0)
    bounded = F.least(F.greatest(F.col("prior_spend"), 0.25 * run_rate), 4.0 * run_rate)
    return {
        "prior_coverage": F.when(delivering, coverage).otherwise(0.0),
        "baseline_budget": F.when(~delivering, 0.0).when(prior_usable, bounded).otherwise(run_rate),
        "baseline_method": F.when(~delivering, NO_DELIVERY).when(prior_usable, PRIOR_YEAR).otherwise(RUN_RATE),
    }
