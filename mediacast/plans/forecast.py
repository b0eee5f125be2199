"""Forecast jobs: serve a model table on canonical facts, with or without budget scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacast.contracts import HORIZONS, ContractError
from mediacast.operators.calendar import staged_calendar, statistical_parameters
from mediacast.operators.fingerprint import canonical_fingerprint, forecast_identity, table_fingerprint
from mediacast.operators.history import campaigns
from mediacast.operators.leaves import (
    BASELINE,
    leaf_forecasts,
    plan_problems,
    raise_on_plan_problems,
    resolve_plan,
    serving_history,
    serving_rows,
    with_scenarios,
)
from mediacast.operators.model_table import complete
from mediacast.operators.rollup import hierarchy_forecast
from mediacast.session import stage


def last_day(calendar: DataFrame):
    return calendar.agg(F.max("date")).first()[0]


def latest_slices(calendar: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The serving slice of each horizon: origin and as-of day are the last observed day."""
    latest = calendar.agg(F.max("date").alias("origin"))
    return latest.select(F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_days"), "origin").withColumn(
        "as_of", F.col("origin")
    )


def statistical_models(calendar: DataFrame, slices: DataFrame) -> DataFrame:
    """Bare statistical models as of each slice."""
    fitted = statistical_parameters(calendar, slices.drop("as_of"))
    return complete(fitted)


def served_at(models: DataFrame, calendar: DataFrame) -> DataFrame:
    """A fitted model table moved to the last day of the data it is going to be served on."""
    latest = calendar.agg(F.max("date").alias("latest"))
    moved = models.drop("origin", "as_of").join(F.broadcast(latest)).withColumns(
        {"origin": F.col("latest"), "as_of": F.col("latest")}
    )
    return complete(moved.drop("latest"))


def scenario_leaves(
    facts: DataFrame,
    calendar: DataFrame,
    models: DataFrame,
    *,
    plan: DataFrame | None = None,
    scenarios: list[tuple[str, float | None]] | None = None,
    horizons: tuple[int, ...] = HORIZONS,
    check_plan: bool = True,
) -> DataFrame:
    """Staged leaf forecasts at the last day; stops when a plan row reaches no active campaign."""
    rows = serving_rows(serving_history(facts, [last_day(calendar)], horizons), calendar, models, horizons)
    resolved = resolve_plan(plan, campaigns(facts)) if plan is not None else None
    leaves = stage(leaf_forecasts(with_scenarios(rows, scenarios, resolved)), "leaves")
    if resolved is not None and check_plan:
        raise_on_plan_problems(plan_problems(resolved, leaves))
    return leaves


def forecast(
    facts: DataFrame,
    models: DataFrame | None = None,
    *,
    calendar: DataFrame | None = None,
    plan: DataFrame | None = None,
    scenarios: list[tuple[str, float | None]] | None = None,
    horizons: tuple[int, ...] = HORIZONS,
    artifact: str = "unhashed-artifact",
) -> DataFrame:
    """All levels, horizons and scenarios in one table with forecast ids.

    ``facts`` is read several times: pass a stored or staged table. ``plan`` has the columns
    ``scenario_id, horizon_days, override_key, planned_budget``.
    """
    if calendar is None:
        calendar = staged_calendar(facts, horizons)
    if models is None:
        models = statistical_models(calendar, latest_slices(calendar, horizons))
    else:
        models = served_at(models, calendar)
    leaves = scenario_leaves(facts, calendar, models, plan=plan, scenarios=scenarios, horizons=horizons)
    rows = hierarchy_forecast(leaves).join(
        F.broadcast(canonical_fingerprint(facts).select(F.col("fingerprint").alias("data_fingerprint")))
    )
    plans = None
    if plan is not None:
        plans = table_fingerprint(plan, ["override_key", "planned_budget"], by=["scenario_id", "horizon_days"])
    return forecast_identity(rows, F.col("data_fingerprint"), F.lit(artifact), plans).drop("data_fingerprint")


def channel_plan(leaves: DataFrame, requests: DataFrame) -> DataFrame:
    """Channel budgets spread over the channel's campaigns in proportion to their baseline plans.

    ``requests``: ``scenario_id, horizon_days, channel, channel_budget``. Totals are aggregated and
    joined back, so that a channel with a third of all campaigns is not one window partition.
    """
    base = leaves.where(F.col("scenario_id") == BASELINE).select("horizon_days", "channel", "campaign_key", "planned_budget")
    totals = base.groupBy("horizon_days", "channel").agg(F.sum("planned_budget").alias("channel_total"))
    wanted = requests.join(totals, ["horizon_days", "channel"])
    return base.join(wanted, ["horizon_days", "channel"]).select(
        "scenario_id",
        "horizon_days",
        F.col("campaign_key").alias("override_key"),
        (F.col("channel_budget") * (F.col("planned_budget") / F.greatest("channel_total", F.lit(1e-9)))).alias("planned_budget"),
    )


def unknown_channels(leaves: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested channels without an active campaign."""
    known = leaves.select("horizon_days", "channel").distinct()
    return requests.join(known, ["horizon_days", "channel"], "left_anti")
