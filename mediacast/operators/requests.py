"""Checks of planning requests, which arrive as JSON text in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.contracts import HORIZONS

# Fields each kind of request may have.
FORECAST_FIELDS = ["horizon_days", "target_roas", "channel_budgets", "campaign_budgets"]
ALLOCATION_FIELDS = ["horizon_days", "target_roas", "total_budget", "channel_minimums", "channel_maximums"]
_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def _parsed(requests: DataFrame) -> DataFrame:
    return requests.withColumn("request", F.try_parse_json("payload"))


def _kind(path: str) -> Column:
    """Type name of a field, null where the field is absent."""
    return F.schema_of_variant(F.try_variant_get("request", path, "variant"))


def _number(path: str) -> Column:
    """The value of a JSON number; text, booleans and objects are not numbers."""
    return F.when(_kind(path).rlike(_NUMERIC), F.try_variant_get("request", path, "double"))


def _budget_maps(fields: list[str]) -> Column:
    """Fields that are present but not objects, or hold something else than non-negative numbers."""

    def broken(name: str) -> Column:
        path = f"$.{name}"
        kind = _kind(path)
        entries = F.try_variant_get("request", path, "map<string,variant>")
        wrong_value = F.exists(
            F.map_values(entries),
            lambda v: ~F.coalesce(F.schema_of_variant(v).rlike(_NUMERIC), F.lit(False))
            | (F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(-1.0)) < 0),
        )
        blank_key = F.exists(F.map_keys(entries), lambda k: F.trim(k) == "")
        return F.when(
            kind.isNotNull() & (~kind.startswith("OBJECT") | F.coalesce(wrong_value | blank_key, F.lit(False))), F.lit(name)
        )

    return F.array_compact(F.array(*[broken(name) for name in fields]))


def request_violations(requests: DataFrame, allocation: bool = False) -> DataFrame:
    """``request_id, violation`` for every broken rule of ``request_id, payload`` rows."""
    allowed = ALLOCATION_FIELDS if allocation else FORECAST_FIELDS
    maps = [f for f in allowed if f.startswith(("channel_", "campaign_"))]
    keys = F.json_object_keys("payload")
    extra = F.sort_array(F.array_except(keys, F.array(*[F.lit(f) for f in allowed])))
    horizon, target = _number("$.horizon_days"), _number("$.target_roas")
    rules = [
        F.when(keys.isNull(), "not_an_object"),
        F.when(F.size(extra) > 0, F.concat(F.lit("unsupported_fields:"), F.array_join(extra, ","))),
        F.when(
            _kind("$.horizon_days").isNotNull() & ~F.coalesce(horizon.isin([float(h) for h in HORIZONS]), F.lit(False)),
            "horizon_days",
        ),
        F.when(_kind("$.target_roas").isNotNull() & ~F.coalesce(target > 0, F.lit(False)), "target_roas"),
    ]
    if allocation:
        total = _number("$.total_budget")
        rules.append(F.when(keys.isNotNull() & ~F.coalesce(total > 0, F.lit(False)), "total_budget"))
    broken = F.concat(F.array_compact(F.array(*rules)), F.coalesce(_budget_maps(maps), F.array().cast("array<string>")))
    return _parsed(requests).select("request_id", F.explode(broken).alias("violation"))


def requested_budgets(requests: DataFrame, field: str) -> DataFrame:
    """The entries of a budget map as rows, one per request and key."""
    entries = F.try_variant_get("request", f"$.{field}", "map<string,double>")
    return _parsed(requests).select(
        "request_id",
        F.coalesce(_number("$.horizon_days"), F.lit(30.0)).cast("int").alias("horizon_days"),
        F.explode(entries).alias("key", "planned_budget"),
    )


def unknown_budget_keys(budgets: DataFrame, leaves: DataFrame) -> DataFrame:
    """Requested campaign keys without an active forecast at that horizon."""
    active = leaves.select("horizon_days", F.col("campaign_key").alias("key")).distinct()
    return budgets.join(active, ["horizon_days", "key"], "left_anti").select("request_id", "key")
