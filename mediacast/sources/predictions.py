"""Versioned output schemas and the predictions sink."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacast.contracts import ALL, ContractError
from mediacast.functions.columns import is_finite, number, strip
from mediacast.sources.exports import header
from mediacast.sources.files import replace_csv_folder, replace_folder, write_single_csv

STRING, INTEGER, NUMBER = "string", "integer", "number"


@dataclass(frozen=True)
class Field:
    """One output column: the names it may come from, its kind and an optional default."""

    name: str
    kind: str
    aliases: tuple[str, ...] = ()
    default: object = None


@dataclass(frozen=True)
class Schema:
    version: str
    fields: tuple[Field, ...]
    sort_by: tuple[str, ...] = ()
    allow_empty: bool = False

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def check(self) -> "Schema":
        if not self.version:
            raise ContractError("an output schema needs a version")
        if not self.fields or len(set(self.columns)) != len(self.columns):
            raise ContractError(f"schema {self.version!r} has missing or duplicate columns")
        kinds = sorted({f.kind for f in self.fields} - {STRING, INTEGER, NUMBER})
        if kinds:
            raise ContractError(f"schema {self.version!r} has unknown kinds {kinds}")
        unknown = sorted(set(self.sort_by) - set(self.columns))
        if unknown:
            raise ContractError(f"schema {self.version!r} sorts by unknown columns {unknown}")
        return self


# Output columns in order, with the older names each may arrive under.
FORECAST_V1 = Schema(
    "forecast-v1",
    (
        Field("forecast_id", STRING, ("prediction_id",)),
        Field("horizon_days", INTEGER, ("horizon",)),
        Field("level", STRING, ("hierarchy_level",)),
        Field("channel", STRING, ("source_channel",)),
        Field("campaign_type", STRING, ("type",)),
        Field("campaign_id", STRING, ("source_campaign_id",), ALL),
        Field("campaign_name", STRING, ("source_campaign_name",), ALL),
        Field("planned_budget", NUMBER, ("planned_spend", "budget")),
        Field("predicted_revenue_p10", NUMBER, ("revenue_p10",)),
        Field("predicted_revenue_p50", NUMBER, ("revenue_p50", "predicted_revenue")),
        Field("predicted_revenue_p90", NUMBER, ("revenue_p90",)),
        Field("predicted_spend_p10", NUMBER, ("spend_p10",)),
        Field("predicted_spend_p50", NUMBER, ("spend_p50", "predicted_spend")),
        Field("predicted_spend_p90", NUMBER, ("spend_p90",)),
        Field("predicted_roas_p10", NUMBER, ("roas_p10",)),
        Field("predicted_roas_p50", NUMBER, ("roas_p50", "predicted_roas")),
        Field("predicted_roas_p90", NUMBER, ("roas_p90",)),
        Field("probability_roas_above_target", NUMBER, ("roas_target_probability",)),
        Field("risk_score", NUMBER, ("forecast_risk_score",)),
        Field("quality_flags", STRING, ("flags",), "none"),
        Field("model_version", STRING, ("artifact_version",)),
    ),
    ("horizon_days", "level", "channel", "campaign_type", "campaign_id"),
)
REGISTRY = {FORECAST_V1.version: FORECAST_V1}


def get_schema(version: str | None = None, registry: dict[str, Schema] = REGISTRY) -> Schema:
    wanted = version or FORECAST_V1.version
    if wanted not in registry:
        raise ContractError(f"unsupported output schema {wanted!r}; known: {sorted(registry)}")
    return registry[wanted].check()


def _source(df: DataFrame, field: Field) -> Column:
    name = next((n for n in (field.name, *field.aliases) if n in df.columns), None)
    if name is None:
        if field.default is None:
            raise ContractError(f"no column for {field.name!r}; expected one of {[field.name, *field.aliases]}")
        return F.lit(field.default)
    c = F.col(name)
    if field.default is None:
        return c
    if field.kind == STRING:
        return F.when(c.isNull() | (strip(c.cast("string")) == ""), F.lit(field.default)).otherwise(c)
    return F.coalesce(c, F.lit(field.default))


def adapt(df: DataFrame, version: str | None = None, registry: dict[str, Schema] = REGISTRY) -> DataFrame:
    """Columns of the schema in order and type; anything that does not convert becomes null."""
    schema = get_schema(version, registry)
    kinds = dict(df.dtypes)

    def typed(field: Field) -> Column:
        c = _source(df, field)
        if field.kind == STRING:
            return c.cast("string")
        name = next((n for n in (field.name, *field.aliases) if n in df.columns), None)
        return number(c) if name and kinds[name] == "string" else c.cast("double")

    return df.select(*[typed(f).alias(f.name) for f in schema.fields])


def output_violations(adapted: DataFrame, version: str | None = None, registry: dict[str, Schema] = REGISTRY) -> DataFrame:
    """One row per column and broken rule; a single pass over the data."""
    schema = get_schema(version, registry)
    checks: list[tuple[str, str, Column]] = []
    for f in schema.fields:
        c = F.col(f.name)
        checks.append(("null", f.name, F.count_if(c.isNull() | (F.isnan(c) if f.kind != STRING else F.lit(False)))))
        if f.kind != STRING:
            checks.append(("non_finite", f.name, F.count_if(c.isNotNull() & ~F.isnan(c) & ~is_finite(c))))
        if f.kind == INTEGER:
            checks.append(("fractional", f.name, F.count_if(is_finite(c) & (c != F.floor(c)))))
    if not schema.allow_empty:
        checks.append(("empty", "*", (F.count("*") == 0).cast("bigint")))
    counted = adapted.agg(*[c.alias(f"c{i}") for i, (_, _, c) in enumerate(checks)])
    rows = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("column_name"), F.col(f"c{i}").cast("bigint").alias("rows"))
            for i, (rule, name, _) in enumerate(checks)
        ]
    )
    return counted.select(F.inline(rows)).where("rows > 0")


def validated(df: DataFrame, version: str | None = None, registry: dict[str, Schema] = REGISTRY) -> DataFrame:
    """Adapted rows in output types; raises before anything is written."""
    schema = get_schema(version, registry)
    adapted = adapt(df, version, registry)
    broken = output_violations(adapted, version, registry).orderBy("column_name", "rule").limit(5).collect()
    if broken:
        raise ContractError("; ".join(f"{r.column_name}: {r.rule} in {r.rows} rows" for r in broken))
    return adapted.withColumns({f.name: F.col(f.name).cast("bigint") for f in schema.fields if f.kind == INTEGER})


def ordered(df: DataFrame, schema: Schema) -> DataFrame:
    """Schema order, then the name, so that equal keys always come out alike."""
    tie = ["campaign_name"] if "campaign_name" in schema.columns else []
    return df.orderBy(*schema.sort_by, *tie)


def as_text(df: DataFrame, schema: Schema) -> DataFrame:
    """Numbers with six decimals, everything else as it is."""
    return df.select(
        *[(F.format_string("%.6f", f.name) if f.kind == NUMBER else F.col(f.name)).alias(f.name) for f in schema.fields]
    )


def write_predictions(
    df: DataFrame, target: str, version: str | None = None, registry: dict[str, Schema] = REGISTRY, as_folder: bool = False
) -> DataFrame:
    """Adapt, check and publish a sorted CSV; a failure leaves an older one as it was.

    One file, written by one task and put in place in one step. ``as_folder`` writes sorted part files instead, each with
    the header, for results that no single task should write; the caller decides, the size does not.
    """
    schema = get_schema(version, registry)
    rows = validated(df, version, registry)
    text = as_text(ordered(rows, schema), schema)
    if as_folder:
        replace_csv_folder(text, target)
    else:
        write_single_csv(text, target)
    return rows


def write_prediction_table(df: DataFrame, target: str, version: str | None = None, registry: dict[str, Schema] = REGISTRY) -> DataFrame:
    """The same rows as parquet, for results too large for one file."""
    rows = validated(df, version, registry)
    replace_folder(rows, target)
    return rows


def check_header(spark: SparkSession, path: str, version: str | None = None) -> list[str]:
    """Columns of a written file, which have to be the schema's in the schema's order."""
    columns = header(spark, path)
    if columns != get_schema(version).columns:
        raise ContractError(f"{path} has columns {columns}")
    return columns


