"""Reading and checking platform exports and the optional metadata files.

Every cell is read as text. A folder ``x.csv`` of part files counts as one file, so an export may be
as large as it needs to be. Checks are single aggregations; only a handful of offenders reach the
driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacast.contracts import (
    EXPORTS,
    HORIZONS,
    OPTIONAL_FILES,
    PLAN_COLUMNS,
    PLAN_FILE,
    REVIEW_STATUS,
    REVIEW_STATUSES,
    SEMANTICS_COLUMNS,
    SEMANTICS_FILE,
    TAXONOMY_COLUMNS,
    TAXONOMY_FILE,
    TAXONOMY_SOURCES,
    ContractError,
)
from mediacast.functions.columns import day, number, present_text, strip
from mediacast.sources.files import current_version, new_version, put_in_place


@dataclass
class Upload:
    """Checked raw exports and whatever metadata came with them."""

    exports: dict[str, DataFrame]
    taxonomy: DataFrame | None = None
    semantics: DataFrame | None = None
    media_plan: DataFrame | None = None
    files: dict[str, str] = field(default_factory=dict)


def csv_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and paths of the CSV files directly under ``folder``; contents are not read."""
    folder = folder.rstrip("/")
    name = F.substring_index(F.substring_index("path", f"{folder}/", -1), "/", 1)
    try:
        found = spark.read.format("binaryFile").load(f"{folder}/*.csv").select("path")
        rows = found.select(name.alias("name")).distinct().collect()
    except Exception as problem:  # Spark reports an empty or missing folder as a path error
        raise ContractError(f"no CSV files in {folder}") from problem
    return {r.name: f"{folder}/{r.name}" for r in sorted(rows)}


def read_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file or a folder of part files with every column as text, under the names of its header.

    Quoted cells may hold line breaks, so a file is read by one task; large exports come as part files. A part whose
    header names other columns or another order is refused.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, escape='"', enforceSchema=False, multiLine=True)


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, escape='"', multiLine=True).columns


def match_source(name: str, columns: list[str]) -> str | None:
    """The platform whose identity columns are all present; the full column set is then required."""
    present = set(columns)
    matches = [source for source, contract in EXPORTS.items() if set(contract.identity) <= present]
    if len(matches) > 1:
        raise ContractError(f"{name} matches several platforms: {matches}")
    if not matches:
        return None
    missing = sorted(EXPORTS[matches[0]].required - present)
    if missing:
        raise ContractError(f"{name} is a {matches[0]} export without {missing}")
    return matches[0]


def discover_exports(spark: SparkSession, folder: str) -> dict[str, tuple[str, list[str]]]:
    """Path and header of the one export of each platform."""
    found: dict[str, tuple[str, list[str]]] = {}
    for name, path in csv_files(spark, folder).items():
        if name in OPTIONAL_FILES:
            continue
        columns = header(spark, path)
        source = match_source(name, columns)
        if source is None:
            continue
        if source in found:
            raise ContractError(f"several files hold {source} exports; keep one")
        found[source] = (path, columns)
    missing = sorted(set(EXPORTS) - set(found))
    if missing:
        raise ContractError(f"no export found for {', '.join(missing)}")
    return found


def _require_text(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Strip text columns and stop on a blank one: one pass for all of them."""
    cleaned = df.withColumns({c: strip(present_text(F.col(c))) for c in columns})
    blanks = cleaned.agg(*[F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias(c) for c in columns]).first()
    bad = [c for c in columns if blanks[c]]
    if bad:
        raise ContractError(f"{label} has blank values in {', '.join(bad)}")
    return cleaned


def read_export(spark: SparkSession, path: str, columns: list[str], source: str) -> DataFrame:
    return _require_text(read_text(spark, path, columns), [EXPORTS[source].id_column], f"{source} export")


def _few(df: DataFrame, column: Column, order: bool = True) -> list[str]:
    values = df.select(column.cast("string").alias("v")).distinct()
    values = values.orderBy("v") if order else values
    return [r.v for r in values.limit(5).collect()]


def _require_columns(columns: list[str], needed: list[str], label: str) -> None:
    missing = sorted(set(needed) - set(columns))
    if missing:
        raise ContractError(f"{label} is missing required columns: {missing}")


def _require_sources(df: DataFrame, label: str) -> None:
    unknown = _few(df.where(~F.col("source_system").isin(list(EXPORTS))), F.col("source_system"))
    if unknown:
        raise ContractError(f"{label} has unknown source_system values: {unknown}")


def _require_unique(df: DataFrame, keys: list[str], label: str) -> None:
    copies = df.groupBy(*keys).count().where("count > 1").agg(F.sum("count").alias("rows")).first().rows
    if copies:
        raise ContractError(f"{label} has {copies} rows with duplicate {', '.join(keys)}")


def checked_review_status(df: DataFrame, label: str) -> DataFrame:
    """Lower-case review marker from a closed vocabulary; the column itself is optional."""
    if REVIEW_STATUS not in df.columns:
        return df
    df = _require_text(df, [REVIEW_STATUS], label).withColumn(REVIEW_STATUS, F.lower(REVIEW_STATUS))
    wrong = _few(df.where(~F.col(REVIEW_STATUS).isin(REVIEW_STATUSES)), F.col(REVIEW_STATUS))
    if wrong:
        raise ContractError(f"{label} {REVIEW_STATUS} must be one of {REVIEW_STATUSES}; got {wrong}")
    return df


def export_campaigns(exports: dict[str, DataFrame]) -> DataFrame:
    """Distinct campaign ids of the upload."""
    parts = [
        df.select(F.lit(source).alias("source_system"), F.col(EXPORTS[source].id_column).alias("source_campaign_id"))
        for source, df in exports.items()
    ]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.distinct()


def unknown_campaigns(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known, ["source_system", "source_campaign_id"], "left_anti").select("source_system", "source_campaign_id")


def _require_known(rows: DataFrame, exports: dict[str, DataFrame], label: str) -> None:
    offenders = unknown_campaigns(rows, export_campaigns(exports))
    first = _few(offenders, F.concat_ws(":", "source_system", "source_campaign_id"), order=False)
    if first:
        raise ContractError(f"{label} names campaigns that are not in this upload: {first}")


def check_taxonomy(df: DataFrame, exports: dict[str, DataFrame]) -> DataFrame:
    _require_columns(df.columns, TAXONOMY_COLUMNS, TAXONOMY_FILE)
    df = checked_review_status(_require_text(df, TAXONOMY_COLUMNS, TAXONOMY_FILE), TAXONOMY_FILE)
    _require_sources(df, TAXONOMY_FILE)
    other = _few(df.where(~F.col("source_system").isin(TAXONOMY_SOURCES)), F.col("source_system"))
    if other:
        raise ContractError(f"{TAXONOMY_FILE} may only map {TAXONOMY_SOURCES}; got {other}")
    _require_unique(df, ["source_system", "source_campaign_id"], TAXONOMY_FILE)
    _require_known(df, exports, TAXONOMY_FILE)
    return df


def check_semantics(df: DataFrame, exports: dict[str, DataFrame]) -> DataFrame:
    """Exactly one row per platform, one currency, one time zone, the canonical revenue fields."""
    label = SEMANTICS_FILE
    _require_columns(df.columns, SEMANTICS_COLUMNS, label)
    df = checked_review_status(_require_text(df, SEMANTICS_COLUMNS, label), label)
    df = df.withColumn("currency", F.upper("currency"))
    _require_unique(df, ["source_system"], label)
    counts = df.agg(
        F.count_distinct("currency").alias("currencies"), F.count_distinct("timezone").alias("timezones")
    ).first()
    rows = df.select("source_system", "revenue_field").limit(len(EXPORTS) + 1).collect()
    if {r.source_system for r in rows} != set(EXPORTS):
        raise ContractError(f"{label} must declare exactly {sorted(EXPORTS)}")
    if counts.currencies != 1:
        raise ContractError(f"{label} contains multiple currencies; normalize before forecasting")
    if counts.timezones != 1:
        raise ContractError(f"{label} contains multiple timezones; align days before forecasting")
    absent = sorted(f"{r.source_system}:{r.revenue_field}" for r in rows if r.revenue_field not in exports[r.source_system].columns)
    if absent:
        raise ContractError(f"{label} revenue_field values are not in their exports: {absent}")
    wrong = sorted(f"{r.source_system}:{r.revenue_field}" for r in rows if r.revenue_field != EXPORTS[r.source_system].revenue_column)
    if wrong:
        raise ContractError(f"{label} revenue_field values must match the canonical mapping: {wrong}")
    return df


def plan_violations(df: DataFrame) -> DataFrame:
    """One row per broken rule of a media plan, in the order they are reported, with its row count."""
    horizon, budget = number(F.col("horizon_days")), number(F.col("planned_budget"))
    infinite = F.lit(float("inf"))
    finite = F.abs(horizon) < infinite
    rules = [
        ("non_numeric_horizon_days", horizon.isNull()),
        ("non_finite_horizon_days", horizon.isNotNull() & ~finite),
        ("fractional_horizon_days", finite & (horizon != F.floor(horizon))),
        ("unsupported_horizon_days", finite & (horizon == F.floor(horizon)) & ~horizon.isin([float(h) for h in HORIZONS])),
        ("non_numeric_planned_budget", budget.isNull()),
        ("negative_planned_budget", budget < 0),
        ("non_finite_planned_budget", F.abs(budget) == infinite),
    ]
    counted = df.agg(*[F.count_if(condition).alias(name) for name, condition in rules])
    return counted.select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("rule"), F.col(n).alias("rows")) for i, (n, _) in enumerate(rules)]))
    ).where("rows > 0")


def check_media_plan(df: DataFrame, exports: dict[str, DataFrame]) -> DataFrame:
    """Typed plan rows; an empty file is a valid plan without overrides."""
    label = PLAN_FILE
    _require_columns(df.columns, PLAN_COLUMNS, label)
    df = _require_text(df, ["source_system", "source_campaign_id"], label)
    _require_sources(df, label)
    broken = plan_violations(df.withColumns({c: present_text(F.col(c)) for c in ("horizon_days", "planned_budget")})).orderBy("position").limit(1).collect()
    if broken:
        raise ContractError(f"{label}: {broken[0].rule} in {broken[0].rows} rows")
    typed = df.select(
        "source_system",
        "source_campaign_id",
        number(F.col("horizon_days")).cast("int").alias("horizon_days"),
        number(F.col("planned_budget")).alias("planned_budget"),
    )
    _require_unique(typed, ["source_system", "source_campaign_id", "horizon_days"], label)
    _require_known(typed, exports, label)
    return typed


def budget_overrides(media_plan: DataFrame, scenario_id: str = "baseline") -> DataFrame:
    """Plan rows as scenario overrides under their qualified campaign key."""
    return media_plan.select(
        F.lit(scenario_id).alias("scenario_id"),
        "horizon_days",
        F.concat_ws(":", "source_system", "source_campaign_id").alias("override_key"),
        "planned_budget",
    )


def read_upload(spark: SparkSession, folder: str) -> Upload:
    """Find, read and check everything in an upload folder."""
    found = discover_exports(spark, folder)
    upload = Upload({s: read_export(spark, path, columns, s) for s, (path, columns) in found.items()})
    upload.files = {s: path for s, (path, _) in found.items()}
    names = csv_files(spark, folder)

    def optional(name: str) -> DataFrame | None:
        return read_text(spark, names[name], header(spark, names[name])) if name in names else None

    taxonomy, semantics, plan = optional(TAXONOMY_FILE), optional(SEMANTICS_FILE), optional(PLAN_FILE)
    if taxonomy is not None:
        upload.taxonomy = check_taxonomy(taxonomy, upload.exports)
    if semantics is not None:
        upload.semantics = check_semantics(semantics, upload.exports)
    if plan is not None:
        upload.media_plan = check_media_plan(plan, upload.exports)
    return upload


def write_recent_windows(spark: SparkSession, folder: str, target: str, days: int = 90) -> str:
    """Publish the last ``days`` days of every export in ``folder``, each in date order, and return the folder to read them from.

    An export becomes a folder of sorted part files with its old name and header; all of them appear in one step.
    """
    version = new_version(target)
    for source, (path, columns) in discover_exports(spark, folder).items():
        window = recent_window(read_export(spark, path, columns, source), EXPORTS[source].date_column, days)
        window.write.csv(f"{version}/{path.rsplit('/', 1)[1]}", header=True, escape='"', lineSep="\n", emptyValue="", nullValue="")
    put_in_place(spark, target, version)
    return current_version(spark, target)


def recent_window(export: DataFrame, date_column: str, days: int = 90) -> DataFrame:
    """The last ``days`` days of an export in date order."""
    kind = dict(export.dtypes)[date_column]
    dated = day(F.col(date_column)) if kind == "string" else F.col(date_column).cast("date")
    last = export.agg(F.max(dated).alias("last_day"))
    # one row by construction
    return (
        export.join(F.broadcast(last))
        .where(dated >= F.date_sub("last_day", days - 1))
        .drop("last_day")
        .orderBy(dated)
    )
