"""Many ridge regressions from one set of sufficient statistics.

Rows are reduced once to sums of products per (channel, campaign type, target end, known-on day).
A fit is a range of those days, so every fit of every origin re-adds the small statistics instead of
scanning rows, and fits that differ in their bound only read running sums. A fit's system, of at most a few hundred unknowns,
is assembled and solved in column expressions over arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacast.contracts import RIDGE_ALPHA
from mediacast.operators.leaves import predicted_log
from mediacast.operators.training import (
    ALIGNED,
    FEATURES,
    MIN_ROWS,
    MIN_SELECTION,
    REALIZED,
    SHARED,
    expert_ready,
    selection_ready,
)
from mediacast.operators.quantiles import deciles, order_statistics

FIT = ["horizon_days", "mode", "origin", "role", "bound"]
# typical magnitudes; sums of squares around them keep small variances exact
CENTRES = dict(zip(FEATURES, (9.0, 4.0, 4.0, 9.0, 10.0, 28.0, 1.0, 0.0, 0.0)))
PAIRS = list(combinations_with_replacement(FEATURES, 2))
FINAL, CALIBRATION, SELECTION, OUT_OF_FOLD = "final", "calibration", "selection", "out_of_fold"
BLEND_WEIGHTS = (0.0, 0.25, 0.50, 0.75, 1.0)


def _sum_names() -> list[str]:
    return (
        ["n", "y"]
        + [f"s_{f}" for f in FEATURES]
        + [f"y_{f}" for f in FEATURES]
        + [f"q_{a}_{b}" for a, b in PAIRS]
    )


def gram_cells(rows: DataFrame) -> DataFrame:
    """Sums of products of the centred features and the label; one map-side combined aggregation."""
    z = {f: F.col(f) - CENTRES[f] for f in FEATURES}
    y = F.col("target_log_revenue")
    return rows.groupBy("horizon_days", "mode", "channel", "campaign_type", "target_end", "known_on").agg(
        F.count("*").cast("double").alias("n"),
        F.sum(y).alias("y"),
        *[F.sum(z[f]).alias(f"s_{f}") for f in FEATURES],
        *[F.sum(z[f] * y).alias(f"y_{f}") for f in FEATURES],
        *[F.sum(z[a] * z[b]).alias(f"q_{a}_{b}") for a, b in PAIRS],
    )


def expert_fits(splits: DataFrame) -> DataFrame:
    """The fits each expert needs: before calibration, before selection, and on everything known."""
    none = F.lit(None).cast("date")
    wanted = F.array_compact(
        F.array(
            F.when(expert_ready(), F.struct(F.lit(FINAL).alias("role"), none.alias("bound"))),
            F.when(expert_ready(), F.struct(F.lit(CALIBRATION).alias("role"), F.col("calibration_start").alias("bound"))),
            F.when(
                expert_ready() & selection_ready(),
                F.struct(F.lit(SELECTION).alias("role"), F.col("selection_start").alias("bound")),
            ),
        )
    )
    return splits.select("horizon_days", "mode", "origin", F.inline(wanted))


def out_of_fold_fits(counts: DataFrame, slices: DataFrame) -> DataFrame:
    """One fit per slice and shared cut-off, on rows whose target ended before it, if there are enough."""
    shared = (
        counts.where(F.col("mode") == SHARED)
        .join(F.broadcast(slices.select("horizon_days", "origin")), "horizon_days")
        .where(F.col("known_on") <= F.col("origin"))
    )
    per_cutoff = shared.groupBy("horizon_days", "mode", "origin", "cutoff").agg(F.sum("count").alias("count"))
    # cut-offs of a slice against earlier ones of the same slice: calendar-sized on both sides
    earlier = per_cutoff.select("horizon_days", "origin", F.col("cutoff").alias("other"), F.col("count").alias("rows"))
    return (
        per_cutoff.join(earlier, ["horizon_days", "origin"])
        .where(F.date_add("other", F.col("horizon_days")) < F.col("cutoff"))
        .groupBy("horizon_days", "mode", "origin", F.col("cutoff").alias("bound"))
        .agg(F.sum("rows").alias("rows"))
        .where(F.col("rows") >= MIN_ROWS)
        .select("horizon_days", "mode", "origin", F.lit(OUT_OF_FOLD).alias("role"), "bound")
    )


def fit_statistics(cells: DataFrame, fits: DataFrame) -> DataFrame:
    """Sufficient statistics of each fit per channel and campaign type."""
    # fits: origins times roles (times shared cut-offs), a calendar-sized table
    return (
        cells.join(F.broadcast(fits), ["horizon_days", "mode"])
        .where(
            (F.col("known_on") <= F.col("origin")) & (F.col("bound").isNull() | (F.col("target_end") < F.col("bound")))
        )
        .groupBy(*FIT, "channel", "campaign_type")
        .agg(*[F.sum(c).alias(c) for c in _sum_names()])
    )


def _added(cells: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda total, c: total + value(c))


def _added_vectors(cells: Column, name: str) -> Column:
    zeros = F.array(*[F.lit(0.0)] * len(FEATURES))
    return F.aggregate(cells, zeros, lambda total, c: F.zip_with(total, c[name], lambda x, y: x + y))


def _places() -> Column:
    return F.sequence(F.lit(0), F.lit(len(FEATURES) - 1))


def eliminated(rows: Column, size: Column) -> Column:
    """Gauss-Jordan elimination of a positive definite system whose rows end with the right side; such systems need no pivoting."""

    def step(matrix: Column, k: Column) -> Column:
        pivot = F.transform(F.get(matrix, k), lambda x: x / F.get(F.get(matrix, k), k))
        return F.transform(matrix, lambda row, i: F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda x, p: x - F.get(row, k) * p)))

    return F.aggregate(F.sequence(F.lit(0), size - 1), rows, step)


def normal_equations(statistics: DataFrame) -> DataFrame:
    """The penalised system of every fit: its ``matrix``, rows with the right side last, and what maps the solution back.

    Unknowns are the intercept, the standardised features, the channels and the campaign types by name. A group is one row
    per channel and campaign type seen.
    """
    at = {pair: i for i, pair in enumerate(PAIRS)}
    places = [[at[a, b] if (a, b) in at else at[b, a] for b in FEATURES] for a in FEATURES]
    cell = F.struct(
        "channel", "campaign_type", "n", "y",
        F.array(*[F.col(f"s_{f}") for f in FEATURES]).alias("s"), F.array(*[F.col(f"y_{f}") for f in FEATURES]).alias("sy"),
    )
    grouped = statistics.groupBy(*FIT).agg(
        F.collect_list(cell).alias("cells"), F.array(*[F.sum(f"q_{a}_{b}") for a, b in PAIRS]).alias("q")
    )
    sums = grouped.select(
        *FIT, "cells",
        F.array(*[F.array(*[F.get("q", F.lit(j)) for j in row]) for row in places]).alias("q"),
        _added(F.col("cells"), lambda c: c["n"]).alias("total"), _added(F.col("cells"), lambda c: c["y"]).alias("label"),
        _added_vectors(F.col("cells"), "s").alias("s"), _added_vectors(F.col("cells"), "sy").alias("sy"),
    ).withColumn("mean", F.transform("s", lambda x: x / F.col("total")))

    def scale(mean: Column, i: Column) -> Column:
        square = F.get(F.get("q", i), i) / F.col("total")
        variance = square - mean * mean
        root = F.sqrt(F.when(variance < 1e-13 * F.greatest(square, F.lit(1e-3)), 0.0).otherwise(variance))
        return F.when(root < 1e-8, 1.0).otherwise(root)

    scaled = sums.withColumn("scale", F.transform("mean", scale))

    def standard(sum_: Column, weight: Column, i: Column) -> Column:
        return (sum_ - weight * F.get("mean", i)) / F.get("scale", i)

    def labels(name: str) -> Column:
        values = F.array_sort(F.array_distinct(F.transform("cells", lambda c: c[name])))
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("name")))

    def members(x: Column) -> Column:
        own = F.filter("cells", lambda c: F.when(x["kind"] == "channel", c["channel"]).otherwise(c["campaign_type"]) == x["name"])
        return F.struct(x["kind"].alias("kind"), x["name"].alias("name"), own.alias("own"))

    def block(x: Column) -> Column:
        n = _added(x["own"], lambda c: c["n"])
        u = F.transform(_added_vectors(x["own"], "s"), lambda v, i: standard(v, n, i))
        return F.struct(x["kind"].alias("kind"), x["name"].alias("name"), x["own"].alias("own"), n.alias("n"), _added(x["own"], lambda c: c["y"]).alias("y"), u.alias("u"))

    blocks = (
        scaled.withColumn("labels", F.transform(F.concat(labels("channel"), labels("campaign_type")), members))
        .withColumn("labels", F.transform("labels", block))
        .withColumn("u", F.transform("s", lambda v, i: standard(v, F.col("total"), i)))
        .withColumn("uy", F.transform("sy", lambda v, i: standard(v, F.col("label"), i)))
    )

    def penalty(same: Column) -> Column:
        return F.when(same, float(RIDGE_ALPHA)).otherwise(0.0)

    def squares(i: Column) -> Column:
        def entry(j: Column) -> Column:
            product = F.get(F.get("q", i), j) - F.col("total") * F.get("mean", i) * F.get("mean", j)
            return product / (F.get("scale", i) * F.get("scale", j)) + penalty(i == j)

        return F.transform(_places(), entry)

    def together(a: Column, b: Column) -> Column:
        shared = F.filter(a["own"], lambda c: F.when(b["kind"] == "channel", c["channel"]).otherwise(c["campaign_type"]) == b["name"])
        return F.when(a["kind"] != b["kind"], _added(shared, lambda c: c["n"])).when(a["name"] == b["name"], a["n"] + RIDGE_ALPHA).otherwise(0.0)

    first = F.concat(F.array("total"), F.col("u"), F.transform("labels", lambda x: x["n"]), F.array("label"))
    features = F.transform(
        _places(), lambda i: F.concat(F.array(F.get("u", i)), squares(i), F.transform("labels", lambda x: F.get(x["u"], i)), F.array(F.get("uy", i)))
    )
    named = F.transform("labels", lambda a: F.concat(F.array(a["n"]), a["u"], F.transform("labels", lambda b: together(a, b)), F.array(a["y"])))
    return blocks.withColumn("matrix", F.concat(F.array(first), features, named)).select(
        *FIT, F.round("total").cast("bigint").alias("sample_count"), "mean", "scale",
        F.transform("labels", lambda x: x["kind"]).alias("kinds"), F.transform("labels", lambda x: x["name"]).alias("names"), "matrix",
    )


def solve_fits(statistics: DataFrame) -> DataFrame:
    """One row of coefficients per fit, solved in column expressions."""
    count = len(FEATURES)
    solved = normal_equations(statistics).withColumn("matrix", eliminated(F.col("matrix"), F.size("matrix")))
    solved = solved.withColumn("solution", F.transform("matrix", lambda row: F.element_at(row, -1)))

    def named(kind: str) -> Column:
        values = F.slice("solution", F.lit(count + 2), F.size("names"))
        own = F.filter(F.arrays_zip("kinds", "names", values.alias("value")), lambda p: p["kinds"] == kind)
        return F.map_from_arrays(F.transform(own, lambda p: p["names"]), F.transform(own, lambda p: p["value"]))

    centres = F.array(*[F.lit(CENTRES[f]) for f in FEATURES])
    return solved.select(
        *FIT,
        "sample_count",
        F.struct(
            F.get("solution", F.lit(0)).alias("intercept"),
            F.zip_with("mean", centres, lambda m, c: m + c).alias("means"),
            F.col("scale").alias("scales"),
            F.slice("solution", 2, count).alias("coefficients"),
            named("channel").alias("channels"),
            named("campaign_type").alias("types"),
        ).alias("fit"),
    )


def expanding_statistics(cells: DataFrame, fits: DataFrame) -> DataFrame:
    """Sufficient statistics of fits that differ in their bound only: running sums over target ends, read at every bound.

    A running sum belongs to one slice, channel and campaign type and has at most one row per day and bound. Bounds are rows
    without statistics that come before the target end of the same day.
    """
    keys = ["horizon_days", "mode", "origin"]
    # slices times shared cut-offs, a calendar-sized table
    slices = fits.select(*keys).distinct()
    inside = (
        cells.join(F.broadcast(slices), ["horizon_days", "mode"])
        .where(F.col("known_on") <= F.col("origin"))
        .groupBy(*keys, "channel", "campaign_type", F.col("target_end").alias("day"))
        .agg(*[F.sum(c).alias(c) for c in _sum_names()])
    )
    labels = inside.select(*keys, "channel", "campaign_type").distinct()
    marks = labels.join(fits.select(*keys, "role", "bound"), keys).withColumn("day", F.col("bound"))
    rows = marks.unionByName(inside, allowMissingColumns=True)
    before = Window.partitionBy(*keys, "channel", "campaign_type").orderBy("day", F.col("bound").isNull())
    sums = [F.sum(c).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c) for c in _sum_names()]
    return rows.select(*FIT, "channel", "campaign_type", *sums).where(F.col("bound").isNotNull() & (F.col("n") > 0))


def solve_out_of_fold(cells: DataFrame, fits: DataFrame) -> DataFrame:
    """All expanding fits of the shared cut-offs."""
    return solve_fits(expanding_statistics(cells, fits))


def _score(rows: DataFrame) -> DataFrame:
    predicted = predicted_log(F.col("fit"), [F.col(f) for f in FEATURES], F.col("channel"), F.col("campaign_type"))
    return rows.withColumn("predicted_log_revenue", predicted).withColumn(
        "residual_log_revenue", F.col("target_log_revenue") - F.col("predicted_log_revenue")
    )


def held_out_residuals(rows: DataFrame, splits: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Residuals on the calibration window of a fit that saw nothing from it."""
    fits = (
        coefficients.where(F.col("role") == CALIBRATION)
        .select("horizon_days", "mode", "origin", "fit")
        .join(splits.select("horizon_days", "mode", "origin", "calibration_start"), ["horizon_days", "mode", "origin"])
    )
    return _score(
        rows.join(F.broadcast(fits), ["horizon_days", "mode"]).where(
            (F.col("known_on") <= F.col("origin")) & (F.col("cutoff") >= F.col("calibration_start"))
        )
    )


def residual_profiles(residuals: DataFrame) -> DataFrame:
    """Residual deciles per expert and the widening of sparse and of extrapolated rows."""
    keys = ["horizon_days", "mode", "origin"]
    conditions = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("recent_active_days") < 28, "sparse"),
            F.when(F.col("support_ratio") > 1.5, "extrapolated"),
        )
    )
    grouped = residuals.select(*keys, F.explode(conditions).alias("condition"), "residual_log_revenue")
    stats = order_statistics(grouped, [*keys, "condition"], "residual_log_revenue", deciles())
    span = F.col("p90") - F.col("p10")

    def at(condition: str, c) -> object:
        return F.max(F.when(F.col("condition") == condition, c))

    wide = stats.groupBy(*keys).agg(
        at("all", F.col("n")).alias("calibration_sample_count"),
        *[at("all", F.col(p)).alias(f"residual_{p}") for p in ("p10", "p50", "p90")],
        at("all", span).alias("span"),
        *[at(c, F.when(F.col("n") >= 12, span)).alias(f"{c}_span") for c in ("sparse", "extrapolated")],
    )

    def multiplier(condition: str) -> object:
        usable = (F.col("calibration_sample_count") >= 20) & (F.col("span") > 1e-8)
        ratio = F.col(f"{condition}_span") / F.when(usable, F.col("span"))
        return F.coalesce(
            F.when(ratio.isNotNull(), F.round(F.least(F.lit(2.50), F.greatest(F.lit(1.15), ratio)), 6)), F.lit(1.0)
        )

    return wide.select(
        *keys,
        "calibration_sample_count",
        "residual_p10",
        "residual_p50",
        "residual_p90",
        multiplier("sparse").alias("sparse_multiplier"),
        multiplier("extrapolated").alias("extrapolation_multiplier"),
    )


def blend_weights(rows: DataFrame, splits: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Scenario weight per slice with the lowest WAPE on validation rows both experts share."""
    keys = ["horizon_days", "origin"]
    fits = (
        coefficients.where(F.col("role") == SELECTION)
        .select("horizon_days", "mode", "origin", "fit")
        .join(
            splits.select("horizon_days", "mode", "origin", "calibration_start", "selection_start"),
            ["horizon_days", "mode", "origin"],
        )
    )
    scored = _score(
        rows.join(F.broadcast(fits), ["horizon_days", "mode"]).where(
            (F.col("known_on") <= F.col("origin"))
            & (F.col("target_end") < F.col("calibration_start"))
            & (F.col("cutoff") >= F.col("selection_start"))
        )
    )
    revenue = F.greatest(F.lit(0.0), F.expm1("predicted_log_revenue"))
    # both experts' rows of a campaign and cut-off meet in one group, so no join of the two sets
    pairs = (
        scored.groupBy(*keys, "campaign_key", "cutoff")
        .agg(
            F.max(F.when(F.col("mode") == REALIZED, revenue)).alias("scenario"),
            F.max(F.when(F.col("mode") == ALIGNED, revenue)).alias("aligned"),
            F.max(F.when(F.col("mode") == REALIZED, F.greatest(F.lit(0.0), F.expm1("target_log_revenue")))).alias("actual"),
        )
        .where(F.col("scenario").isNotNull() & F.col("aligned").isNotNull())
    )
    weights = F.array(*[F.lit(w) for w in BLEND_WEIGHTS])
    scores = (
        pairs.select(*keys, "scenario", "aligned", "actual", F.explode(weights).alias("weight"))
        .groupBy(*keys, "weight")
        .agg(
            F.sum(F.abs(F.col("actual") - (F.col("weight") * F.col("scenario") + (1.0 - F.col("weight")) * F.col("aligned")))).alias("error"),
            F.sum(F.abs("actual")).alias("actual"),
            F.count("*").alias("rows"),
        )
    )
    return scores.groupBy(*keys).agg(
        F.max("rows").alias("selection_sample_count"),
        F.when((F.max("rows") < MIN_SELECTION) | (F.max("actual") <= 1e-9), 1.0)
        .otherwise(F.min_by("weight", F.struct(F.col("error") / F.col("actual"), F.col("weight"))))
        .alias("scenario_weight"),
    )


def experts(coefficients: DataFrame, profiles: DataFrame, weights: DataFrame) -> DataFrame:
    """Per slice the serving experts: a blend, one expert, or no row when neither could be fitted."""
    keys = ["horizon_days", "origin"]
    ready = coefficients.where(F.col("role") == FINAL).join(profiles, ["horizon_days", "mode", "origin"])
    expert = F.struct(
        "fit.*",
        "residual_p10",
        "residual_p50",
        "residual_p90",
        "sparse_multiplier",
        "extrapolation_multiplier",
        "sample_count",
        "calibration_sample_count",
    )
    both = ready.groupBy(*keys).agg(
        F.max_by(expert, F.when(F.col("mode") == REALIZED, 1)).alias("scenario"),
        F.max_by(expert, F.when(F.col("mode") == ALIGNED, 1)).alias("aligned"),
    )
    weighed = both.join(weights, keys, "left").withColumn("scenario_weight", F.coalesce("scenario_weight", F.lit(1.0)))
    w, scenario, aligned = F.col("scenario_weight"), F.col("scenario"), F.col("aligned")
    pair = scenario.isNotNull() & aligned.isNotNull()
    return weighed.select(
        *keys,
        F.when(pair, w).when(scenario.isNotNull(), 1.0).otherwise(0.0).alias("scenario_weight"),
        F.when(~pair | (w > 0), scenario).alias("scenario_expert"),
        F.when(~pair | (w < 1), aligned).alias("aligned_expert"),
        F.coalesce("selection_sample_count", F.lit(0)).alias("selection_sample_count"),
    )


def out_of_fold_residuals(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Residuals at each shared cut-off of the model fitted strictly before it."""
    fits = coefficients.where(F.col("role") == OUT_OF_FOLD).select(
        "horizon_days", "origin", F.col("bound").alias("cutoff"), "fit"
    )
    scored = _score(
        rows.where(F.col("mode") == SHARED)
        .join(F.broadcast(fits), ["horizon_days", "cutoff"])
        .where(F.col("known_on") <= F.col("origin"))
    )
    return scored.select(
        "horizon_days", "origin", "cutoff", "campaign_key", "channel", "campaign_type",
        "target_log_revenue", "predicted_log_revenue", "residual_log_revenue",
    )
