"""Ridge fits, splits, blends and dependence against direct NumPy computations on collected rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediacast.operators import quantiles
from mediacast.operators.calendar import staged_calendar
from mediacast.operators.dependence import factor_weights
from mediacast.operators.leaves import _blend, _expert_quantiles, _expert_width
from mediacast.operators.ridge import (
    CALIBRATION,
    FINAL,
    blend_weights,
    eliminated,
    expert_fits,
    fit_statistics,
    gram_cells,
    held_out_residuals,
    out_of_fold_fits,
    out_of_fold_residuals,
    residual_profiles,
    solve_fits,
    solve_out_of_fold,
)
from mediacast.operators.training import FEATURES, SHARED, cutoff_counts, purged_splits, training_rows
from mediacast.session import stage
from mediacast.sources.lineitem import campaign_days

HORIZON = 30


@pytest.fixture(scope="module")
def trained(spark):
    facts = stage(campaign_days(spark, "/root/testdata/sf0.01"), "facts")
    calendar = staged_calendar(facts, (HORIZON,))
    first, last = calendar.agg(F.min("date"), F.max("date")).first()
    rows = stage(training_rows(facts, calendar, first, (HORIZON,)), "rows")
    origins = [last, last - dt.timedelta(days=90)]
    slices = spark.createDataFrame([(HORIZON, o, o) for o in origins], "horizon_days int, origin date, as_of date")
    counts = stage(cutoff_counts(rows), "counts")
    splits = stage(purged_splits(counts, slices), "splits")
    cells = stage(gram_cells(rows), "cells")
    coefficients = stage(solve_fits(fit_statistics(cells, expert_fits(splits))), "coefficients")
    return dict(rows=rows, slices=slices, counts=counts, splits=splits, cells=cells, coefficients=coefficients, frame=rows.toPandas())


def design(frame, fit_on):
    x, base = frame[FEATURES].to_numpy(float), fit_on[FEATURES].to_numpy(float)
    scale = base.std(axis=0)
    scale[scale < 1e-8] = 1.0
    parts = [np.ones((len(frame), 1)), (x - base.mean(axis=0)) / scale]
    for c in ("channel", "campaign_type"):
        parts += [(frame[c] == v).to_numpy(float)[:, None] for v in sorted(fit_on[c].unique())]
    return np.hstack(parts)


def solve(frame):
    x = design(frame, frame)
    penalty = 4.0 * np.eye(x.shape[1])
    penalty[0, 0] = 0
    return np.linalg.solve(x.T @ x + penalty, x.T @ frame["target_log_revenue"].to_numpy())


def test_coefficients(trained):
    frame = trained["frame"]
    for fit in trained["coefficients"].where(F.col("role").isin(FINAL, CALIBRATION)).collect():
        rows = frame[(frame["mode"] == fit["mode"]) & (frame.known_on <= fit.origin)]
        if fit.bound is not None:
            rows = rows[rows.target_end < fit.bound]
        assert fit.sample_count == len(rows)
        expected = solve(rows)
        found = [fit.fit.intercept, *fit.fit.coefficients]
        found += [fit.fit.channels[c] for c in sorted(fit.fit.channels)] + [fit.fit.types[c] for c in sorted(fit.fit.types)]
        np.testing.assert_allclose(found, expected, rtol=1e-7, atol=1e-8)


def test_holdout_residuals_and_profiles(trained):
    frame = trained["frame"]
    residuals = held_out_residuals(trained["rows"], trained["splits"], trained["coefficients"])
    profiles = {(r["mode"], r.origin): r for r in residual_profiles(residuals).collect()}
    for split in trained["splits"].collect():
        rows = frame[(frame["mode"] == split["mode"]) & (frame.known_on <= split.origin)]
        cuts = sorted(rows.cutoff.unique())
        assert split.calibration_start == cuts[-max(1, int(np.ceil(0.2 * len(cuts))))]
        fit_on = rows[rows.target_end < split.calibration_start]
        held = rows[rows.cutoff >= split.calibration_start]
        e = held["target_log_revenue"].to_numpy() - design(held, fit_on) @ solve(fit_on)
        r = profiles[(split["mode"], split.origin)]
        np.testing.assert_allclose([r.residual_p10, r.residual_p50, r.residual_p90], np.quantile(e, [0.1, 0.5, 0.9]), rtol=1e-6, atol=1e-8)
        sparse = e[(held.recent_active_days < 28).to_numpy()]
        if len(sparse) >= 12:
            ratio = np.subtract(*np.quantile(sparse, [0.9, 0.1])) / np.subtract(*np.quantile(e, [0.9, 0.1]))
            assert r.sparse_multiplier == pytest.approx(min(2.5, max(1.15, ratio)), abs=2e-6)


def test_blend_weight(trained):
    frame = trained["frame"]
    found = {r.origin: r for r in blend_weights(trained["rows"], trained["splits"], trained["coefficients"]).collect()}
    for origin in {s.origin for s in trained["splits"].collect()}:
        scored = {}
        for split in trained["splits"].where(F.col("origin") == F.lit(origin)).collect():
            rows = frame[(frame["mode"] == split["mode"]) & (frame.known_on <= origin) & (frame.target_end < split.calibration_start)]
            fit_on = rows[rows.target_end < split.selection_start]
            held = rows[rows.cutoff >= split.selection_start]
            scored[split["mode"]] = pd.Series(
                np.maximum(0, np.expm1(design(held, fit_on) @ solve(fit_on))), index=[held.campaign_key, held.cutoff]
            )
            actual = pd.Series(np.expm1(held.target_log_revenue.to_numpy()), index=[held.campaign_key, held.cutoff])
        both = pd.DataFrame({"s": scored["realized_future"], "a": scored["inference_aligned"], "y": actual}).dropna()
        errors = {w: np.abs(both.y - (w * both.s + (1 - w) * both.a)).sum() for w in (0.0, 0.25, 0.5, 0.75, 1.0)}
        assert found[origin].selection_sample_count == len(both)
        assert found[origin].scenario_weight == min(errors, key=lambda w: (errors[w], w))


def test_out_of_fold_path_never_sees_the_future(trained):
    frame = trained["frame"]
    fits = out_of_fold_fits(trained["counts"], trained["slices"])
    found = out_of_fold_residuals(trained["rows"], solve_out_of_fold(trained["cells"], fits)).toPandas()
    shared = frame[frame["mode"] == SHARED]
    for origin in found.origin.unique():
        mine = found[found.origin == origin]
        known = shared[shared.known_on <= origin]
        usable = [c for c in sorted(known.cutoff.unique()) if (known.target_end < c).sum() >= 80]
        assert sorted(mine.cutoff.unique()) == usable
        for cutoff in (usable[0], usable[len(usable) // 2], usable[-1]):
            past, now = known[known.target_end < cutoff], known[known.cutoff == cutoff].sort_values("campaign_key")
            expected = now.target_log_revenue.to_numpy() - design(now, past) @ solve(past)
            got = mine[mine.cutoff == cutoff].sort_values("campaign_key").residual_log_revenue
            np.testing.assert_allclose(got, expected, rtol=1e-6, atol=1e-7)


@pytest.mark.parametrize("size", [1, 2, 7, 30])
def test_elimination(spark, size):
    rng = np.random.default_rng(size)
    root = rng.normal(size=(size + 3, size)) * np.exp(rng.normal(size=size))
    left, right = root.T @ root + np.eye(size) * 0.1, rng.normal(size=size)
    rows = np.column_stack([left, right]).tolist()
    df = spark.createDataFrame([(rows,)], "a array<array<double>>")
    solved = df.select(eliminated(F.col("a"), F.size("a")).alias("a")).first().a
    np.testing.assert_allclose([row[-1] for row in solved], np.linalg.solve(left, right), rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose([row[:-1] for row in solved], np.eye(size), atol=1e-9)


def test_factor_weights(spark):
    rng = np.random.default_rng(3)
    rows = []
    for b in range(12):
        shock = rng.normal()
        for c in ("A", "B", "C"):
            own = rng.normal() * 0.7
            for i in range(5 if c != "C" else 1):
                rows.append((30, dt.date(2025, 1, 1), dt.date(2024, 1, 1) + dt.timedelta(days=21 * b), c, "t" if i < 3 else "u", float(shock + own + rng.normal() * 0.5)))
    frame = pd.DataFrame(rows, columns=["horizon_days", "origin", "cutoff", "channel", "campaign_type", "residual_log_revenue"])
    found = factor_weights(spark.createDataFrame(rows, "horizon_days int, origin date, cutoff date, channel string, campaign_type string, residual_log_revenue double")).first()
    r = frame.residual_log_revenue
    g = r.groupby(frame.cutoff).transform("mean")
    by_channel = r.groupby([frame.cutoff, frame.channel])
    by_type = r.groupby([frame.cutoff, frame.channel, frame.campaign_type])
    ce = (by_channel.transform("mean") - g).where(by_channel.transform("size") >= 2, 0.0)
    te = (by_type.transform("mean") - by_channel.transform("mean")).where(by_type.transform("size") >= 2, 0.0)
    v = [np.var(x) for x in (g, ce, te, r - g - ce - te)]
    common = min(0.85, sum(v[:3]) / sum(v))
    expected = [common * x / sum(v[:3]) for x in v[:3]]
    np.testing.assert_allclose([found.weight_global, found.weight_channel, found.weight_campaign_type], expected, atol=2e-8)
    assert found.weight_idiosyncratic == pytest.approx(1 - sum(expected), abs=3e-8)
    assert (found.sample_count, found.block_count) == (len(rows), 12)


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_exact_quantiles_with_ties(spark, monkeypatch, accuracy):
    """Exact whatever the sketch is worth, with a third of all rows sharing one value."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25), rng.exponential(size=1003)])
    keyed = [("a", float(v)) for v in values] + [("b", float(v)) for v in values[:57]] + [("a", None)]
    df = spark.createDataFrame(keyed, "g string, v double").repartition(5)
    wanted = {**quantiles.deciles(), "q90": (0.9, quantiles.conformal_rank(0.9))}
    for r in quantiles.order_statistics(df, ["g"], "v", wanted).collect():
        mine = values if r.g == "a" else values[:57]
        np.testing.assert_allclose([r.p10, r.p50, r.p90], np.quantile(mine, [0.1, 0.5, 0.9]), rtol=1e-12)
        assert r.q90 == np.sort(mine)[min(len(mine) - 1, int(np.ceil((len(mine) + 1) * 0.9)) - 1)]
        assert r.n == len(mine)


def test_expert_interval_and_blend(spark):
    expert = "named_struct('residual_p10', -0.3D, 'residual_p50', 0.1D, 'residual_p90', 0.4D, 'sparse_multiplier', 1.5D, 'extrapolation_multiplier', 2.0D)"
    df = spark.sql(f"SELECT 20L AS recent_days, 2.0D AS support, 5.0D AS a_log, 5.2D AS b_log, {expert} AS e")
    width = _expert_width(F.col("e"), F.col("support"))
    a, b = (_expert_quantiles(F.col("e"), F.col(x), width) for x in ("a_log", "b_log"))
    r = df.select(width.alias("w"), a.alias("a"), b.alias("b"), _blend(F.lit(0.25), a, b).alias("m")).first()
    assert r.w == 3.0
    assert r.a.p50 == pytest.approx(np.expm1(5.1)) and r.a.p10 == pytest.approx(np.expm1(5.1 - 0.4 * 3))
    middle = 0.25 * r.a.p50 + 0.75 * r.b.p50
    spread = min(abs(r.a.p50 - r.b.p50), max(3 * middle, 1))
    assert r.m.p50 == pytest.approx(middle)
    assert r.m.p90 == pytest.approx(0.25 * r.a.p90 + 0.75 * r.b.p90 + 0.25 * spread)
    assert r.m.p10 == pytest.approx(max(0, 0.25 * r.a.p10 + 0.75 * r.b.p10 - 0.25 * spread))
