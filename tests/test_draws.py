"""Draw paths, copula and portfolio calibration against a plain-Python account of the rules."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediacast.operators.model_table import FACTOR_COPULA, INDEPENDENT
from mediacast.operators.rollup import hierarchy_forecast, leaf_draws

WEIGHTS = {"global": 0.2, "channel": 0.3, "campaign_type": 0.1, "idiosyncratic": 0.4}


def path(label):
    order = sorted(range(99), key=lambda i: hashlib.sha256(f"draw-order-1|{label}|{i}".encode()).hexdigest())
    rank = {i: r + 1 for r, i in enumerate(order)}
    return np.array([NormalDist().inv_cdf(rank[i] / 100) for i in range(99)]), np.array([rank[i] for i in range(99)])


def curve(p10, p50, p90, ranks):
    out = []
    for r in ranks:
        if r <= 10 or r >= 90 or r == 50:
            out.append(p10 if r <= 10 else p90 if r >= 90 else p50)
            continue
        a, b, t = (p10, p50, (r / 100 - 0.1) / 0.4) if r < 50 else (p50, p90, (r / 100 - 0.5) / 0.4)
        out.append(math.exp((1 - t) * math.log(a + 1e-9) + t * math.log(b + 1e-9)) - 1e-9)
    return np.array(out)


def leaf_table(spark, copula: bool, calibrated: bool):
    rows = []
    for i, (channel, kind) in enumerate([("A", "x"), ("A", "x"), ("A", "y"), ("B", "z"), ("B", "z")]):
        p50 = 100.0 * (i + 1)
        rows.append((
            "baseline", 30, "2025-01-31", "s", str(i), f"s:{i}", channel, kind, f"n{i}", "v", 4.0, "direct_ensemble", p50 / 4,
            p50 * 0.6, p50, p50 * 1.7, p50 / 5, p50 / 4, p50 / 3.5, "",
            FACTOR_COPULA if copula else INDEPENDENT,
            *(WEIGHTS.values() if copula else (0.0, 0.0, 0.0, 1.0)),
            *((-0.3, 0.05, 0.4) if calibrated else (None, None, None)),
        ))
    schema = (
        "scenario_id string, horizon_days int, origin string, source_system string, source_campaign_id string, campaign_key string, "
        "channel string, campaign_type string, campaign_name string, model_version string, target_roas double, family string, planned_budget double, "
        "predicted_revenue_p10 double, predicted_revenue_p50 double, predicted_revenue_p90 double, predicted_spend_p10 double, "
        "predicted_spend_p50 double, predicted_spend_p90 double, quality_flags string, dependence_method string, weight_global double, "
        "weight_channel double, weight_campaign_type double, weight_idiosyncratic double, portfolio_p10 double, portfolio_p50 double, portfolio_p90 double"
    )
    return spark.createDataFrame(rows, schema).withColumn("origin", F.to_date("origin"))


def expected_draws(rows, copula):
    draws = []
    for r in rows:
        own, ranks = path(f"campaign:{r.campaign_key}")
        if copula:
            latent = (
                math.sqrt(WEIGHTS["global"]) * path("global")[0]
                + math.sqrt(WEIGHTS["channel"]) * path(f"channel:{r.channel}")[0]
                + math.sqrt(WEIGHTS["campaign_type"]) * path(f"campaign_type:{r.channel}:{r.campaign_type}")[0]
                + math.sqrt(WEIGHTS["idiosyncratic"]) * own
            )
            ranks = np.empty(99, dtype=int)
            ranks[np.argsort(latent, kind="stable")] = np.arange(1, 100)
        draws.append((
            curve(r.predicted_revenue_p10, r.predicted_revenue_p50, r.predicted_revenue_p90, ranks),
            curve(r.predicted_spend_p10, r.predicted_spend_p50, r.predicted_spend_p90, ranks),
        ))
    return np.array([d[0] for d in draws]), np.array([d[1] for d in draws])


@pytest.mark.parametrize("copula", [False, True])
def test_leaf_draws(spark, copula):
    rows = leaf_draws(leaf_table(spark, copula, False)).orderBy("campaign_key").collect()
    revenue, spend = expected_draws(rows, copula)
    for i, r in enumerate(rows):
        np.testing.assert_allclose(r.revenue_draws, revenue[i], rtol=1e-12)
        np.testing.assert_allclose(r.spend_draws, spend[i], rtol=1e-12)


@pytest.mark.parametrize("calibrated", [False, True])
def test_roll_up(spark, calibrated):
    leaves = leaf_table(spark, True, calibrated)
    rows = leaves.orderBy("campaign_key").collect()
    revenue, spend = expected_draws(rows, True)
    point = sum(r.predicted_revenue_p50 for r in rows)
    total = revenue.sum(axis=0)
    if calibrated:
        ranks = np.empty(99, dtype=int)
        ranks[np.argsort(total, kind="stable")] = np.arange(1, 100)
        residual = np.interp(ranks / 100, [0.1, 0.5, 0.9], [-0.3, 0.05, 0.4]) - 0.05
        revenue = revenue * (np.maximum(0, np.expm1(np.log1p(point) + residual)) / total)
    groups = {("overall", "ALL", "ALL"): range(5), ("channel", "A", "ALL"): range(3), ("campaign_type", "B", "z"): (3, 4)}
    found = {(r.level, r.channel, r.campaign_type): r for r in hierarchy_forecast(leaves).where("level <> 'campaign'").collect()}
    for key, members in groups.items():
        r = found[key]
        rev, sp = revenue[list(members)].sum(axis=0), spend[list(members)].sum(axis=0)
        p50 = sum(rows[i].predicted_revenue_p50 for i in members)
        assert r.predicted_revenue_p50 == pytest.approx(p50)
        assert r.predicted_revenue_p10 == pytest.approx(min(np.sort(rev)[9], p50))
        assert r.predicted_revenue_p90 == pytest.approx(max(np.sort(rev)[89], p50))
        assert r.predicted_spend_p50 == pytest.approx(np.sort(sp)[49])
        assert r.predicted_roas_p90 == pytest.approx(max(np.sort(rev / sp)[89], p50 / np.sort(sp)[49]))
        share = float(np.mean(rev / sp >= 4.0))
        assert r.probability_roas_above_target == pytest.approx(share, abs=1e-4)
        width = (r.predicted_revenue_p90 - r.predicted_revenue_p10) / p50
        risk = 100 * min(1, 0.55 * (1 - r.probability_roas_above_target) + 0.25 * min(width / 3, 1))
        assert r.risk_score == pytest.approx(risk, abs=0.051)
        assert ("portfolio_oof_residual_calibration" in r.quality_flags) == calibrated
        assert r.quality_flags.startswith("historical_residual_factor_copula_rollup")
    leaf = {r.campaign_key: r for r in hierarchy_forecast(leaves).where("level = 'campaign'").collect()}
    for i, r in enumerate(rows):
        assert leaf[r.campaign_key].predicted_revenue_p90 == pytest.approx(max(np.sort(revenue[i])[89], r.predicted_revenue_p50))
