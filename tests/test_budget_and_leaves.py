"""Baseline plans and leaf forecasts on cases small enough to work out by hand."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from conftest import days
from pyspark.sql import functions as F

from mediacast.contracts import ContractError, HORIZONS
from mediacast.operators import calendar as cal
from mediacast.operators.history import PRIOR, _fact_and_prior
from mediacast.operators.rollup import hierarchy_forecast
from mediacast.plans.forecast import latest_slices, scenario_leaves, statistical_models
from mediacast.session import stage


def leaves_of(facts, plan=None, scenarios=None):
    facts = stage(facts, "facts")
    calendar = cal.staged_calendar(facts)
    models = stage(statistical_models(calendar, latest_slices(calendar)), "models")
    return scenario_leaves(facts, calendar, models, plan=plan, scenarios=scenarios)


def history(prior_days: int):
    """28 days at 10 a day, and the matching days of the year before at 1,000."""
    recent = days("2025-06-04", 28)  # ends 2025-07-01
    prior = days("2024-07-02", 30)[:prior_days]
    rows = [("google_ads", "1", d, 10, 40) for d in recent] + [("google_ads", "1", d, 1000, 4000) for d in prior]
    return rows


@pytest.mark.parametrize("prior_days, budget, method, coverage", [
    (30, 1200.0, "calendar_matched_prior_year_budget", 1.0),
    (23, 300.0, "recent_run_rate_budget", 23 / 30),
])
def test_prior_year_plan_is_capped_and_needs_coverage(make_facts, prior_days, budget, method, coverage):
    row = leaves_of(make_facts(history(prior_days))).where("horizon_days = 30").first()
    assert row.planned_budget == pytest.approx(budget)
    assert row.baseline_method == method
    assert row.prior_coverage == pytest.approx(coverage)


def test_leap_days_map_like_a_calendar(make_facts):
    rows = [("google_ads", "1", dt.date(2023, 2, 28), 7, 1), ("google_ads", "1", dt.date(2024, 2, 29), 5, 1), ("google_ads", "1", dt.date(2024, 3, 1), 3, 1)]
    placed = make_facts(rows).select("spend", F.inline(_fact_and_prior(F.col("date")))).where(F.col("kind") == PRIOR)
    found = {(r.date, r.spend) for r in placed.select(F.date_from_unix_date("day").alias("date"), "spend").collect()}
    assert found == {(dt.date(2024, 2, 28), 7.0), (dt.date(2024, 2, 29), 7.0), (dt.date(2025, 3, 1), 3.0)}


def test_overrides_reach_only_active_campaigns(spark, make_facts):
    recent, old = days("2025-01-04", 28), days("2024-06-01", 40)
    rows = [("google_ads", "1", d, 10, 40) for d in recent] + [("google_ads", "2", d, 10, 40) for d in old]
    facts = make_facts(rows)
    schema = "scenario_id string, horizon_days int, override_key string, planned_budget double"
    plan = spark.createDataFrame([("baseline", 30, "google_ads:1", 777.0)], schema)
    found = {r.horizon_days: r.planned_budget for r in leaves_of(facts, plan).collect()}
    assert found[30] == 777.0 and found[60] == pytest.approx(600.0)
    dormant = spark.createDataFrame([("baseline", 30, "2", 777.0)], schema)
    with pytest.raises(ContractError, match="no_active_campaign"):
        leaves_of(facts, dormant)


def test_bare_key_shared_by_sources_is_ambiguous(spark, make_facts):
    rows = [(s, "1", d, 10, 40) for s in ("google_ads", "meta_ads") for d in days("2025-01-04", 28)]
    plan = spark.createDataFrame([("baseline", 30, "1", 5.0)], "scenario_id string, horizon_days int, override_key string, planned_budget double")
    with pytest.raises(ContractError, match="ambiguous"):
        leaves_of(make_facts(rows), plan)


def test_dormant_portfolio_keeps_its_hierarchy(make_facts):
    rows = [("google_ads", "1", d, 10, 40) for d in days("2024-01-01", 60)] + [("google_ads", "1", d, 0, 0) for d in days("2024-03-01", 40)]
    leaves = leaves_of(make_facts(rows))
    for row in leaves.collect():
        assert row.planned_budget == 0 and row.predicted_revenue_p50 == 0
        assert "portfolio_dormant_zero_plan" in row.quality_flags.split(";")
    overall = hierarchy_forecast(leaves).where("level = 'overall'").collect()
    assert {r.horizon_days for r in overall} == set(HORIZONS)
    assert all(r.predicted_revenue_p90 == 0 and r.predicted_spend_p90 == 0 for r in overall)


def test_statistical_leaf_by_hand(make_facts):
    rows = [("google_ads", "1", d, 10 + i % 3, (10 + i % 3) * (3 if i % 2 else 5)) for i, d in enumerate(days("2024-11-01", 60))]
    row = leaves_of(make_facts(rows)).where("horizon_days = 30").first()
    spend = [r[3] for r in rows]
    revenue = [r[4] for r in rows]
    logs = [math.log(r / s) for r, s in zip(revenue, spend)]
    mean = sum(logs) / 60
    sigma = min(1.25, max(0.20, math.sqrt(sum((x - mean) ** 2 for x in logs) / 60)))
    overall = sum(revenue) / sum(spend)
    by_month = {}
    for r in rows:
        s, v = by_month.get(r[2].month, (0, 0))
        by_month[r[2].month] = (s + r[3], v + r[4])
    factor = {m: min(1.45, max(0.55, v / s / overall)) for m, (s, v) in by_month.items()}
    last = rows[-1][2]
    season = sum(factor.get((last + dt.timedelta(days=i)).month, 1.0) for i in range(1, 31)) / 30
    recent = sum(revenue[-28:]) / sum(spend[-28:])
    roas = (0.7 * recent + 0.3 * overall) * season
    budget = sum(spend[-28:]) / 28 * 30
    assert row.planned_budget == pytest.approx(budget)
    assert row.predicted_revenue_p50 == pytest.approx(budget * roas, rel=1e-9)
    assert row.predicted_revenue_p10 == pytest.approx(budget * roas * math.exp(-1.28155 * sigma), rel=1e-9)
    assert row.predicted_spend_p50 == pytest.approx(budget)
    assert row.predicted_spend_p10 <= budget <= row.predicted_spend_p90


def test_order_and_partitioning_do_not_matter(spark, make_facts):
    rows = [(s, str(i), d, 5 + (d.day * (i + 3)) % 11, 20 + (d.day * (i + 5)) % 37)
            for s in ("google_ads", "meta_ads") for i in range(3) for d in days("2024-10-01", 90)]
    plain, shuffled = make_facts(rows), make_facts(rows[::-1]).repartition(7)
    a = hierarchy_forecast(leaves_of(plain)).orderBy("horizon_days", "level", "campaign_key").collect()
    b = hierarchy_forecast(leaves_of(shuffled)).orderBy("horizon_days", "level", "campaign_key").collect()
    for x, y in zip(a, b, strict=True):
        assert (x.level, x.campaign_key, x.quality_flags) == (y.level, y.campaign_key, y.quality_flags)
        assert x.predicted_revenue_p90 == pytest.approx(y.predicted_revenue_p90, rel=1e-9)
        assert x.predicted_revenue_p10 <= x.predicted_revenue_p50 <= x.predicted_revenue_p90
    total = {h: sum(r.predicted_revenue_p50 for r in a if r.level == "campaign" and r.horizon_days == h) for h in HORIZONS}
    for r in a:
        if r.level == "overall":
            assert r.predicted_revenue_p50 == pytest.approx(total[r.horizon_days], rel=1e-12)
