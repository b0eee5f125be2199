"""Wall seconds of the headline jobs with every supplier as a campaign; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 4) choose data and threads.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from mediacast.operators import calendar as cal
from mediacast.operators.allocate import AllocationRequest, allocate
from mediacast.operators.canonical import canonical_days
from mediacast.operators.quality import quality_rules, raise_if_blocking
from mediacast.operators.ridge import expert_fits, fit_statistics, gram_cells, solve_fits
from mediacast.operators.rollup import hierarchy_forecast
from mediacast.operators.training import cutoff_counts, purged_splits, training_rows
from mediacast.plans.backtest import backtest
from mediacast.plans.forecast import latest_slices, scenario_leaves, statistical_models
from mediacast.session import build_session, stage
from mediacast.sources.lineitem import campaign_days, raw_exports


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").agg(F.sum("l_quantity")).collect()
    seconds: dict[str, float] = {}

    def timed(name, job):
        started = time.time()
        result = job()
        seconds[name] = round(time.time() - started, 3)
        return result

    def canonicalise():
        facts = stage(canonical_days(raw_exports(campaign_days(spark, folder, by_supplier=True))), "canonical")
        raise_if_blocking(quality_rules(facts))
        return facts

    def forecast_all():
        calendar = cal.staged_calendar(facts)
        models = stage(statistical_models(calendar, latest_slices(calendar)), "models")
        leaves = scenario_leaves(facts, calendar, models)
        return calendar, leaves

    def fit_experts():
        rows = stage(training_rows(facts, calendar, calendar.agg(F.min("date")).first()[0], shared=False), "rows")
        splits = stage(purged_splits(cutoff_counts(rows), latest_slices(calendar)), "splits")
        return stage(solve_fits(fit_statistics(gram_cells(rows), expert_fits(splits))), "coefficients")

    def give_budget():
        base = leaves.where(F.col("horizon_days") == 30)
        total = base.agg(F.sum("planned_budget")).first()[0]
        return allocate(base, AllocationRequest(30, round(0.9 * total, 2), 3.5))

    facts = timed("canonicalise_and_gate", canonicalise)
    calendar, leaves = timed("leaf_forecast", forecast_all)
    timed("draw_rollup", lambda: hierarchy_forecast(leaves).write.format("noop").mode("overwrite").save())
    timed("training_and_ridge", fit_experts)
    timed("allocation", give_budget)
    timed("backtest_36_fits", lambda: backtest(facts).report.collect())
    print(
        json.dumps(
            {
                "metric": "total wall time of headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
