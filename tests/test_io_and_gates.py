"""Export reading, quality gate, output contract, parameter store, ledger."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from conftest import days
from pyspark.sql import functions as F

from mediacast.contracts import ContractError
from mediacast.functions import columns
from mediacast.operators import canonical, quality
from mediacast.operators.fingerprint import canonical_fingerprint
from mediacast.plans.predict import predict_folder
from mediacast.sources import exports, files, predictions, store

GOOGLE = "campaign_id,segments_date,campaign_advertising_channel_type,campaign_name,metrics_cost_micros,metrics_conversions_value,metrics_clicks,metrics_impressions,metrics_conversions,campaign_budget_amount"
MICROSOFT = "CampaignId,TimePeriod,CampaignType,CampaignName,Revenue,Spend,Clicks,Impressions,Conversions,DailyBudget"
META = "campaign_id,date_start,campaign_name,conversion,spend,clicks,impressions,daily_budget"


def upload(folder: Path, count: int = 40, **files: str) -> Path:
    folder.mkdir(exist_ok=True)
    dates = days("2025-01-01", count)
    google = [f"007,{d},SEARCH, Brand ,{(10 + i % 3) * 1000000},{40 + i},5,50,1,12" for i, d in enumerate(dates)]
    microsoft = [f"00{1 + i % 2},{d},Performance-Max,NA,30,{8 + i % 4},4,40,1," for i, d in enumerate(dates)]
    meta = [f"123456789012345678,{d},Autumn retargeting,25,{6 + i % 5},3,30,nan" for i, d in enumerate(dates)]
    texts = {
        "g.csv": "\n".join([GOOGLE, *google]),
        "m.csv": "\n".join([MICROSOFT, *microsoft]),
        "f.csv": "\n".join([META, *meta]),
    }
    for name, text in {**texts, **{k.replace("__", "."): v for k, v in files.items()}}.items():
        (folder / name).write_text(text + "\n")
    return folder


def read(spark, folder):
    return exports.read_upload(spark, str(folder))


def test_ids_names_and_numbers_survive(spark, tmp_path):
    up = read(spark, upload(tmp_path / "u"))
    rows = canonical.canonical_days(up.exports, up.taxonomy, up.semantics).collect()
    assert {r.source_campaign_id for r in rows} == {"007", "001", "002", "123456789012345678"}
    by = {r.source_system: r for r in rows}
    assert by["google_ads"].campaign_name == "Brand" and by["google_ads"].configured_budget == 12
    assert by["microsoft_ads"].campaign_type == "PERFORMANCE_MAX" and by["microsoft_ads"].campaign_name in ("001", "002")
    assert by["microsoft_ads"].configured_budget is None and by["meta_ads"].configured_budget is None
    assert by["meta_ads"].campaign_type == "META_REMARKETING" and by["meta_ads"].revenue == by["meta_ads"].conversions == 25
    assert by["meta_ads"].date >= dt.date(2025, 1, 1)


@pytest.mark.parametrize("files, message", [
    ({"g__csv": GOOGLE + "\n ,2025-01-01,SEARCH,n,1,1,1,1,1,1"}, "blank"),
    ({"h__csv": GOOGLE}, "several files"),
    ({"m__csv": MICROSOFT.replace(",DailyBudget", "")}, "without"),
    ({"m__csv": "a,b"}, "no export found"),
    ({"media_plan__csv": "source_system,source_campaign_id,horizon_days,planned_budget\ngoogle_ads,007,30.5,1"}, "fractional"),
    ({"media_plan__csv": "source_system,source_campaign_id,horizon_days,planned_budget\ngoogle_ads,007,inf,1"}, "non_finite_horizon"),
    ({"media_plan__csv": "source_system,source_campaign_id,horizon_days,planned_budget\ngoogle_ads,007,45,1"}, "unsupported"),
    ({"media_plan__csv": "source_system,source_campaign_id,horizon_days,planned_budget\ngoogle_ads,007,30,-1"}, "negative"),
    ({"media_plan__csv": "source_system,source_campaign_id,horizon_days,planned_budget\ngoogle_ads,7,30,1"}, "not in this upload"),
    ({"media_plan__csv": "source_system,source_campaign_id,horizon_days,planned_budget\ngoogle_ads,007,30,1\ngoogle_ads,007,30.0,2"}, "duplicate"),
    ({"media_plan__csv": "source_system,source_campaign_id,horizon_days\ngoogle_ads,007,30"}, "missing required"),
    ({"campaign_taxonomy__csv": "source_system,source_campaign_id,campaign_type\ngoogle_ads,007,X"}, "may only map"),
    ({"campaign_taxonomy__csv": "source_system,source_campaign_id,campaign_type,review_status\nmeta_ads,123456789012345678,X,maybe"}, "must be one of"),
    ({"source_semantics__csv": "source_system,currency,timezone,attribution_method,revenue_field\ngoogle_ads,USD,UTC,a,metrics_conversions_value\nmicrosoft_ads,EUR,UTC,a,Revenue\nmeta_ads,USD,UTC,a,conversion"}, "multiple currencies"),
    ({"source_semantics__csv": "source_system,currency,timezone,attribution_method,revenue_field\ngoogle_ads,USD,UTC,a,metrics_clicks\nmicrosoft_ads,usd,UTC,a,Revenue\nmeta_ads,USD,UTC,a,conversion"}, "canonical mapping"),
    ({"source_semantics__csv": "source_system,currency,timezone,attribution_method,revenue_field\ngoogle_ads,USD,UTC,a,metrics_conversions_value"}, "exactly"),
])
def test_broken_uploads_are_refused(spark, tmp_path, files, message):
    with pytest.raises(ContractError, match=message):
        read(spark, upload(tmp_path / "u", 3, **files))


def test_review_markers_decide_types_and_flags(spark, tmp_path):
    semantics = "source_system,currency,timezone,attribution_method,revenue_field,review_status\n" + "\n".join(
        f"{s},usd,UTC,a,{f},Reviewed" for s, f in (("google_ads", "metrics_conversions_value"), ("microsoft_ads", "Revenue"), ("meta_ads", "conversion"))
    )
    for status, kind, flag in (("reviewed", "SPECIAL", "meta_campaign_type_mapped_reviewed"), ("unreviewed", "META_REMARKETING", "meta_campaign_type_mapping_unreviewed_fallback")):
        taxonomy = f"source_system,source_campaign_id,campaign_type,review_status\nmeta_ads,123456789012345678,SPECIAL,{status}"
        up = read(spark, upload(tmp_path / status, 3, campaign_taxonomy__csv=taxonomy, source_semantics__csv=semantics))
        row = canonical.meta_days(up.exports["meta_ads"], up.taxonomy, up.semantics).first()
        assert row.campaign_type == kind and flag in row.quality_flags
        assert row.quality_flags.endswith("meta_conversion_semantics_reviewed;source_semantics_reviewed")


def test_quality_gate_counts(spark, make_facts):
    good = [("google_ads", "1", d, 10, 40) for d in days("2025-01-01", 5)]
    facts = make_facts(good + good[:1] + [("google_ads", "2", dt.date(2025, 1, 1), -1, float("inf"))])
    facts = facts.withColumn("clicks", F.when(F.col("spend") < 0, None).otherwise(F.col("clicks"))).withColumn(
        "campaign_name", F.when(F.col("date") == "2025-01-05", F.lit(" ")).otherwise(F.col("campaign_name"))
    )
    found = {(r.rule, r.column_name): r.violations for r in quality.quality_rules(facts).where("violations > 0").collect()}
    assert found == {
        ("blank", "campaign_name"): 1,
        ("negative", "spend"): 1,
        ("non_finite", "revenue"): 1,
        ("null_or_non_numeric", "clicks"): 1,
        ("missing_budget", "configured_budget"): 7,
        ("duplicate_campaign_day", "date"): 2,
        ("inconsistent_hierarchy", "channel,campaign_type,campaign_name"): 1,
    }
    with pytest.raises(ContractError, match="blockers"):
        quality.raise_if_blocking(quality.quality_rules(facts))
    missing = quality.quality_rules(facts.drop("spend")).collect()
    assert [(r.rule, r.column_name) for r in missing] == [("missing_column", "spend")]


def test_upload_to_predictions_file(spark, tmp_path):
    plan = "source_system,source_campaign_id,horizon_days,planned_budget\ngoogle_ads,007,30,0"
    folder = upload(tmp_path / "u", 60, media_plan__csv=plan)
    target = tmp_path / "out" / "predictions.csv"
    rows, warnings = predict_folder(spark, str(folder), None, str(target))
    assert predictions.check_header(spark, str(target)) == predictions.FORECAST_V1.columns
    lines = target.read_bytes().decode().splitlines()
    assert len(lines) == rows + 1 and b"\r" not in target.read_bytes()
    cells = [line.split(",") for line in lines[1:]]
    assert cells == sorted(cells, key=lambda c: (int(c[1]), c[2], c[3], c[4], c[5]))
    zero = next(c for c in cells if c[1] == "30" and c[5] == "007")
    assert zero[7] == "0.000000" and zero[9] == "0.000000"
    assert any("missing_budget" in w for w in warnings)
    first = target.read_bytes()
    predict_folder(spark, str(folder), None, str(target))
    assert target.read_bytes() == first


def test_output_contract(spark, tmp_path):
    row = {f.name: ("x" if f.kind == "string" else 30 if f.kind == "integer" else 1.5) for f in predictions.FORECAST_V1.fields}
    row |= {"campaign_name": " ", "quality_flags": ""}
    row["prediction_id"] = row.pop("forecast_id")
    good = spark.createDataFrame([row])
    out = predictions.validated(good).first()
    assert (out.campaign_name, out.quality_flags, out.forecast_id, out.horizon_days) == ("ALL", "none", "x", 30)
    target = tmp_path / "p.csv"
    target.write_text("old")
    for broken in (good.withColumn("horizon_days", F.lit(30.5)), good.withColumn("risk_score", F.lit(float("inf"))), good.where("false"), good.withColumn("level", F.lit(None).cast("string"))):
        with pytest.raises(ContractError):
            predictions.write_predictions(broken, str(target))
        assert target.read_text() == "old"
    with pytest.raises(ContractError, match="expected one of"):
        predictions.adapt(good.drop("risk_score"))
    with pytest.raises(ContractError, match="unsupported"):
        predictions.get_schema("v0")
    with pytest.raises(ContractError, match="sorts by"):
        predictions.Schema("v", (predictions.Field("a", "string"),), ("b",)).check()


def test_store_refuses_changed_tables(spark, tmp_path, make_facts):
    from mediacast.operators.calendar import portfolio_calendar
    from mediacast.plans.forecast import latest_slices, statistical_models
    from mediacast.session import stage

    facts = stage(make_facts([("google_ads", "1", d, 10, 40) for d in days("2025-01-01", 40)]), "facts")
    calendar = portfolio_calendar(facts)
    models = stage(statistical_models(calendar, latest_slices(calendar)), "models")
    folder = str(tmp_path / "store")
    store.save_model(models, facts, folder)
    loaded, card = store.load_model(spark, folder)
    assert loaded.count() == 3 and card["training_rows"] == 40
    loaded.withColumn("global_roas", F.col("global_roas") + 1e-9).write.mode("overwrite").parquet(str(tmp_path / "other"))
    spark.read.parquet(str(tmp_path / "other")).write.mode("overwrite").parquet(f"{files.current_version(spark, folder)}/models")
    with pytest.raises(ContractError, match="artifact_sha256"):
        store.load_model(spark, folder)


def test_fingerprint_sees_copies_but_not_order(spark, make_facts):
    rows = [("google_ads", str(i % 3), d, i, 2 * i) for i, d in enumerate(days("2025-01-01", 30))]

    def mark(r):
        return canonical_fingerprint(make_facts(r)).first().fingerprint

    assert mark(rows) == mark(rows[::-1]) != mark(rows + rows[:1])
    assert mark(rows) != canonical_fingerprint(make_facts(rows, configured_budget=1.0)).first().fingerprint


def test_decision_ledger(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    for i in range(3):
        rows = spark.sql(f"SELECT 'draft' AS action, 'f{i}' AS forecast_id, named_struct('h', 30) AS scenario, named_struct('risk', {i}) AS summary")
        store.record_decisions(rows, folder)
    last = store.recent_decisions(spark, folder, 2).collect()
    assert [r.forecast_id for r in last] == ["f2", "f1"] and last[0].summary_json == '{"risk":2}'
    with pytest.raises(ContractError):
        store.record_decisions(rows.withColumn("action", F.lit("deleted")), folder)


def test_recent_window(spark):
    df = spark.createDataFrame([(str(d), i) for i, d in enumerate(days("2025-01-01", 120))], "day string, i int")
    kept = [r.i for r in exports.recent_window(df, "day").collect()]
    assert kept == list(range(30, 120))


def test_published_folders_change_in_one_step(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        files.current_version(spark, target)

    def table(n):
        return spark.range(n).toDF("n")

    def read():
        return spark.read.parquet(files.current_version(spark, target)).count()

    files.replace_folder(table(1), target)
    assert read() == 1
    # stopped while the version is written, and after it but before it is put in place
    table(2).write.parquet(files.new_version(target))
    assert read() == 1
    whole = files.publish
    for stop in ("before", "after"):

        def stopped(spark, staged, final, stop=stop):
            if stop == "after":
                whole(spark, staged, final)
            raise KeyboardInterrupt

        monkeypatch.setattr(files, "publish", stopped)
        with pytest.raises(KeyboardInterrupt):
            files.replace_folder(table(3), target)
        monkeypatch.setattr(files, "publish", whole)
        assert read() == (1 if stop == "before" else 3)
    files.replace_folder(table(4), target)
    versions = [p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("version-")]
    assert read() == 4 and len(versions) == 2  # and the one that a reader may still hold
    files.replace_csv_folder(table(5), target)
    assert spark.read.csv(files.current_version(spark, target), header=True).count() == 5


def test_recent_windows_of_all_sources(spark, tmp_path):
    source = upload(tmp_path / "u", count=40)
    found = exports.write_recent_windows(spark, str(source), str(tmp_path / "sample"), days=7)
    again = read(spark, found)
    assert set(again.exports) == set(read(spark, source).exports) and len(again.exports) == 3
    for name, export in again.exports.items():
        kept = [str(r[0]) for r in export.select(exports.EXPORTS[name].date_column).collect()]
        assert kept == sorted(kept) == [str(d) for d in days("2025-01-01", 40)][-7:]
    with pytest.raises(ContractError):
        exports.write_recent_windows(spark, str(tmp_path / "none"), str(tmp_path / "sample"))
    assert exports.current_version(spark, str(tmp_path / "sample")) == found


def test_report_document(spark, tmp_path, make_facts):
    from mediacast.operators.calendar import portfolio_calendar
    from mediacast.operators.evidence import trust
    from mediacast.plans.backtest import Backtest, backtest_document
    from mediacast.plans.fit import Fit
    from mediacast.plans.forecast import latest_slices, statistical_models
    from mediacast.session import stage

    facts = stage(make_facts([("google_ads", "1", d, 10, 40) for d in days("2025-01-01", 40)]), "facts")
    calendar = portfolio_calendar(facts)
    models = stage(statistical_models(calendar, latest_slices(calendar)), "models")
    card = stage(store.manifest(models, facts), "card")
    report = spark.createDataFrame([(60, 0.5, None), (30, 0.1, "x")], "horizon_days int, wape double, note string")
    folder = str(tmp_path / "report")
    store.save_report(store.report_document({"horizons": report, "none": report.limit(0)}, card, "r1", "m1"), folder)
    mark = card.first().training_data_fingerprint
    document = store.load_report(spark, folder, mark)
    assert sorted(store.report_table(document, "horizons").collect()) == sorted(report.collect()) and store.report_table(document, "none").count() == 0
    in_use = card.withColumnRenamed("training_data_fingerprint", "data_fingerprint").selectExpr("'m1' AS model_id", "*", "data_fingerprint AS training_data_fingerprint")
    assert trust(document, in_use).first().status == "available"
    assert trust(document, in_use.withColumn("artifact_sha256", F.lit("other"))).first().reason == "differs:artifact_sha256"
    with pytest.raises(ContractError, match="other data"):
        store.load_report(spark, folder, "other")
    whole = Backtest(None, Fit(calendar, None, models, None, None, None), None, None, None, report, report.limit(1), report)
    written = backtest_document(whole, facts, "r2", "m1")
    assert written.first().data_fingerprint == mark and written.first().report_id == "r2"
    assert sorted(store.report_table(written, "reliability").collect()) == sorted(report.collect()) and store.report_table(written, "coverage").count() == 1
    changed = document.withColumn("horizons", F.transform("horizons", lambda r: r.withField("wape", r["wape"] + 1e-9)))
    files.replace_folder(stage(changed, "changed"), folder)
    with pytest.raises(ContractError, match="fingerprint"):
        store.load_report(spark, folder)


def test_date_spellings(spark):
    same = ["2024-01-05", "2024/01/05", "1/5/2024", "01/05/2024 10:11", "2024-01-05T10:11:12.345", "2024-01-05 10:11:12Z", "Jan 5, 2024", " January 5, 2024 ", "2024-1-5"]
    none = ["", "2024-13-05", "2024-01-05 25:00", "5.1.2024 x", "2024/01-05", None, "yesterday"]
    df = spark.createDataFrame([(x,) for x in same + none], "t string")
    found = [str(r.d) for r in df.select(columns.day(F.col("t")).alias("d")).collect()]
    assert found == ["2024-01-05"] * len(same) + ["None"] * len(none)


def test_parts_and_quoted_breaks(spark, tmp_path):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('a,b\n1,"two\nlines"\n')
    (folder / "b.csv").write_text("a,b\n3,4\n")
    rows = {tuple(r) for r in exports.read_text(spark, str(folder), ["a", "b"]).collect()}
    assert rows == {("1", "two\nlines"), ("3", "4")}
    (folder / "b.csv").write_text("b,a\n4,3\n")
    with pytest.raises(Exception, match="header"):
        exports.read_text(spark, str(folder), ["a", "b"]).collect()
