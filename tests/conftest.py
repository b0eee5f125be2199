from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mediacast.contracts import CANONICAL_SCHEMA  # noqa: E402
from mediacast.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_facts(spark):
    """Canonical rows from ``(source, id, day, spend, revenue)`` with the rest filled in."""

    def build(rows, **changes):
        full = []
        for source, campaign, day, spend, revenue in rows:
            row = dict(
                source_system=source, source_campaign_id=campaign, date=day, channel="SEARCH", campaign_type="SEARCH",
                campaign_name=f"name {campaign}", spend=float(spend), revenue=float(revenue), clicks=1.0, impressions=10.0,
                conversions=1.0, configured_budget=None, quality_flags="",
            )
            for key, value in changes.items():
                row[key] = value(row) if callable(value) else value
            full.append(tuple(row[c] for c in CANONICAL_SCHEMA.fieldNames()))
        return spark.createDataFrame(full, CANONICAL_SCHEMA)

    return build


def days(start: str, count: int):
    first = dt.date.fromisoformat(start)
    return [first + dt.timedelta(days=i) for i in range(count)]
