"""Registered queries against their SQL on the smallest tables (tests/oracle_tool.py runs all of them)."""

import pytest

duckdb = pytest.importorskip("duckdb")

from oracle_tool import compare, connect  # noqa: E402
from tidewatch.catalog import load  # noqa: E402

QUERIES, ORACLES = load()
CHECKED = ["a01_fold_web", "a03_profiles", "a13_efficiency", "a15_who_visited_folded", "a16_attendance", "d01_deviation", "d03_archive_then_send",
           "d11_verdicts", "d17_risk_board", "j03_resolve_identity", "j13_baseline_asof", "l01_merge_alerts", "l11_audit_alerts",
           "s09_proxy_messages", "s10_agent_messages", "t04_stream_sessions", "w1_windows", "w2_leisure_segments", "w5_suppress_repeats"]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, data, con, name):
    diff, _ = compare(QUERIES[name](spark, data), con, ORACLES[name])
    assert diff == ""


def test_profile_export_has_stories(spark, data, con):
    name = "k05_profile_export_story"
    got = QUERIES[name](spark, data)
    assert compare(got, con, ORACLES[name])[0] == "" and got.filter("kind = 'story'").count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark, data):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
