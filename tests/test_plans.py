"""Plans: pushdown, pruning, early rank cuts, no pair-wise joins, no sort in the hot aggregate."""

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import load
from tidewatch.catalog.base import ev
from tidewatch.operators import profiles as P
from tidewatch.operators import windows as W
from tidewatch.plans import boards as B
from tidewatch.plans import reports as R


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_facts_use_one_hash_aggregate(spark, data):
    plan = physical(W.session_facts(ev(spark, data)))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_scan_reads_only_needed_columns(spark, data, tmp_path):
    ev(spark, data).write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    read = lambda df: physical(df).split("ReadSchema: ")[1].splitlines()[0]
    assert read(W.build_windows(stored)) == "struct<employee_id:string,occurred_at:timestamp_ntz>"
    assert "size_bytes" not in read(W.session_facts(stored)) and "url" not in read(W.session_facts(stored))


def test_time_filter_reaches_the_scan(spark, data):
    plan = physical(B.who_visited(ev(spark, data), "2024-01-31 00:00:00", "netdisk"))
    assert "GreaterThanOrEqual(ts," in plan


def test_rank_is_cut_before_the_shuffle(spark, data):
    for df in (P.profiles(ev(spark, data)), R.timelines(ev(spark, data), "2024-01-31 00:00:00")):
        assert "WindowGroupLimit" in physical(df)


def test_top_lists_do_not_sort_everything(spark, data):
    assert "TakeOrderedAndProject" in physical(B.who_visited(ev(spark, data), "2024-01-31 00:00:00", "netdisk"))


QUICK = ["a13_efficiency", "a15_who_visited", "d03_archive_then_send", "d06_mass_delete", "j04_drop_cross_source", "j01_classify_with_table",
         "l10_discover_aliases", "a02_common_domains", "a20_transfer_domains", "p05_timelines", "w2_leisure_segments"]


@pytest.mark.parametrize("name", QUICK)
def test_no_pairwise_joins(spark, data, name):
    plan = physical(load()[0][name](spark, data))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_time_bounds_prune_days(spark, make, tmp_path):
    """Operators with a time bound read only the stored days they need."""
    from tidewatch.operators import digest as G
    from tidewatch.operators.profiles import profiles
    from tidewatch.plans import boards as B
    from tidewatch.sources.sinks import append_partitioned
    append_partitioned(make([{"at": "2026-07-22 09:00:00", "domain": "a.org"}, {"at": "2026-01-01 09:00:00", "domain": "b.org"}]), str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    verdicts = spark.createDataFrame([], "employee_id string, window_start timestamp_ntz, risk_score int")
    for df in (B.who_visited(stored, "2026-07-23 00:00:00", "netdisk"), profiles(stored, "2026-07-23 00:00:00"),
               G.day_candidates(verdicts, stored, "2026-07-22")):
        plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        assert "event_date" in plan.split("PartitionFilters: ", 1)[1].split("]", 1)[0]
