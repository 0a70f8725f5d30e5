"""Queries with ordered groups, joins and carried state on skewed tables, with the hot path forced."""

import pytest

import __spark_entry__ as contract
from compare import check, connect
from conftest import SF
from skew import write_skewed
from topicloom.operators import ordered

NAMES = [
    "over_rows", "win_lag", "win_lead", "win_rank", "win_ntile", "win_running", "session_count",
    "slide_sum", "join_asof", "join_range", "join_inner", "status_changes", "process_history",
    "status_rollup", "set_except_all", "upsert_latest", "merge_by_key", "lookup_growing",
    "lineage_topic_tasks", "register_absent", "stream_over_rows", "stream_status_changes",
    "stream_interval_join", "stream_distinct",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return write_skewed(spark, SF, str(tmp_path_factory.mktemp("skewed") / "tables"))


@pytest.mark.parametrize("name", NAMES)
def test_skewed(spark, tables, name, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    assert len(ordered.hot_keys(spark.read.parquet(f"{tables}/events.parquet"), ["user_id"])[0])
    problem = check(spark, connect(tables), name, contract.queries()[name],
                    contract.oracle_sql()[name], tables)
    assert problem is None
