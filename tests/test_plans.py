"""Plans stay the ones that scale."""

import pytest

import __spark_entry__ as driver
from slotwise.operators import history
from slotwise.operators import monitors as mon
from slotwise.plans.inputs import NOW, shape

SF = "/root/testdata/sf0.001"
LIGHT = [
    n for n in driver.queries()
    if not n.startswith("stream_") and n not in ("nonce_replay_filter", "dlq_replay_job", "monitor_tick", "append_audit")
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LIGHT)
def test_no_nested_loops(spark, name):
    text = plan(driver.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_time_bounds_reach_the_scan(spark):
    text = plan(history.event_history(shape(spark, SF, "chain_events"), "Prog3", "", "2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z"))
    assert "GreaterThanOrEqual(ts," in text and "LessThanOrEqual(ts," in text
    assert "TakeOrderedAndProject" in text


def test_launch_bounds_reach_the_scan(spark):
    text = plan(driver.queries()["launch_backtest"](spark, SF))
    assert "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text and "BroadcastHashJoin" in text


def test_monitors_are_checked_once(spark):
    """Values read the checked monitors that were written, not the requests and their checks again."""
    made = mon.monitor_values(shape(spark, SF, "chain_events"), mon.accepted_monitors(shape(spark, SF, "monitor_requests")), NOW)
    assert not any("customer" in f for f in made.inputFiles()) and made.count() > 0
