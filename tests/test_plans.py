"""Shapes of the physical plans that matter at scale."""

import re

import pytest

from tidegauge.plans.queries import QUERIES
from tidegauge.plans.streams import STREAM_QUERIES

SF_DIR = "/root/testdata/sf0.001"
WRITES = {"append_results", "publish_messages"}
USER_FUNCTIONS = {"parse_cost_udf", "reduce_word_count", "reduce_cost_bits"}
BATCH = sorted(set(QUERIES) - {f.__name__ for f in STREAM_QUERIES} - WRITES)


@pytest.fixture(scope="module")
def plan(spark):
    known = {}

    def of(name):
        if name not in known:
            known[name] = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        return known[name]

    return of


@pytest.mark.parametrize("name", BATCH)
def test_no_pairing_of_all_rows_and_no_window_over_a_single_partition(plan, name):
    text = plan(name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for window in re.findall(r"Window \[.*", text):
        spec = window.split("windowspecdefinition(")[1]
        assert re.match(r"(run_id|source_id|batch_start_s|_groupingexpression)", spec), window


@pytest.mark.parametrize("name", ["throughput_decisions", "epoch_outcomes", "post_warmup_delays", "params_as_of", "param_patches", "overrun_report"])
def test_no_window_holds_a_whole_series(plan, name):
    """Windows by a key alone stand right above the aggregate of its spans; all others hold one span, or one second."""
    lines = plan(name).split("\n")
    for i, line in enumerate(lines):
        if "Window [" not in line:
            continue
        keys = re.findall(r"\], \[([^\]]*)\], \[", line)[-1]
        if "_segment" not in keys and "of_sec" not in keys:
            below = "".join(lines[i + 1 : i + 7])
            assert re.search(r"Aggregate\(keys?=\[[^]]*_segment", below), line


@pytest.mark.parametrize("name", BATCH)
def test_single_partitions_hold_one_row_per_task(plan, name):
    text = plan(name)
    # One row per task is all that may meet in a single partition.
    for before, after in zip(text.split("\n"), text.split("\n")[1:]):
        if "Exchange SinglePartition" in before:
            assert "HashAggregate(keys=[], functions=[partial_" in after


@pytest.mark.parametrize("name", BATCH)
def test_only_the_user_function_leaves_the_jvm(plan, name):
    assert bool(re.search("Python|InArrow|InPandas", plan(name))) == (name in USER_FUNCTIONS)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("word_count", "text:string"),
        ("batch_counts", "ts:timestamp_ntz"),
        ("interval_message_count", "ts:timestamp_ntz,user_id:bigint"),
        ("message_filenames", "event_id:bigint,ts:timestamp_ntz"),
        ("effective_rate", "event_id:bigint,event_type:string,props:string"),
    ],
)
def test_only_needed_columns_are_read(plan, name, columns):
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(name))) == {columns}


@pytest.mark.parametrize("name", ["effective_rate", "generate_messages", "app_records", "throughput_decisions"])
def test_choice_of_changes_reaches_the_scan(plan, name):
    assert "EqualTo(event_type,signup)" in plan(name)


def test_limits_are_applied_before_the_shuffle(plan):
    assert "TakeOrderedAndProject(limit=500" in plan("log_tail")
    for name in ("batch_preview", "longest_delays"):
        assert re.search(r"WindowGroupLimit .*, Partial", plan(name)), name


@pytest.mark.parametrize("name", ["word_count", "batch_counts", "completed_delays", "file_listing_pauses", "scaling_curve"])
def test_groups_are_combined_before_the_shuffle(plan, name):
    assert re.search(r"HashAggregate\(keys=\[.+\], functions=\[partial_", plan(name))


# a series in spans: its rows, the ends of its spans, and these in order; decisions: two series, each over all kinds of rows
@pytest.mark.parametrize("name, at_most", [("throughput_decisions", 17), ("params_as_of", 3), ("overrun_report", 3), ("batch_counts", 1), ("param_patches", 3)])
def test_number_of_shuffles(plan, name, at_most):
    assert len(re.findall(r"Exchange (?:hash|range|Single)", plan(name))) <= at_most


def test_nothing_shuffles_whole_payloads(plan):
    """Polls and lines are reduced to a few numbers before they are ordered."""
    for line in plan("throughput_decisions").split("\n"):
        if "Exchange hash" in line:
            assert "payload" not in line and "line#" not in line


@pytest.mark.parametrize("name", ["batch_records", "app_records", "statistics_records", "completed_delays"])
def test_payloads_are_read_once(plan, name):
    assert plan(name).count("from_json(") == 1


@pytest.mark.parametrize("name", ["file_listing_pauses", "app_log_lines", "throughput_decisions"])
def test_lines_are_tested_where_they_are_made_once(plan, name):
    """A filter on a line would be moved below the making of the line, and make it again for every test in it."""
    assert not re.search(r"Filter .*RLIKE|Filter .*rlike", plan(name))
    assert plan(name).count("explode(array(CASE WHEN (Contains(line#") > 0


@pytest.mark.parametrize("name", ["throughput_decisions", "epoch_outcomes", "max_throughput"])
def test_rows_of_a_run_get_their_epoch_once(spark, name):
    """The series in order of epochs and the ends of its spans read one shuffle of the rows, so the tables are not read for each."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(re.findall("FileScan", text)) <= 6, text.count("FileScan")


def test_the_tag_of_an_event_is_read_once_for_its_poll(plan):
    assert plan("batch_records").count("get_json_object(") == 1
