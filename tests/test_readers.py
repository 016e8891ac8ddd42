"""Literal payloads: applications, batch lists, statistics, results, control messages; file rules."""

import json

from pyspark.sql import functions as F

from tidegauge.operators import files, params, scaling, telemetry
from tidegauge.sources import readers

APPS = [
    {
        "id": "local-1700000123456",
        "name": "gauge run",
        "attempts": [
            {
                "startTime": "2023-11-14T22:15:22.001GMT",
                "endTime": "1969-12-31T23:59:59.999GMT",
                "lastUpdated": "2023-11-14T22:15:22.001GMT",
                "duration": 0,
                "sparkUser": "someone",
                "completed": False,
                "startTimeEpoch": 1700000122001,
                "endTimeEpoch": -1,
                "lastUpdatedEpoch": 1700000122001,
            }
        ],
    }
]


def test_applications(spark):
    df = spark.createDataFrame([(1, json.dumps(APPS)), (2, "[]"), (3, "junk")], "fetch_id int, payload string")
    rows = readers.app_records(df).collect()
    assert [(r.fetch_id, r.app_id, r.completed, r.endTimeEpoch) for r in rows] == [(1, "local-1700000123456", False, -1)]


def batch(number, second, status, **more):
    return {"batchId": number, "batchTime": f"2023-11-14T22:20:{second:02d}.000GMT", "status": status, **more}


T0 = 1700000400  # 22:20:00


def fetches(spark):
    first = [batch(1, 10, "COMPLETED", totalDelay=100), batch(2, 15, "PROCESSING"), batch(3, 20, "QUEUED")]
    second = [
        batch(1, 10, "COMPLETED", totalDelay=999),
        batch(2, 15, "COMPLETED", totalDelay=200),
        batch(3, 20, "COMPLETED"),
        batch(4, 25, "COMPLETED", totalDelay=-5),
        batch(5, 30, "QUEUED"),
        batch(6, 35, "QUEUED"),
    ]
    rows = [(1, 7, json.dumps(first)), (2, 7, json.dumps(second)), (3, 8, "[]")]
    return readers.batch_records(spark.createDataFrame(rows, "fetch_id bigint, run_id bigint, payload string"))


def test_first_delay_of_a_batch_stays_and_missing_ones_are_skipped(spark):
    got = telemetry.completed_delays(fetches(spark)).orderBy("batch_ts").collect()
    assert [(r.batch_ts - T0, r.delay_ms) for r in got] == [(10, 100), (15, 200)]


def test_unfinished_batches(spark):
    latest = fetches(spark).where("fetch_id = 1")
    row = telemetry.unfinished_batches(latest, F.lit(T0 + 40).cast("bigint")).first()
    assert (row.queued, row.has_backlog, row.in_process_sec) == (1, False, 25)
    row = telemetry.unfinished_batches(fetches(spark).where("fetch_id = 2"), F.lit(T0).cast("bigint")).first()
    assert (row.queued, row.has_backlog, row.in_process_sec) == (2, True, 0)


def test_last_pause_of_a_second_stays(spark):
    rows = [
        (1, 7, "2023-05-06 07:08:10 INFO  FileInputDStream:54 - Finding new files took 61 ms"),
        (2, 7, "2023-05-06 07:08:10 INFO  FileInputDStream:54 - Finding new files took 99 ms"),
        (3, 7, "2023-05-06 07:08:11 INFO  Other:54 - Finding new files took 1 ms"),
        (4, 7, "2023-05-06 07:08:12 INFO  FileInputDStream:54 - something else"),
        (5, 7, "Finding new files took 7 ms"),
    ]
    df = spark.createDataFrame(rows, "line_no bigint, run_id bigint, line string")
    assert [(r.ts, r.pause_ms) for r in telemetry.listing_pauses(df).collect()] == [(1683356890, 99)]


def test_slow_listing_needs_more_than_two(spark):
    df = spark.createDataFrame([(r, i, p) for r, ps in {1: [4751] * 3, 2: [4751, 4751, 4750]}.items() for i, p in enumerate(ps)], "run_id bigint, ts bigint, pause_ms bigint")
    assert {r.run_id: (r.slow_listings, r.listing_limit) for r in telemetry.slow_listing_flags(df).collect()} == {
        1: (3, True), 2: (2, False),
    }


def test_statistics_payload(spark):
    body = {"startTime": "2023-11-14T22:20:00.250GMT", "batchDuration": 1000, "numProcessedRecords": 19, "avgInputRate": 0.95, "avgSchedulingDelay": 7, "avgProcessingTime": 110}
    row = readers.statistics_records(spark.createDataFrame([(1, json.dumps(body))], "fetch_id int, payload string")).first()
    assert (row.batchDuration, row.numProcessedRecords, row.avgInputRate, row.avgTotalDelay) == (1000, 19, 0.95, None)


def test_run_statistics_of_a_steady_run(spark):
    rows = [(1, 100 + i, "COMPLETED", 0 if i == 0 else 1, 7, 110) for i in range(20)] + [(1, 200, "PROCESSING", 9, 9, 9)]
    df = spark.createDataFrame(rows, "run_id bigint, batch_ts bigint, status string, records bigint, scheduling_ms bigint, processing_ms bigint")
    row = telemetry.run_statistics(df, batch_sec=1).first()
    assert (row.completed_batches, row.processed_records, row.active_batches) == (20, 19, 1)
    assert row.avg_input_rate == 0.95
    assert (row.avg_scheduling_ms, row.avg_processing_ms, row.avg_total_ms) == (7, 110, 117)


def test_run_statistics_without_a_completed_batch(spark):
    df = spark.createDataFrame([(1, 1, "QUEUED", 1, 1, 1)], "run_id bigint, batch_ts bigint, status string, records bigint, scheduling_ms bigint, processing_ms bigint")
    row = telemetry.run_statistics(df, batch_sec=1).first()
    assert (row.completed_batches, row.avg_input_rate, row.avg_total_ms) == (0, None, None)


def test_delay_stats_of_one_delay_have_no_spread(spark):
    df = spark.createDataFrame([(1, 1, 1500), (2, 1, 1000), (2, 2, 3000)], "run_id bigint, batch_ts bigint, delay_ms bigint")
    got = {r.run_id: (r.n, r.mean_sec, r.variance, r.stdev) for r in telemetry.delay_stats(df).collect()}
    assert got == {1: (1, 1.5, None, None), 2: (2, 2.0, 2.0, 1.4142)}


def test_benchmark_rows_and_durations(spark):
    lines = [
        "benchmarking,benchmark_full_pipeline,full,,1600000000.25,1600000080.75,80.5,-1",
        "benchmarking,simulator_no_flask,prepared_to_stream,,1,2,5.5,-1",
        "noise",
        "benchmarking,benchmark_full_pipeline,full,,1,2,1.0,-1",
        "benchmarking,short",
    ]
    rows = [(i, 1, 4, line) for i, line in enumerate(lines)] + [(9, 2, 5, lines[0])]
    parsed = readers.bench_rows(spark.createDataFrame(rows, "line_no bigint, run_id bigint, container_count int, line string"))
    first = parsed.where("line_no = 0").first()
    assert (first.duration_secs, first.description, first.number_of_bytes) == ("80.5", "", "-1")
    assert parsed.where("line_no = 4").first().duration_secs is None
    got = scaling.run_durations(parsed).collect()
    assert [(r.run_id, r.total, r.prepare) for r in got] == [(1, 80.5, 5.5)]
    back = readers.result_rows(scaling.printed_results(scaling.run_durations(parsed))).first()
    assert (back.total, back.prepare, back.container_count) == (80.5, 5.5, 4)


def test_control_messages_merge_over_defaults(spark):
    bodies = ['{"message_bytes": 500}', '{"cpu_pause_ms": 100, "period_sec": 0.2}', "{}", '{"cpu_pause_ms": 7}']
    rows = [(i, 1, i, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "event_id bigint, run_id bigint, s bigint, body string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = params.merged_params(readers.param_patches(df)).orderBy("event_id").collect()
    assert [(r.cpu_pause_ms, r.message_bytes, r.period_sec) for r in got] == [
        (20, 500, 1.0), (100, 500, 0.2), (100, 500, 0.2), (7, 500, 0.2),
    ]


NAMES = [".COPYING.1704067201_0000000001", "_SUCCESS", "1704067201_0000000007", "abc_1", "1704067202_0000000008"]


def test_file_rules(spark):
    df = spark.createDataFrame([(n, 100) for n in NAMES], "name string, mtime_s bigint")
    names = lambda d: sorted(r.name for r in d.collect())
    assert names(files.visible_files(df)) == sorted(NAMES[1:])
    # Ten seconds after the time in the name is too late; one second earlier is not.
    assert names(files.fresh_files(df, F.lit(1704067211))) == ["1704067202_0000000008"]
    assert names(files.fresh_files(df, F.lit(1704067210))) == [NAMES[2], NAMES[4]]
    assert names(files.unreadable_names(df)) == ["_SUCCESS", "abc_1"]
    assert files.expired_files(df, F.lit(160)).count() == 0
    assert names(files.expired_files(df, F.lit(161))) == sorted(NAMES[1:])
    assert files.new_files(df, F.lit(100)).count() == 5 and files.new_files(df, F.lit(101)).count() == 0
