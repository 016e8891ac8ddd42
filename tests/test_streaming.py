"""Streams: live triggers, generators, sinks, progress, and state that survives repeats."""

import glob
import os
import random
import time
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import decisions, generate, lines
from tidegauge.plans.queries import QUERIES
from tidegauge.sources import directory, folders, readers, tables
from tidegauge.streaming import epochs, late, progress, runs, sinks, tail, windows, wins

SF_DIR = "/root/testdata/sf0.001"


def test_generated_stream_feeds_a_live_query_and_its_progress(spark, tmp_path):
    log = progress.ProgressLog(spark, str(tmp_path / "events"))
    spark.streams.addListener(log)
    try:
        stream = generate.message_stream(spark, rows_per_batch=50, message_bytes=100, partitions=2)
        query = runs.start_live(sinks.cost_per_batch(stream, str(tmp_path / "out")), str(tmp_path / "check"), interval_sec=1)
        deadline = time.time() + 60
        while (query.lastProgress is None or query.lastProgress["batchId"] < 2) and time.time() < deadline:
            time.sleep(0.2)
        query.stop()
        log.wait_for([query])
    finally:
        spark.streams.removeListener(log)
    kept = sinks.kept_batches(spark, str(tmp_path / "out")).collect()
    assert len(kept) >= 2 and all((r.n, r.cost_ms) == (50, 50 * 20) for r in kept)
    records = log.records(interval_sec=1).collect()
    assert len(records) >= 2 and all(r.total_delay_ms == r.scheduling_ms + r.processing_ms for r in records)
    assert {"started", "progress", "terminated"} <= {r.kind for r in log.events().collect()}


def test_terminated_event_holds_the_error(spark, tmp_path):
    log = progress.ProgressLog(spark, str(tmp_path / "events"))
    spark.streams.addListener(log)
    try:
        def fail(batch, batch_id):
            raise ValueError("broken action")

        stream = generate.message_stream(spark, rows_per_batch=1)
        query = runs.start_live(sinks.for_each_batch(stream, fail), str(tmp_path / "check"), interval_sec=1)
        with pytest.raises(Exception, match="broken action"):
            query.awaitTermination(60)
        log.wait_for([query])
    finally:
        spark.streams.removeListener(log)
    ended = log.events().where("kind = 'terminated'").collect()
    assert "broken action" in ended[0].body


def test_lag_of_a_batch_that_starts_late(spark):
    starts = [("00:00:00", 0, 27_000), ("00:00:27", 1, 100), ("00:00:30", 2, 100)]
    rows = [
        (f'{{"id":"q","batchId":{n},"timestamp":"2024-01-01T{t}.000Z","numInputRows":1,"durationMs":{{"triggerExecution":{ms}}}}}',)
        for t, n, ms in starts
    ]
    found = progress.progress_records(spark.createDataFrame(rows, "body string"), interval_sec=5).orderBy("batch_id").collect()
    assert [(r.scheduling_ms, r.total_delay_ms) for r in found] == [(0, 27_000), (22_000, 22_100), (0, 100)]


def test_missing_state_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([], decisions.TIMELINE)
    with pytest.raises(FileNotFoundError):
        epochs.EpochOutcomes(str(tmp_path))(rows, 3)


def test_line_stream_sees_names_and_skips_hidden_files(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("100_0000000001", ".COPYING.100_0000000002", "_note"):
        (inbox / name).write_text("C000007-F\nbad\n")
    stream = lines.parse_cost(readers.read_line_stream(spark, "text", path=str(inbox)))
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    runs.run_available(writer, str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.file_name, r.line, r.cpu_pause_ms) for r in got) == [
        ("100_0000000001", "C000007-F", 7), ("100_0000000001", "bad", None),
    ]
    assert all(r.file_mtime_s > 0 for r in got)


def test_unknown_kind_of_stream(spark):
    with pytest.raises(ValueError):
        readers.read_line_stream(spark, "letters")


def test_console_preview_runs(spark, tmp_path):
    stream = generate.message_stream(spark, rows_per_batch=20)
    query = runs.start_live(sinks.console_preview(stream.select("name")), str(tmp_path), interval_sec=1)
    try:
        for _ in range(100):
            if query.lastProgress is not None:
                break
            time.sleep(0.2)
        assert query.lastProgress is not None and query.exception() is None
    finally:
        query.stop()


def test_published_files_are_complete_or_absent(spark, tmp_path):
    df = spark.range(1000).select(F.concat(F.lit("C000001-F"), F.col("id").cast("string")).alias("line"))
    sinks.publish_messages(df, str(tmp_path / "out"))
    sinks.publish_messages(df, str(tmp_path / "out"))
    assert not [p for p in glob.glob(str(tmp_path / "out" / "*")) if os.path.basename(p).startswith("_temporary")]
    assert readers.read_lines(spark, str(tmp_path / "out")).count() == 2000


def test_time_slices_cover_every_row_once(spark):
    rows = tables.messages(spark, SF_DIR)
    parts = [p.select("msg_id") for p in runs.time_slices(rows, 3)]
    assert sum(p.count() for p in parts) == rows.count()
    assert all(p.count() > 0 for p in parts)
    nothing = [p.count() for p in runs.time_slices(rows.where("msg_id < 0"), 2)]
    assert nothing == [0, 0]


def feed_of(spark):
    return epochs.observations(
        tables.changes(spark, SF_DIR), tables.log_lines(spark, SF_DIR), tables.batch_payloads(spark, SF_DIR)
    )


def expected_outcomes(spark):
    return sorted(map(tuple, QUERIES["epoch_outcomes"](spark, SF_DIR).collect()), key=str)


def streamed(spark, slices, root, twice=False, **kwargs):
    """Outcomes of a stream that gets slice after slice of a raw feed; ``twice`` repeats each micro-batch's action."""
    action = epochs.EpochOutcomes(f"{root}/state")

    def act(rows, batch_id):
        action(rows, batch_id)
        if twice:
            again = spark.read.schema(decisions.TIMELINE).parquet(action._path("timeline", batch_id)).collect()
            action(spark.createDataFrame(again, decisions.TIMELINE), batch_id)

    def start():
        stream = spark.readStream.schema(epochs.OBSERVATIONS).parquet(f"{root}/in/*")
        return sinks.for_each_batch(epochs.timeline(stream, **kwargs), act)

    runs.replay(iter(slices), lambda part, number: part.write.parquet(f"{root}/in/slice-{number}"), start, f"{root}/check")
    return action


def test_repeated_batches_and_repeated_telemetry_change_nothing(spark, tmp_path):
    slices = list(runs.time_slices(feed_of(spark), 3))
    # Every slice also brings the telemetry of the slice before once more, as if fetched again.
    shifted = [slices[0]]
    for before, part in zip(slices, slices[1:]):
        first = part.agg(F.min("ts")).first()[0]
        again = before.where("kind <> 'change'").where(F.col("ts") >= F.lit(first - timedelta(hours=12))).where("kind = 'fetch'")
        again = again.withColumns({"ts": F.lit(first), "id": F.lit(0).cast("bigint"), "payload": F.regexp_replace("payload", "PROCESSING", "WAITING")})
        shifted.append(part.unionByName(again))
    batch = shifted[0].unionByName(shifted[1]).unionByName(shifted[2])
    kind = F.col("kind")
    whole = decisions.throughput_decisions(
        batch.where(kind == "change").withColumnRenamed("id", "change_id"),
        batch.where(kind == "log").withColumnRenamed("id", "line_no"),
        batch.where(kind == "fetch").withColumnRenamed("id", "fetch_id"),
    )
    expected = sorted(map(tuple, decisions.epoch_outcomes(whole).collect()), key=str)
    action = streamed(spark, shifted, str(tmp_path), twice=True, bucket_sec=7 * 86_400)
    assert sorted(map(tuple, action.outcomes(spark).collect()), key=str) == expected


def test_many_slices_equal_the_batch_replay(spark, tmp_path):
    action = streamed(spark, runs.time_slices(feed_of(spark), 4), str(tmp_path))
    assert sorted(map(tuple, action.outcomes(spark).collect()), key=str) == expected_outcomes(spark)
    # old state goes
    kept = sorted(int(n.split("=")[1]) for n in os.listdir(tmp_path / "state" / "state"))
    assert len(kept) == 2 and kept[1] == kept[0] + 1


OBSERVED = "run_id bigint, us bigint, kind string, id bigint, frequency bigint, message_bytes bigint, line string, payload string"


def observed(spark, rows):
    df = spark.createDataFrame([(7, round(at * 1e6), *rest) for at, *rest in rows], OBSERVED)
    return df.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us").select(*[c.split()[0] for c in epochs.OBSERVATIONS.split(", ")])


def poll(at, number, *batches):
    body = ",".join(f'{{"batchId":{s},"batchTime":"1970-01-01T00:{s // 60:02d}:{s % 60:02d}.000GMT","status":"COMPLETED","totalDelay":{d}}}' for s, d in batches)
    return (at, "fetch", number, None, None, None, f"[{body}]")


def listing(at, number, ms):
    sec = int(at)
    return (at, "log", number, None, None, f"1970-01-01 00:{sec // 60:02d}:{sec % 60:02d} INFO  FileInputDStream:54 - Finding new files took {ms} ms", None)


CHANGE = (10, "change", 1, 10, 64, None, None)


def test_state_keeps_the_epoch_open_across_batches(spark, tmp_path):
    """Four delays in four micro-batches make the fifth rule fire in the last one only; batches listed again do not count again."""
    seen = [(20, 9), (30, 400), (40, 400), (50, 400), (60, 400), (70, 400)]
    slices = [[CHANGE, poll(31, 1, *seen[:2])]] + [[poll(s + 1, i, *seen[: i + 1], (30, 99_999))] for i, (s, _) in enumerate(seen) if i > 1]
    action = streamed(spark, [observed(spark, rows) for rows in slices], str(tmp_path))
    # The batch at 20 lies in the warm-up of the change at 10, so the fourth delay is that of 60.
    assert [(r.poll_us, r.rule, r.new_frequency) for r in action.outcomes(spark).collect()] == [(61_000_000, 5, 50)]


def test_delays_fetched_long_after_their_time_count(spark, tmp_path):
    """Log lines come first, then six batches are fetched forty seconds late."""
    slices = [
        [CHANGE, *[listing(t, t, 10) for t in range(30, 80, 5)]],
        [poll(72 + i, i, *[(s, 400) for s in range(30, 35 + 5 * i, 5)]) for i in range(6)],
    ]
    action = streamed(spark, [observed(spark, rows) for rows in slices], str(tmp_path))
    assert [(r.poll_us, r.rule) for r in action.outcomes(spark).collect()] == [(75_000_000, 5)]


def test_the_last_line_of_a_second_counts_across_batches(spark, tmp_path):
    """Three slow listings would stop the run, but the last word of one second takes it back, in the next micro-batch."""
    slices = [
        [CHANGE, *[listing(t + 0.1, t, 9_000) for t in (30, 31, 32)], poll(32.05, 1, (25, 5_000))],
        [listing(32.5, 33, 10), poll(33, 2, (25, 5_000)), listing(40.2, 40, 9_000), poll(41, 3, (25, 5_000))],
    ]
    action = streamed(spark, [observed(spark, rows) for rows in slices], str(tmp_path))
    assert [(r.poll_us, r.rule, r.reason) for r in action.outcomes(spark).collect()] == [(41_000_000, 2, "LIMIT_FILE_LISTNG")]


def test_known_telemetry_is_forgotten_once_no_arrival_can_count(spark, tmp_path):
    polls = [[poll(60, 1, (30, 1))], [poll(70, 2, (30, 2), (65, 3))], [poll(3_000, 3, (2_990, 4))], [poll(3_010, 4, (30, 5), (2_990, 6))]]
    schema = "fetch_id bigint, run_id bigint, ts timestamp_ntz, payload string"

    def deliver(part, number):
        part.select(F.col("id").alias("fetch_id"), "run_id", "ts", "payload").write.parquet(f"{tmp_path}/in/slice-{number}")

    def start():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        found = wins.first_delays(stream, keep_sec=100, lateness="10 seconds", bucket_sec=50)
        return sinks.keep_batches(found, f"{tmp_path}/out", lambda batch: batch)

    queries = runs.replay(iter([observed(spark, rows) for rows in polls]), deliver, start, f"{tmp_path}/check")
    got = sinks.kept_batches(spark, f"{tmp_path}/out").collect()
    assert sorted((r.batch_ts, r.delay_ms) for r in got) == [(30, 1), (65, 3), (2_990, 4)]
    assert queries[-1].recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def told_one_by_one(held, rows, kind):
    """What ``wins._standing`` does, row by row; a run is (no_run, run)."""
    held, found = {r[:3]: r for r in held}, []
    for row in sorted(rows, key=lambda r: r[3:5]):
        old = held.get(row[:3])
        if old is not None and (kind == decisions.DELAY or row[3:5] <= old[3:5]):
            continue
        held[row[:3]] = row
        change = row[5] - (old[5] if old is not None and kind == decisions.PAUSE else 0)
        if kind == decisions.DELAY or change:
            found.append((*row[:5], change))
    return sorted(held.values()), sorted(found)


@pytest.mark.parametrize("kind", [decisions.DELAY, decisions.PAUSE])
def test_what_stands_is_found_in_whole_columns_as_row_by_row(kind):
    deal = random.Random(7)
    held = np.zeros((0, 6), np.int64)
    for size in (0, 1, 60, 0, 200, 40):
        rows = []
        for _ in range(size):
            no_run, at = deal.randrange(2), (deal.randrange(30), deal.choice([-(1 << 63), 0, 1]))
            # a value depends on the line alone, as repeated lines are equal
            rows.append((no_run, 0 if no_run else deal.randrange(3), deal.randrange(5), *at, hash(at) % 2 if kind == decisions.PAUSE else hash(at) % 9))
        expected = told_one_by_one([tuple(r) for r in held.tolist()], rows, kind)
        held, found = wins._standing(held, np.array(rows, np.int64).reshape(-1, 6), kind)
        assert (sorted(map(tuple, held.tolist())), sorted(map(tuple, found.tolist()))) == expected


def test_delays_of_runs_without_a_number(spark, tmp_path):
    rows = observed(spark, [poll(60, 1, (30, 1)), poll(61, 2, (30, 2))])
    rows = rows.unionByName(rows.withColumn("run_id", F.lit(0).cast("bigint"))).unionByName(rows.withColumn("run_id", F.lit(None).cast("bigint")))
    rows.select(F.col("id").alias("fetch_id"), "run_id", "ts", "payload").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("fetch_id bigint, run_id bigint, ts timestamp_ntz, payload string").parquet(f"{tmp_path}/in")
    runs.run_available(sinks.keep_batches(wins.first_delays(stream), f"{tmp_path}/out", lambda batch: batch), f"{tmp_path}/check")
    got = sinks.kept_batches(spark, f"{tmp_path}/out").collect()
    assert sorted(((r.run_id, r.batch_ts, r.delay_ms) for r in got), key=str) == [(0, 30, 1), (7, 30, 1), (None, 30, 1)]


def test_micro_batches_do_not_take_all_shuffle_partitions(spark, tmp_path):
    """Spark turns adaptive execution off for streams with state, so 300 runs used to be dealt over every shuffle partition in each step."""
    files = {}

    def act(rows, batch_id):
        rows.sparkSession.conf.set("spark.sql.shuffle.partitions", "40")
        rows.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
        action(rows, batch_id)
        assert rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "false"
        files[batch_id] = glob.glob(f"{tmp_path}/state/state/batch_id={batch_id}/*.parquet")

    action = epochs.EpochOutcomes(f"{tmp_path}/state")
    changes = spark.range(300).select(F.col("id").alias("change_id"), F.col("id").alias("run_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit(1).alias("frequency"), F.lit(64).alias("message_bytes"))
    decisions.change_rows(changes).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(decisions.TIMELINE).parquet(f"{tmp_path}/in")
    runs.run_available(sinks.for_each_batch(stream, act), f"{tmp_path}/check")
    assert spark.read.schema(epochs.STATE).parquet(*files[0]).count() == 300
    assert len(files[0]) < 10


def test_directory_source_takes_new_fresh_files_and_names_the_strange_ones(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    now = int(time.time())

    def put(name, old=False):
        (inbox / name).write_text(f"from {name}\nsecond line\n")
        if old:
            os.utime(inbox / name, (now - 500, now - 500))

    for name in ("200_1", "150_1", "95_1", ".COPYING.200_2", "notes", "x_200"):
        put(name)
    put("201_old", old=True)
    put("strange-old", old=True)

    def start():
        lines = directory.directory_lines(spark, str(inbox), directory.fresh_by_name(F.lit(105)), start_s=now - 100)
        return directory.to_two_sinks(lines, str(tmp_path / "lines"), str(tmp_path / "strange"))

    runs.run_available(start(), str(tmp_path / "check"))
    put("300_1")
    put("more")
    runs.run_available(start(), str(tmp_path / "check"))
    runs.run_available(start(), str(tmp_path / "check"))
    lines = sinks.kept_batches(spark, str(tmp_path / "lines")).collect()
    assert sorted((r.batch_id, r.name, r.line) for r in lines) == [
        (n, name, line) for n, name in ((0, "150_1"), (0, "200_1"), (1, "300_1")) for line in (f"from {name}", "second line")
    ]
    strange = sinks.kept_batches(spark, str(tmp_path / "strange")).collect()
    assert sorted((r.batch_id, r.name) for r in strange) == [(0, "notes"), (0, "x_200"), (1, "more")]


def test_directory_source_with_another_predicate_and_no_start(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("a.log", "b.txt"):
        (inbox / name).write_text("one\n")
        os.utime(inbox / name, (1_000, 1_000))
    lines = directory.directory_lines(spark, str(inbox), lambda name: name.endswith(".log"))
    runs.run_available(directory.to_two_sinks(lines, str(tmp_path / "lines"), str(tmp_path / "strange")), str(tmp_path / "check"))
    assert [(r.name, r.line) for r in spark.read.parquet(str(tmp_path / "lines")).collect()] == [("a.log", "one")]
    assert spark.read.parquet(str(tmp_path / "strange")).isEmpty()


def test_published_files_have_their_own_names(spark, tmp_path):
    df = spark.createDataFrame([("a b%c", "1"), ("100_1", "2"), ("100_1", "3")], "name string, line string")
    paths = sinks.publish_files(df, str(tmp_path / "out"))
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == ["100_1", "a b%c"]
    got = spark.read.text(str(tmp_path / "out")).select("_metadata.file_path", "value").collect()
    assert sorted(r.value for r in got) == ["1", "2", "3"]
    assert (tmp_path / "out" / "a b%c").read_text() == "1\n"
    with pytest.raises(FileExistsError):
        folders.move(spark, paths[0], paths[1])


def test_newest_rows_of_all_that_arrived(spark, tmp_path):
    action = tail.NewestRows(str(tmp_path / "kept"), [F.desc("at"), F.desc("id")], 5)
    parts, seen = [[(5, 1), (9, 2), (1, 3)], [], [(7, 4), (9, 5), (2, 6), (None, 7), (8, 8), (3, 9)], [(1, 10)], [(99, 11)]], []
    for number, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "at bigint, id bigint")
        seen += rows
        action(df, number)
        action(df, number)
        kept = action.kept(spark).where(F.col("batch_id") == number).collect()
        order = sorted(seen, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)[:5]
        assert sorted((r.at, r.id) for r in kept if r.at is not None) == sorted(r for r in order if r[0] is not None)
        assert len(kept) == len(order)
    with pytest.raises(FileNotFoundError):
        action(df, 9)


def test_late_rows_are_those_that_windows_drop(spark, tmp_path):
    parts = [[100, 3_000, 7_300], [3_500, 3_599, 3_600, 7_000, 20_000], [7_199, 12_599, 12_600, 16_400, 16_399, 19_000], [10, 16_500, 40_000]]
    slices = [spark.createDataFrame([(s,) for s in part], "s bigint").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")) for part in parts]
    action = late.LateRows(str(tmp_path / "late"), 3600, 3600)

    def feed(name, writer):
        def deliver(part, number):
            part.write.parquet(f"{tmp_path}/{name}/slice-{number}")

        def start():
            return writer(spark.readStream.schema("ts timestamp_ntz").parquet(f"{tmp_path}/{name}/*"))

        runs.replay(iter(slices), deliver, start, f"{tmp_path}/{name}-check")

    feed("ours", lambda stream: sinks.for_each_batch(stream, action))
    feed("windows", lambda stream: sinks.keep_batches(windows.windowed_counts(stream, "1 hour", "1 hour"), f"{tmp_path}/out", lambda b: b, mode="update"))
    counted = {r.batch_start_s: r.n for r in windows.newest_counts(sinks.kept_batches(spark, f"{tmp_path}/out")).collect()}
    totals = action.totals(spark).collect()
    assert {r.batch_start_s: r.n for r in totals if not r.is_late} == counted
    assert sum(r.n for r in totals) == sum(map(len, parts))
    assert action.late_rows(spark).count() == sum(r.n for r in totals if r.is_late) > 0


def test_late_rows_repeat_and_rows_without_a_time(spark, tmp_path):
    action = late.LateRows(str(tmp_path / "late"), 10, 5)
    def rows(*seconds):
        return spark.createDataFrame([(s,) for s in seconds], "s bigint").select(F.timestamp_seconds("s").alias("ts"))
    for _ in range(2):
        action(rows(100, None, 1), 0)
    for _ in range(2):
        action(rows(89, 90, 200), 1)
    action(rows(), 2)
    found = sorted((r.batch_start_s, r.is_late, r.n) for r in action.totals(spark).collect() if r.batch_start_s is not None)
    assert found == [(0, False, 1), (80, True, 1), (90, False, 1), (100, False, 1), (200, False, 1)]
    assert action.late_rows(spark).count() == 2
    with pytest.raises(FileNotFoundError):
        action(rows(1), 9)
