"""One hand-made row for each line of the decision, and the order-dependent rules around it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import decisions as dec
from tidegauge.operators import params

POINT = "frequency bigint, n bigint, total_ms bigint, newest_ms bigint, slow_listings bigint, in_process_ms bigint"

# frequency, n, mean, latest, slow listings, in process -> rule, new frequency, reason
CASES = [
    ((10, 1, 100, 25_001, 0, 0), (1, 5, None)),
    ((10, 1, 100, 25_000, 0, 0), (10, 10, None)),
    ((1, 1, 100, 25_001, 0, 0), (10, 1, None)),
    ((1, 1, 100, 100, 0, 25_001), (1, 1, None)),
    ((5, 1, 100, 100, 0, 30_000), (1, 2, None)),
    ((10, 1, 100, 100, 3, 0), (2, 10, "LIMIT_FILE_LISTNG")),
    ((10, 1, 100, 100, 2, 0), (10, 10, None)),
    ((1, 1, 100, 100, 3, 0), (10, 1, None)),
    ((7, 6, 10_001, 100, 0, 0), (3, 3, None)),
    ((7, 5, 10_001, 100, 0, 0), (9, 3, None)),
    ((7, 3, 10_001, 100, 0, 0), (10, 7, None)),
    ((7, 4, 49, 49, 0, 0), (4, 350, None)),
    ((7, 4, 50, 50, 0, 0), (5, 35, None)),
    ((7, 4, 499, 499, 0, 0), (5, 35, None)),
    ((7, 4, 500, 500, 0, 0), (6, 13, None)),
    ((7, 4, 2_499, 2_499, 0, 0), (6, 13, None)),
    ((7, 4, 2_500, 2_500, 0, 0), (7, 8, None)),
    ((100, 4, 4_499, 4_499, 0, 0), (7, 104, None)),
    ((7, 4, 4_500, 4_500, 0, 0), (8, 7, "LIMIT_TOTAL_DELAY")),
    ((7, 4, 4_999, 4_999, 0, 0), (8, 7, "LIMIT_TOTAL_DELAY")),
    ((7, 4, 5_000, 5_000, 0, 0), (9, 3, None)),
    ((1, 4, 5_000, 5_000, 0, 0), (9, 1, None)),
    ((6_250_000, 4, 49, 49, 0, 0), (4, 312_500_000, None)),
    ((7, 3, 49, 49, 0, 0), (10, 7, None)),
]


def test_every_line_of_the_decision(spark):
    rows = [(i, f, n, mean * n, latest, slow, busy) for i, ((f, n, mean, latest, slow, busy), _) in enumerate(CASES)]
    points = spark.createDataFrame(rows, "i int, " + POINT)
    got = dec.decide(points).orderBy("i").collect()
    for (given, (rule, new, reason)), r in zip(CASES, got):
        assert (r.rule, r.new_frequency, r.reason) == (rule, new, reason), given
        assert r.ends_epoch == (reason is not None or new != given[0]), given


def test_growth_equals_the_same_steps_in_floats(spark):
    for rule_mean, factor in ((600, 1.75), (3_000, 1.03)):
        rates = spark.range(1, 3000).select(F.col("id").alias("frequency"), F.lit(4).alias("n"), F.lit(4 * rule_mean).alias("total_ms"), F.lit(1).alias("newest_ms"), F.lit(0).alias("slow_listings"), F.lit(0).alias("in_process_ms"))
        assert all(r.new_frequency == int(r.frequency * factor) + 1 for r in dec.decide(rates).collect())


def test_full_run_waits_longer(spark):
    points = spark.createDataFrame([(7, 13, 13, 1, 0, 0), (7, 14, 14, 1, 0, 0)], POINT)
    got = dec.decide(points, dec.WAIT_BATCHES_FULL).orderBy("n").collect()
    assert [r.rule for r in got] == [10, 4]


def changes_of(spark, *rows):
    df = spark.createDataFrame(list(rows), "change_id bigint, run_id bigint, us bigint, frequency bigint, message_bytes bigint")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def fetches_of(spark, *rows):
    """Polls from (fetch_id, run_id, seconds, [(batch second, status, delay), ...])."""

    def listed(sec, status, delay):
        time = f"1970-01-01T00:{sec // 60:02d}:{sec % 60:02d}.000GMT"
        return {"batchId": sec, "batchTime": time, "status": status} | ({} if delay is None else {"totalDelay": delay})

    full = [(i, run, round(at * 1e6), json.dumps([listed(*r) for r in found])) for i, run, at, found in rows]
    df = spark.createDataFrame(full, "fetch_id bigint, run_id bigint, us bigint, payload string")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def lines_of(spark, *rows):
    """Listing lines from (line_no, run_id, second, ms) and an optional time of arrival."""
    text = "1970-01-01 00:{:02d}:{:02d} INFO  FileInputDStream:54 - Finding new files took {} ms"
    full = [(i, run, round((at[0] if at else sec) * 1e6), text.format(sec // 60, sec % 60, ms)) for i, run, sec, ms, *at in rows]
    df = spark.createDataFrame(full, "line_no bigint, run_id bigint, us bigint, line string")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


DONE = "COMPLETED"


def decided(*tables, **kwargs):
    rows = dec.throughput_decisions(*tables, **kwargs).orderBy("poll_us", "fetch_id").collect()
    return [(r.fetch_id, r.frequency, r.n, r.total_ms, r.latest_ms, r.slow_listings, r.rule) for r in rows]


def test_warm_up_is_strict_and_epochs_start_over(spark):
    changes = changes_of(spark, (1, 7, 100_000_000, 10, 64), (2, 7, 200_500_000, 20, 64))
    polls = fetches_of(
        spark,
        (1, 7, 101, [(99, DONE, 1)]),  # before any change
        (2, 7, 114, [(113, DONE, 2)]),  # exactly at the end of the warm-up
        (3, 7, 115, [(114, DONE, 3)]),
        (4, 7, 151, [(150, "PROCESSING", 9)]),
        (5, 7, 160.5, [(160, DONE, None)]),
        (6, 7, 161, [(160, DONE, 5), (114, DONE, 99)]),  # the first known delay of a batch stays
        (7, 7, 162, [(160, DONE, 6)]),
        (8, 7, 200.4, [(200, DONE, 7)]),
        (9, 7, 214, [(213, DONE, 8)]),  # the change came half a second after 200
        (10, 7, 215, [(214, DONE, 9)]),
        (11, 7, 301, [(300, DONE, -1)]),
    )
    lines = lines_of(spark, (1, 7, 113, 9_999), (2, 7, 160, 4_751), (3, 7, 161, 4_750), (4, 7, 214, 9_999))
    assert decided(changes, lines, polls) == [
        (3, 10, 1, 3, 3, 0, 10), (4, 10, 1, 3, 3, 0, 10), (5, 10, 1, 3, 3, 1, 10), (6, 10, 2, 8, 5, 1, 10), (7, 10, 2, 8, 5, 1, 10),
        (8, 10, 3, 15, 7, 1, 10), (10, 20, 1, 9, 9, 1, 10), (11, 20, 1, 9, 9, 1, 10),
    ]


def test_a_hanging_batch_is_cut_though_nothing_else_ends(spark):
    changes = changes_of(spark, (1, 7, 10_000_000, 10, 64))
    polls = fetches_of(
        spark,
        (1, 7, 31, [(30, DONE, 100)]),
        (2, 7, 60, [(35, "PROCESSING", None)]),  # 25 s old: not yet
        (3, 7, 60.000001, [(35, "PROCESSING", None)]),
        (4, 7, 70, [(35, "PROCESSING", None), (40, "QUEUED", None)]),
        (5, 7, 80, []),
    )
    assert [row[0::6] for row in decided(changes, lines_of(spark, (1, 9, 1, 1)), polls)] == [(1, 10), (2, 10), (3, 1), (4, 1), (5, 10)]


def test_without_a_known_delay_nothing_is_decided(spark):
    changes = changes_of(spark, (1, 7, 10_000_000, 10, 64))
    polls = fetches_of(spark, (1, 7, 100, [(35, "PROCESSING", None)]), (2, 8, 100, [(90, DONE, 1)]))
    assert decided(changes, lines_of(spark, (1, 7, 60, 9_999)), polls) == []


def test_a_later_poll_alters_no_earlier_decision(spark):
    changes = changes_of(spark, (1, 7, 10_000_000, 10, 64))
    polls = [(i, 7, at, [(s, DONE, 400 + at) for s in range(30, at, 5)]) for i, at in enumerate((36, 41, 46, 51, 56))]
    polls += [(9, 7, 51, [(20, "PROCESSING", None), (30, DONE, 1)])]  # at the moment of another poll, after it
    lines = [(1, 7, 40, 9_999, 40.1), (2, 7, 40, 10, 40.9), (3, 7, 44, 10, 44.0), (4, 7, 44, 5_000, 47.0)]
    all_polls, all_lines = fetches_of(spark, *polls), lines_of(spark, *lines)
    whole = decided(changes, all_lines, all_polls)
    assert [row[0] for row in whole] == [0, 1, 2, 3, 9, 4]
    assert [row[5] for row in whole] == [0, 0, 0, 1, 1, 1]
    for at in (36, 41, 46, 51, 56):
        known = decided(changes, all_lines.where(F.col("ts") <= F.timestamp_seconds(F.lit(at))), all_polls.where(F.col("ts") <= F.timestamp_seconds(F.lit(at))))
        assert known == whole[: len(known)] and known


def test_the_last_of_several_changes_at_one_moment_counts(spark):
    changes = changes_of(spark, (2, 7, 100_000_000, 20, 64), (1, 7, 100_000_000, 10, 64), (3, 7, 99_999_999, 30, 64))
    assert decided(changes, lines_of(spark, (1, 9, 1, 1)), fetches_of(spark, (1, 7, 121, [(120, DONE, 1)])))[0][:3] == (1, 20, 1)


def test_what_comes_too_late_is_left_out(spark):
    changes = changes_of(spark, (1, 7, 10_000_000, 10, 64))
    polls = fetches_of(spark, (1, 7, 60, [(30, DONE, 1)]), (2, 7, 61, [(31, DONE, 1)]), (3, 7, 62, [(30, DONE, 1), (32, DONE, 1)]))
    assert [row[:3] for row in decided(changes, lines_of(spark, (1, 9, 1, 1)), polls, keep_sec=30)] == [(1, 10, 1), (2, 10, 2), (3, 10, 3)]
    assert [row[:3] for row in decided(changes, lines_of(spark, (1, 9, 1, 1)), polls, keep_sec=29)] == []


def loop(changes, lines, polls, warmup=13, wait=dec.WAIT_BATCHES):
    """The decision as a plain loop over the polls of a run, with dictionaries that grow."""
    delays, out = {}, []
    for fetch_id, _, now, found in sorted(polls, key=lambda p: (p[2], p[0])):
        in_process = 0
        for sec, status, delay in found:
            if status == "PROCESSING":
                in_process = max(in_process, now - sec)
            if status == DONE and delay is not None and delay >= 0:
                delays.setdefault(sec, delay)
        pauses = {}
        for line_no, _, sec, ms, *at in sorted(lines, key=lambda r: (r[4] if len(r) > 4 else r[2], r[0])):
            if (at[0] if at else sec) <= now:
                pauses[sec] = ms
        past = [c for c in changes if c[2] / 1e6 <= now]
        if not past:
            continue
        _, _, us, f, _ = max(past, key=lambda c: (c[2], c[0]))
        recent = {t: d for t, d in delays.items() if t > us / 1e6 + warmup}
        if not recent:
            continue
        slow = sum(t > us / 1e6 + warmup and ms > 4_750 for t, ms in pauses.items())
        n, total, latest = len(recent), sum(recent.values()), recent[max(recent)]
        mean = total / n
        if f > 1 and latest > 25_000 or in_process > 25:
            rule = 1
        elif f > 1 and slow > 2:
            rule = 2
        elif n > 5 and mean > 10_000:
            rule = 3
        elif n > wait:
            rule = next((r for r, limit in ((4, 50), (5, 500), (6, 2_500), (7, 4_500), (8, 5_000)) if mean < limit), 9)
        else:
            rule = 10
        out.append((fetch_id, f, n, total, latest, slow, rule))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    changes = [(i, 7, rng.randrange(0, 900_000_000), rng.randrange(1, 30), 64) for i in range(12)]
    scale = rng.choice([10, 1_000, 8_000, 30_000])
    polls = []
    for i in range(150):
        at = rng.randrange(5_000, 900_000) / 1000
        shown = [(s, rng.choice([DONE] * 6 + ["QUEUED", "PROCESSING"]), rng.choice([None, -1, rng.randrange(scale), rng.randrange(scale)])) for s in range(max(0, int(at) // 5 * 5 - 60), int(at), 5)]
        polls.append((i, 7, at, rng.sample(shown, min(len(shown), 6))))
    lines = [(i, 7, s, rng.choice([100, 9_000]), s + rng.randrange(900) / 1000) for i, s in enumerate(rng.choices(range(900), k=120))]
    assert decided(changes_of(spark, *changes), lines_of(spark, *lines), fetches_of(spark, *polls)) == loop(changes, lines, polls)


def test_first_decision_ends_an_epoch_and_best_rate_per_size(spark):
    schema = "run_id bigint, poll_us bigint, fetch_id bigint, change_us bigint, frequency bigint, message_bytes bigint, rule int, new_frequency bigint, reason string, ends_epoch boolean"
    rows = [
        (1, 5, 5, 0, 10, 64, 10, 10, None, False),
        (1, 6, 6, 0, 10, 64, 8, 10, "LIMIT_TOTAL_DELAY", True),
        (1, 7, 7, 0, 10, 64, 9, 5, None, True),
        (1, 8, 8, 9, 30, 64, 9, 15, None, True),
        (2, 6, 6, 0, 20, 64, 2, 20, "LIMIT_FILE_LISTNG", True),
        (3, 6, 6, 0, 5, 128, 8, 5, "LIMIT_TOTAL_DELAY", True),
    ]
    outcomes = dec.epoch_outcomes(spark.createDataFrame(rows, schema))
    assert sorted((r.run_id, r.change_us, r.poll_us, r.rule) for r in outcomes.collect()) == [
        (1, 0, 6, 8), (1, 9, 8, 9), (2, 0, 6, 2), (3, 0, 6, 8),
    ]
    best = [tuple(r) for r in dec.max_throughput(outcomes).collect()]
    assert best == [(128, "LIMIT_TOTAL_DELAY", 5, 640), (64, "LIMIT_FILE_LISTNG", 20, 1280)]


@pytest.mark.parametrize("cut", [{}, {"span": 7}])
def test_settings_as_of(spark, cut):
    changes = changes_of(spark, (1, 7, 10, 100, 64), (2, 7, 2_000_000, 200, 72), (3, 8, 5, 300, 80))
    sent = spark.createDataFrame(
        [(i, s, us) for i, (s, us) in enumerate([(7, 9), (7, 10), (7, 1_999_999), (7, 2_000_000), (8, 9_000_000), (9, 1), (7, 2_900_000)])],
        "msg_id bigint, source_id bigint, us bigint",
    ).withColumn("ts", F.timestamp_micros("us"))
    got = {r.msg_id: r.frequency for r in params.params_as_of(sent, changes, **cut).collect()}
    assert got == {0: None, 1: 100, 2: 100, 3: 200, 4: 300, 5: None, 6: 200}
    # Looking once per second: the second message of a second keeps what the first one found.
    held = {r.msg_id: r.frequency for r in params.params_as_of(sent, changes, hold_sec=1, **cut).collect()}
    assert held == {0: None, 1: None, 2: 100, 3: 200, 4: 300, 5: None, 6: 200}
