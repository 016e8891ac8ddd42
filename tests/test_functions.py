"""Edge rows of the parsing and rendering rules."""

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import logs, messages as msg, times
from tidegauge.operators import generate, lines, words
from tidegauge.sources import readers


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


COSTS = {
    "C000123-F": 123,
    "C00": 0,
    "C 12   -": 12,
    "C-00005-": -5,
    "C1234567-F": 123456,
    "": None,
    "Cabcdef-": None,
    "C1e3   -": None,
    "C12.5  -": None,
}


def test_cost_tag(spark):
    assert column(spark, COSTS, msg.cost_ms) == list(COSTS.values())


def test_user_function_agrees_with_the_built_in_form(spark):
    df = spark.createDataFrame([(k,) for k in COSTS], "line string")
    both = lines.map_lines(lines.parse_cost(df), lines.cost_by_slicing(), "int", "by_function")
    assert all(r.cpu_pause_ms == r.by_function for r in both.collect())


def test_bad_costs_are_set_aside(spark):
    df = spark.createDataFrame([(k,) for k in COSTS], "line string")
    assert lines.bad_cost_lines(df).count() == sum(v is None for v in COSTS.values())


@pytest.mark.parametrize("line", ["a b", "a  b", "", " lead", "trail ", "   "])
def test_words_like_python_split(spark, line):
    assert column(spark, [line], words.words_of) == [line.split(" ")]


def test_word_count_keeps_empty_words(spark):
    df = spark.createDataFrame([("a  b\n\n a",), ("",), (None,)], "text string")
    counts = {r.word: r.n for r in words.word_count(df, words.words_of_text(F.col("text"))).collect()}
    assert counts == {"a": 2, "b": 1, "": 4}


LOG_LINES = [
    "2023-05-06 07:08:05 INFO  file-streaming-app:76 - a first note\n",
    "2023-05-06 07:08:10 INFO  FileInputDStream:54 - Finding new files took 61 ms",
    "",
    " bla bla",
    "2023-05-06 07:08:10 INFO  FileInputDStream:54 - a: b - c:1 - d\r\n",
    "2023-99-06 07:08:10 WARN x y:1 - m",
]


def test_log_fields(spark):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(LOG_LINES)], "i int, line string")
    rows = readers.log_records(df).orderBy("i").collect()
    first, listing, *junk, tail, bad_time = rows
    assert (first.timestamp_str, first.level, first.logger_name, first.linenumber, first.message) == (
        "2023-05-06 07:08:05", "INFO", "file-streaming-app", "76", "a first note",
    )
    assert first.timestamp_unix == 1683356885
    assert (listing.logger_name, listing.message) == ("FileInputDStream", "Finding new files took 61 ms")
    assert all(r.timestamp_str is None and r.message is None and r.timestamp_unix is None for r in junk)
    assert tail.message == "a: b - c:1 - d"
    assert (bad_time.logger_name, bad_time.timestamp_unix) == ("x y", None)


def test_first_integer(spark):
    assert column(spark, ["took 61 ms of 7", "none"], logs.first_integer) == [61, None]


def test_batch_times(spark):
    times_in = ["2023-11-14T22:20:10.000GMT", "2023-11-14T22:20:10.544GMT", "2023-11-14 22:20:10.000GMT", "x"]
    assert column(spark, times_in, times.batch_time_seconds) == [1700000410, None, None, None]


def test_ceil_seconds(spark):
    micros = [1_000_000, 1_000_001, 1_999_999, 0]
    assert column(spark, map(str, micros), lambda c: times.ceil_seconds(c.cast("bigint"))) == [1, 2, 2, 0]


def test_message_id_drops_trailing_zeros_and_masks_the_counter(spark):
    ids = column(spark, ["1704067201500000", "1704067201000000"], lambda c: msg.message_id(c.cast("bigint"), F.lit(10_000_001)))
    masked = f"{10_000_001 & 10_000_000:08d}"
    assert ids == [f"1704067201.5_{masked}", f"1704067201.0_{masked}"]


def test_file_name_wraps_at_a_million(spark):
    assert column(spark, ["1000007"], lambda c: msg.file_name(F.lit(1704067201), c.cast("bigint"))) == [
        "1704067201_0000000007"
    ]


def test_padding_fits_exactly_or_is_rejected(spark):
    df = spark.createDataFrame([(20, 20, "n"), (20, 11, "n"), (20, 10, "n"), (123, 30_000, "n")], "cpu_pause_ms int, message_bytes bigint, name string")
    got = generate.with_line(df).select("message_bytes", F.length("line").alias("n")).collect()
    assert [(r.message_bytes, r.n) for r in got] == [(20, 20), (11, 11), (10, None), (30_000, 30_000)]
    assert generate.rejected_settings(df).count() == 1


def test_big_message_reads_back(spark):
    df = spark.createDataFrame([(123, 30_000_000, "x")], "cpu_pause_ms int, message_bytes bigint, name string")
    check = generate.roundtrip_check(generate.with_line(df)).first()
    assert (check.messages, check.bad_length, check.bad_cost) == (1, 0, 0)


def test_seven_digit_cost_is_misread(spark):
    df = spark.createDataFrame([(1_234_567, 64, "x")], "cpu_pause_ms int, message_bytes bigint, name string")
    assert generate.roundtrip_check(generate.with_line(df)).first().bad_cost == 1


def test_whole_rate_loses_one_where_division_is_inexact(spark):
    rates = [1, 2, 92, 93, 94, 98, 99, 105]
    got = column(spark, map(str, rates), lambda c: msg.whole_rate(msg.period_of(c.cast("bigint"))))
    assert got == [int(1 / (1 / f)) for f in rates]
    assert got[rates.index(93)] == 92


def test_one_second_of_messages(spark):
    df = spark.createDataFrame([(100, 20, 64, 0.25), (100, 20, 64, 2.0)], "unix_sec bigint, cpu_pause_ms int, message_bytes bigint, period_sec double")
    for block_bytes in (1, 64, 3 * 64, 4 * 64, 10_000):
        names = [r.name for r in generate.one_second(df, block_bytes).orderBy("seq").collect()]
        assert names == [f"100_{i:010d}" for i in (1, 2, 3, 4)]


def test_large_messages_of_one_setting_are_dealt_out(spark):
    df = spark.createDataFrame([(100, 20, 50_000_000, 0.01)], "unix_sec bigint, cpu_pause_ms int, message_bytes bigint, period_sec double")
    parts = generate.one_second(df).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 100


def test_large_sizes_keep_their_row(spark):
    df = spark.createDataFrame([(20, 102_400_001, "n"), (20, 3_000_000_000, "n")], "cpu_pause_ms int, message_bytes bigint, name string")
    assert [r.message_bytes for r in generate.rejected_settings(df).collect()] == [3_000_000_000]
    assert generate.with_line(df.limit(1)).select(F.length("line").alias("n")).first().n == 102_400_001


def test_numbered_messages(spark):
    got = generate.numbered_messages(spark, 5, start_sec=1000, period_sec=0.5).orderBy("seq").collect()
    assert [r.name.split("_")[0] for r in got] == ["1000", "1000", "1001", "1001", "1002"]
    assert all(len(r.line) == 200 and r.line.startswith("C000020-F100") for r in got)


def test_sweep_tries_the_largest_messages_first(spark):
    got = [tuple(r) for r in generate.sweep_settings(spark).collect()]
    assert len(got) == 8 and got[0] == (50_000_000, 20, 1.0) and got[-1] == (500, 20, 1.0)


def test_params_key(spark):
    df = spark.range(1).select(msg.params_key(F.lit(20), F.lit(200).cast("bigint"), F.lit(1.0)).alias("k"))
    assert df.first().k == '{"cpu_pause_ms":20,"message_bytes":200,"period_sec":1.0}'


def test_user_function_needs_no_package_on_the_workers(tmp_path):
    """The function is read back in a process that cannot import this package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(lines.cost_by_slicing()))
    code = "import pickle, pandas as pd; print(int(pickle.load(open('f', 'rb'))(pd.Series(['C000123-F']))[0]))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "123", done.stderr
