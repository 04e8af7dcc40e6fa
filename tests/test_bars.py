"""Bars against hand-computed rows and against what must hold for any bars."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars
from barloom.operators.numbering import as_of_join, range_join, row_numbers
from barloom.sources.tables import event_ticks, save

DAY = dt.datetime(2024, 1, 1)
TICK = "sym string, ts timestamp_ntz, seq long, price double, qty double"


def at(hours: float) -> dt.datetime:
    return DAY + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def ticks(spark):
    rows = [
        ("a", at(0.0), 2, 11.0, 1.0), ("a", at(0.0), 1, 10.0, 2.0), ("a", at(0.5), 3, 14.0, 1.0), ("a", at(0.9), 4, 9.0, 1.0), ("a", at(1.0), 5, 12.0, 3.0),
        ("a", at(5.0), 6, 13.0, 1.0), ("b", at(2.0), 7, 1.0, 1.0),
    ]
    return spark.createDataFrame(rows, TICK)


def plain(df, *order) -> list[tuple]:
    return [tuple(row) for row in df.orderBy(*order).collect()]


def test_hour_bars_by_hand(ticks):
    assert plain(bars.bars(ticks, "1 hour"), "sym", "bar_ts") == [
        ("a", at(0), 10.0, 14.0, 9.0, 9.0, 5.0, 4), ("a", at(1), 12.0, 12.0, 12.0, 12.0, 3.0, 1), ("a", at(5), 13.0, 13.0, 13.0, 13.0, 1.0, 1),
        ("b", at(2), 1.0, 1.0, 1.0, 1.0, 1.0, 1),
    ]


def test_overlapping_bars_by_hand(ticks):
    found = {(r["sym"], r["bar_ts"]): r["ticks"] for r in bars.bars(ticks, "2 hours", "1 hour").where("sym = 'a'").collect()}
    assert found == {("a", at(-1)): 4, ("a", at(0)): 5, ("a", at(1)): 1, ("a", at(4)): 1, ("a", at(5)): 1}


def test_sessions_by_hand(ticks):
    found = plain(bars.session_bars(ticks, "1 hour").select("sym", "bar_ts", "end_ts", "open", "close", "ticks"), "sym", "bar_ts")
    assert found == [("a", at(0), at(1), 10.0, 12.0, 5), ("a", at(5), at(5), 13.0, 13.0, 1), ("b", at(2), at(2), 1.0, 1.0, 1)]


def test_a_gap_of_exactly_the_length_does_not_end_a_session(spark):
    rows = [("a", at(0), 1, 1.0, 1.0), ("a", at(1), 2, 2.0, 1.0), ("a", at(2) + dt.timedelta(microseconds=1), 3, 3.0, 1.0)]
    assert bars.session_bars(spark.createDataFrame(rows, TICK), "1 hour").count() == 2


def test_count_and_volume_bars_by_hand(ticks):
    by_count = plain(bars.count_bars(ticks, 2).where("sym = 'a'").select("bar", "open", "close", "ticks"), "bar")
    assert by_count == [(0, 10.0, 11.0, 2), (1, 14.0, 9.0, 2), (2, 12.0, 13.0, 2)]
    by_volume = plain(bars.volume_bars(ticks, 4.0).where("sym = 'a'").select("bar", "volume", "ticks"), "bar")
    assert by_volume == [(0, 4.0, 3), (1, 4.0, 2), (2, 1.0, 1)]


def test_filling_by_hand(ticks):
    filled = bars.forward_fill(bars.fill_calendar(bars.bars(ticks, "1 hour"), "1 hour"), "close").where("sym = 'a'")
    assert [(r["bar_ts"], r["open"], r["close"], r["volume"], r["ticks"]) for r in filled.orderBy("bar_ts").collect()] == [
        (at(0), 10.0, 9.0, 5.0, 4), (at(1), 12.0, 12.0, 3.0, 1), (at(2), None, 12.0, 0.0, 0), (at(3), None, 12.0, 0.0, 0), (at(4), None, 12.0, 0.0, 0),
        (at(5), 13.0, 13.0, 1.0, 1),
    ]


def test_vwap_by_hand(ticks):
    assert plain(bars.vwap(bars.bars(ticks, "1 hour")), "sym")[0] == ("a", pytest.approx((9 * 5 + 12 * 3 + 13) / 9), 9.0)


def test_no_ticks(spark):
    none = spark.createDataFrame([], TICK)
    for made in (bars.bars(none, "1 hour"), bars.session_bars(none, "1 hour"), bars.count_bars(none, 5), bars.volume_bars(none, 5.0), bars.fill_calendar(bars.bars(none, "1 hour"), "1 hour")):
        assert made.collect() == []


def test_null_prices_make_invalid_bars(spark):
    made = bars.bars(spark.createDataFrame([("a", at(0), 1, None, 1.0), ("b", at(0), 1, 2.0, -1.0), ("c", at(0), 1, 2.0, 1.0)], TICK), "1 hour")
    assert {r["sym"] for r in bars.invalid(made).collect()} == {"a", "b"}


def test_what_holds_for_all_bars(spark, sf_dir):
    ticks = event_ticks(spark, sf_dir)
    day = bars.bars(ticks, "1 day")
    assert bars.invalid(day).isEmpty()
    assert day.agg(F.sum("ticks")).first()[0] == ticks.count() == bars.session_bars(ticks, "2 hours").agg(F.sum("ticks")).first()[0]
    assert plain(bars.resample(bars.bars(ticks, "1 hour"), "1 day"), "sym", "bar_ts") == plain(day, "sym", "bar_ts")
    assert plain(bars.calendar_bars(ticks, "day"), "sym", "bar_ts") == plain(day, "sym", "bar_ts")


def test_row_numbers_across_buckets(spark):
    df = spark.createDataFrame([("k", at(h)) for h in (0, 1, 30, 31, 80)], "sym string, ts timestamp_ntz")
    numbered = row_numbers(df, ["sym"], ["ts"], F.window("ts", "1 day")["start"])
    assert [r["row"] for r in numbered.orderBy("ts").collect()] == [1, 2, 3, 4, 5]


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([("k", at(h)) for h in (0, 5, 5.5, 100)] + [("x", at(5))], "sym string, t timestamp_ntz")
    right = spark.createDataFrame([("k", at(1), 1), ("k", at(5), 2), ("k", at(50), None)], "sym string, u timestamp_ntz, v int")
    found = {(r["sym"], r["t"]): (r["as_of"]["u"] if r["as_of"] else None) for r in as_of_join(left, right, "t", "u", "1 day").collect()}
    assert found == {("k", at(0)): None, ("k", at(5)): at(5), ("k", at(5.5)): at(5), ("k", at(100)): at(50), ("x", at(5)): None}
    strict = {(r["sym"], r["t"]): (r["as_of"]["u"] if r["as_of"] else None) for r in as_of_join(left, right, "t", "u", "1 day", strict=True).collect()}
    assert strict[("k", at(5))] == at(1) and strict[("k", at(5.5))] == at(5)


def test_ranges_are_half_open(spark):
    points = spark.createDataFrame([(at(h),) for h in (0, 10, 23, 47.99, 48)], "ts timestamp_ntz")
    ranges = spark.createDataFrame([("r", at(10), at(48)), ("empty", at(10), at(10))], "name string, start timestamp_ntz, until timestamp_ntz")
    assert sorted(r["ts"] for r in range_join(points, ranges, "ts", "start", "until", "1 day").collect()) == [at(10), at(23), at(47.99)]


def test_save_by_partition(ticks, spark, tmp_path):
    save(ticks, str(tmp_path / "t"), ["sym"])
    assert spark.read.parquet(str(tmp_path / "t")).where("sym = 'a'").count() == 6
