"""Running columns, ranks, calendars, range joins and brackets over long series, against the plain windows and loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import series
from barloom.operators import bars, ranks, strategies
from barloom.operators.numbering import cells_of_range, range_join
from barloom.operators.scans import Running, scanned

START = dt.datetime(2024, 1, 1)
VALUES = "sym string, bar_ts timestamp_ntz, x double, k int"


@pytest.fixture
def apart(spark):
    """Partitions stay apart, however small, and there are more of them than symbols."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def made_up(spark, n=150):
    rng = random.Random(3)
    rows = [(sym, START + dt.timedelta(hours=h), rng.choice([None, float(rng.randrange(-5, 6)), float(rng.randrange(100))]), rng.randrange(3)) for sym in ("a", "b", None) for h in sorted(rng.sample(range(2 * n), n))]
    rows += [("nulls", START + dt.timedelta(hours=h), None, 1) for h in range(20)] + [("one", START, 4.0, 2)]
    return spark.createDataFrame(rows, VALUES)


def texts(df):
    return sorted(repr([None if x is None else round(x, 9) + 0.0 if isinstance(x, float) else x for x in row]) for row in df.collect())


@pytest.mark.parametrize("hours", [1, 7, 50, 720])
def test_scans_equal_windows(spark, hours):
    """Nulls, a null symbol, buckets of a row and of all rows; what stands on the row before, also of running columns."""
    df, so_far = made_up(spark), series().rowsBetween(Window.unboundedPreceding, 0)
    found = scanned(
        df, {"last": Running("last", F.col("x")), "total": Running("sum", F.col("x")), "most": Running("max", F.col("x")), "peak": Running("peak", F.col("x"))},
        {"x_before": "x", "k_before": "k", "last_before": "last", "peak_before": "peak"}, hours=hours,
    )
    want = df.withColumns({"last": F.last("x", ignorenulls=True).over(so_far), "total": F.sum("x").over(so_far), "most": F.max("x").over(so_far)})
    want = want.withColumn("peak", F.max("total").over(so_far))
    want = want.withColumns({f"{name}_before": F.lag(name).over(series()) for name in ("x", "k", "last", "peak")})
    assert found.columns == want.columns and texts(found) == texts(want)


def test_scans_may_replace_columns_and_take_keys(spark):
    df = made_up(spark)
    found = scanned(df, {"x": Running("last", F.col("x"))}, keys=("sym", "k"), hours=5)
    want = df.withColumn("x", F.last("x", ignorenulls=True).over(Window.partitionBy("sym", "k").orderBy("bar_ts")))
    assert found.columns == df.columns and texts(found) == texts(want)
    assert scanned(df.limit(0), {"y": Running("sum", F.col("x"))}, {"z": "x"}).collect() == []


def test_a_million_rows_of_one_symbol_are_many_tasks(spark, apart):
    """No task has the series, in the running columns of a whole strategy."""
    n = 1_000_000
    long = spark.range(n).select(F.lit("a").alias("sym"), (F.lit(START) + F.make_dt_interval(secs=F.col("id"))).alias("bar_ts"), (100 + F.col("id") % 7).cast("double").alias("close"))
    placed = strategies.with_position(long, F.col("close") > 104, F.col("close") < 102, hours=24)
    made = strategies.with_equity(strategies.with_profit(placed, 1.0, hours=24), hours=24)
    made = scanned(made, {"n": Running("sum", F.lit(1))}, hours=24)
    tasks = made.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows"), F.max("n").alias("n"), F.sum("pos").alias("pos")).collect()
    # buckets of 24 hours: twelve of them
    assert sum(row["rows"] for row in tasks) == n == max(row["n"] for row in tasks)
    assert len(tasks) > 4 and max(row["rows"] for row in tasks) <= 0.6 * n
    assert sum(row["pos"] for row in tasks) == pytest.approx(n * 2 / 7, abs=7)


@pytest.mark.parametrize("ranges", [2, 5, 128])
def test_ranks_equal_windows(spark, monkeypatch, ranges):
    """Ties, nulls, a null symbol, a value that most rows share, one row."""
    monkeypatch.setattr(ranks, "RANGES", ranges)
    df = made_up(spark).unionByName(spark.createDataFrame([("common", START + dt.timedelta(hours=h), 7.0 if h % 10 else float(h), 0) for h in range(300)], VALUES))
    by = Window.partitionBy("sym").orderBy("x")
    found = ranks.ranked(df, "x", {"r": "rank", "d": "dense_rank", "p": "percent_rank", "c": "cume_dist"})
    want = df.withColumns({"r": F.rank().over(by), "d": F.dense_rank().over(by), "p": F.percent_rank().over(by), "c": F.cume_dist().over(by)})
    assert texts(found) == texts(want)


@pytest.mark.parametrize("tiles", [1, 2, 4, 7, 200])
def test_tiles_and_first_values_equal_windows(spark, tiles):
    df = made_up(spark)
    assert texts(ranks.with_tiles(df, tiles)) == texts(df.withColumn("tile", F.ntile(tiles).over(series())))
    found = ranks.with_first_values(df, "x", {"one": 1, "three": 3})
    assert texts(found) == texts(df.withColumns({"one": F.first("x").over(series()), "three": F.nth_value("x", 3).over(series())}))


def test_ranks_of_a_long_symbol_are_many_tasks(spark, apart):
    long = spark.range(200_000).select(F.lit("a").alias("sym"), (F.lit(START) + F.make_dt_interval(mins=F.col("id"))).alias("bar_ts"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("x"))
    made = ranks.with_tiles(ranks.ranked(long, "x", {"r": "rank"}), 4)
    tasks = made.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 4 and max(row["count"] for row in tasks) < 100_000
    assert made.agg(F.countDistinct("r"), F.max("r"), F.max("tile")).first() == (200_000, 200_000, 4)


def test_twelve_years_of_seconds(spark):
    """The calendar of a range that no array could hold."""
    found = spark.createDataFrame([("a", START), ("a", START + dt.timedelta(days=4383)), ("b", START)], "sym string, bar_ts timestamp_ntz")
    made = bars.calendar(found, "1 second")
    assert made.count() == 4383 * 86_400 + 2  # more than an array may hold
    late = made.where(F.col("bar_ts") > F.lit(START + dt.timedelta(days=4382, hours=23)))
    assert late.agg(F.countDistinct("bar_ts"), F.max("bar_ts")).first() == (3600, START + dt.timedelta(days=4383))


@pytest.mark.parametrize(("every", "block"), [("1 hour", 2), ("1 hour", 7), ("1 hour", 4096), ("1 month", 4096), ("90 minutes", 5)])
def test_calendars_equal_sequences(spark, every, block):
    found = made_up(spark, 40).select("sym", "bar_ts")
    spans = found.groupBy("sym").agg(F.min("bar_ts").alias("a"), F.max("bar_ts").alias("b"))
    want = spans.select("sym", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {every}"))).alias("bar_ts"))
    assert texts(bars.calendar(found, every, block)) == texts(want)


def test_range_join_against_a_theta_join(spark):
    """Ranges from nothing to years over cells of a minute, before the epoch and behind it, without and with keys."""
    rng = random.Random(4)
    at = lambda: dt.datetime(1969, 6, 1) + dt.timedelta(seconds=rng.randrange(3 * 365 * 86_400), microseconds=rng.randrange(10))
    points = spark.createDataFrame([(k, "ab"[k % 2], at()) for k in range(300)], "p int, sym string, ts timestamp_ntz")
    spans = [(k, "ab"[k % 2], begin := at(), begin + dt.timedelta(seconds=rng.choice([-5, 0, 1, 59, 3600, 86_400, 40 * 86_400, 900 * 86_400]))) for k in range(120)]
    ranges = spark.createDataFrame(spans, "r int, sym string, a timestamp_ntz, b timestamp_ntz")
    want = points.join(ranges.withColumnRenamed("sym", "s"), F.expr("a <= ts and ts < b")).select("p", "r", (F.col("sym") == F.col("s")).alias("same"))
    for every in ("1 minute", "7 days", "2000 days"):
        keyed = range_join(points, ranges, "ts", "a", "b", every, ["sym"]).select("p", "r")
        assert texts(keyed) == texts(want.where("same").select("p", "r"))
        assert texts(range_join(points.drop("sym"), ranges.drop("sym"), "ts", "a", "b", every).select("p", "r")) == texts(want.select("p", "r"))


def test_long_ranges_are_few_rows(spark):
    """A range of ten years is a few cells a level, not five million minutes."""
    points = spark.createDataFrame([(START + dt.timedelta(days=77),)], "ts timestamp_ntz")
    ranges = spark.createDataFrame([(START, START + dt.timedelta(days=3653))], "a timestamp_ntz, b timestamp_ntz")
    assert range_join(points, ranges, "ts", "a", "b", "1 minute").count() == 1
    minutes = 3653 * 24 * 60
    sizes = [spark.range(1).select(F.size(cells_of_range(F.lit(3), F.lit(3 + minutes), level, 7)).alias("n")).first()["n"] for level in range(8)]
    assert sum(sizes) < 100 and sum(n * 8**level for level, n in enumerate(sizes)) == minutes


def brackets_by_hand(rows, stop, target, longest):
    out = []
    for k, (ts, high, low, close, enter) in enumerate(rows):
        if not enter:
            continue
        later = rows[k + 1 : k + 1 + longest]
        reason, end = ("time" if len(later) == longest else "open"), (later[-1] if later else None)
        price = end[3] if end else close
        for bar in later:
            if bar[2] <= close * (1 - stop) or bar[1] >= close * (1 + target):
                reason, end = ("stop" if bar[2] <= close * (1 - stop) else "target"), bar
                price = close * (1 - stop) if reason == "stop" else close * (1 + target)
                break
        out.append((ts, reason, end and end[0], round(price / close - 1, 9)))
    return out


BARS = "sym string, bar_ts timestamp_ntz, high double, low double, close double, go boolean"


@pytest.mark.parametrize(("frame", "longest"), [(64, 5), (0, 5), (0, 1), (0, 8), (0, 63), (0, 64), (0, 300)])
def test_brackets_by_frame_and_by_tree(spark, monkeypatch, frame, longest):
    monkeypatch.setattr(strategies, "FRAME", frame)
    rng, rows = random.Random(longest), {}
    for sym in ("a", None):
        price, rows[sym] = 100.0, []
        for k in range(400):
            price *= 1 + rng.uniform(-0.02, 0.02)
            rows[sym].append((START + dt.timedelta(minutes=k), price * (1 + rng.random() / 50), price * (1 - rng.random() / 50), price, rng.random() < 0.3))
    df = spark.createDataFrame([(sym, *row) for sym, some in rows.items() for row in some], BARS)
    found = strategies.bracket_exits(df, F.col("go"), 0.08, 0.1, longest).collect()
    for sym, some in rows.items():
        assert sorted((r["t_in"], r["reason"], r["t_out"], round(r["ret"], 9)) for r in found if r["sym"] == sym) == brackets_by_hand(some, 0.08, 0.1, longest)


def test_long_holds_do_not_shuffle_more(spark):
    """What a hold of 10,000 bars reads per entry is some nodes a level, not 10,000 bars."""
    rows = spark.range(30_000).select(
        F.lit("a").alias("sym"), (F.lit(START) + F.make_dt_interval(mins=F.col("id"))).alias("bar_ts"), (100 + F.sin(F.col("id") / 9000) * 20).alias("close"), (F.col("id") % 3 == 0).alias("go")
    ).withColumns({"high": F.col("close") + 0.1, "low": F.col("close") - 0.1})
    made = strategies.bracket_exits(rows, F.col("go"), 0.1, 0.1, 10_000).cache()
    counts = {row["reason"]: row["count"] for row in made.groupBy("reason").count().collect()}
    assert sum(counts.values()) == 10_000 and counts.get("stop", 0) > 100 and counts.get("target", 0) > 100
    close = [100 + math.sin(k / 9000) * 20 for k in range(30_000)]
    for row in made.orderBy("t_in").limit(3000).where("reason != 'open'").collect()[::500]:
        k = int((row["t_in"] - START).total_seconds() // 60)
        first = next((j for j in range(k + 1, k + 10_001) if close[j] - 0.1 <= close[k] * 0.9 or close[j] + 0.1 >= close[k] * 1.1), None)
        assert int((row["t_out"] - START).total_seconds() // 60) == (first if first is not None else k + 10_000)
