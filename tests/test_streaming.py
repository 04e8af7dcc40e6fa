"""Streams over several batches, late ticks, and state."""

import datetime as dt
import os
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars
from barloom.plans.queries import queries
from barloom.sources.shared import shared_dir
from barloom.sources.tables import event_ticks
from barloom.streaming import bars as streams
from barloom.streaming import brackets, figures, revisions


@pytest.fixture(scope="module")
def batches(spark, sf_dir, tmp_path_factory):
    """Events in five files, one batch each, in time order."""
    folder = tmp_path_factory.mktemp("events")
    pdf = pd.read_parquet(f"{sf_dir}/events.parquet").sort_values("ts")
    (folder / "events.parquet").mkdir()
    step = -(-len(pdf) // 5)
    for k in range(5):
        part = pdf.iloc[k * step : (k + 1) * step].astype({"ts": "datetime64[us]"})
        part.to_parquet(folder / "events.parquet" / f"part-{k}.parquet", index=False)
    return str(folder)


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_complete_bars_of_many_batches(spark, sf_dir, batches):
    ticks = streams.tick_stream(spark, batches, files_per_batch=1)
    same(streams.completed(streams.stream_bars(ticks, "1 day", "1 hour"), "complete"), bars.bars(event_ticks(spark, sf_dir), "1 day"))


def test_closed_bars_of_many_batches(spark, sf_dir, batches):
    ticks = streams.tick_stream(spark, batches, files_per_batch=1)
    ended = event_ticks(spark, sf_dir).agg(F.max("ts")).first()[0]
    whole = bars.bars(event_ticks(spark, sf_dir), "1 day").where(F.col("bar_ts") + F.expr("INTERVAL 1 DAY") <= F.lit(ended) - F.expr("INTERVAL 1 HOUR"))
    same(streams.completed(streams.stream_bars(ticks, "1 day", "1 hour")), whole)


def test_state_goes_on_across_batches(spark, sf_dir, batches):
    made = streams.completed(streams.stream_ema(streams.tick_stream(spark, batches, files_per_batch=1), 10))
    found = {row["seq"]: row["ema"] for row in made.collect()}
    pdf = pd.read_parquet(f"{sf_dir}/events.parquet").sort_values("ts")
    for _, part in pdf.groupby("event_type"):
        want = part["value"].ewm(span=10, adjust=False).mean()
        assert [found[i] for i in part["event_id"]] == pytest.approx(want.tolist())


def test_averages_do_not_depend_on_how_batches_are_cut(spark, tmp_path):
    """Ticks out of order in one batch, in two, with a missing price and a symbol that only one batch has, in Arrow batches of three rows."""
    rows = pd.DataFrame({"event_id": range(40), "ts": pd.date_range("2024-01-01", periods=40, freq="s").astype("datetime64[us]"), "event_type": ["a", "b"] * 15 + ["a"] * 10, "value": [float(k % 7) for k in range(40)]})
    rows.loc[[4, 30, 36], "value"] = None
    made = {}
    for cut in (40, 20):
        (tmp_path / str(cut) / "events.parquet").mkdir(parents=True)
        for k in range(0, 40, cut):
            rows.iloc[k : k + cut].sample(frac=1, random_state=1).to_parquet(tmp_path / str(cut) / "events.parquet" / f"part-{k:02d}.parquet", index=False)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        try:
            found = streams.completed(streams.stream_ema(streams.tick_stream(spark, str(tmp_path / str(cut)), files_per_batch=1), 5)).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        made[cut] = {row["seq"]: row["ema"] for row in found}
    want = pd.concat([part["value"].ewm(span=5, adjust=False, ignore_na=True).mean() for _, part in rows.groupby("event_type")])
    assert sorted(made[40]) == sorted(made[20]) == list(range(40))
    for found in made.values():
        assert [found[k] for k in range(40)] == pytest.approx(want.sort_index().tolist())


def test_late_ticks_are_dropped(spark, batches, tmp_path):
    """A file of early ticks that comes in last adds nothing to bars that are closed."""
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(5):
        part = pd.read_parquet(f"{batches}/events.parquet/part-{k}.parquet").astype({"ts": "datetime64[us]"})
        part.to_parquet(folder / f"a-{k}.parquet", index=False)
    late = pd.read_parquet(f"{batches}/events.parquet/part-0.parquet").astype({"ts": "datetime64[us]"})
    late.to_parquet(folder / "b-late.parquet", index=False)
    (folder / "b-late.parquet").touch()
    found = streams.completed(streams.stream_bars(streams.tick_stream(spark, str(tmp_path), files_per_batch=1), "1 day", "1 hour"))
    want = streams.completed(streams.stream_bars(streams.tick_stream(spark, batches, files_per_batch=1), "1 day", "1 hour"))
    same(found, want)


def test_figures_stand_until_their_time_is_over(spark, tmp_path):
    """Two batches in Arrow batches of three rows, with a symbol that is null, one in one batch only, and ticks that don't count; a state that lives a millisecond holds the last batch alone."""
    rows = pd.DataFrame({"event_id": range(40), "ts": pd.date_range("2024-01-01", periods=40, freq="s").astype("datetime64[us]"), "event_type": ["a", None] * 10 + ["b"] * 5 + ["a"] * 15, "value": [float(k * 5 % 7) for k in range(40)]})
    rows.loc[[39], "value"], rows.loc[[38], "ts"] = float("nan"), pd.NaT
    rows["event_id"] = rows["event_id"].astype("Int64").where(rows["event_id"] != 37)
    (tmp_path / "events.parquet").mkdir()
    for k in (0, 20):
        rows.iloc[k : k + 20].sample(frac=1, random_state=1).to_parquet(tmp_path / "events.parquet" / f"part-{k:02d}.parquet", index=False)
    ticks = streams.tick_stream(spark, str(tmp_path), files_per_batch=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        made = {(live, parts): figures.running_figures(ticks, live, parts).collect() for live, parts in ((figures.MONTH, 1), (figures.MONTH, 4), (1, 1))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"

    def wanted(part):
        sound = part[part["value"].notna() & part["ts"].notna() & part["event_id"].notna()]
        return {None if pd.isna(sym) else sym: (len(of), pytest.approx(of["value"].mean()), of["value"].max(), of["value"].min(), of["value"].iloc[-1]) for sym, of in sound.groupby("event_type", dropna=False)}

    def found(made):
        return {row["sym"]: (row["ticks"], row["vwap"], row["high"], row["low"], row["last"]) for row in made}

    assert found(made[figures.MONTH, 1]) == found(made[figures.MONTH, 4]) == wanted(rows)
    assert found(made[1, 1]) == {None: wanted(rows)[None]} | wanted(rows.iloc[20:])


def test_figures_of_no_ticks(spark, sf_dir, tmp_path):
    pd.read_parquet(f"{sf_dir}/events.parquet").head(0).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet", index=False)
    assert figures.running_figures(streams.tick_stream(spark, str(tmp_path))).collect() == []


def ticks_of(spark, rows):
    return spark.createDataFrame([("a", dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc), seq, price, 1.0) for seq, (day, hour, price) in enumerate(rows)], "sym string, ts timestamp, seq long, price double, qty double")


def test_late_ticks_revise_bars_until_they_are_closed(spark, tmp_path):
    """A late tick changes its bar's open, close and low; a batch that is run twice changes nothing; a tick behind the time to live is dropped."""
    batches = [ticks_of(spark, [(1, 10, 5.0), (1, 12, 7.0)]), ticks_of(spark, [(2, 1, 6.0)]), ticks_of(spark, [(1, 9, 4.0), (1, 23, 9.0)]), ticks_of(spark, [(9, 0, 1.0)]), ticks_of(spark, [(1, 11, 100.0), (9, 5, 2.0)])]
    work = revisions.revise("1 day", "3 days", str(tmp_path))
    for number, batch in enumerate(batches):
        for _ in range(1 + (number in (2, 4))):
            work(batch, number)
    rows = {row["bar_ts"].day: tuple(row)[2:] for row in revisions.latest(str(tmp_path), batches[0], len(batches)).collect()}
    assert rows == {1: (4.0, 9.0, 4.0, 9.0, 4.0, 4, 2), 2: (6.0, 6.0, 6.0, 6.0, 1.0, 1, 1), 9: (1.0, 2.0, 1.0, 2.0, 2.0, 2, 4)}


def test_streams_leave_no_folders(spark, sf_dir):
    before = {path.name for path in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    queries()["stream_ema"](spark, sf_dir).count()
    queries()["stream_bars_complete"](spark, sf_dir).count()
    left = {path.name for path in Path(shared_dir(spark).removeprefix("file:")).iterdir()} - before
    assert not [name for name in left if name.startswith("stream-")]


def brackets_by_hand(ticks, stop, target, longest):
    """(t_in, reason, t_out) of (time, price, enter) in order."""
    out = []
    for k, (at, paid, enter) in enumerate(ticks):
        later = ticks[k + 1 : k + 1 + longest] if enter else []
        hit = next(((j, "stop" if p <= paid * (1 - stop) else "target") for j, (_, p, _) in enumerate(later) if p <= paid * (1 - stop) or p >= paid * (1 + target)), None)
        if hit:
            out.append((at, hit[1], later[hit[0]][0]))
        elif enter and len(later) == longest:
            out.append((at, "time", later[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [100], [40, 80, 120, 160]])
def test_brackets_do_not_depend_on_batches(spark, tmp_path, cuts):
    """Ticks in any split into batches, the ticks of a batch in any order, and trades that go on from batch to batch."""
    rng = np.random.default_rng(9)
    start, prices = dt.datetime(2024, 1, 1), 100 * np.exp(np.cumsum(rng.normal(0, 0.05, 200)))
    events = pd.DataFrame({"event_id": range(200), "ts": [start + dt.timedelta(minutes=7 * k) for k in range(200)], "user_id": 1, "event_type": "a", "value": prices, "props": "{}"})
    (tmp_path / "events.parquet").mkdir()
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, 200], strict=True)):
        events.iloc[rng.permutation(np.arange(a, b))].to_parquet(tmp_path / "events.parquet" / f"part-{number}.parquet", coerce_timestamps="us", index=False)
        os.utime(tmp_path / "events.parquet" / f"part-{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))
    stream = streams.tick_stream(spark, str(tmp_path), files_per_batch=1)
    found = brackets.ended_trades(stream, F.col("seq") % 3 == 0, 0.1, 0.15, 12, "10 minutes").collect()
    closed = start + dt.timedelta(minutes=7 * 199 - 10)
    hour_end = lambda at: start + -(-(at - start) // dt.timedelta(hours=1)) * dt.timedelta(hours=1)
    want = [row for row in brackets_by_hand([(start + dt.timedelta(minutes=7 * k), prices[k], k % 3 == 0) for k in range(200)], 0.1, 0.15, 12) if hour_end(row[2]) <= closed]
    assert sorted((row["t_in"], row["reason"], row["t_out"]) for row in found) == want and {row[1] for row in want} == {"stop", "target", "time"}


class Held:
    """A state of any kind in memory, and its handle, that count the calls that change them."""

    def __init__(self):
        self.values, self.timers, self.written = {}, [], 0

    def getMapState(self, *_):
        return Held()

    getListState = getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)

    def get(self):
        return self.values.get("own")

    def getValue(self, key):
        return self.values[key]

    def updateValue(self, key, value):
        self.values[key], self.written = value, self.written + 1

    def update(self, value):
        self.updateValue("own", value)

    def appendList(self, values):
        self.written += len(values)


def test_brackets_keep_blocks_and_one_timer():
    """However many ticks and hours a batch has, they wait as one block under one timer."""
    made, handle = brackets.Brackets(0.1, 0.1, 3), Held()
    made.init(handle)
    ticks = pd.DataFrame({"at": [k * 600_000_000 for k in range(3000)], "seq": range(3000), "price": 1.0, "enter": True})
    list(made.handleInputRows(("a",), iter([ticks[2000:], ticks[:2000]]), None))
    assert handle.timers == [0]
    held, blocks = made.waiting()
    assert held["seq"].tolist() == [*range(3000)] and blocks == made.blocks.written == 2
