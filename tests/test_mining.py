"""Indicators, conditions, rules and strategies by hand, and that nothing looks ahead."""

import datetime as dt
import itertools
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import upper_tail
from barloom.operators import conditions as cond
from barloom.operators import indicators as ind
from barloom.operators import rule_strategies, rules, strategies
from barloom.operators.numbering import in_parts
from barloom.plans.mining import NAMES, conditioned, strategy

BAR = "sym string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double, ticks long"
START = dt.datetime(2024, 1, 1)


def bars_of(spark, closes, sym="a", spread=1.0):
    rows = [(sym, START + dt.timedelta(hours=k), float(c), c + spread, c - spread, float(c), 10.0, 1) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def values(df, *names):
    rows = df.orderBy("sym", "bar_ts").collect()
    return [row[names[0]] if len(names) == 1 else tuple(row[name] for name in names) for row in rows]


def test_averages_by_hand(spark):
    df = bars_of(spark, [1, 2, 3, 5]).withColumns({"s": ind.sma(3), "d": ind.rolling_std(3), "r": ind.simple_return(), **ind.channel(2)})
    assert values(df, "s") == [None, None, 2.0, pytest.approx(10 / 3)]
    assert values(df, "d")[2:] == [1.0, pytest.approx(math.sqrt(7 / 3))]
    assert values(df, "r") == [None, 1.0, 0.5, pytest.approx(2 / 3)]
    assert values(df, "channel_high", "channel_low") == [(None, None), (3.0, 0.0), (4.0, 1.0), (6.0, 2.0)]


@pytest.mark.parametrize(("part", "hours"), [(1, 1), (7, 5), (40, 720), (1000, 720)])
def test_windows_do_not_depend_on_parts(spark, part, hours):
    """Looks back over one part and many, a look ahead, a null symbol and missing closes."""
    closes = [math.sin(k) * 50 + k % 11 + 60 for k in range(90)]
    df = bars_of(spark, closes).unionByName(bars_of(spark, closes[5:30], None)).withColumn("close", F.when(F.hour("bar_ts") != 7, F.col("close"))).withColumn("two", F.lit(60.0))

    def apply(df):
        df = ind.with_stochastic(ind.with_atr(ind.with_rsi(df, 5), 5), 5, 3)
        return df.withColumns({"s": ind.sma(9), "z": ind.zscore(9), "r": ind.simple_return(4), "x": cond.cross_above("close", "two"), "f": rules.forward_return(3), **ind.channel(4)})

    found, want = in_parts(df, apply, back=8, ahead=3, part=part, hours=hours), apply(df)
    assert found.columns == want.columns and sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def test_zero_prices_give_null_returns(spark):
    df = bars_of(spark, [1, 0, 2]).withColumns({"r": ind.simple_return(), "l": ind.log_return()})
    assert values(df, "r") == [None, -1.0, None] and values(df, "l") == [None, None, None]


def test_recursive_averages_by_hand(spark):
    both = bars_of(spark, [1, 2, 4]).unionByName(bars_of(spark, [10, 20], "b"))
    assert values(ind.with_ema(both, 3), "ema3") == [1.0, 1.5, 2.75, 10.0, 15.0]
    with_null = bars_of(spark, [1, 2, 4]).withColumn("close", F.when(F.col("close") != 2, F.col("close")))
    assert values(ind.with_ema(with_null, 3), "ema3") == [1.0, 1.0, 2.5]


def test_wilder_seed_by_hand(spark):
    df = bars_of(spark, [1, 2, 4, 3, 3, 6])  # changes 1, 2, -1, 0, 3; the first three average 1 up and 1/3 down
    assert values(ind.with_rsi_wilder(df, 3, 3), "rsi_wilder") == [None, None, None, 75.0, 75.0, pytest.approx(100 * (13 / 9) / (13 / 9 + 4 / 27))]


@pytest.mark.parametrize(("block", "hours"), [(512, 720), (4, 7), (1, 1), (1000, 10_000)])
def test_smoothing_does_not_depend_on_blocks(spark, monkeypatch, block, hours):
    """Long series, several weights, missing values and a seed of several values, against pandas."""
    monkeypatch.setattr(ind, "BLOCK", block)
    closes = [math.sin(k) * 1000 + k % 7 for k in range(700)]
    df = bars_of(spark, closes).unionByName(bars_of(spark, closes[5:90], None)).withColumn("x", F.when((F.minute("bar_ts") == 0) & (F.hour("bar_ts") % 5 != 2), F.col("close")))
    steps = [ind.Smooth(f"y{k}", F.col("x"), w, n) for k, (w, n) in enumerate([(0.9, 1), (1.0, 1), (0.002, 1), (1 / 14, 14), (0.5, 3)])]
    rows = ind.smoothed(df, steps, hours=hours).orderBy("sym", "bar_ts").toPandas()
    for _, part in rows.groupby("sym", dropna=False):
        known = part["x"].dropna()
        for k, (_, _, w, n) in enumerate(steps):
            seeded = pd.concat([pd.Series([known[:n].mean()], index=known.index[n - 1 : n]), known[n:]])
            want = seeded.ewm(alpha=w, adjust=False).mean().reindex(part.index).ffill()
            assert part[f"y{k}"].tolist() == pytest.approx(want.tolist(), rel=1e-9, abs=1e-9, nan_ok=True)


@pytest.mark.parametrize("lengths", [(12, 26, 9), (9, 26, 9), (3, 10, 11)])
def test_macd_of_any_lengths(spark, lengths):
    """In one pass, or in two where the signal is as long as an average."""
    fast, slow, signal = lengths
    s = pd.Series([math.sin(k) * 50 + k for k in range(120)])
    macd = s.ewm(span=fast, adjust=False).mean() - s.ewm(span=slow, adjust=False).mean()
    found = values(ind.with_macd(bars_of(spark, s), *lengths), "macd", "macd_signal", "macd_hist")
    line = macd.ewm(span=signal, adjust=False).mean()
    assert [x for row in found for x in row] == pytest.approx([x for row in zip(macd, line, macd - line, strict=True) for x in row], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("lengths", [(12, 26, 9), (9, 26, 9)])
def test_macd_stays_where_a_close_is_missing(spark, lengths):
    closes = [math.sin(k) * 50 + k for k in range(40)]
    whole = values(ind.with_macd(bars_of(spark, closes), *lengths), "macd", "macd_signal", "macd_hist")
    missing = bars_of(spark, [*closes[:20], 0, 0, *closes[20:]]).withColumn("close", F.when(~F.col("bar_ts").isin(*[START + dt.timedelta(hours=k) for k in (20, 21)]), F.col("close")))
    gaps = values(ind.with_macd(missing, *lengths), "macd", "macd_signal", "macd_hist")
    assert [x for row in gaps for x in row] == pytest.approx([x for row in [*whole[:20], whole[19], whole[19], *whole[20:]] for x in row], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_recursion_goes_on_across_batches(spark, batch):
    closes = [math.sin(k) + 2 for k in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = values(ind.with_macd(bars_of(spark, closes).unionByName(bars_of(spark, closes[::-1], "b"))), "macd", "macd_signal")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    s = pd.Series(closes)
    macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    assert [x for x, _ in found[:50]] == pytest.approx(macd.tolist()) and [y for _, y in found[:50]] == pytest.approx(macd.ewm(span=9, adjust=False).mean().tolist())


def test_oscillators_by_hand(spark):
    df = bars_of(spark, [10, 12, 11, 11])
    assert values(ind.with_rsi(df, 2), "rsi") == [None, None, pytest.approx(200 / 3), 0.0]
    assert values(ind.with_rsi_wilder(df, 2), "rsi_wilder") == [None, 100.0, pytest.approx(200 / 3), pytest.approx(200 / 3)]
    assert values(ind.with_atr(df, 2), "atr") == [None, 2.5, 2.5, 2.0]
    assert values(ind.with_obv(df), "obv") == [0.0, 10.0, 0.0, 0.0]
    assert values(ind.with_stochastic(df, 2, 2), "stoch_k", "stoch_d") == [(None, None), (75.0, None), (pytest.approx(100 / 3), pytest.approx((75 + 100 / 3) / 2)), (50.0, pytest.approx((100 / 3 + 50) / 2))]


def test_conditions_by_hand(spark):
    df = bars_of(spark, [1, 3, 2, 3, 3]).withColumn("two", F.lit(2.0))
    made = {"above": cond.cross_above("close", "two"), "below": cond.cross_below("close", "two"), "stay": cond.persist(F.col("close") >= 2, 2), "lately": cond.recent(F.col("close") == 1, 2)}
    found = cond.with_conditions(df, made)
    assert values(found, "above") == [False, True, False, True, False] and values(found, "below") == [False] * 5
    assert values(found, "stay") == [False, False, True, True, True] and values(found, "lately") == [True, True, False, False, False]
    assert [r["cond"] for r in cond.long_form(found, list(made)).orderBy("bar_ts", "cond").collect()] == ["lately", "above", "lately", "stay", "above", "stay", "stay"]
    assert cond.long_form(found, []).collect() == []


def test_patterns_by_hand(spark):
    rows = [("a", START, 10.0, 12.0, 5.0, 7.0), ("a", START + dt.timedelta(hours=1), 6.0, 13.0, 4.0, 11.0), ("a", START + dt.timedelta(hours=2), 8.0, 9.0, 7.0, 8.05)]
    df = spark.createDataFrame([(*row, 1.0, 1) for row in rows], BAR)
    found = cond.with_conditions(df, {name: cond.pattern(name) for name in cond.PATTERNS})
    assert values(found, *cond.PATTERNS) == [(False, False, False, False), (False, False, True, False), (True, True, False, False)]


def test_nothing_looks_ahead(spark, sf_dir):
    """Changing later bars leaves everything up to then as it was, but for the outcome label."""
    whole = conditioned(spark, sf_dir)
    cut = dt.datetime(2024, 1, 15)
    changed = whole.select("sym", "bar_ts", *[F.when(F.col("bar_ts") < F.lit(cut), F.col(n)).otherwise(F.col(n) * 3 + 1).alias(n) for n in ("open", "high", "low", "close", "volume")], "ticks")
    for made in (lambda df: ind.with_macd(df), lambda df: ind.with_rsi(df), lambda df: df.withColumns({"x": ind.zscore(5), **ind.bands(5, 2.0)}), lambda df: strategies.crossover_backtest(df, [3], [5]), lambda df: ind.with_stochastic(df)):
        base = whole.select(*changed.columns)
        assert sorted(map(repr, made(base).where(F.col("bar_ts") < F.lit(cut)).collect())) == sorted(map(repr, made(changed).where(F.col("bar_ts") < F.lit(cut)).collect()))


@pytest.fixture(scope="module")
def sets_and_bars(spark, sf_dir):
    found = conditioned(spark, sf_dir).cache()
    return rules.itemsets(found, NAMES, 3, 5), found


def test_itemsets_against_counting(sets_and_bars):
    sets, found = sets_and_bars
    baskets = [{name for name in NAMES if row[name]} for row in found.collect()]
    want = {c: n for k in (1, 2, 3) for c in itertools.combinations(sorted(NAMES), k) if (n := sum(set(c) <= basket for basket in baskets)) >= 5}
    assert {tuple(r["items"]): r["n"] for r in sets.collect()} == want
    assert all(want[c[:-1]] >= n for c, n in want.items() if len(c) > 1)


def test_fp_growth_agrees(sets_and_bars):
    sets, found = sets_and_bars
    total = found.count()
    freq, grown = rules.fp_growth(found, NAMES, 5 / total, 0.3)
    assert {tuple(sorted(r["items"])): r["freq"] for r in freq.collect() if len(r["items"]) <= 3} == {tuple(r["items"]): r["n"] for r in sets.collect()}
    ours = {(tuple(sorted(r["antecedent"])), r["consequent"]): (r["confidence"], r["lift"]) for r in rules.association_rules(sets, total).collect()}
    for row in grown.collect():
        key = (tuple(sorted(row["antecedent"])), row["consequent"][0])
        if key in ours:
            assert ours[key] == pytest.approx((row["confidence"], row["lift"]))


def test_combination_scores_against_counting(sets_and_bars):
    _, found = sets_and_bars
    rows = [({name for name in NAMES if row[name]}, row["fwd"]) for row in found.collect() if row["fwd"] is not None]
    made = {tuple(r["items"]): (r["n"], r["wins"]) for r in rules.combination_scores(found, NAMES, 3).collect()}
    want = {}
    for k in (1, 2, 3):
        for c in itertools.combinations(sorted(NAMES), k):
            fwd = [f for held, f in rows if set(c) <= held]
            if fwd:
                want[c] = (len(fwd), sum(f > 0 for f in fwd))
    assert made == want


def test_mining_scores_the_earlier_half_only(sets_and_bars):
    _, found = sets_and_bars
    halves = strategies.with_folds(found, 2)
    later = halves.withColumn("fwd", F.when(F.col("fold") == 1, F.col("fwd")).otherwise(-F.col("fwd")))
    pick = lambda df: sorted((tuple(r["items"]), r["train_n"], r["z"], r["rank"], r["kept"]) for r in rules.mined(df, NAMES, 2, 3, 0.3).collect())
    assert pick(halves) == pick(later) != []


def test_pruning_by_hand(spark):
    df = spark.createDataFrame([(["a"], "z", 0.5), (["a", "b"], "z", 0.5), (["a", "c"], "z", 0.6), (["b", "c"], "z", 0.1), (["c"], "y", 0.9)], "antecedent array<string>, consequent string, confidence double")
    assert sorted((tuple(r["antecedent"]), r["consequent"]) for r in rules.pruned(df).collect()) == [(("a",), "z"), (("a", "c"), "z"), (("b", "c"), "z"), (("c",), "y")]


def test_false_discovery_by_hand(spark):
    p = [0.01, 0.02, 0.03, 0.5, 0.9]
    from statistics import NormalDist

    df = spark.createDataFrame([(k, NormalDist().inv_cdf(1 - x)) for k, x in enumerate(p)], "id int, z double")
    rows = sorted(rules.false_discovery(df, 0.05).collect(), key=lambda r: r["id"])
    assert [r["p"] for r in rows] == pytest.approx(p, abs=1e-6) and [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["kept"] for r in rows] == [True, True, True, False, False]
    assert spark.range(1).select(upper_tail(F.lit(-1.0)).alias("p")).first()[0] == pytest.approx(0.841344746, abs=1e-6)


def test_positions_trades_and_equity_by_hand(spark):
    df = bars_of(spark, [10, 11, 12.1, 11, 11, 22]).withColumns({"in": F.col("close").isin(10, 11), "out": F.col("close") > 12})
    made = strategies.with_equity(strategies.with_profit(strategies.with_position(df, F.col("in"), F.col("out")), 100.0))
    assert values(made, "pos") == [0, 1, 1, 0, 1, 1]
    assert values(made, "pnl") == pytest.approx([0, 0.1 - 0.01, 0.1, -0.01, -0.01, 1.0])
    found = sorted((r["trade_id"], r["n"], round(r["pnl"], 9)) for r in strategies.trades(made).collect())
    assert found == [(1, 2, 0.19), (2, 2, 0.99)]
    assert values(made, "drawdown")[3] == pytest.approx(0.01) and values(made, "equity")[-1] == pytest.approx(1.09 * 1.1 * 0.99 * 0.99 * 2)
    row = strategies.metrics(made, "sym").first()
    assert row["total"] == pytest.approx(1.09 * 1.1 * 0.99 * 0.99 * 2 - 1) and row["exposure"] == pytest.approx(4 / 6) and row["hit_rate"] == pytest.approx(3 / 4)


def test_losing_everything_is_not_null(spark):
    df = bars_of(spark, [10, 10, 0, 5]).withColumns({"pos": F.lit(1)})
    made = strategies.with_equity(strategies.with_profit(df))
    assert all(x is not None for x in values(made, "log_equity")) and values(made, "drawdown")[-1] > 0.999


def test_brackets_by_hand(spark):
    df = bars_of(spark, [100, 101, 108, 90, 100, 100, 100])
    found = strategies.bracket_exits(df, F.col("close").isin(100, 101), 0.05, 0.05, 2).orderBy("t_in").collect()
    assert [(r["t_in"].hour, r["reason"], r["t_out"] and r["t_out"].hour, round(r["ret"], 6)) for r in found] == [
        (0, "target", 2, 0.05), (1, "target", 2, 0.05), (4, "time", 6, 0.0), (5, "open", 6, 0.0), (6, "open", None, 0.0),
    ]


def test_walk_forward_trains_only_on_the_past(spark, sf_dir):
    base = conditioned(spark, sf_dir).select("sym", "bar_ts", "open", "high", "low", "close", "volume", "ticks")
    tested = strategies.with_folds(strategies.crossover_backtest(base, [2], [4]), 3, "fast", "slow")
    folds = {(r["sym"], r["fold"]): (r["n"], r["s"]) for r in tested.groupBy("sym", "fold").agg(F.count("*").alias("n"), F.sum("pnl").alias("s")).collect()}
    for row in strategies.walk_forward(tested, ["sym"]).collect():
        past = [folds[row["sym"], k] for k in range(1, row["test_fold"])]
        assert row["train_n"] == sum(n for n, _ in past) and row["train_mean"] == pytest.approx(sum(s for _, s in past) / row["train_n"])
    with pytest.raises(ValueError, match="shorter"):
        strategies.crossover_grid(base, [5], [5])


def test_dealing_a_grid_changes_nothing(spark, sf_dir, monkeypatch):
    base = conditioned(spark, sf_dir).select("sym", "bar_ts", "open", "high", "low", "close", "volume", "ticks")
    found = []
    for least in (1, 100):
        monkeypatch.setattr(strategies, "DEAL_FROM", least)
        found.append(sorted(map(repr, strategies.crossover_backtest(base, [2, 3], [4, 6]).select("sym", "bar_ts", "fast", "slow", "pos", "pnl").collect())))
    assert found[0] == found[1]


def test_portfolio_and_excess(spark, sf_dir):
    placed = strategy(spark, sf_dir)
    total = placed.agg(F.sum("pnl")).first()[0]
    assert strategies.portfolio(placed).agg(F.sum(F.col("pnl") * F.col("n"))).first()[0] == pytest.approx(total)
    assert strategies.excess(placed).agg(F.sum(F.col("excess") + F.col("hold"))).first()[0] == pytest.approx(total)


def test_training_does_not_look_into_the_later_half(spark, sf_dir):
    """A bar whose return ends in the other half counts in neither, for any length of the return."""
    halves = strategies.with_folds(conditioned(spark, sf_dir).withColumn("fwd", rules.forward_return(3)), 2)
    known = halves.where("fwd is not null").groupBy("sym").agg(F.count_if(F.col("fold") == 1).alias("n")).collect()
    left = {r["sym"]: r["n"] for r in rules.purged(halves, 3).where("fwd is not null and fold = 1").groupBy("sym").agg(F.count("*").alias("n")).collect()}
    assert known and all(left[r["sym"]] == r["n"] - 3 for r in known)
    first = rules.mined(halves, NAMES, 1, 1, 0.3, h=3).where(F.col("items") == F.array(F.lit("up"))).first()
    assert first["train_n"] == rules.purged(halves, 3).where("fwd is not null and fold = 1 and up").count()


def test_pruning_with_a_common_condition(spark):
    """Thousands of rules that share a condition meet only the sets below them; sets that are no rules lie between."""
    rows = [(["hot"], "z", 0.5)] + [(["hot", f"c{k}"], "z", 0.4 if k % 2 else 0.6) for k in range(1500)] + [(["hot", f"c{k}", f"d{k}"], "z", 0.55) for k in range(0, 1500, 3)]
    df = spark.createDataFrame(rows, "antecedent array<string>, consequent string, confidence double")
    kept = {tuple(r["antecedent"]) for r in rules.pruned(df).collect()}
    want = {tuple(a) for a, _, own in rows if all(own > other for b, _, other in rows[:1] + [r for r in rows[1:1501] if r[0][1] in a] if set(b) < set(a))}
    assert kept == want
    deep = spark.createDataFrame([(["a"], "z", 0.9), (["a", "b", "c", "d"], "z", 0.5), (["e", "b", "c"], "z", 0.5)], df.schema)
    assert sorted(tuple(r["antecedent"]) for r in rules.pruned(deep).collect()) == [("a",), ("e", "b", "c")]


def test_sequences_by_hand(spark):
    held_on = {0: "a", 2: "b", 3: "b", 5: "a", 6: "c", 9: "b"}
    df = bars_of(spark, range(1, 12)).withColumns({c: F.hour("bar_ts").isin(*[k for k, v in held_on.items() if v == c]) for c in "abc"}).withColumn("fwd", rules.forward_return())
    found = {tuple(r["items"]): r["n"] for r in rules.sequences(df, ["a", "b", "c"], 3, 3, 1).collect()}
    assert found == {
        ("a",): 2, ("b",): 3, ("c",): 1, ("a", "b"): 2, ("b", "b"): 1, ("b", "a"): 1, ("a", "c"): 1, ("b", "c"): 1, ("c", "b"): 1,
        ("a", "b", "b"): 1, ("a", "b", "a"): 1, ("a", "b", "c"): 1, ("b", "b", "a"): 1, ("b", "b", "c"): 1, ("b", "a", "c"): 1, ("a", "c", "b"): 1, ("b", "c", "b"): 1,
    }


def test_permuted_scores_see_through_dependent_bars(spark):
    """A condition that paid on one lucky day has a high z and no significance by days; one that pays each day keeps it."""
    rows = []
    for k in range(24 * 40):
        day, lucky, steady = k // 24, k // 24 == 7, k % 6 == 0
        rows.append(("a", START + dt.timedelta(hours=k), lucky, steady, (0.5 if lucky else 0.0) + (0.3 if steady else 0.0) + 0.01 * math.sin(k * k) + 0.001 * (day % 2)))
    df = spark.createDataFrame(rows, "sym string, bar_ts timestamp_ntz, lucky boolean, steady boolean, fwd double")
    found = {tuple(r["items"]): r["p"] for r in rules.permuted(df, ["lucky", "steady"], 1, 5).collect()}
    assert found["steady",] == 0.01 and found["lucky",] > 0.3


def loop_of_strategy(df, entry, leave, fold, fee):
    """(entries, total, exposure, hits, drawdown) of one strategy bar by bar in plain Python."""
    entries, total, inside, hits, worst = 0, 0.0, 0, 0, 0.0
    for rows in df.values():
        wanted, path, top = 0, 0.0, 0.0
        for k, row in enumerate(rows):
            before, counted = wanted, k + 1 < len(rows) and rows[k + 1]["fold"] == row["fold"] and row["fwd"] is not None
            wanted = 0 if all(row[c] for c in leave) else 1 if all(row[c] for c in entry) else wanted
            if counted and row["fold"] == fold:
                pnl = wanted * row["fwd"] - abs(wanted - before) * fee
                entries, total, inside, hits = entries + (wanted > before), total + pnl, inside + wanted, hits + (pnl > 0)
                path += math.log(max(1 + pnl, 1e-9))
                top = max(top, path)
                worst = max(worst, 1 - math.exp(path - top))
    return entries, total, inside, hits, worst


@pytest.mark.parametrize(("block", "at_once", "hours"), [(512, 1024, 720), (3, 4, 5), (1, 1, 1), (50, 7, 100)])
def test_strategies_of_sets_against_a_loop(spark, sf_dir, monkeypatch, block, at_once, hours):
    """Blocks, buckets and groups of strategies of any size compose to the same figures."""
    monkeypatch.setattr(rule_strategies, "BLOCK", block)
    monkeypatch.setattr(rule_strategies, "AT_ONCE", at_once)
    halves = strategies.with_folds(conditioned(spark, sf_dir), 2).select("sym", "bar_ts", "fold", "fwd", *NAMES).cache()
    found = {(r["entry"], r["exit"]): r for r in rule_strategies.mined(halves, NAMES, 2, 8, 5.0, hours=hours).collect()}
    series = {}
    for row in halves.orderBy("bar_ts").collect():
        series.setdefault(row["sym"], []).append(row)
    assert len(found) > 20 and all(r["tried"] == len(found) for r in found.values()) and sorted(r["rank"] for r in found.values()) == [*range(1, len(found) + 1)]
    for entry, leave in sorted(found)[::7]:
        row = found[entry, leave]
        for fold, part in ((1, "train"), (2, "test")):
            entries, total, inside, hits, worst = loop_of_strategy(series, entry.split("+"), leave.split("+"), fold, 0.0005)
            assert (row[f"{part}_entries"], row[f"{part}_total"], row[f"{part}_drawdown"]) == (entries, pytest.approx(total), pytest.approx(worst))
            assert row[f"{part}_exposure"] == pytest.approx(inside / row[f"{part}_bars"]) and row[f"{part}_hit_rate"] == pytest.approx(hits / inside if inside else None)


def test_too_many_strategies_are_refused():
    with pytest.raises(ValueError, match="raise the least"):
        rule_strategies.strategies_of([f"c{k}" for k in range(200)], [(f"c{k}",) for k in range(200)])
    assert rule_strategies.strategies_of(["a", "b"], [("a",), ("a", "b")]).pairs == ((0, 1),)


def test_no_sets_give_no_strategies(spark, sf_dir):
    halves = strategies.with_folds(conditioned(spark, sf_dir), 2)
    assert rule_strategies.mined(halves, NAMES, 2, 10**6).collect() == []


def test_thousands_of_strategies_do_not_multiply_the_bars(spark, sf_dir):
    """What is shuffled by the job are bars and a row for each bucket, whatever is tried."""
    halves = strategies.with_folds(conditioned(spark, sf_dir), 2)
    sets = [(a,) for a in NAMES] + list(itertools.combinations(sorted(NAMES), 2)) + list(itertools.combinations(sorted(NAMES), 3))
    plan = rule_strategies.scored(halves, rule_strategies.strategies_of(NAMES, sets), 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
