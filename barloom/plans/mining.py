"""Conditions, rules and strategies over hour bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import full, last_rows
from barloom.operators import conditions as cond
from barloom.operators import indicators as ind
from barloom.operators import rule_strategies, rules, strategies
from barloom.plans.bars import hours
from barloom.plans.registry import HOURS, SERIES, query, rounded, rows, shown, when_full

NAMES = ("above_avg", "doji", "heavy", "new_high", "up")

CONDITIONS = f"""c AS (SELECT *, coalesce(close > {when_full("avg(close)", 5)}, false) AS above_avg, coalesce(abs(close - open) <= 0.1 * (high - low), false) AS doji,
coalesce(volume > {when_full("avg(volume)", 10)}, false) AS heavy, coalesce(high >= {when_full("max(high)", 10)}, false) AS new_high, coalesce(close > open, false) AS up,
lead(close) OVER ({SERIES}) / nullif(close, 0) - 1 AS fwd FROM b)"""
HELD = "list_filter([" + ", ".join(f"CASE WHEN {name} THEN '{name}' END" for name in NAMES) + "], lambda x: x IS NOT NULL)"
LONG = f"{HOURS}, {CONDITIONS}, l AS (SELECT sym, bar_ts, fwd, unnest({HELD}) AS cond FROM c)"
OUTCOME = f"count(*) AS n, count(*) FILTER (fwd > 0) AS wins, {shown(mean_fwd='avg(fwd)')}"


def conditioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour bars with five conditions and the forward return."""
    made = {
        "above_avg": F.col("close") > ind.sma(5), "doji": cond.doji(), "heavy": F.col("volume") > full(F.avg("volume").over(last_rows(10)), 10),
        "new_high": F.col("high") >= ind.channel(10)["channel_high"], "up": F.col("close") > F.col("open"),
    }
    return cond.with_conditions(hours(spark, sf_dir), made).withColumn("fwd", rules.forward_return())


BEFORE = {name: f"lag({name}) OVER ({SERIES})" for name in ("open", "high", "low", "close")}


@query(f"""{HOURS} SELECT sym, bar_ts, coalesce(abs(close - open) <= 0.1 * (high - low), false) AS doji,
coalesce(high < {BEFORE["high"]} AND low > {BEFORE["low"]}, false) AS inside_bar,
coalesce(close > open AND {BEFORE["close"]} < {BEFORE["open"]} AND open <= {BEFORE["close"]} AND close >= {BEFORE["open"]}, false) AS bullish_engulfing,
coalesce(close < open AND {BEFORE["close"]} > {BEFORE["open"]} AND open >= {BEFORE["close"]} AND close <= {BEFORE["open"]}, false) AS bearish_engulfing FROM b""")
def cond_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {name: cond.pattern(name) for name in cond.PATTERNS}
    return cond.with_conditions(hours(spark, sf_dir), made).select("sym", "bar_ts", *made)


@query(f"""{HOURS}, a AS (SELECT *, {when_full("avg(close)", 3)} AS f, {when_full("avg(close)", 10)} AS s, close > open AS up FROM b),
x AS (SELECT *, f > s AND lag(f) OVER ({SERIES}) <= lag(s) OVER ({SERIES}) AS above, f < s AND lag(f) OVER ({SERIES}) >= lag(s) OVER ({SERIES}) AS below FROM a)
SELECT sym, bar_ts, coalesce(above, false) AS above, coalesce(below, false) AS below,
coalesce(CASE WHEN count(*) OVER {rows(2)} = 2 THEN min(up::INT) OVER {rows(2)} = 1 END, false) AS up_2, max(up::INT) OVER {rows(3)} = 1 AS up_in_3,
coalesce(up AND NOT (f > s), false) AS up_below, coalesce(up OR f > s, false) AS up_or_over FROM x""")
def cond_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    averaged = hours(spark, sf_dir).withColumns({"f": ind.sma(3), "s": ind.sma(10), "up": F.col("close") > F.col("open")})
    over = F.col("f") > F.col("s")
    made = {
        "above": cond.cross_above("f", "s"), "below": cond.cross_below("f", "s"), "up_2": cond.persist("up", 2), "up_in_3": cond.recent("up", 3),
        "up_below": cond.all_of(F.col("up"), cond.negate(over)), "up_or_over": cond.any_of(F.col("up"), over),
    }
    return cond.with_conditions(averaged, made).select("sym", "bar_ts", *made)


@query(f"{LONG} SELECT sym, bar_ts, cond FROM l")
def cond_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cond.long_form(conditioned(spark, sf_dir), NAMES)


@query(f"{LONG} SELECT cond, {OUTCOME} FROM l WHERE fwd IS NOT NULL GROUP BY cond")
def rule_singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.single_scores(conditioned(spark, sf_dir), NAMES))


PAIRS = f"{LONG}, p AS (SELECT a.cond AS c1, b.cond AS c2, a.fwd FROM l a JOIN l b ON a.sym = b.sym AND a.bar_ts = b.bar_ts AND a.cond < b.cond WHERE a.fwd IS NOT NULL)"


@query(f"{PAIRS} SELECT c1, c2, {OUTCOME} FROM p GROUP BY c1, c2")
def rule_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.pair_scores(conditioned(spark, sf_dir), NAMES))


LEAST = 20
SETS = f"""{LONG}, i1 AS (SELECT sym, bar_ts, [cond] AS items FROM l), i2 AS (SELECT i.sym, i.bar_ts, list_append(items, cond) AS items FROM i1 i JOIN l ON i.sym = l.sym AND i.bar_ts = l.bar_ts AND cond > items[-1]),
i3 AS (SELECT i.sym, i.bar_ts, list_append(items, cond) AS items FROM i2 i JOIN l ON i.sym = l.sym AND i.bar_ts = l.bar_ts AND cond > items[-1]),
f AS (SELECT items, count(*) AS n FROM (FROM i1 UNION ALL FROM i2 UNION ALL FROM i3) GROUP BY items HAVING count(*) >= {LEAST})"""


@query(f"{SETS} SELECT array_to_string(items, '+') AS items, n FROM f")
def rule_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.itemsets(conditioned(spark, sf_dir), NAMES, 3, LEAST).select(F.array_join("items", "+").alias("items"), "n")


ASSOCIATED = f"""{SETS}, u AS (SELECT items, n, unnest(items) AS consequent FROM f WHERE len(items) > 1), v AS (SELECT list_filter(items, lambda x: x <> consequent) AS antecedent, consequent, n FROM u),
total AS (SELECT count(*) AS bars FROM b),
r AS (SELECT antecedent, consequent, v.n, v.n / bars AS support, v.n / a.n AS confidence, v.n / a.n / (c.n / bars) AS lift FROM v JOIN f a ON a.items = antecedent JOIN f c ON c.items = [consequent], total)"""


def associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conditioned(spark, sf_dir)
    return rules.association_rules(rules.itemsets(found, NAMES, 3, LEAST), found.count())


@query(f"{ASSOCIATED} SELECT array_to_string(antecedent, '+') AS antecedent, consequent, n, {shown('support', 'confidence', 'lift')} FROM r")
def rule_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(associated(spark, sf_dir).withColumn("antecedent", F.array_join("antecedent", "+")))


@query(f"""{ASSOCIATED} SELECT array_to_string(antecedent, '+') AS antecedent, consequent, {shown('confidence')} FROM r
WHERE NOT EXISTS (FROM r s WHERE s.consequent = r.consequent AND len(s.antecedent) < len(r.antecedent) AND list_has_all(r.antecedent, s.antecedent) AND r.confidence <= s.confidence)""")
def rule_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rules.pruned(associated(spark, sf_dir))
    return rounded(kept.select(F.array_join("antecedent", "+").alias("antecedent"), "consequent", "confidence"))


@query(f"""{LONG}, s AS (SELECT sym, bar_ts, list(cond) AS conds FROM l GROUP BY ALL), a AS (SELECT list_sort({HELD}) AS conds FROM c), total AS (SELECT count(*) AS bars FROM b),
m AS (SELECT unnest(range(1, {1 << len(NAMES)})) AS mask), x AS (SELECT list_filter({list(NAMES)!r}, lambda name, k: (mask >> (k - 1)::INT) & 1 = 1) AS items FROM m),
n AS (SELECT items, count(*) AS freq FROM x JOIN a ON list_has_all(conds, items) GROUP BY items)
SELECT array_to_string(items, '+') AS items, freq FROM n, total WHERE freq >= 0.02 * bars""")
def rule_fp_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, _ = rules.fp_growth(conditioned(spark, sf_dir), NAMES, 0.02, 0.3)
    return sets.select(F.array_join(F.sort_array("items"), "+").alias("items"), "freq")


@query(f"""{HOURS}, {CONDITIONS}, o AS (SELECT *, row_number() OVER ({SERIES}) AS rn FROM c), l AS (SELECT sym, rn, unnest({HELD}) AS cond FROM o)
SELECT a.cond AS c1, b.cond AS c2, b.rn - a.rn AS lag, count(*) AS n FROM l a JOIN l b ON a.sym = b.sym AND b.rn - a.rn BETWEEN 1 AND 3 GROUP BY ALL""")
def rule_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rules.lagged_pairs(conditioned(spark, sf_dir), NAMES, 3)
    return made.withColumn("lag", F.col("lag").cast("long"))


TAIL = (
    "(((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-abs(z) / sqrt(2.0) * abs(z) / sqrt(2.0)) / 2)"
)


@query(f"""{PAIRS}, s AS (SELECT c1, c2, count(*) AS n, count(*) FILTER (fwd > 0) AS wins FROM p GROUP BY ALL),
z AS (SELECT *, (wins - n * 0.5) / nullif(sqrt(n * 0.5 * (1 - 0.5)), 0) AS z FROM s), k AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS k FROM z),
q AS (SELECT *, CASE WHEN z >= 0 THEN {TAIL} ELSE 1 - {TAIL} END AS p FROM k), r AS (SELECT *, row_number() OVER (ORDER BY p, c1, c2) AS rank, count(*) OVER () AS m FROM q)
SELECT c1, c2, n, wins, {shown("z", "p")}, rank, rank <= coalesce((SELECT max(rank) FROM r WHERE p <= rank * 0.3 / m), 0) AS kept FROM r""")
def rule_false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rules.pair_scores(conditioned(spark, sf_dir), NAMES).select("c1", "c2", "n", "wins").withColumn("z", rules.binomial_z())
    return rounded(rules.false_discovery(scored, 0.3), "z", "p")


# Halves of each series; a bar counts where its return is known and ends in its own half.
HALVES = f"n2 AS (SELECT *, ntile(2) OVER ({SERIES}) AS fold FROM c), h AS (SELECT *, fwd IS NOT NULL AND coalesce(lead(fold) OVER ({SERIES}) = fold, false) AS counted FROM n2)"


@query(f"""{HOURS}, {CONDITIONS}, {HALVES}, l AS (SELECT sym, bar_ts, fwd, fold, unnest({HELD}) AS cond FROM h WHERE counted),
i1 AS (SELECT sym, bar_ts, fwd, fold, [cond] AS items FROM l),
i2 AS (SELECT i.sym, i.bar_ts, i.fwd, i.fold, list_append(items, cond) AS items FROM i1 i JOIN l ON i.sym = l.sym AND i.bar_ts = l.bar_ts AND cond > items[-1]),
i3 AS (SELECT i.sym, i.bar_ts, i.fwd, i.fold, list_append(items, cond) AS items FROM i2 i JOIN l ON i.sym = l.sym AND i.bar_ts = l.bar_ts AND cond > items[-1]),
s AS (SELECT array_to_string(items, '+') AS items, fold, count(*) AS n, count(*) FILTER (fwd > 0) AS wins, avg(fwd) AS mean_fwd FROM (FROM i1 UNION ALL FROM i2 UNION ALL FROM i3) GROUP BY ALL),
z AS (SELECT *, (wins - n * 0.5) / nullif(sqrt(n * 0.5 * (1 - 0.5)), 0) AS z FROM s WHERE fold = 1 AND n >= {LEAST}), k AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS k FROM z),
q AS (SELECT *, CASE WHEN z >= 0 THEN {TAIL} ELSE 1 - {TAIL} END AS p FROM k), r AS (SELECT *, row_number() OVER (ORDER BY p, string_split(items, '+'), n, wins, mean_fwd) AS rank, count(*) OVER () AS m FROM q)
SELECT r.items, r.n AS train_n, r.wins AS train_wins, {shown(train_mean="r.mean_fwd")}, {shown("z", "p")}, rank, rank <= coalesce((SELECT max(rank) FROM r WHERE p <= rank * 0.3 / m), 0) AS kept,
m AS tried, coalesce(t.n, 0) AS test_n, {shown(test_mean="t.mean_fwd")} FROM r LEFT JOIN s t ON t.items = r.items AND t.fold = 2""")
def rule_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rules.mined(strategies.with_folds(conditioned(spark, sf_dir), 2), NAMES, 3, LEAST, 0.3)
    return rounded(made.withColumns({"items": F.array_join("items", "+"), "tried": F.col("tried").cast("long")}))


@query(f"{PAIRS} SELECT c1, c2, {OUTCOME} FROM p GROUP BY c1, c2 ORDER BY avg(fwd) DESC, c1, c2 LIMIT 5")
def rule_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.top(rules.pair_scores(conditioned(spark, sf_dir), NAMES), 5, "mean_fwd", "c1", "c2"))


# One strategy: in while the close is above its average of 10 bars, 5 basis points a change.
STRATEGY = f"""a AS (SELECT *, {when_full("avg(close)", 10)} AS m FROM b), g AS (SELECT *, CASE WHEN close <= m THEN 0 WHEN close > m THEN 1 END AS sig FROM a),
w AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER ({SERIES}), 0) AS wanted FROM g), p AS (SELECT *, coalesce(lag(wanted) OVER ({SERIES}), 0) AS pos FROM w),
e AS (SELECT *, pos * coalesce(close / nullif(lag(close) OVER ({SERIES}), 0) - 1, 0) - abs(pos - coalesce(lag(pos) OVER ({SERIES}), 0)) * 0.0005 AS pnl FROM p)"""
EQUITY = f"""q AS (SELECT *, sum(ln(greatest(1 + pnl, 1e-9))) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS log_equity FROM e),
d AS (SELECT *, 1 - exp(log_equity - greatest(0, max(log_equity) OVER ({SERIES} ROWS UNBOUNDED PRECEDING))) AS drawdown FROM q)"""


def strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    averaged = hours(spark, sf_dir).withColumn("m", ind.sma(10))
    placed = strategies.with_position(averaged, F.col("close") > F.col("m"), F.col("close") <= F.col("m"))
    return strategies.with_profit(placed, 5.0)


@query(f"{HOURS}, {STRATEGY} SELECT sym, bar_ts, wanted, pos, {shown('pnl')} FROM e")
def strat_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategy(spark, sf_dir).select("sym", "bar_ts", "wanted", "pos", "pnl"))


@query(f"""{HOURS}, {STRATEGY}, i AS (SELECT *, CASE WHEN pos <> 0 AND coalesce(lag(pos) OVER ({SERIES}), 0) = 0 THEN 1 ELSE 0 END AS entered FROM e),
j AS (SELECT *, sum(entered) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS trade_id FROM i)
SELECT sym, trade_id::BIGINT AS trade_id, min(bar_ts) AS t_in, max(bar_ts) AS t_out, count(*) AS n, {shown(pnl='sum(pnl)')} FROM j WHERE pos <> 0 GROUP BY sym, trade_id""")
def strat_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategies.trades(strategy(spark, sf_dir)))


@query(f"{HOURS}, {STRATEGY}, {EQUITY} SELECT sym, bar_ts, {shown('log_equity', 'drawdown')} FROM d")
def strat_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategies.with_equity(strategy(spark, sf_dir)).select("sym", "bar_ts", "log_equity", "drawdown"))


FIGURES = shown(
    log_total="sum(ln(greatest(1 + pnl, 1e-9)))", total="exp(sum(ln(greatest(1 + pnl, 1e-9)))) - 1", mean="avg(pnl)", sharpe="avg(pnl) / nullif(stddev_samp(pnl), 0)", max_drawdown="max(drawdown)",
    hit_rate="count(*) FILTER (pnl > 0) / nullif(count(*) FILTER (pos <> 0), 0)", exposure="avg(abs(pos))",
)


@query(f"{HOURS}, {STRATEGY}, {EQUITY} SELECT sym, count(*) AS n, {FIGURES} FROM d GROUP BY sym")
def strat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategies.metrics(strategies.with_equity(strategy(spark, sf_dir)), "sym"))


FAST, SLOW = (3, 5), (10, 20)
KEYED = "PARTITION BY sym, fast, slow ORDER BY bar_ts"
GRID = (
    "a AS (SELECT *, " + ", ".join(f"{when_full('avg(close)', n)} AS m{n}" for n in (*FAST, *SLOW)) + " FROM b), x AS ("
    + " UNION ALL ".join(f"SELECT sym, bar_ts, close, {f}::INT AS fast, {s}::INT AS slow, m{f} AS f, m{s} AS s FROM a" for f in FAST for s in SLOW) + "), "
) + STRATEGY.split("g AS", 1)[1].join(["g AS", ""]).replace("close <= m ", "f <= s ").replace("close > m ", "f > s ").replace("FROM a)", "FROM x)").replace(SERIES, KEYED)


@query(f"{HOURS}, {GRID}, {EQUITY.replace(SERIES, KEYED)} SELECT sym, fast, slow, count(*) AS n, {FIGURES} FROM d GROUP BY sym, fast, slow")
def strat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategies.metrics(strategies.crossover_backtest(hours(spark, sf_dir), FAST, SLOW, 5.0), "sym", "fast", "slow"))


FOLDS = 4
WALK = f"""fo AS (SELECT *, ntile({FOLDS}) OVER ({KEYED}) AS fold FROM e), pa AS (SELECT sym, fast, slow, fold, count(*) AS test_n, sum(pnl) AS s FROM fo GROUP BY ALL),
wf AS (SELECT a.fold AS test_fold, a.sym, a.fast, a.slow, sum(b.test_n)::BIGINT AS train_n, sum(b.s) / sum(b.test_n) AS train_mean, any_value(a.test_n) AS test_n, any_value(a.s) / any_value(a.test_n) AS test_mean
FROM pa a JOIN pa b ON a.sym = b.sym AND a.fast = b.fast AND a.slow = b.slow AND b.fold < a.fold GROUP BY ALL)"""


@query(f"{HOURS}, {GRID}, {WALK} SELECT test_fold, sym, fast, slow, train_n, {shown('train_mean')}, test_n, {shown('test_mean')} FROM wf")
def strat_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = strategies.crossover_backtest(strategies.with_folds(hours(spark, sf_dir), FOLDS), FAST, SLOW, 5.0)
    made = strategies.walk_forward(tested, ["sym", "fast", "slow"])
    return rounded(made.withColumn("test_fold", F.col("test_fold").cast("long")))


@query(f"""{HOURS}, {GRID}, {WALK}, k AS (SELECT *, row_number() OVER (PARTITION BY sym, test_fold ORDER BY train_mean DESC, fast, slow) AS rank, count(*) OVER (PARTITION BY sym, test_fold) AS tried FROM wf)
SELECT test_fold, sym, fast, slow, {shown('train_mean', 'test_mean')}, rank, tried FROM k WHERE rank <= 2""")
def strat_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = strategies.mined(hours(spark, sf_dir), FAST, SLOW, FOLDS, 2, 5.0).drop("train_n", "test_n")
    return rounded(made.withColumns({"test_fold": F.col("test_fold").cast("long"), "rank": F.col("rank").cast("long")}))


@query(f"""{HOURS}, {CONDITIONS}, o AS (SELECT *, row_number() OVER ({SERIES}) AS rn, count(*) OVER (PARTITION BY sym) AS total FROM c),
l AS (SELECT e.sym, e.rn, e.bar_ts AS t_in, e.close AS price_in, e.total, x.rn AS xrn, x.bar_ts, x.close, x.low <= e.close * (1 - 0.2) AS hit_stop, x.high >= e.close * (1 + 0.2) AS hit_target
      FROM o e LEFT JOIN o x ON x.sym = e.sym AND x.rn BETWEEN e.rn + 1 AND e.rn + 5 WHERE e.new_high),
f AS (SELECT sym, rn, t_in, price_in, total, min(xrn) FILTER (hit_stop OR hit_target) AS first_hit, max(xrn) AS last_seen FROM l GROUP BY ALL),
g AS (SELECT f.*, l.bar_ts AS t_out, l.close, CASE WHEN first_hit IS NOT NULL THEN CASE WHEN hit_stop THEN 'stop' ELSE 'target' END WHEN last_seen = f.rn + 5 THEN 'time' ELSE 'open' END AS reason
      FROM f LEFT JOIN l ON l.sym = f.sym AND l.rn = f.rn AND l.xrn = coalesce(first_hit, last_seen))
SELECT sym, t_in, {shown('price_in')}, t_out, reason, {shown(ret="CASE reason WHEN 'stop' THEN price_in * (1 - 0.2) WHEN 'target' THEN price_in * (1 + 0.2) ELSE coalesce(close, price_in) END / nullif(price_in, 0) - 1")} FROM g""")
def strat_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategies.bracket_exits(conditioned(spark, sf_dir), F.col("new_high"), 0.2, 0.2, 5))


@query(f"{HOURS}, {STRATEGY} SELECT bar_ts, count(*) AS n, {shown(pnl='avg(pnl)')} FROM e GROUP BY bar_ts")
def strat_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategies.portfolio(strategy(spark, sf_dir)))


@query(f"{HOURS}, {STRATEGY}, h AS (SELECT *, coalesce(close / nullif(lag(close) OVER ({SERIES}), 0) - 1, 0) AS hold FROM e) SELECT sym, bar_ts, {shown('pnl', 'hold', excess='pnl - hold')} FROM h")
def strat_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategies.excess(strategy(spark, sf_dir)).select("sym", "bar_ts", "pnl", "hold", "excess"))


@query(f"""{HOURS}, h AS (SELECT *, bar_ts::DATE AS part, max(close) OVER (PARTITION BY sym, bar_ts::DATE ORDER BY bar_ts) AS top, min(bar_ts) OVER (PARTITION BY sym, bar_ts::DATE) AS t_in FROM b),
o AS (SELECT sym, part, t_in, coalesce(min(bar_ts) FILTER (close <= top * (1 - 0.3::DOUBLE)), max(bar_ts)) AS t_out, count(*) FILTER (close <= top * (1 - 0.3::DOUBLE)) > 0 AS stopped FROM h GROUP BY ALL)
SELECT o.sym, part, t_in, t_out, stopped, {shown(ret='b2.close / nullif(b1.close, 0) - 1')} FROM o JOIN b b1 ON b1.sym = o.sym AND b1.bar_ts = t_in JOIN b b2 ON b2.sym = o.sym AND b2.bar_ts = t_out""")
def strat_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's first bar is bought and sold when its close lies 30 % below the day's highest so far."""
    return rounded(strategies.trailing_exits(hours(spark, sf_dir), 0.3, F.to_date("bar_ts")), "ret")


PART = "PARTITION BY sym, entry, leave"
FOLDED = ", ".join(
    f"max({expression}) FILTER (fold = {number}) AS {part}_{name}" for number, part in ((1, "train"), (2, "test"))
    for name, expression in {"bars": "bars", "entries": "entries", "total": "total", "mean": "total / bars", "sharpe": "total / bars / nullif(dev, 0)", "exposure": "inside / bars", "hit_rate": "wins / nullif(inside, 0)", "drawdown": "drawdown"}.items()
)
FIGURED = ("total", "mean", "sharpe", "exposure", "hit_rate", "drawdown")


@query(f"""{HOURS}, {CONDITIONS}, {HALVES}, l AS (SELECT sym, bar_ts, unnest({HELD}) AS cond FROM h WHERE counted AND fold = 1),
i1 AS (SELECT sym, bar_ts, [cond] AS items FROM l), i2 AS (SELECT i.sym, i.bar_ts, list_append(items, cond) AS items FROM i1 i JOIN l ON i.sym = l.sym AND i.bar_ts = l.bar_ts AND cond > items[-1]),
f AS (SELECT items FROM (FROM i1 UNION ALL FROM i2) GROUP BY items HAVING count(*) >= {LEAST}), pr AS (SELECT a.items AS entry, b.items AS leave FROM f a, f b WHERE NOT list_has_all(a.items, b.items)),
g AS (SELECT sym, bar_ts, fold, counted, fwd, entry, leave, CASE WHEN list_has_all({HELD}, leave) THEN 0 WHEN list_has_all({HELD}, entry) THEN 1 END AS sig FROM h, pr),
w AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER ({PART} ORDER BY bar_ts), 0) AS wanted FROM g), v AS (SELECT *, coalesce(lag(wanted) OVER ({PART} ORDER BY bar_ts), 0) AS before FROM w),
e AS (SELECT *, wanted * fwd - abs(wanted - before) * 0.0005 AS pnl FROM v WHERE counted), q AS (SELECT *, sum(ln(greatest(1 + pnl, 1e-9))) OVER ({PART}, fold ORDER BY bar_ts) AS path FROM e),
d AS (SELECT *, 1 - exp(path - greatest(0, max(path) OVER ({PART}, fold ORDER BY bar_ts))) AS drawdown FROM q),
s AS (SELECT entry, leave, fold, count(*) AS bars, count(*) FILTER (wanted = 1 AND before = 0) AS entries, sum(pnl) AS total, stddev_samp(pnl) AS dev, sum(wanted) AS inside, count(*) FILTER (pnl > 0) AS wins, max(drawdown) AS drawdown FROM d GROUP BY ALL),
r AS (SELECT array_to_string(entry, '+') AS entry, array_to_string(leave, '+') AS exit, {FOLDED} FROM s GROUP BY ALL)
SELECT entry, exit, train_bars, test_bars, train_entries, test_entries, {shown(*(f"{part}_{name}" for part in ("train", "test") for name in FIGURED))},
row_number() OVER (ORDER BY round(train_mean, 9) DESC, entry, exit) AS rank, count(*) OVER () AS tried FROM r""")
def strat_mined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of frequent sets of conditions as entry and exit, ranked by the earlier half and scored on the later."""
    return rounded(rule_strategies.mined(strategies.with_folds(conditioned(spark, sf_dir), 2), NAMES, 2, LEAST, 5.0))


@query(f"""{HOURS}, {CONDITIONS}, o AS (SELECT *, row_number() OVER ({SERIES}) AS rn FROM c), l AS (SELECT sym, rn, fwd, unnest({HELD}) AS cond FROM o),
s1 AS (SELECT sym, rn, fwd, [cond] AS items FROM l), f1 AS (SELECT items, {OUTCOME} FROM s1 GROUP BY items HAVING count(*) >= 100),
s2 AS (SELECT DISTINCT b.sym, b.rn, b.fwd, list_append(a.items, b.cond) AS items FROM s1 a JOIN f1 USING (items) JOIN l b ON b.sym = a.sym AND b.rn BETWEEN a.rn + 1 AND a.rn + 3), f2 AS (SELECT items, {OUTCOME} FROM s2 GROUP BY items HAVING count(*) >= 100),
s3 AS (SELECT DISTINCT b.sym, b.rn, b.fwd, list_append(a.items, b.cond) AS items FROM s2 a JOIN f2 USING (items) JOIN l b ON b.sym = a.sym AND b.rn BETWEEN a.rn + 1 AND a.rn + 3), f3 AS (SELECT items, {OUTCOME} FROM s3 GROUP BY items HAVING count(*) >= 100)
SELECT array_to_string(items, '>') AS items, n, wins, mean_fwd FROM (FROM f1 UNION ALL FROM f2 UNION ALL FROM f3)""")
def rule_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three conditions one after another, one to three bars apart."""
    made = rules.sequences(conditioned(spark, sf_dir), NAMES, 3, 3, 100)
    return rounded(made.withColumn("items", F.array_join("items", ">")))


@query(f"""{LONG}, i1 AS (SELECT sym, bar_ts, fwd, [cond] AS items FROM l WHERE fwd IS NOT NULL), i2 AS (SELECT i.sym, i.bar_ts, i.fwd, list_append(items, cond) AS items FROM i1 i JOIN l ON i.sym = l.sym AND i.bar_ts = l.bar_ts AND cond > items[-1]),
d AS (SELECT items, bar_ts::DATE::VARCHAR AS day, sum(fwd) AS total, count(*) AS n FROM (FROM i1 UNION ALL FROM i2) GROUP BY ALL), f AS (SELECT items FROM d GROUP BY items HAVING sum(n) >= {LEAST}), e AS (FROM d SEMI JOIN f USING (items)),
k AS (SELECT range AS k FROM range(-1, 99)), g AS (SELECT DISTINCT day, k, CASE WHEN k >= 0 AND substr(md5('1:' || k || ':' || day), 1, 1) < '8' THEN -1.0 ELSE 1.0 END AS sign FROM e, k),
s AS (SELECT items, k, sum(n)::BIGINT AS n, sum(total * sign) / nullif(sqrt(sum(total * total)), 0) AS score FROM e JOIN g USING (day) GROUP BY ALL), m AS (SELECT k, max(score) AS high FROM s WHERE k >= 0 GROUP BY k)
SELECT array_to_string(items, '+') AS items, n, {shown('score')}, ((SELECT count(*) FROM m WHERE round(high, 9) >= round(s.score, 9)) + 1) / 100 AS p FROM s WHERE k = -1""")
def rule_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of conditions with p-values out of 99 turns of the signs of whole days."""
    made = rules.permuted(conditioned(spark, sf_dir), NAMES, 2, LEAST)
    return rounded(made.withColumn("items", F.array_join("items", "+")), "score")
