"""Rules: sets of conditions scored by what the bars after them did, and association rules.

Inputs are bars in wide form with condition columns (``names``) and, where outcomes matter, a
forward return ``fwd``. Itemsets are counted level by level out of the bars' arrays of conditions, and
only itemsets that reach ``least`` bars go on to the next level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import column, ratio, series, upper_tail
from barloom.operators.conditions import held, long_form
from barloom.operators.joins import broadcast_up_to
from barloom.operators.numbering import row_numbers
from barloom.operators.ranks import numbered
from barloom.sources.shared import checkpointed

BAR = ["sym", "bar_ts"]
#: So many frequent sets of one size are broadcast at most, and ranges of p in which rules are ranked.
BROADCAST_SETS, RANGES = 100_000, 64


def forward_return(h: int = 1, value: str = "close") -> Column:
    """The return over the next h bars: the only column that looks ahead."""
    return ratio(F.lead(value, h).over(series()), value) - 1


def purged(df: DataFrame, h: int = 1) -> DataFrame:
    """``df`` with ``fwd`` only where the bar that it ends on, ``h`` bars on, lies in the same ``fold``: what one fold learns doesn't look into the next."""
    return df.withColumn("fwd", F.when(F.lead("fold", h).over(series()) == F.col("fold"), F.col("fwd")))


def outcome() -> list[Column]:
    """Bars, rises and mean forward return of a group."""
    return [F.count(F.lit(1)).alias("n"), F.count_if(F.col("fwd") > 0).alias("wins"), F.avg("fwd").alias("mean_fwd")]


def single_scores(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(cond, n, wins, mean_fwd) over bars with a known outcome."""
    return long_form(df.where("fwd is not null"), names, "fwd").groupBy("cond").agg(*outcome())


def pair_scores(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(c1, c2, n, wins, mean_fwd) of every two conditions that hold on one bar.

    A bar's pairs come out of its own array, so nothing is joined.
    """
    known = df.where("fwd is not null").select("fwd", F.sort_array(held(names)).alias("conds"))
    pairs = F.flatten(F.transform("conds", lambda a: F.transform(F.filter("conds", lambda b: b > a), lambda b: F.struct(a.alias("c1"), b.alias("c2")))))
    return known.select("fwd", F.explode(pairs).alias("pair")).select("pair.*", "fwd").groupBy("c1", "c2").agg(*outcome())


def _levels(bars: DataFrame, longest: int, frequent: Column, *figures: Column, within: Sequence[str] = ()) -> list[DataFrame]:
    """(items, figures) of the sets of 1, 2, ... ``longest`` conditions of ``bars`` (conds, a sorted array, and what figures are of) whose smaller sets are all ``frequent``.

    A bar's sets grow out of its own array: nothing is joined but the few sets that are frequent. With columns ``within``,
    figures (one of them ``n``) are of each of their values, and ``frequent`` is of ``all``, the set's n in all of them.
    """
    level, found = bars.withColumn("items", F.explode(F.transform("conds", lambda c: F.array(c)))), []
    for k in range(longest):
        counts = checkpointed(level.groupBy("items", *within).agg(*figures))
        if within:
            whole = checkpointed(counts.groupBy("items").agg(F.sum("n").alias("all")).where(frequent)).select("items")
            found.append(counts.join(broadcast_up_to(whole, BROADCAST_SETS), "items", "left_semi"))
        else:
            found.append(counts.where(frequent))
            whole = found[-1].select("items")
        if k + 1 < longest:
            kept = level.join(broadcast_up_to(whole, BROADCAST_SETS), "items", "left_semi")
            grown = F.transform(F.filter("conds", lambda c: c > F.element_at("items", -1)), lambda c: F.concat("items", F.array(c)))
            level = kept.withColumn("items", F.explode(grown))
    return found


def combination_scores(df: DataFrame, names: Sequence[str], longest: int, least: int = 1) -> DataFrame:
    """(items, n, wins, mean_fwd) of every set of up to ``longest`` conditions that hold together on ``least`` bars with a known outcome."""
    bars = df.where("fwd is not null").select("fwd", F.sort_array(held(names)).alias("conds"))
    return reduce(DataFrame.unionByName, _levels(bars, longest, F.col("n") >= least, *outcome()))


def mined(df: DataFrame, names: Sequence[str], longest: int, least: int, q: float, base: float = 0.5, h: int = 1) -> DataFrame:
    """The mining loop for rules: enumerate, score on the earlier half, filter, score on the later half.

    (items, train_n, train_wins, train_mean, z, p, rank, kept, tried, test_n, test_mean): sets of
    conditions that held on ``least`` bars or more of each symbol's earlier half (``fold`` 1), with
    what the Benjamini-Hochberg procedure at rate q says of them there and what came of them later.
    ``fwd`` is the return of ``h`` bars; bars whose return ends in the other half count in neither.
    """
    bars = checkpointed(purged(df, h).where("fwd is not null").select("fwd", "fold", F.sort_array(held(names)).alias("conds")))
    early, late = F.col("fold") == 1, F.col("fold") == 2
    figures = [
        F.count_if(early).alias("train_n"), F.count_if(early & (F.col("fwd") > 0)).alias("train_wins"), F.avg(F.when(early, F.col("fwd"))).alias("train_mean"),
        F.count_if(late).alias("test_n"), F.avg(F.when(late, F.col("fwd"))).alias("test_mean"),
    ]
    scores = checkpointed(reduce(DataFrame.unionByName, _levels(bars, longest, F.col("train_n") >= least, *figures)))
    train = scores.drop("test_n", "test_mean")
    judged = false_discovery(train.withColumn("z", binomial_z("train_wins", "train_n", base)), q)
    return judged.withColumn("tried", F.lit(train.count())).join(scores.select("items", "test_n", "test_mean"), "items")


def itemsets(df: DataFrame, names: Sequence[str], longest: int, least: int) -> DataFrame:
    """(items, n): the sets of up to ``longest`` conditions that hold together on at least ``least`` bars."""
    bars = df.select(F.sort_array(held(names)).alias("conds"))
    return reduce(DataFrame.unionByName, _levels(bars, longest, F.col("n") >= least, F.count(F.lit(1)).alias("n")))


def association_rules(sets: DataFrame, bars: int) -> DataFrame:
    """(antecedent, consequent, n, support, confidence, lift) for each condition of each itemset of two or more.

    ``sets`` must hold every subset of its itemsets, as those of ``itemsets`` do.
    """
    split = sets.where(F.size("items") > 1).select("n", F.col("items"), F.explode("items").alias("consequent"))
    split = split.withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    left = sets.select(F.col("items").alias("antecedent"), F.col("n").alias("n_antecedent"))
    right = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("n").alias("n_consequent"))
    joined = split.join(left, "antecedent").join(right, "consequent")
    confidence = F.col("n") / F.col("n_antecedent")
    return joined.select(
        "antecedent", "consequent", "n", (F.col("n") / F.lit(bars)).alias("support"), confidence.alias("confidence"),
        (confidence / (F.col("n_consequent") / F.lit(bars))).alias("lift"),
    )


def fp_growth(df: DataFrame, names: Sequence[str], min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Frequent itemsets (items, freq) and rules, by Spark's FP-growth; it runs jobs at once."""
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(df.select(held(names).alias("items")))
    return model.freqItemsets, model.associationRules


def lagged_pairs(df: DataFrame, names: Sequence[str], longest: int) -> DataFrame:
    """(c1, c2, lag, n): c1 held ``lag`` bars before c2 did, for lags 1 to ``longest``.

    What held lately is gathered by a frame of ``longest`` rows over the bars' arrays.
    """
    frame = series().rowsBetween(-longest, -1)
    numbered = df.select(*BAR, held(names).alias("now"), F.row_number().over(series()).alias("row"))
    before = numbered.withColumn("past", F.collect_list(F.struct("row", "now")).over(frame))
    each = before.select("now", "row", F.explode("past").alias("then")).select("now", (F.col("row") - F.col("then.row")).alias("lag"), F.explode("then.now").alias("c1"))
    return each.select("c1", F.explode("now").alias("c2"), "lag").groupBy("c1", "c2", "lag").agg(F.count(F.lit(1)).alias("n"))


def sequences(df: DataFrame, names: Sequence[str], longest: int, gap: int, least: int) -> DataFrame:
    """(items, n, wins, mean_fwd) of sequences of up to ``longest`` conditions, each holding 1 to ``gap`` bars after the one before.

    ``n`` counts the bars on which a sequence ends, however many ways lead there, and ``fwd`` is their outcome. Sequences grow from those
    that end on ``least`` bars or more, one condition a level: a list has where each sequence ends, and each
    entry meets the conditions of the next ``gap`` bars by their numbers.
    """
    rows = numbered(df.select(*BAR, held(names).alias("conds"), "fwd"), name="row").select(F.struct("sym").alias("key"), "row", "conds", "fwd")
    rows, found = checkpointed(rows), []
    ends = rows.select("key", "row", "fwd", F.explode("conds").alias("cond")).select("key", "row", F.array("cond").alias("items"), "fwd")
    for k in range(longest):
        ends = checkpointed(ends)
        found.append(checkpointed(ends.groupBy("items").agg(*outcome()).where(F.col("n") >= least)))
        if k + 1 < longest:
            kept = ends.join(broadcast_up_to(found[-1].select("items"), BROADCAST_SETS), "items", "left_semi")
            after = kept.select("key", F.explode(F.sequence(F.col("row") + 1, F.col("row") + gap)).alias("row"), "items").distinct()
            ends = after.join(rows, ["key", "row"]).select("key", "row", "items", "fwd", F.explode("conds").alias("cond")).select("key", "row", F.concat("items", F.array("cond")).alias("items"), "fwd")
    return reduce(DataFrame.unionByName, found)


def pruned(rules: DataFrame, by: str = "confidence", margin: float = 0.0) -> DataFrame:
    """Rules (antecedent, consequent, ...) that beat each rule for the same consequent with a smaller antecedent within theirs.

    The best of what lies below a set goes up a level at a time: each set asks the sets that lack one of its conditions, by
    equality, for the best figure of themselves and all below them. Sets between two rules that are no rules themselves
    take part without a figure. A rule of k conditions costs k rows a level, however common its conditions are.
    """
    own = checkpointed(rules.select("consequent", F.array_sort(F.array_distinct("antecedent")).alias("set"), F.col(by).cast("double").alias("own")).groupBy("consequent", "set").agg(F.max("own").alias("own")))
    top = own.agg(F.max(F.size("set"))).first()[0] or 0
    below = lambda sets: sets.select("consequent", "set", F.explode("set").alias("item")).select("consequent", F.array_remove("set", F.col("item")).alias("less"), "set")
    levels = {top: own.where(F.size("set") == top)}
    for k in range(top - 1, 0, -1):  # all sets that are needed, from the largest down
        needed = below(levels[k + 1]).select("consequent", F.col("less").alias("set")).distinct().withColumn("own", F.lit(None).cast("double"))
        levels[k] = checkpointed(needed.unionByName(own.where(F.size("set") == k)).groupBy("consequent", "set").agg(F.max("own").alias("own")))
    best, figures = None, []
    for k in range(1, top + 1):
        level = levels[k].withColumn("best", F.lit(None).cast("double"))
        if best is not None:
            asked = below(levels[k]).join(best.select("consequent", F.col("set").alias("less"), F.greatest("own", "best").alias("figure")), ["consequent", "less"])
            level = levels[k].join(asked.groupBy("consequent", "set").agg(F.max("figure").alias("best")), ["consequent", "set"], "left")
        best = checkpointed(level)
        figures.append(best)
    if not figures:
        return rules
    beaten = reduce(DataFrame.unionByName, figures).where(F.col("own").isNotNull()).select(F.col("consequent").alias("__for"), F.col("set").alias("__set"), "best")
    met = (F.array_sort(F.array_distinct("antecedent")) == F.col("__set")) & (F.col("consequent") == F.col("__for"))
    kept = rules.join(beaten, met).where(F.col("best").isNull() | ~F.coalesce(F.col(by) <= F.col("best") + margin, F.lit(False)))
    return kept.select(rules.columns)


def permuted(df: DataFrame, names: Sequence[str], longest: int, least: int, replicates: int = 99, block: Column | None = None, seed: str = "1") -> DataFrame:
    """(items, n, score, p): sets of up to ``longest`` conditions that hold on ``least`` bars, with a p-value for all of them together that bars may depend on one another within a block.

    A set's score is the sum of its bars' ``fwd`` over the root of its squared sums by block (the day, if none is given). Each replicate
    turns the signs of whole blocks around by their hash, and keeps the highest score of any set: ``p`` is the share of replicates
    (and of the score itself) in which that is no lower. So dependence within a block, between symbols and between sets is
    kept, and the number of sets tried is paid for. Sets are summed by block first; the replicates of a set are then sums of one aggregation.
    """
    by = F.to_date("bar_ts") if block is None else block
    bars = checkpointed(df.where("fwd is not null").select("fwd", by.cast("string").alias("block"), F.sort_array(held(names)).alias("conds")))
    sums = checkpointed(reduce(DataFrame.unionByName, _levels(bars, longest, F.col("all") >= least, F.sum("fwd").alias("total"), F.count(F.lit(1)).alias("n"), within=("block",))))
    sign = lambda k: F.when(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.col("block")).cast("binary")), 1, 1) < "8", -1.0).otherwise(1.0)
    signs = sums.select("block").distinct().select("block", F.array(*[sign(k) for k in range(replicates)]).alias("signs"))
    signed = sums.join(broadcast_up_to(checkpointed(signs), BROADCAST_SETS), "block")
    root = F.sqrt(F.sum(F.col("total") * F.col("total")))
    scores = signed.groupBy("items").agg(
        F.sum("n").alias("n"), ratio(F.sum("total"), root).alias("score"), F.array(*[ratio(F.sum(F.col("total") * F.col("signs")[k]), root) for k in range(replicates)]).alias("others")
    )
    scores = checkpointed(scores)
    highest = scores.agg(F.array(*[F.max(F.col("others")[k]) for k in range(replicates)])).first()[0]
    reached = lambda high: F.coalesce(F.round(F.lit(high), 9) >= F.round("score", 9), F.lit(False)).cast("int")
    beaten = sum((reached(high) for high in highest if high is not None), F.lit(0))
    return scores.select("items", "n", "score", ((beaten + 1) / F.lit(float(replicates + 1))).alias("p"))


def binomial_z(wins: str | Column = "wins", n: str | Column = "n", base: float | Column = 0.5) -> Column:
    """How many deviations the wins lie above what the base rate gives."""
    base = F.lit(base) if isinstance(base, float) else base
    return ratio(column(wins) - column(n) * base, F.sqrt(column(n) * base * (1 - base)))


def false_discovery(rules: DataFrame, q: float, z: str = "z") -> DataFrame:
    """``rules`` with ``p`` (one-sided), ``rank`` and ``kept``: the Benjamini-Hochberg procedure at rate q.

    Ranks are taken within ranges of p that hold about as many rules each, so no task sees all rules.
    """
    rules = checkpointed(rules)
    scored = rules.withColumn("p", upper_tail(z)).withColumn("__all", F.lit(1))
    keys = [name for name, kind in rules.dtypes if not kind.startswith("map")]
    cuts = scored.agg(F.approx_percentile("p", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    place = F.size(F.filter(F.array(*[F.lit(cut) for cut in sorted({*cuts})]), lambda cut: cut < F.col("p"))) if cuts else F.lit(0)
    ranked = row_numbers(scored, ["__all"], ["p", *keys], place, "rank")
    total = F.lit(rules.count())
    last = ranked.where(F.col("p") <= F.col("rank") * q / total).agg(F.max("rank")).first()[0] or 0
    return ranked.withColumn("kept", F.col("rank") <= F.lit(last)).drop("__all")


def top(rules: DataFrame, n: int, by: str, *keys: str) -> DataFrame:
    """The n best by a column, ties to the smaller keys."""
    return rules.orderBy(F.desc_nulls_last(by), *keys).limit(n)


def top_per_group(rules: DataFrame, n: int, by: str, group: Sequence[str], *keys: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc_nulls_last(by), *keys)
    return rules.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
