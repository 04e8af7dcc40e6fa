"""Joins, grouping, sets and functions over the star schema and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.aggregates import Ladder, mean_absolute_change
from barloom.operators import bars
from barloom.operators.joins import BROADCAST_ROWS, broadcast_up_to, hot_join, lookup_join
from barloom.operators.numbering import as_of_join, range_join
from barloom.operators.statistics import percentiles
from barloom.plans.bars import hours
from barloom.plans.registry import HOURS, bars_sql, query, rounded, shown
from barloom.sources.shared import checkpointed, removed, shared_dir
from barloom.sources.tables import event_ticks, load, save


@query("""SELECT n_name, r_name, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) + 0.0 AS balance FROM nation
FULL JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def rel_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer and left outer equi-joins; Spark broadcasts the sides whose size it knows to be small."""
    nation, region, customer = (load(spark, sf_dir, name) for name in ("nation", "region", "customer"))
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "full_outer").join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return both.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"), (F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2) + F.lit(0.0)).alias("balance"))


@query("""SELECT (SELECT count(*) FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey)) AS with_orders,
(SELECT count(*) FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey)) AS without_orders""")
def rel_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    matched = F.col("c_custkey") == F.col("o_custkey")
    kinds = {"with_orders": "left_semi", "without_orders": "left_anti"}
    parts = [customer.join(orders, matched, how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n") for name, how in kinds.items()]
    both = parts[0].unionByName(parts[1])
    return both.agg(*[F.max(F.when(F.col("kind") == name, F.col("n"))).alias(name) for name in kinds])


def _revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")


GROUPED = "coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY"


def _summed(grouped: GroupedData) -> DataFrame:
    summed = grouped.agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    return summed.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "qty", "n")


@query(f"SELECT {GROUPED} CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(_revenue(spark, sf_dir).cube("l_returnflag", "l_linestatus"))


@query(f"SELECT {GROUPED} ROLLUP (l_returnflag, l_linestatus)")
def rel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(_revenue(spark, sf_dir).rollup("l_returnflag", "l_linestatus"))


@query(f"SELECT {GROUPED} GROUPING SETS ((l_returnflag), (l_linestatus))")
def rel_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return _summed(_revenue(spark, sf_dir).groupingSets([[flag], [status]], flag, status))


@query("""SELECT event_type, median(value) AS med, round(quantile_cont(value, 0.9), 6) + 0.0 AS p90, count(DISTINCT user_id) AS users,
round(corr(value, user_id), 6) + 0.0 AS corr_user, round(regr_slope(value, user_id), 6) + 0.0 AS slope, round(stddev_samp(value), 6) + 0.0 AS dev FROM events GROUP BY event_type""")
def rel_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles take steps of their own, as an event type may hold any share of the rows."""
    events = load(spark, sf_dir, "events")
    moments = events.groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.corr("value", "user_id").alias("corr_user"),
        F.regr_slope("value", F.col("user_id").cast("double")).alias("slope"), F.stddev_samp("value").alias("dev"),
    )
    both = percentiles(events, "event_type", "value", {"med": 0.5, "p90": 0.9}).join(moments, "event_type")
    return rounded(both.select("event_type", "med", "p90", "users", "corr_user", "slope", "dev"), "p90", "corr_user", "slope", "dev")


@query("""SELECT event_type, round(skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1)), 6) + 0.0 AS skew,
round(kurtosis_pop(value), 6) + 0.0 AS kurt FROM events GROUP BY event_type""")
def rel_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewness and excess kurtosis of the population."""
    return rounded(load(spark, sf_dir, "events").groupBy("event_type").agg(F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt")))


@query("SELECT event_type, count(*) AS n, true AS users_near, true AS med_near FROM events GROUP BY event_type")
def rel_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches held against exact figures: distinct users within three standard errors, the median's rank within the sketch's accuracy.

    Users are counted exactly apart from the sketches: in one aggregation every pair of an event type and a user would have sketches of its own.
    """
    events, error, accuracy = load(spark, sf_dir, "events"), 0.02, 1000
    made = events.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", error).alias("users"), F.approx_percentile("value", 0.5, accuracy).alias("med"), F.count(F.lit(1)).alias("n"), F.count("value").alias("values"),
    )
    exact = events.select(F.col("event_type").alias("kind"), "user_id").distinct().groupBy("kind").agg(F.count("user_id").alias("exact"))
    below, until = F.count_if(F.col("value") < F.col("med")), F.count_if(F.col("value") <= F.col("med"))
    known = broadcast_up_to(made.select(F.col("event_type").alias("of"), "med"), BROADCAST_ROWS)
    ranks = events.join(known, F.col("event_type").eqNullSafe(F.col("of"))).groupBy("of").agg(below.alias("below"), until.alias("until"))
    half, off = F.col("values") / 2, F.col("values") / accuracy + 1
    return made.join(exact, F.col("event_type").eqNullSafe(F.col("kind"))).join(ranks, F.col("event_type").eqNullSafe(F.col("of"))).select(
        "event_type", "n", (F.abs(F.col("users") - F.col("exact")) <= 3 * error * F.col("exact")).alias("users_near"),
        ((F.col("below") <= half + off) & (F.col("until") >= half - off)).alias("med_near"),
    )


@query("""WITH a AS (SELECT user_id FROM events WHERE event_type = 'click'), b AS (SELECT user_id FROM events WHERE event_type = 'purchase')
SELECT 'all' AS kind, count(*) AS n FROM (FROM a UNION ALL FROM b) UNION ALL SELECT 'union', count(*) FROM (FROM a UNION FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', count(*) FROM (FROM a EXCEPT FROM b)
UNION ALL SELECT 'except_all', count(*) FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'intersect_all', count(*) FROM (FROM a INTERSECT ALL FROM b)""")
def rel_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    a, b = (events.where(F.col("event_type") == kind).select("user_id") for kind in ("click", "purchase"))
    made = {"all": a.union(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except_all": a.exceptAll(b), "intersect_all": a.intersectAll(b)}
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in made.items()]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT (props->>'$.k')::INT AS k, count(*) AS n, round(sum(value), 6) + 0.0 AS value FROM events GROUP BY ALL")
def rel_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rounded(found.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")))


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def rel_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = load(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    return ranked.select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@query(f"{HOURS} SELECT t.sym, t.ts, t.seq, t.price, b.bar_ts AS known_ts, b.close AS known_close FROM t ASOF LEFT JOIN (SELECT sym, bar_ts, bar_ts + INTERVAL 1 HOUR AS end_ts, close FROM b) b ON t.sym = b.sym AND t.ts >= b.end_ts")
def rel_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick with the last hour bar that had ended by then."""
    ended = hours(spark, sf_dir).select("sym", "bar_ts", (F.col("bar_ts") + F.expr("INTERVAL 1 HOUR")).alias("end_ts"), "close")
    joined = as_of_join(event_ticks(spark, sf_dir).drop("qty"), ended, "ts", "end_ts", "1 day")
    return joined.select("sym", "ts", "seq", "price", F.col("as_of.bar_ts").alias("known_ts"), F.col("as_of.close").alias("known_close"))


@query(f"""WITH {bars_sql('4 hours')} SELECT b.sym, b.bar_ts, count(*) AS n, round(sum(o.price), 6) + 0.0 AS price FROM b JOIN t o ON o.ts >= b.bar_ts AND o.ts < b.bar_ts + INTERVAL 30 HOUR AND o.sym = b.sym
WHERE b.close > 150 GROUP BY ALL""")
def rel_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks of the 30 hours from each 4-hour bar that closed high."""
    found = bars.bars(event_ticks(spark, sf_dir), "4 hours").where("close > 150")
    ranges = found.select("sym", "bar_ts", (F.col("bar_ts") + F.expr("INTERVAL 30 HOURS")).alias("until_ts"))
    joined = range_join(event_ticks(spark, sf_dir), ranges, "ts", "bar_ts", "until_ts", "1 day", ["sym"])
    return rounded(joined.groupBy("sym", "bar_ts").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price")))


@query("""SELECT p_partkey, upper(p_brand) AS brand, length(p_name) AS chars, substr(p_type, 1, 5) AS kind, string_split(p_name, ' ')[1] AS first_word,
list_sort(list_distinct(string_split(p_name, ' '))) [1] AS least_word, floor(p_retailprice)::BIGINT AS dollars, p_size % 7 AS size_mod,
coalesce(nullif(p_size, 1), 0) AS size, MAP {'size': p_size}['size'] AS mapped, replace(p_name, ' ', '_') AS joined, p_name LIKE '%a%' AS has_a FROM part""")
def rel_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_brand").alias("brand"), F.length("p_name").cast("long").alias("chars"), F.substring("p_type", 1, 5).alias("kind"), words[0].alias("first_word"),
        F.sort_array(F.array_distinct(words))[0].alias("least_word"), F.floor("p_retailprice").alias("dollars"), (F.col("p_size") % 7).alias("size_mod"),
        F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(0)).alias("size"), F.create_map(F.lit("size"), "p_size")["size"].alias("mapped"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"), F.col("p_name").like("%a%").alias("has_a"),
    )


@query("""SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofweek(o_orderdate) + 1 AS dow, date_trunc('month', o_orderdate)::DATE AS month,
(o_orderdate + INTERVAL 10 DAY)::DATE AS due, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS age, strftime(o_orderdate, '%Y/%m/%d') AS shown FROM orders""")
def rel_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(date).cast("long").alias("y"), F.quarter(date).cast("long").alias("q"), F.dayofweek(date).cast("long").alias("dow"), F.trunc(date, "month").alias("month"),
        F.date_add(date.cast("date"), 10).alias("due"), F.datediff(date.cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("age"), F.date_format(date, "yyyy/MM/dd").alias("shown"),
    )


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def rel_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins that broadcast only what was counted first."""
    orders, customer, nation = (load(spark, sf_dir, name) for name in ("orders", "customer", "nation"))
    known = lookup_join(orders.withColumnRenamed("o_custkey", "c_custkey"), customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"], "inner")
    named = lookup_join(known, nation.select("n_nationkey", "n_name"), ["n_nationkey"])
    return named.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), (F.round(F.sum("o_totalprice"), 2) + F.lit(0.0)).alias("total"))


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (value > mean) AS above FROM events JOIN (SELECT event_type, avg(value) AS mean FROM events GROUP BY event_type) USING (event_type) GROUP BY user_id""")
def rel_hot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events that lie above their type's mean, by a join on event types, each of which holds much of the table."""
    events = load(spark, sf_dir, "events").select("user_id", "event_type", "value")
    means = events.groupBy("event_type").agg(F.avg("value").alias("mean"))
    above = F.count_if(F.col("value") > F.col("mean"))
    return hot_join(events, means, ["event_type"], share=0.05, salts=16).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), above.alias("above"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)
SELECT p_partkey, len(words) AS n, list_contains(words, words[1]) AS has_first, array_to_string(list_sort(words), '-') AS sorted, array_to_string(list_reverse(words), ' ') AS reversed,
list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS letters, len(list_filter(words, lambda x: length(x) > 4)) AS long_words, array_to_string(words[1:2], '+') AS first_two,
coalesce(list_position(words, words[2]), 0)::BIGINT AS at FROM w""")
def rel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.size(words).cast("long").alias("n"), F.array_contains(words, words[0]).alias("has_first"), F.array_join(F.array_sort(words), "-").alias("sorted"), F.array_join(F.reverse(words), " ").alias("reversed"),
        F.aggregate(words, F.lit(0).cast("long"), lambda total, x: total + F.length(x)).alias("letters"), F.size(F.filter(words, lambda x: F.length(x) > 4)).cast("long").alias("long_words"),
        F.array_join(F.slice(words, 1, 2), "+").alias("first_two"), F.coalesce(F.array_position(words, F.get(words, F.lit(1))), F.lit(0)).alias("at"),
    )


@query("""SELECT p_brand, sum(n)::BIGINT AS parts, count(*) AS sizes, max(n)::BIGINT AS most, sum(CASE WHEN p_size > 25 THEN n ELSE 0 END)::BIGINT AS large FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand""")
def rel_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by size as a map of each brand, taken apart again."""
    counts = load(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_size", "n"))).alias("by_size"))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)
    return maps.select(
        "p_brand", total(F.map_values("by_size")).alias("parts"), F.size("by_size").cast("long").alias("sizes"), F.array_max(F.map_values("by_size")).alias("most"),
        total(F.map_values(F.map_filter("by_size", lambda size, _: size > 25))).alias("large"),
    )


@query(r"""SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS shape,
len(regexp_extract_all(html, '<a '))::BIGINT AS links, regexp_matches(html, '<title>') AS titled FROM pages""")
def rel_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, parts = load(spark, sf_dir, "pages"), r"^(https?)://([^/]+)"
    return pages.select(
        "page_id", F.regexp_extract("url", parts, 1).alias("scheme"), F.regexp_extract("url", parts, 2).alias("host"), F.regexp_replace("url", "[0-9]+", "#").alias("shape"),
        F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp("html", F.lit("<title>")).alias("titled"),
    )


@query("""SELECT event_id, ts + INTERVAL 2 HOUR AS paris_summer, epoch_us(ts) // 1000 AS millis, hour(ts - INTERVAL 8 HOUR) AS pacific_hour,
struct_extract(from_json(props, '{"k": "INTEGER"}'), 'k')::INT AS k FROM events""")
def rel_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in other zones, and a JSON text as a struct."""
    ts = F.col("ts")
    return load(spark, sf_dir, "events").select(
        "event_id", F.convert_timezone(F.lit("UTC"), F.lit("+02:00"), ts).alias("paris_summer"), F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")).alias("millis"),
        F.hour(F.convert_timezone(F.lit("UTC"), F.lit("-08:00"), ts)).cast("long").alias("pacific_hour"), F.from_json("props", "k int")["k"].alias("k"),
    )


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total, min(o_orderkey) AS first FROM orders GROUP BY o_orderstatus")
def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as Parquet by their status and read back."""
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    save(load(spark, sf_dir, "orders"), path, ["o_orderstatus"])
    back = spark.read.schema(load(spark, sf_dir, "orders").schema).parquet(path)
    summed = back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("o_totalprice"), 2) + F.lit(0.0)).alias("total"), F.min("o_orderkey").alias("first"))
    made = checkpointed(summed)
    removed(spark, path)
    return made


@query(f"""{HOURS}, d AS (SELECT sym, bar_ts::DATE AS day, abs(close - lag(close) OVER (PARTITION BY sym, bar_ts::DATE ORDER BY bar_ts)) AS step FROM b)
SELECT sym, day, {shown(change='avg(step)')} FROM d GROUP BY ALL""")
def udf_mean_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped user aggregate over each day's closes in order."""
    closes = hours(spark, sf_dir).select("sym", F.to_date("bar_ts").alias("day"), "bar_ts", "close")
    return rounded(closes.groupBy("sym", "day").agg(mean_absolute_change("close", F.unix_micros(F.col("bar_ts").cast("timestamp"))).alias("change")))


@query("SELECT p_partkey AS key, step::INT AS step, round(p_retailprice + step * 0.5, 6) + 0.0 AS level FROM part, range(-2, 3) r(step)")
def udf_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user table function over a whole table, in Arrow batches."""
    return rounded(Ladder(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice").asTable()))
