"""Mixing to target weights by iterative proportional fitting.

Tokens are summed per (source, language, topic) cell. Raking scales the cells' weights to the
target share of each source, then of each language, then of each topic, until every category is
within ``TOLERANCE`` of its target, or ``PASSES`` times. A document's probability is its cell's
raked weight over the cell's tokens; its own hash of the id decides.

How much stays is a budget of tokens: what stays if the largest probability is 1, but at least ``rate``
of all tokens, so that one small cell doesn't set the scale of all. Weights are raked to the budget's
tokens with no cell beyond its own. A category whose target is more than it has is kept whole and
the others of its kind share the rest. Targets that aren't met are logged (``missed`` lists them).

Targets come as DataFrames (category, share), or as a power to which observed shares are
raised and renormalised (below 1: large categories are damped). A document's topic is the caller's
column or else learned from all documents: the shares of a text's words that hash into each of ``BUCKETS`` make a vector; what its
language has on average is taken off, so that topics aren't languages, and the rest is brought to one length, so that short and long texts
weigh alike; ``TOPICS`` centroids of these vectors, found by sort-means in integers, are the topics. Texts are
cut into words once to learn, into narrow rows that are kept meanwhile, and once to draw.

Cells are few (sources x languages x topics): up to ``GATHERED`` are raked in one task, as arrays.
Beyond that the same steps are windows over the distributed table of cells.

Defined cases: null source, language or topic is the category ''; a document without words is of
topic 'other', and one that differs in nothing from its language's average of that whose centroid is shortest; categories without a target keep their own share; a null or empty text has no tokens, and
a cell without tokens is kept whole; repeated rows have the same fate, and of centroids equally near the
first is taken; an empty table gives an empty result; other columns are carried by ``sample``, and
those named like its results (a prefix, a parameter) are replaced.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.llm import centroids
from barloom.llm.util import broadcast_up_to, fields, hash_number
from barloom.sources.shared import checkpointed, removed

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.8, "lang": 0.8, "topic": 0.9}
#: The share of all tokens that is expected to stay at least.
RATE = 0.5
#: Raking stops at this relative error of every category, or after so many passes; distributed it looks after every ``ROUND``.
TOLERANCE, PASSES, ROUND = 1e-12, 64, 4
#: A cell that lacks less than this share of its tokens stays whole.
WHOLE = 1e-9
#: From this relative error on a target counts as missed.
MISSED = 1e-3
SEED = "mix-1"
#: Tables of so many cells are raked in one task, and broadcast, at most.
GATHERED, BROADCAST_CELLS = 200_000, 20_000
#: Topics, buckets of words, what all of a text's shares come to, the length of a vector, and rounds of learning.
TOPICS, BUCKETS, WHOLE_SHARE, LENGTH, ROUNDS = 12, 64, 4096, 1024, 3
OTHER_TOPIC = "other"
#: Words whose bucket a worker remembers, and languages whose averages are broadcast at most.
REMEMBERED, BROADCAST_LANGUAGES = 50_000, 10_000

_BLANK = r"[\x20\x09-\x0D]"

Targets = dict[str, DataFrame | float]
#: What raking adds to cells.
RAKED = (*[f"goal_{name}" for name in DIMENSIONS], "weight", "budget")


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.col(text), _BLANK), "")


def token_count(text: str = "text") -> Column:
    """Whitespace-separated words of a text; 0 for null."""
    return F.coalesce(F.size(_words(text)), F.lit(0)).cast("long")


FEATURES = fields(tokens="long", shares=T.ArrayType(T.IntegerType()))


class _Counter:
    """Counts a text's words and the share of each bucket in them; a worker remembers some words' buckets."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        words, known = (text or "").encode().split(), self.known  # of bytes, which splits at ASCII's blanks alone
        if not words:
            return 0, np.zeros(BUCKETS, np.int32)
        if len(known) > REMEMBERED:
            known.clear()
        for word in {*words}.difference(known):
            known[word] = hashlib.md5(word).digest()[0] % BUCKETS
        counts = np.bincount([known[word] for word in words], minlength=BUCKETS)
        return len(words), (counts * WHOLE_SHARE // len(words)).astype(np.int32)


@F.pandas_udf(FEATURES)
def features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The number of a text's words, and the share of each bucket in them."""
    count = _Counter()
    for batch in texts:
        yield pd.DataFrame([count(text) for text in batch], columns=FEATURES.names)
    pa.default_memory_pool().release_unused()  # a worker goes on to other work


class Topics(NamedTuple):
    """What was learned: each language's average shares (of_lang, average), and the centroids."""

    averages: DataFrame
    centroids: np.ndarray


def _differing(shares: list, averages: list) -> np.ndarray:
    """How shares differ from averages, as integers of about one length."""
    off = (np.stack(shares).astype(np.int64) - np.stack(averages)).astype(np.float64)
    length = np.sqrt((off * off).sum(axis=1, keepdims=True))
    return np.floor(np.divide(LENGTH * off, length, out=np.zeros_like(off), where=length > 0)).astype(np.int64)


@F.pandas_udf(T.ArrayType(T.ShortType()))
def direction(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How each row's shares differ from its average."""
    for shares, averages in rows:
        yield pd.Series(list(_differing(shares.to_list(), averages.to_list()).astype(np.int16)) if len(shares) else [], dtype=object)


def _with_average(rows: DataFrame, averages: DataFrame, lang: Column) -> DataFrame:
    """``rows`` with their language's ``__average``."""
    met = rows.withColumn("__lang", lang).join(broadcast_up_to(averages, BROADCAST_LANGUAGES), F.col("__lang") == F.col("of_lang"), "left")
    return met.withColumn("__average", F.col("average")).drop("__lang", "of_lang", "average")


def learned(rows: DataFrame, lang: Column, own: str, doc_id: str, topics: int = TOPICS) -> Topics:
    """The topics of ``rows``, which have ``features`` as the column ``own``."""
    said = rows.where(F.col(own)["tokens"] > 0).withColumn("__of", lang).withColumn("__shares", F.col(own)["shares"])
    average = F.array(*[F.expr(f"CAST(sum(__shares[{b}]) div count(1) AS INT)") for b in range(BUCKETS)])
    averages = checkpointed(said.groupBy(F.col("__of").alias("of_lang")).agg(average.alias("average")))
    met = _with_average(rows.where(F.col(own)["tokens"] > 0), averages, lang)
    # kept, as sort-means is a Python step too: two in a task take a worker each, and all workers stay with the executor and take turns later
    vectors = checkpointed(met.select(F.col(doc_id).alias("vec_id"), direction(F.col(own)["shares"], F.col("__average")).alias("embedding")))
    found, _, folder = centroids.means(vectors, topics, ROUNDS, BUCKETS, 1)
    removed(rows.sparkSession, folder)
    return Topics(averages, found)


def _topics(tokens: np.ndarray, shares: list, averages: list, found: np.ndarray) -> list[str]:
    """The names of the topics that rows are nearest to."""
    out, said = [OTHER_TOPIC] * len(tokens), np.flatnonzero(tokens > 0)
    if len(said):
        places = centroids.squared(_differing([shares[k] for k in said], [averages[k] for k in said]), found).argmin(axis=1)
        for k, place in zip(said, places, strict=True):
            out[k] = f"topic{place}"
    return out


def _named(found: np.ndarray):
    """A column function of tokens, shares and averages: the name of the topic."""

    @F.pandas_udf(T.StringType())
    def topic(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tokens, shares, averages in rows:
            yield pd.Series(_topics(tokens.to_numpy(), shares.to_list(), averages.to_list(), found), dtype=object)

    return topic


def _told(found: np.ndarray):
    """A column function of texts and averages: the number of words and the name of the topic, in one pass through a worker."""

    @F.pandas_udf(fields(tokens="long", topic="string"))
    def told(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        count = _Counter()
        for texts, averages in rows:
            tokens, shares = zip(*[count(text) for text in texts], strict=True) if len(texts) else ((), ())
            yield pd.DataFrame({"tokens": tokens, "topic": _topics(np.array(tokens, np.int64), list(shares), averages.to_list(), found)}).astype({"tokens": "int64"})
        pa.default_memory_pool().release_unused()

    return told


def narrowed(docs: DataFrame, text: str = "text", prefix: str = "mix_") -> DataFrame:
    """``docs`` with what mixing needs of their texts instead of these, computed once and kept; what is worked out of it doesn't read texts."""
    return checkpointed(docs.withColumn(f"{prefix}features", features(text)).drop(text))


def described(docs: DataFrame, text: str = "text", named: Column | None = None, prefix: str = "mix_", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``docs`` with their source, lang, topic and tokens behind the prefix, and narrow rows of the same; ``named`` is the caller's topic, else topics are learned. ``docs`` may be ``narrowed``."""
    blank, own = F.lit(""), f"{prefix}features"
    source, lang = F.coalesce("source", blank), F.coalesce("lang", blank)

    def whole(rows: DataFrame, topic: Column, *gone: str) -> DataFrame:
        made = {"source": source, "lang": lang, "topic": topic, "tokens": F.col(own)["tokens"]}
        return rows.withColumns({prefix + name: column for name, column in made.items()}).drop(own, *gone)

    if named is not None:
        made = whole(docs if own in docs.columns else docs.withColumn(own, features(text)), F.coalesce(named, blank))
        return made, made
    is_narrow = own in docs.columns
    narrow = docs if is_narrow else checkpointed(docs.select(doc_id, "source", "lang", features(text).alias(own)))
    model = learned(narrow, lang, own, doc_id)
    found = model.centroids if len(model.centroids) else np.zeros((1, BUCKETS), np.int64)  # without a word there is nothing to be near to
    near = _with_average(narrow, model.averages, lang)
    made = whole(near, _named(found)(F.col(own)["tokens"], F.col(own)["shares"], F.col("__average")), "__average")
    if is_narrow:
        return made, made
    told = _with_average(docs, model.averages, lang).withColumn(own, _told(found)(F.col(text), F.col("__average")))
    return whole(told, F.col(own)["topic"], "__average"), made


def _aimed(cells: DataFrame, targets: Targets) -> DataFrame:
    """``cells`` (source, lang, topic, tokens > 0) with the target share of each dimension's category."""
    total, aimed = cells.agg(F.sum("tokens")).first()[0] or 1, cells
    for name in DIMENSIONS:
        aim, goal = targets[name], cells.groupBy(name).agg((F.sum("tokens") / F.lit(total)).alias("own"))
        if isinstance(aim, DataFrame):
            goal = goal.join(aim.select(name, "share"), name, "left").select(name, F.coalesce("share", "own").alias("goal"))
        else:
            goal = goal.select(name, F.pow("own", F.lit(float(aim))).alias("goal"))
        goal = checkpointed(goal)
        whole = goal.agg(F.sum("goal")).first()[0] or 1.0
        aimed = aimed.join(broadcast_up_to(goal.select(name, (F.col("goal") / F.lit(whole)).alias(f"goal_{name}")), BROADCAST_CELLS), name)
    return checkpointed(aimed)


class _Cells:
    """Cells as arrays: ``tokens``, and of each dimension the cells' categories and the categories' shares."""

    def __init__(self, frame: pd.DataFrame, powers: dict[str, float]):
        self.tokens, self.kinds, self.goals = frame["tokens"].to_numpy(float), [], []
        for name in DIMENSIONS:
            _, first, kinds = np.unique(frame[name].to_numpy(object), return_index=True, return_inverse=True)
            goal = np.bincount(kinds, self.tokens) / self.tokens.sum()
            if name in powers:
                goal = goal ** powers[name]
            else:
                shares = frame[f"share_{name}"].to_numpy(float)[first]
                goal = np.where(np.isnan(shares), goal, shares)
            self.kinds.append(kinds)
            self.goals.append(goal / (goal.sum() or 1.0))

    def sums(self, weight: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(kind, weight, len(goal)) for kind, goal in zip(self.kinds, self.goals, strict=True)]

    def raked(self, weight: np.ndarray, goals: list[np.ndarray], most: np.ndarray | float = np.inf) -> np.ndarray:
        for _ in range(PASSES):
            for kind, goal in zip(self.kinds, goals, strict=True):
                here = np.bincount(kind, weight, len(goal))
                weight = np.minimum(most, weight * np.divide(goal, here, out=np.zeros_like(goal), where=here > 0)[kind])
            if all((np.abs(here - goal) <= TOLERANCE * goal).all() for here, goal in zip(self.sums(weight), goals, strict=True)):
                break
        return weight

    def affordable(self, budget: float) -> list[np.ndarray]:
        """Each category's tokens of the budget: its share of it, or all it has and the others share the rest."""
        out = []
        for own, goal in zip(self.sums(self.tokens), self.goals, strict=True):
            poor, scale = np.zeros(len(own), bool), budget
            while not poor.all() and (more := own <= goal * scale).sum() > poor.sum():
                poor = more
                scale = (budget - own[poor].sum()) / goal[~poor].sum() if not poor.all() else scale
            out.append(np.minimum(own, goal * scale))
        return out

    def weights(self, rate: float) -> tuple[np.ndarray, float]:
        """Each cell's expected tokens, and the budget."""
        total = self.tokens.sum()
        free = self.raked(self.tokens / total, self.goals)
        budget = max(rate * total, 1 / (free / self.tokens).max())
        return self.raked(self.tokens * (budget / total), self.affordable(budget), self.tokens), budget


def _gathered(rate: float, powers: dict[str, float]):
    def rake(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches), ignore_index=True)
        if len(frame):
            made = _Cells(frame, powers)
            frame["weight"], frame["budget"] = made.weights(rate)
            yield frame[[*DIMENSIONS, "tokens"]].assign(**{f"goal_{name}": goal[kinds] for name, goal, kinds in zip(DIMENSIONS, made.goals, made.kinds, strict=True)}, weight=frame["weight"], budget=frame["budget"])

    return rake


def _passes(cells: DataFrame, goals: dict[str, Column], most: Column | None = None) -> DataFrame:
    """``_Cells.raked`` over a distributed table with ``weight``."""
    for _ in range(0, PASSES, ROUND):
        for name in DIMENSIONS * ROUND:
            weight = F.when(F.col("weight") > 0, F.col("weight") * goals[name] / F.sum("weight").over(Window.partitionBy(name))).otherwise(F.lit(0.0))
            cells = cells.withColumn("weight", weight if most is None else F.least(most, weight))
        cells = checkpointed(cells)
        off = [cells.groupBy(name).agg(F.sum("weight").alias("here"), F.max(goals[name]).alias("goal")).where(F.abs(F.col("here") - F.col("goal")) > F.col("goal") * TOLERANCE) for name in DIMENSIONS]
        if reduce(DataFrame.unionAll, [df.select("here") for df in off]).isEmpty():
            break
    return cells


def _affordable(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` with ``_Cells.affordable`` in columns ``due_...``."""
    for name in DIMENSIONS:
        kinds = checkpointed(cells.groupBy(name).agg(F.max(f"goal_{name}").alias("goal"), F.sum("tokens").cast("double").alias("own")))
        scale, before = budget, 0
        while True:
            poor = F.col("own") <= F.col("goal") * F.lit(scale)
            count, spent, rest = kinds.agg(F.count(F.when(poor, 1)), F.sum(F.when(poor, F.col("own"))), F.sum(F.when(~poor, F.col("goal")))).first()
            if count == before or not rest:
                break
            before, scale = count, (budget - (spent or 0.0)) / rest
        due = kinds.select(name, F.least("own", F.col("goal") * F.lit(scale)).alias(f"due_{name}"))
        cells = cells.join(broadcast_up_to(due, BROADCAST_CELLS), name)
    return cells


def _distributed(aimed: DataFrame, rate: float) -> DataFrame:
    """``_Cells.weights`` over a table of any number of cells."""
    total = aimed.agg(F.sum("tokens")).first()[0]
    free = _passes(aimed.withColumn("weight", F.col("tokens") / F.lit(total)), {name: F.col(f"goal_{name}") for name in DIMENSIONS})
    budget = max(rate * total, 1 / free.agg(F.max(F.col("weight") / F.col("tokens"))).first()[0])
    start = _affordable(aimed.withColumn("weight", F.col("tokens") * F.lit(budget / total)), budget)
    made = _passes(start, {name: F.col(f"due_{name}") for name in DIMENSIONS}, F.col("tokens").cast("double"))
    return made.withColumn("budget", F.lit(budget)).select(*aimed.columns, "weight", "budget")


def rake(cells: DataFrame, targets: Targets, rate: float = RATE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens > 0) with ``weight``, the tokens of each that are expected to stay, the ``budget`` and the shares aimed at (``goal_...``)."""
    cells = checkpointed(cells.select(*DIMENSIONS, "tokens"))
    size = cells.limit(GATHERED + 1).count()
    if 0 < size <= GATHERED:
        asked, powers = cells, {name: float(aim) for name, aim in targets.items() if not isinstance(aim, DataFrame)}
        for name in {*DIMENSIONS} - {*powers}:
            asked = asked.join(broadcast_up_to(targets[name].select(name, F.col("share").cast("double").alias(f"share_{name}")), BROADCAST_CELLS), name, "left")
        made = checkpointed(asked.coalesce(1).mapInPandas(_gathered(rate, powers), fields(**{kind.name: kind.dataType for kind in cells.schema}, **dict.fromkeys(RAKED, "double"))))
    else:
        made = _distributed(_aimed(cells, targets), rate) if size else cells.withColumns({name: F.lit(0.0) for name in RAKED})
    _logged(missed(made))
    return made


def missed(raked: DataFrame, tolerance: float = MISSED) -> DataFrame:
    """(dimension, category, goal, reached): categories whose expected tokens aren't their share of the budget."""
    sums = [
        raked.groupBy(F.lit(name).alias("dimension"), F.col(name).alias("category")).agg(F.max(F.col(f"goal_{name}") * F.col("budget")).alias("goal"), F.sum("weight").alias("reached"))
        for name in DIMENSIONS
    ]
    return reduce(DataFrame.unionAll, sums).where(F.abs(F.col("reached") - F.col("goal")) > F.col("goal") * F.lit(tolerance))


def _logged(rows: DataFrame) -> None:
    for row in rows.orderBy(F.desc(F.abs(F.col("reached") - F.col("goal")))).limit(20).collect():
        logging.getLogger(__name__).warning("mixing: %s %r: %.0f of %.0f tokens", row["dimension"], row["category"], row["reached"], row["goal"])


def calibrated(
    docs: DataFrame, targets: Targets = POWERS, text: str = "text", rate: float = RATE, named: Column | None = None, prefix: str = "mix_", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with mix_source, mix_lang, mix_topic, mix_tokens and mix_probability (``mix_`` is the ``prefix``)."""
    marked, narrow = described(docs, text, named, prefix, doc_id)
    names = {f"{prefix}{name}": name for name in DIMENSIONS}
    cells = narrow.groupBy(*names).agg(F.sum(f"{prefix}tokens").alias("tokens")).withColumnsRenamed(names)
    raked = rake(cells.where("tokens > 0"), targets, rate)
    chance = f"{prefix}probability"
    ratio = F.col("weight") / F.col("tokens")
    chances = raked.select(*[F.col(name).alias(column) for column, name in names.items()], F.when(ratio > 1 - WHOLE, 1.0).otherwise(ratio).alias(chance))
    found = marked.drop(chance).join(broadcast_up_to(chances, BROADCAST_CELLS), [*names], "left")
    return found.withColumn(chance, F.coalesce(chance, F.lit(1.0)))


def sample(
    docs: DataFrame, targets: Targets = POWERS, doc_id: str = "doc_id", text: str = "text", rate: float = RATE, named: Column | None = None, prefix: str = "mix_"
) -> DataFrame:
    """The rows of ``calibrated`` whose hash falls below their probability."""
    salted = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return calibrated(docs, targets, text, rate, named, prefix, doc_id).where((hash_number(salted, 13) / F.lit(float(1 << 52))) < F.col(f"{prefix}probability"))


def oracle() -> str:
    """DuckDB SQL of ``sample`` over documents with the default targets."""
    goals, cells, dues = "", "", ""
    for n in DIMENSIONS:
        goals += f", g_{n} AS (SELECT {n}, own, pow(own / t, {POWERS[n]}) / sum(pow(own / t, {POWERS[n]})) OVER () AS goal FROM (SELECT {n}, sum(tokens) AS own FROM c GROUP BY 1), total)\n"
        cells += f" JOIN g_{n} USING ({n})"
        # in the order of what they have for their goal, categories are poor up to the first that isn't
        dues += f""", p_{n} AS (SELECT *, own / goal <= (b - coalesce(sum(own) OVER before, 0)) / (1 - coalesce(sum(goal) OVER before, 0)) AS poor FROM g_{n}, budget
            WINDOW before AS (ORDER BY own / goal, {n} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
     , d_{n} AS (SELECT {n}, least(own, goal * coalesce((b - coalesce(sum(own) FILTER (poor) OVER (), 0)) / nullif(sum(goal) FILTER (NOT poor) OVER (), 0), b)) AS due_{n} FROM p_{n})\n"""

    def passes(table: str, columns: dict[str, str], capped: bool) -> str:
        inner = f"SELECT step, source, lang, topic, tokens, {', '.join(columns.values())}, weight FROM {table} WHERE step < {PASSES}"
        for n in DIMENSIONS:
            weight = f"CASE WHEN weight > 0 THEN weight * {columns[n]} / sum(weight) OVER (PARTITION BY {n}) ELSE 0 END"
            inner = f"SELECT * REPLACE ({f'least(tokens, {weight})' if capped else weight} AS weight) FROM ({inner})"
        return f"SELECT * REPLACE (step + 1 AS step) FROM ({inner})"

    shares, due = {n: f"goal_{n}" for n in DIMENSIONS}, {n: f"due_{n}" for n in DIMENSIONS}
    named = ", ".join(f"g_{n}.goal AS goal_{n}" for n in DIMENSIONS)
    return f"""
WITH RECURSIVE x AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda w: w <> '') AS words, len(words)::BIGINT AS n_tokens FROM documents),
     sh AS MATERIALIZED (SELECT row, doc_id, lang, list_transform(range({BUCKETS}), lambda b: len(list_filter(codes, lambda c: c = b)) * {WHOLE_SHARE} // n_tokens) AS y
           FROM (SELECT row, doc_id, lang, n_tokens, list_transform(words, lambda w: ('0x' || substr(md5(w), 1, 2))::INT % {BUCKETS}) AS codes FROM x WHERE n_tokens > 0)),
     av AS (SELECT lang, list(m ORDER BY pos) AS m FROM (SELECT lang, pos, sum(y)::BIGINT // count(*) AS m FROM (SELECT lang, unnest(y) AS y, generate_subscripts(y, 1) AS pos FROM sh) GROUP BY ALL) GROUP BY lang),
     df AS (SELECT row, doc_id, list_transform(range(1, {BUCKETS} + 1), lambda b: (y[b] - m[b])::DOUBLE) AS off FROM sh JOIN av USING (lang)),
     k AS MATERIALIZED (SELECT row, doc_id AS vec_id, list_transform(off, lambda o: coalesce(floor({LENGTH}::DOUBLE * o / nullif(sqrt(list_inner_product(off, off)), 0)), 0)) AS v FROM df),
     {centroids.oracle_rounds(TOPICS, ROUNDS)},
     d AS (SELECT x.doc_id, source, lang, coalesce('topic' || cluster, '{OTHER_TOPIC}') AS topic, n_tokens FROM x LEFT JOIN a{ROUNDS} USING (row)),
     c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
     total AS (SELECT sum(tokens) AS t FROM c)
{goals}, free AS (SELECT 0 AS step, source, lang, topic, tokens, {named}, tokens / t AS weight FROM c{cells}, total
               UNION ALL {passes('free', shares, False)}),
     budget AS (SELECT greatest({RATE} * t, (SELECT 1 / max(weight / tokens) FROM free WHERE step = {PASSES})) AS b, t FROM total)
{dues}, raked AS (SELECT 0 AS step, source, lang, topic, tokens, {', '.join(due.values())}, tokens * (b / t) AS weight
               FROM c{''.join(f' JOIN d_{n} USING ({n})' for n in DIMENSIONS)}, budget UNION ALL {passes('raked', due, True)}),
     s AS (SELECT d.*, coalesce(weight / tokens, 1) AS p FROM d LEFT JOIN (FROM raked WHERE step = {PASSES}) USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability FROM s
WHERE ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(2, 52) < p"""
