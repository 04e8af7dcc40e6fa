import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing
from tests.conftest import TESTDATA


def share(spark, name: str, **kinds: float):
    return spark.createDataFrame([*kinds.items()], f"{name} string, share double")


@pytest.mark.parametrize("gathered", [mixing.GATHERED, 0])
def test_raked_shares_are_the_targets(spark, monkeypatch, gathered):
    monkeypatch.setattr(mixing, "GATHERED", gathered)
    cells = spark.createDataFrame([(s, l, t, float(1 + k)) for k, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in "xyz" for t in "pq")], "source string, lang string, topic string, tokens double")
    targets = {"source": share(spark, "source", a=0.3, b=0.7), "lang": share(spark, "lang", x=0.5, y=0.25, z=0.25), "topic": 1.0}
    raked = mixing.rake(cells, targets, 0.1)
    budget = raked.first()["budget"]
    assert {r[0]: pytest.approx(r[1] / budget, abs=1e-6) for r in raked.groupBy("source").agg(F.sum("weight")).collect()} == {"a": 0.3, "b": 0.7}
    assert {r[0]: pytest.approx(r[1] / budget, abs=1e-6) for r in raked.groupBy("lang").agg(F.sum("weight")).collect()} == {"x": 0.5, "y": 0.25, "z": 0.25}
    assert raked.where("weight > tokens * 1.000001").isEmpty() and raked.agg(F.max(F.col("weight") / F.col("tokens"))).first()[0] == pytest.approx(1, abs=1e-6)


def test_distributed_and_gathered_alike(spark, monkeypatch):
    """Sparse cells, a category that can't reach its target and one without a target, in one task and by windows."""
    rng = random.Random(2)
    kinds = [(f"s{a}", f"l{b}", f"t{c}") for a in range(6) for b in range(4) for c in range(5)]
    cells = spark.createDataFrame([(*kind, rng.randrange(1, 10 ** rng.randrange(1, 6))) for kind in rng.sample(kinds, 110)], "source string, lang string, topic string, tokens long")
    targets = {"source": 0.5, "lang": share(spark, "lang", l0=0.9, l1=0.05), "topic": 0.9}
    made = []
    for gathered in (mixing.GATHERED, 0):
        monkeypatch.setattr(mixing, "GATHERED", gathered)
        made.append({tuple(row[name] for name in mixing.DIMENSIONS): row["weight"] for row in mixing.rake(cells, targets).collect()})
    assert made[0].keys() == made[1].keys() and all(made[1][k] == pytest.approx(x, rel=1e-6, abs=1e-6) for k, x in made[0].items())


def test_all_three_marginals_of_documents_are_met(spark):
    """At the scale of the largest probability no cell is at its end, so every target can be met."""
    made = mixing.calibrated(spark.read.parquet(str(TESTDATA / "sf0.01/documents.parquet")), rate=0.0).where("mix_tokens > 0")
    kept = F.sum(F.col("mix_tokens") * F.col("mix_probability"))
    total = made.agg(kept).first()[0]
    for name, power in mixing.POWERS.items():
        rows = made.groupBy(f"mix_{name}").agg(F.sum("mix_tokens").alias("own"), kept.alias("kept")).collect()
        whole = sum(row["own"] ** power for row in rows)
        assert len(rows) > 1 and all(row["kept"] / total == pytest.approx(row["own"] ** power / whole, abs=1e-6) for row in rows)


def test_topics_of_made_up_subjects(spark):
    """Texts that take their words from one subject share a topic, in whatever language and of whatever length; the languages' common words don't matter."""
    rng, rows = random.Random(7), []
    subjects = [[f"s{n}w{k}" for k in range(12)] for n in range(4)]
    common = {lang: [f"{lang}{k}" for k in range(30)] for lang in ("en", "de")}
    for k in range(600):
        lang, subject = ("en", "de")[k % 2], k // 2 % 4
        n = rng.randrange(40, 200)
        rows.append((k, " ".join(rng.choice(subjects[subject] if rng.random() < 0.5 else common[lang]) for _ in range(n)), lang, "s", subject))
    docs = spark.createDataFrame([*rows, (600, None, "en", "s", 9), (601, " \n", "en", "s", 9)], "doc_id long, text string, lang string, source string, subject int")
    made = mixing.described(docs)[0].groupBy("mix_topic", "subject", "lang").count().collect()
    assert {row["subject"] for row in made if row["mix_topic"] == mixing.OTHER_TOPIC} == {9}
    of_topic = {}
    for row in made:
        of_topic.setdefault(row["mix_topic"], []).append((row["count"], row["subject"], row["lang"]))
    pure = sum(sum(n for n, subject, _ in some if subject == max(some)[1]) for some in of_topic.values())
    assert pure > 0.95 * 602 and all({lang for _, subject, lang in some if subject == max(some)[1]} >= {"en", "de"} for topic, some in of_topic.items() if topic != mixing.OTHER_TOPIC and sum(n for n, *_ in some) > 20)


def test_features_against_plain_counting(spark, odd_documents):
    for row in odd_documents.select("text", mixing.features("text").alias("made")).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        buckets = [hashlib.md5(word.encode()).digest()[0] % mixing.BUCKETS for word in words]
        assert row["made"]["tokens"] == len(words)
        assert row["made"]["shares"] == [buckets.count(b) * mixing.WHOLE_SHARE // max(1, len(words)) for b in range(mixing.BUCKETS)]


def test_topics_spread_over_documents_and_languages(spark):
    docs = spark.read.parquet(str(TESTDATA / "sf0.01/documents.parquet"))
    made = mixing.described(docs)[0].groupBy("mix_lang", "mix_topic").count().collect()
    total = sum(row["count"] for row in made)
    assert sum(row["count"] for row in made if row["mix_topic"] == mixing.OTHER_TOPIC) < 0.1 * total
    for lang in {row["mix_lang"] for row in made}:
        own = [row["count"] for row in made if row["mix_lang"] == lang]
        assert len(own) >= 6 and max(own) < 0.6 * sum(own)


def test_callers_topic_and_narrow_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = mixing.described(docs, named=F.when(F.col("doc_id") % 2 == 0, "even"), prefix="own_")[0]
    assert {row["own_topic"] for row in named.collect()} == {"even", ""} and "mix_topic" not in named.columns
    names = ["doc_id", *(f"mix_{name}" for name in mixing.DIMENSIONS), "mix_tokens", "mix_probability"]
    texts = lambda df: sorted(map(repr, df.select(names).collect()))
    whole, narrow = mixing.sample(docs), mixing.sample(mixing.narrowed(docs))
    assert texts(whole) == texts(narrow) and "text" not in narrow.columns and set(docs.columns) <= set(whole.columns)


def test_repeated_rows_and_categories_without_a_target(spark):
    rows = [(k // 2, "some words here", "en" if k % 3 else "de", f"s{k % 5}") for k in range(200)] + [(10_000, "some words here", None, None)]
    docs = spark.createDataFrame([(i, t, "xx", s) if i == 7 else (i, t, l, s) for i, t, l, s in rows], "doc_id long, text string, lang string, source string")
    made = mixing.calibrated(docs, {"source": share(spark, "source", s0=0.5), "lang": share(spark, "lang", en=0.5), "topic": 1.0})
    assert made.count() == len(rows) and made.where("mix_probability is null or mix_probability <= 0").isEmpty()
    kept = mixing.sample(docs.unionByName(docs)).groupBy("doc_id", "text", "lang", "source").count().collect()
    assert kept and all(row["count"] % 2 == 0 for row in kept)


def test_probabilities_and_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = mixing.calibrated(docs)
    low, high = made.agg(F.min("mix_probability"), F.max("mix_probability")).first()
    assert 0 < low <= high == pytest.approx(1)
    drawn = mixing.sample(docs)
    again = {row["doc_id"] for row in mixing.sample(docs).collect()}
    assert {row["doc_id"] for row in drawn.collect()} == again and 0 < len(again) < docs.count()
    expected, found = made.agg(F.sum(F.col("mix_tokens") * F.col("mix_probability"))).first()[0], drawn.agg(F.sum("mix_tokens")).first()[0]
    assert found == pytest.approx(expected, rel=0.35)


def test_odd_documents(odd_documents, no_documents):
    made = mixing.calibrated(odd_documents)
    assert made.count() == odd_documents.count() and sorted(set(made.columns)) == sorted(made.columns)
    rows = {row["doc_id"]: row for row in made.collect()}
    assert rows[3]["mix_source"] == "" and rows[3]["mix_tokens"] == 0 and rows[2]["mix_tokens"] == 0
    assert all(0 < row["mix_probability"] <= 1 for row in rows.values())
    assert mixing.sample(odd_documents).columns and mixing.sample(no_documents).collect() == []


def test_a_tiny_cell_does_not_set_the_scale(spark):
    rows = [(k, "some words of a text " * (1 + k % 3), ("en", "de", "fr")[k % 3], f"src{k % 2}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = docs.agg(F.sum(mixing.token_count())).first()[0]
    kept = lambda made: made.agg(F.sum(F.col("mix_tokens") * F.col("mix_probability"))).first()[0] / whole
    before = {row["doc_id"]: row["mix_probability"] for row in mixing.calibrated(docs).collect()}
    rare = docs.unionByName(spark.createDataFrame([(10_000, "ten words", "xx", "rare")], docs.schema))
    made = mixing.calibrated(rare).cache()
    after = {row["doc_id"]: row["mix_probability"] for row in made.collect()}
    assert after.pop(10_000) == 1 and max(after.values()) <= 1
    assert kept(made) >= mixing.RATE * 0.99 > kept(mixing.calibrated(rare, rate=0.0))
    langs = lambda made: {r[0]: r[1] for r in made.where("mix_lang != 'xx'").groupBy("mix_lang").agg(F.sum(F.col("mix_tokens") * F.col("mix_probability"))).collect()}
    old, new = langs(mixing.calibrated(docs)), langs(made)
    assert set(before) == set(after)
    assert all(new[k] / sum(new.values()) == pytest.approx(old[k] / sum(old.values()), rel=0.02) for k in old)


def test_learning_topics_takes_one_python_worker_a_task(spark, monkeypatch):
    """Sort-means, a Python step, reads vectors that are kept: what another Python step makes as it reads takes a second worker, which stays."""
    plans, means = [], mixing.centroids.means
    monkeypatch.setattr(mixing.centroids, "means", lambda vectors, *args: plans.append(vectors._jdf.queryExecution().executedPlan().toString()) or means(vectors, *args))
    docs = spark.createDataFrame([(k, f"a{k % 3} b{k % 5} c{k}", "en", "web") for k in range(20)], "doc_id long, text string, lang string, source string")
    mixing.sample(docs).collect()
    assert len(plans) == 1 and "EvalPython" not in plans[0]
