import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from barloom.llm import conversations as conv
from tests.compare import assert_same

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def cheapest(rows):
    """(cost, audit, turns) by trying repairs in order of (cost, audit); ``rows`` are (role, text, must go, unfinished)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, said, turns = heapq.heappop(heap)
        if at == len(rows) and LEGAL.fullmatch(said):
            return cost, audit, turns
        if (at, said[-1:], len(said) == 0) in seen:
            continue
        seen.add((at, said[-1:], len(said) == 0))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, said + role[0], (*turns, f"{role}:")))
        if at < len(rows):
            role, text, must, cut = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, said, turns))
            if not must:
                heapq.heappush(heap, (cost + 3 * cut, audit + "K", at + 1, said + (role[:1] or "?"), (*turns, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", at + 1, said + other[0], (*turns, f"{other}:{text}")))
        heap = [x for x in heap if re.fullmatch(r"s?(ua)*u?", x[3])]
        heapq.heapify(heap)


def plain(rows):
    """What the operator returns for one conversation's (turn, role, text), by plain rules and a search."""
    rows = sorted(((turn, role if role is not None else " ", text if text is not None else " ") for turn, role, text in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        blank, again = bool(BLANK.fullmatch(text)), (role, text) in seen
        cut = not blank and not again and re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] not in ".!?"
        seen.add((role, text))
        for at, fault in enumerate((blank, again and not blank, cut)):
            counts[at] += fault
        judged.append((role, text, blank or again, cut))
    known = [turn for turn, _, _ in rows if turn is not None]
    gaps = max(known) - min(known) + 1 - len({*known}) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, turns = cheapest(judged)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def made_up(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "aunt"], ["yes.", "no", "why? ", " \n", "", None, "one two", "é!", "end.\x0b\t", "日本"]
    weights = [6, 6, 2, 1, 1, 1, 1, 1]
    return [(rng.choice([None, *range(n + 2)]), rng.choices(roles, weights)[0], rng.choice(texts)) for _ in range(n)]


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    found = {i: made_up(rng, rng.choice((1, 2, 3, 5, 8, 13))) for i in range(200)}
    found[None], found[1000], found[1001] = made_up(rng, 4), [(k // 2, "user", "same.") for k in range(40)], [(7, "tool", f"t{k}") for k in range(12)]
    rows = [(i, *row) for i, some in found.items() for row in some]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' AS piece", "1 AS kind", "true AS blank", "'y' AS initial").repartition(5)
    return df, {i: plain(some) for i, some in found.items()}


@pytest.mark.parametrize(("long", "piece"), [(4096, 4096), (2, 1), (3, 4), (6, 2)])
def test_against_a_search(many, monkeypatch, long, piece):
    """Odd roles, nulls, ties of turns, repeated rows, short conversations and those cut into pieces of any size."""
    monkeypatch.setattr(conv, "LONG_ROWS", long)
    monkeypatch.setattr(conv, "PIECE_ROWS", piece)
    df, want = many
    assert {row["conv_id"]: tuple(row)[1:] for row in conv.digested(df).collect()} == want


def test_repaired_turns(spark):
    rows = [(1, 1, "user", "hi."), (1, 2, "user", "there."), (1, 3, "assistant", "yes"), (2, 1, "assistant", "so?")]
    made = {row["conv_id"]: row for row in conv.repaired(spark.createDataFrame(rows, ROWS)).collect()}
    assert made[1]["audit"] == "KIKK" and [(t["role"], t["text"]) for t in made[1]["turns"]] == [("user", "hi."), ("assistant", ""), ("user", "there."), ("assistant", "yes")]
    assert made[1]["cost"] == 6 and made[2]["audit"] == "IK" and made[2]["piece"] is None


def test_rows_that_are_not_kept(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a.", False), (1, 2, "assistant", "b.", False), (2, 1, "user", "a.", True), (2, 2, "assistant", "b.", True), (None, 4, "user", "c.", False)], f"{ROWS}, there boolean")
    found = {row["conv_id"]: tuple(row)[1:] for row in conv.digested(rows, kept="there").collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[1] == found[None] == empty and found[2][:7] == (0, 0, 0, 0, 0, 0, "KK")


def test_damage(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").unionByName(spark.createDataFrame([(None, None, None, None), (900, 3, None, "a.b")], ROWS))
    want = []
    for row in table.collect():
        said = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{said(row['conv_id'])}:{said(row['turn'])}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", said(row["text"])) if kind == 2 else said(row["text"])
        want += [(row["conv_id"], row["turn"], "user" if kind == 4 else said(row["role"]), "" if kind == 0 else text, kind != 0)] * (2 if kind == 3 else 1)
    assert sorted(map(repr, want)) == sorted(repr(tuple(row)) for row in conv.damaged(table).collect())


def test_damaged_and_repaired_table_in_pieces(spark, sf_dir, duck, monkeypatch):
    monkeypatch.setattr(conv, "LONG_ROWS", 4)
    monkeypatch.setattr(conv, "PIECE_ROWS", 3)
    assert_same(conv.digested(conv.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), kept="kept"), duck.execute(conv.oracle()))


def test_buckets_hold_everything_once():
    lengths = [0, 1, 5, 4, 7, 300, 0, 8]
    found = [*conv._buckets(lengths)]
    assert sorted(place for places in found for place in places) == [*range(8)] and all(max(lengths[p] for p in places) <= 2 * max(1, min(lengths[p] for p in places)) for places in found)


def test_one_long_conversation_is_many_pieces(spark):
    """Its pieces come from several tasks, and its rows are in none whole."""
    rows = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id, '.') AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be put together
    try:
        made = conv.repaired(rows).where("piece >= 0").select("piece", "audit", "cost").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({row["piece"] >> 32 for row in made}) > 1 and len(made) >= 8 and sum(len(row["audit"]) for row in made) == 30_000
    assert sum(row["cost"] for row in made) == 0 and {*"".join(row["audit"] for row in made)} == {"K"}


def test_no_rows(spark):
    assert conv.digested(spark.createDataFrame([], ROWS)).collect() == []
    assert np.array_equal(conv.FILL, [2, 2, 3, 2])
