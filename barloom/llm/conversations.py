"""Repair of conversation structure by dynamic programming over time-major tensors.

A conversation's rows, by turn (nulls first, then by role and text), are kept, given another role or deleted, and empty turns are
inserted, at the least cost that makes the roles' initials ``(s?(ua)+)?``. Blank rows and repeated ones must go; an
unfinished one that stays costs extra. Of equally cheap repairs the one with the least audit (K, R, D, I in order) is taken.

Four states tell what was said last (nothing, system, user, assistant). Conversations are put into buckets by
length and each bucket into a tensor by turn, conversation and state: going back in time, one NumPy step a turn works out the costs
to the end for all conversations at once; going forward, one step a turn takes each conversation's least letter among the cheapest.

Conversations are dealt by id, and a task holds a few at a time. Those of more than ``LONG_ROWS`` rows or ``LONG_BYTES``
bytes are cut into pieces, which are many tasks' work: a piece is a matrix of costs between states it is entered and left in;
matrices are folded backwards into what each piece's ends cost, then each piece tells for every state it may be
entered in where it is left, and these maps are folded forwards. Only the folds, a row a piece, go in order.

Defined cases: a null role or text is one blank; rows with a false ``kept`` don't count, but their conversation does; a
conversation without rows has zeros, no audit and no turns; a null id is a conversation like any other; a role of another
initial than s, u or a can't be kept as it is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm.util import fields
from barloom.operators.joins import broadcast_up_to
from barloom.sources.shared import checkpointed


class Fees(NamedTuple):
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


FEES = Fees()
#: What of one conversation is one task's work at most, and the rows and bytes of a piece of a longer one.
LONG_ROWS, LONG_BYTES, PIECE_ROWS, PIECE_BYTES = 4096, 16 << 20, 4096, 4 << 20
#: Rows, and bytes of their texts, that a task gathers before it repairs them.
AT_ONCE, BYTES_AT_ONCE = 20_000, 16 << 20
#: So many long conversations, and pieces of them, are broadcast at most.
BROADCAST_ROWS = 100_000

#: States: nothing said yet, then by the initial of what was said last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
#: What is said next where a row is given another role or inserted.
FILL = np.array([USER, USER, ASSISTANT, USER])
FILLED = {USER: "user", ASSISTANT: "assistant"}
#: By initial (others last) and state: the state behind a row that is kept; DEAD where it can't be.
DEAD, NEVER = 4, 1 << 40
KEPT = np.array([[SYSTEM, DEAD, DEAD, DEAD], [USER, USER, DEAD, USER], [DEAD, DEAD, ASSISTANT, DEAD], [DEAD] * 4])
OPEN_END = np.array([0, NEVER, NEVER, 0], np.int64)
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"

TURNS = T.ArrayType(fields(role="string", text="string"))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
Batches = Iterator[pa.RecordBatch]


# ---- the tensors


class Rows(NamedTuple):
    """Conversations, or pieces of them, by turn and conversation: each row's initial, whether it must go or is unfinished, and their lengths."""

    initial: np.ndarray
    must: np.ndarray
    cut: np.ndarray
    lengths: np.ndarray

    def repeated(self, n: int) -> Rows:
        return Rows(*[np.repeat(x, n, axis=1) for x in self[:3]], np.repeat(self.lengths, n))


def stacked(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Rows:
    lengths = np.array([len(initial) for initial, _, _ in parts], np.int64)
    made = [np.zeros((lengths.max(initial=0), len(parts)), kind) for kind in (np.int8, bool, bool)]
    for column, part in enumerate(parts):
        for whole, own in zip(made, part, strict=True):
            whole[: len(own), column] = own
    return Rows(*made, lengths)


def _inserted(costs: np.ndarray, fees: Fees) -> np.ndarray:
    for _ in range(3):
        costs = np.minimum(costs, costs[:, FILL] + fees.insert)
    return costs


def _kept(later: np.ndarray, initial: np.ndarray) -> np.ndarray:
    return np.take_along_axis(np.pad(later, ((0, 0), (0, 1)), constant_values=NEVER), KEPT[initial], axis=1)


def backward(rows: Rows, ends: np.ndarray, fees: Fees = FEES) -> np.ndarray:
    """By turn, conversation and state: what the rest costs at least, if ending in a state costs ``ends``."""
    out = np.empty((len(rows.initial) + 1, len(rows.lengths), 4), np.int64)
    out[-1] = _inserted(ends, fees)
    for t in range(len(rows.initial) - 1, -1, -1):
        later = out[t + 1]
        staying = np.minimum(_kept(later, rows.initial[t]), later[:, FILL] + fees.rerole) + fees.truncated * rows.cut[t][:, None]
        here = np.minimum(later + fees.delete, np.where(rows.must[t][:, None], NEVER, staying))
        out[t] = np.where((t < rows.lengths)[:, None], _inserted(here, fees), later)
    return out


def traced(rows: Rows, costs: np.ndarray, ends: np.ndarray, entry: np.ndarray, fees: Fees = FEES) -> tuple[list[bytes], np.ndarray]:
    """The least letters of each conversation's cheapest repair from the state ``entry``, and the state it ends in."""
    n, state = len(rows.lengths), entry.astype(np.int64)
    every, letters, sizes = np.arange(n), np.zeros((n, 3 * len(rows.initial) + 4), np.uint8), np.zeros(n, np.int64)

    def write(which: np.ndarray, letter: bytes | np.ndarray) -> None:
        letters[every[which], sizes[which]] = letter if isinstance(letter, np.ndarray) else ord(letter)
        sizes[which] += 1

    for t in range(len(rows.initial)):
        here, later, active = costs[t], costs[t + 1], t < rows.lengths
        while True:
            going = active & (later[every, state] + fees.delete == here[every, state])
            adding = active & ~going & (here[every, FILL[state]] + fees.insert == here[every, state])
            if not adding.any():
                break
            write(adding, b"I")
            state[adding] = FILL[state[adding]]
        keeping = active & ~going & ~rows.must[t] & (_kept(later, rows.initial[t])[every, state] + fees.truncated * rows.cut[t] == here[every, state])
        write(active, np.where(going, ord("D"), np.where(keeping, ord("K"), ord("R")))[active].astype(np.uint8))
        state = np.where(active & ~going, np.where(keeping, KEPT[rows.initial[t], state], FILL[state]), state)
    while (adding := costs[-1][every, state] < ends[every, state]).any():
        write(adding, b"I")
        state[adding] = FILL[state[adding]]
    return [row[:size].tobytes() for row, size in zip(letters, sizes, strict=True)], state


def spoken(letters: bytes, roles: list[str], texts: list[str], state: int = NOTHING) -> list[dict[str, str]]:
    """The turns that an audit makes of rows, entered in ``state``."""
    out, rows = [], zip(roles, texts, strict=True)
    for letter in letters.decode():
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = 1 + INITIALS.index(role[0])
        else:
            state = int(FILL[state])
            role = FILLED[state]
        out.append({"role": role, "text": text})
    return out


# ---- rows of a table


def marked(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", kept: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, initial, blank, truncated, kept): the rows with what each tells by itself."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    named = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), (F.lit(True) if kept is None else F.col(kept)).alias("kept"))
    shown = named.withColumn("shown", F.rtrim("text", F.lit(BLANKS)))
    place = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(len(INITIALS) + 1)) - 1
    initial = F.when(F.col("role") == "", F.lit(len(INITIALS))).otherwise(place)
    blank, last = F.col("shown") == "", F.substring("shown", -1, 1)
    return shown.select("conv_id", "turn", "role", "text", initial.cast("int").alias("initial"), blank.alias("blank"), (~blank & ~last.isin(".", "!", "?")).alias("truncated"), "kept")


ORDER = ("conv_id", "turn", "role", "text")
PIECES = T.StructType([*[T.StructField(name, T.LongType()) for name in ("piece", *COUNTS)], T.StructField("audit", T.StringType()), T.StructField("turns", TURNS)])


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


class _Gathered:
    """One conversation's rows in order, or a piece's."""

    def __init__(self, key: object):
        self.key, self.turns, self.roles, self.texts, self.flags = key, [], [], [], []

    def add(self, turn: int | None, role: str, text: str, flags: tuple[int, bool, bool, bool]) -> None:
        """``flags``: the initial, then whether the row is blank, a repeated one, or unfinished; the first of these counts."""
        initial, blank, again, cut = flags
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.flags.append((initial, blank, again and not blank, cut and not again and not blank))

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flags = np.array(self.flags, np.int8).reshape(-1, 4)
        return flags[:, 0], (flags[:, 1] | flags[:, 2]).astype(bool), flags[:, 3].astype(bool)

    def counts(self) -> list[int]:
        known = [turn for turn in self.turns if turn is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        return [gaps, *(sum(flag[at] for flag in self.flags) for at in (1, 2, 3)), _illegal(self.roles)]


def _buckets(lengths: list[int]) -> Iterator[list[int]]:
    """Places of conversations of about one length each: from a power of two to the next."""
    found: dict[int, list[int]] = {}
    for place, length in enumerate(lengths):
        found.setdefault(length.bit_length(), []).append(place)
    yield from found.values()


def _repaired(conversations: list[_Gathered], fees: Fees) -> Iterator[tuple]:
    """(key, counts, audit, turns) of whole conversations."""
    for places in _buckets([len(c.roles) for c in conversations]):
        group = [conversations[place] for place in places]
        rows, ends = stacked([c.parts() for c in group]), np.tile(OPEN_END, (len(group), 1))
        costs = backward(rows, ends, fees)
        audits, _ = traced(rows, costs, ends, np.zeros(len(group), np.int64), fees)
        for c, audit, cost in zip(group, audits, costs[0][:, NOTHING].tolist(), strict=True):
            yield c.key, [*c.counts(), cost], audit, spoken(audit, c.roles, c.texts)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[at] for row in rows], kind.type) for at, kind in enumerate(schema)], schema=schema)


def _whole(fees: Fees, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Rows in ORDER, whole conversations in a partition, as a row of PIECES for each conversation."""

    def repair(batches: Batches) -> Batches:
        gathered: list[_Gathered] = []
        rows, size, said = 0, 0, set()

        def done(some: list[_Gathered]) -> pa.RecordBatch:
            return _frame([(key, None, *counts, audit.decode(), turns) for key, counts, audit, turns in _repaired(some, fees)], schema)

        for batch in batches:
            for key, turn, role, text, initial, blank, cut, kept in _rows(batch):
                if not gathered or gathered[-1].key != key:
                    if rows >= AT_ONCE or size >= BYTES_AT_ONCE:
                        yield done(gathered)
                        gathered, rows, size = [], 0, 0
                    gathered.append(_Gathered(key))
                    said = set()
                rows, size = rows + 1, size + len(text)
                if kept:
                    gathered[-1].add(turn, role, text, (initial, blank, (role, text) in said, cut))
                    said.add((role, text))
        if gathered:
            yield done(gathered)

    return repair


# ---- long conversations


STEPS = T.ArrayType(T.LongType())
CUT = fields(
    piece="long", roles=T.ArrayType(T.StringType()), texts=T.ArrayType(T.StringType()), initial="binary", must="binary", cut="binary", counts=STEPS, steps=STEPS
)


def _cut(fees: Fees, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Rows in ORDER, with ``again``, as pieces with their counts (the gaps are 0) and costs between states."""

    def cut(batches: Batches) -> Batches:
        here, number = TaskContext.get().partitionId() << 32, 0
        piece, size, before = None, 0, None

        def done() -> pa.RecordBatch:
            rows = stacked([piece.parts()]).repeated(4)
            ends = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)
            steps = backward(rows, ends, fees)[0]  # by the state it is left in and that it is entered in
            counts = [0, *piece.counts()[1:], 0]
            row = (piece.key, here + number, piece.roles, piece.texts, *(part.tobytes() for part in piece.parts()), counts, steps.ravel().tolist())
            return _frame([row], schema)

        for batch in batches:
            for key, turn, role, text, initial, blank, is_cut, again in _rows(batch):
                if piece is not None and (key != piece.key or len(piece.roles) >= PIECE_ROWS or size >= PIECE_BYTES):
                    yield done()
                    piece, number = None, number + 1
                if piece is None:
                    piece, size = _Gathered(key), 0
                same = before == (key, turn, role, text)
                piece.add(turn, role, text, (initial, blank, again or same, is_cut))
                size, before = size + len(text), (key, turn, role, text)
        if piece is not None:
            yield done()

    return cut


def _ends(schema: pa.Schema) -> Callable[[Batches], Batches]:
    """(conv_id, piece, steps), last pieces first: what it costs to leave each piece in which state."""

    def fold(batches: Batches) -> Batches:
        key, costs = object(), OPEN_END
        for batch in batches:
            made = []
            for conv, piece, steps in _rows(batch):
                if conv != key:
                    key, costs = conv, OPEN_END
                made.append((piece, costs.tolist()))
                costs = (np.array(steps).reshape(4, 4) + costs[:, None]).min(axis=0)
            yield _frame(made, schema)

    return fold


def _piece(initial: bytes, must: bytes, cut: bytes) -> Rows:
    return stacked([(np.frombuffer(initial, np.int8), np.frombuffer(must, bool), np.frombuffer(cut, bool))])


def _maps(fees: Fees, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Of each piece the state it is left in by the state it is entered in."""

    def trace(batches: Batches) -> Batches:
        for batch in batches:
            made = []
            for conv, piece, initial, must, cut, first, last, ends in _rows(batch):
                rows, due = _piece(initial, must, cut).repeated(4), np.tile(np.array(ends), (4, 1))
                _, left = traced(rows, backward(rows, due, fees), due, np.arange(4), fees)
                made.append((conv, piece, left.tolist(), first, last))
            yield _frame(made, schema)

    return trace


def _entries(schema: pa.Schema) -> Callable[[Batches], Batches]:
    """(conv_id, piece, left, first, last), first pieces first: the state that each piece is entered in, and whether its first row may not follow the one before."""

    def fold(batches: Batches) -> Batches:
        key, state, said = object(), NOTHING, None
        for batch in batches:
            made = []
            for conv, piece, left, first, last in _rows(batch):
                if conv != key:
                    key, state, said = conv, NOTHING, None
                made.append((piece, state, int(said is not None and said[:1] + first[:1] not in LEGAL)))
                state, said = left[state], last
            yield _frame(made, schema)

    return fold


def _made(fees: Fees, schema: pa.Schema) -> Callable[[Batches], Batches]:
    def trace(batches: Batches) -> Batches:
        for batch in batches:
            for conv, piece, roles, texts, initial, must, cut, counts, ends, entry, edge in _rows(batch):
                rows, due = _piece(initial, must, cut), np.array([ends])
                costs = backward(rows, due, fees)
                (audit,), (left,) = traced(rows, costs, due, np.array([entry]), fees)
                counts = [*counts[:4], counts[4] + edge, int(costs[0][0, entry]) - ends[left]]
                yield _frame([(conv, piece, *counts, audit.decode(), spoken(audit, roles, texts, entry))], schema)

    return trace


def _with(kind: T.DataType, schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *schema])


def _in_pieces(rows: DataFrame, fees: Fees) -> DataFrame:
    """PIECES of long conversations (``marked`` rows that are kept), and one of each that has its gaps alone."""
    kind = rows.schema["conv_id"].dataType
    step = lambda df, make, schema: df.mapInArrow(make(to_arrow_schema(schema)), schema)
    since = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = checkpointed(rows.withColumns({"digest": F.sha2("text", 256), "since": since}))
    seen = keyed.groupBy("conv_id", "role", "digest").agg(F.min("since").alias("first")).withColumnsRenamed({"conv_id": "c", "role": "r", "digest": "d"})
    met = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = checkpointed(keyed.join(seen, met).select(*ORDER, "initial", "blank", "truncated", (F.col("since") > F.col("first")).alias("again")))
    dealt = again.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*ORDER)
    cut = checkpointed(step(dealt, lambda schema: _cut(fees, schema), _with(kind, CUT)))
    back = cut.select("conv_id", "piece", "steps").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece"))
    ends = broadcast_up_to(checkpointed(step(back, _ends, fields(piece="long", ends=STEPS))), BROADCAST_ROWS)
    narrow = cut.select("conv_id", "piece", "initial", "must", "cut", F.col("roles")[0].alias("first"), F.element_at("roles", -1).alias("last")).join(ends, "piece")
    maps = step(narrow.select("conv_id", "piece", "initial", "must", "cut", "first", "last", "ends"), lambda schema: _maps(fees, schema), _with(kind, fields(piece="long", left=STEPS, first="string", last="string")))
    forth = maps.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    entries = broadcast_up_to(checkpointed(step(forth, _entries, fields(piece="long", entry="long", edge="long"))), BROADCAST_ROWS)
    whole = cut.join(ends, "piece").join(entries, "piece").select("conv_id", "piece", "roles", "texts", "initial", "must", "cut", "counts", "ends", "entry", "edge")
    made = step(whole, lambda schema: _made(fees, schema), _with(kind, PIECES))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    alone = keyed.groupBy("conv_id").agg(gaps.alias("gaps")).select(
        "conv_id", F.lit(-1).cast("long").alias("piece"), "gaps", *[F.lit(0).cast("long").alias(name) for name in COUNTS[1:]], F.lit("").alias("audit"), F.array().cast(TURNS).alias("turns")
    )
    return made.unionByName(alone)


def _parts(rows: DataFrame, fees: Fees, **columns: str | None) -> tuple[DataFrame, DataFrame | None]:
    """PIECES of conversations that are one row each, and those of long ones, if there are any."""
    own = marked(rows, **columns)
    sizes = own.groupBy("conv_id").agg(F.count_if("kept").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    long = checkpointed(sizes.where((F.col("rows") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES) & (F.col("rows") > 1)).select(F.col("conv_id").alias("long_id")))
    schema = _with(own.schema["conv_id"].dataType, PIECES)
    met, any_long = F.col("conv_id").eqNullSafe(F.col("long_id")), not long.isEmpty()
    short = own.join(broadcast_up_to(long, BROADCAST_ROWS), met, "left_anti") if any_long else own
    whole = short.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(_whole(fees, to_arrow_schema(schema)), schema)
    return whole, _in_pieces(own.where("kept").drop("kept").join(broadcast_up_to(long, BROADCAST_ROWS), met, "left_semi"), fees) if any_long else None


def repaired(rows: DataFrame, fees: Fees = FEES, **columns: str | None) -> DataFrame:
    """(conv_id, piece, gaps, blank, duplicate, truncated, illegal, cost, audit, turns): the repaired conversations.

    ``piece`` is null where a conversation is one row; a long one has a row for each of its pieces, whose counts add
    up and whose audits and turns (role, text) follow one another by ``piece``. ``columns`` are names as in ``marked``.
    """
    whole, pieces = _parts(rows, fees, **columns)
    return whole if pieces is None else whole.unionByName(pieces)


def _joined(schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Pieces in order as one row a conversation, with the hash of its turns; texts go through the hash one after another."""

    def join(batches: Batches) -> Batches:
        key, now = object(), None

        def done() -> pa.RecordBatch:
            return _frame([(key, *now[0], "".join(now[1]), now[2].hexdigest())], schema)

        for batch in batches:
            for conv, *counts, audit, turns in _rows(batch):
                if now is None or conv != key:
                    if now is not None:
                        yield done()
                    key, now = conv, ([0] * len(COUNTS), [], hashlib.sha256(), [])
                now[0][:] = [a + b for a, b in zip(now[0], counts, strict=True)]
                now[1].append(audit)
                for said in turns:
                    now[2].update((("\n" if now[3] else "") + f"{said['role']}:{said['text']}").encode())
                    now[3][:] = [True]
        if now is not None:
            yield done()

    return join


def digested(rows: DataFrame, fees: Fees = FEES, **columns: str | None) -> DataFrame:
    """(conv_id, counts, audit, repaired_sha256) of each conversation, repaired as by ``repaired``."""
    whole, pieces = _parts(rows, fees, **columns)
    lines = F.transform("turns", lambda said: F.concat(said["role"], F.lit(":"), said["text"]))
    made = whole.select("conv_id", *COUNTS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    if pieces is None:
        return made
    schema = T.StructType([pieces.schema["conv_id"], *fields(**dict.fromkeys(COUNTS, "long"), audit="string", repaired_sha256="string")])
    parts = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return made.unionByName(parts.select("conv_id", *COUNTS, "audit", "turns").mapInArrow(_joined(to_arrow_schema(schema)), schema))


# ---- damage, which the registered query repairs


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kept): conversations with rows dropped (not ``kept``), emptied, without sentence ends, repeated or of another role, by their hash."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(said("role"))
    copies: Column = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    made = rows.withColumn("kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("kept"), copies.alias("copy"))
    return made.drop("copy")


def oracle() -> str:
    """DuckDB SQL of the registered query: the same costs going forward, with the audit and the turns carried along."""
    step = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END"  # a bit of crc32, whose polynomial this is
    keys = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    bits = f"list_prepend(4294967295, flatten(list_transform(string_split({keys}, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])))"
    names = {NOTHING: "n", SYSTEM: "s", USER: "u", ASSISTANT: "a"}
    kept = [f"('{INITIALS[i]}', '{names[q]}', '{names[KEPT[i, q]]}')" for i in range(3) for q in range(4) if KEPT[i, q] != DEAD]
    fill = [f"('{names[q]}', '{names[FILL[q]]}', '{FILLED[FILL[q]]}')" for q in range(4)]
    best = lambda states: f"SELECT conv, t, q2 AS q, min(cost2) AS cost, arg_min(audit2, row(cost2, audit2)) AS audit, arg_min(said2, row(cost2, audit2)) AS said FROM ({states}) GROUP BY conv, t, q2"
    filled = lambda table: f"SELECT s.conv, s.t, i.q2, s.cost + {FEES.insert} * len(i.roles) AS cost2, s.audit || repeat('I', len(i.roles)) AS audit2, list_concat(s.said, list_transform(i.roles, lambda r: r || ':')) AS said2 FROM ({table}) s JOIN ins i USING (q)"
    return f"""
WITH RECURSIVE o AS (SELECT *, xor(list_reduce({bits}, lambda c, x: {step}), 4294967295) % 20 AS kind FROM conversations),
     w AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
           FROM o, range(2) r(again) WHERE kind <> 0 AND (again = 0 OR kind = 3)),
     ids AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
     y AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
           FROM w JOIN ids ON w.conv_id IS NOT DISTINCT FROM ids.conv_id),
     f AS (SELECT *, shown = '' AS blank, shown <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS duplicate,
                  left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv ORDER BY n), 1) AS before FROM y),
     x AS (SELECT *, NOT blank AND NOT duplicate AND right(shown, 1) NOT IN ('.', '!', '?') AS truncated FROM f),
     g AS (SELECT conv, max(n) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                  count(*) FILTER (truncated) AS truncated, count(*) FILTER (before || initial NOT IN {LEGAL!r}) AS illegal FROM x GROUP BY conv),
     keep AS (FROM (VALUES {', '.join(kept)}) v(initial, q, q2)), fill AS (FROM (VALUES {', '.join(fill)}) v(q, q2, role)),
     ins AS (SELECT q, q AS q2, []::VARCHAR[] AS roles FROM fill UNION ALL SELECT q, q2, [role] FROM fill UNION ALL SELECT a.q, b.q2, [a.role, b.role] FROM fill a JOIN fill b ON b.q = a.q2),
     d AS ({best(filled("SELECT conv, 0::BIGINT AS t, 'n' AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM g"))}
           UNION ALL
           {best(filled(f'''
             SELECT d.conv, x.n AS t, d.q, d.cost + {FEES.delete} AS cost, d.audit || 'D' AS audit, d.said FROM d JOIN x ON x.conv = d.conv AND x.n = d.t + 1
             UNION ALL SELECT d.conv, x.n, k.q2, d.cost + {FEES.truncated} * truncated::INT, d.audit || 'K', list_append(d.said, x.role || ':' || x.text)
             FROM d JOIN x ON x.conv = d.conv AND x.n = d.t + 1 JOIN keep k ON k.initial = x.initial AND k.q = d.q WHERE NOT blank AND NOT duplicate
             UNION ALL SELECT d.conv, x.n, k.q2, d.cost + {FEES.rerole} + {FEES.truncated} * truncated::INT, d.audit || 'R', list_append(d.said, k.role || ':' || x.text)
             FROM d JOIN x ON x.conv = d.conv AND x.n = d.t + 1 JOIN fill k ON k.q = d.q WHERE NOT blank AND NOT duplicate'''))}),
     e AS (SELECT d.conv, min(cost) AS cost, arg_min(audit, row(cost, audit)) AS audit, arg_min(said, row(cost, audit)) AS said FROM d JOIN g ON g.conv = d.conv AND g.rows = d.t WHERE q IN ('n', 'a') GROUP BY d.conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN g USING (conv) LEFT JOIN e USING (conv)"""
