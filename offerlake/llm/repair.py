"""Repair of conversation structure by a run-length dynamic programme.

A conversation is a sequence of symbols, the class of a row's role initial (s, u, a, other) beside its
fault (none, truncated, to be deleted). Equal neighbours form runs. A row, with the inserts before it, is
a min-plus matrix over four states (nothing yet, after s, after u, after a); a run of n rows is the n-th
power, applied by cached binary powers from the end of the conversation to its start, so the cost needs
a step per run and bit. The audit then walks forward through the vectors at the runs' ends and takes the
ASCII-least edit that keeps the cost.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation with any share of the rows
is sorted in many tasks. A task settles the conversations that lie inside its range. Those at its ends
may cross into the next range: their rows are staged, each range leaves one piece (runs and counts),
and pieces are joined per conversation. Only the digest of the repaired text streams a crossing
conversation through one task, row by row, as SHA-256 has no other way. Equal rows are counted before they
are dealt, and first uses of a (role, text) are partial minimums.

Null roles and texts count as one space. Rows of one turn stand in the order of role and text; a null turn
comes first; null ids are one conversation. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import stage

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
SPACES = " \t\n\x0b\f\r"

INITIALS = "sua"
CLEAN, CUT, GONE = range(3)  # faults of a symbol: GONE rows are blank or duplicates
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (EMPTY, AFTER_A)
FAR = 1 << 62
#: Rows of a run whose vectors are held at once while the audit is unrolled.
BLOCK = 4096


def after(state: int, initial: int) -> int | None:
    """The state that follows when a role with this initial (an index of INITIALS) is added, if it may be."""
    if initial == 0:
        return AFTER_S if state == EMPTY else None
    if initial == 1:
        return None if state == AFTER_U else AFTER_U
    return AFTER_A if initial == 2 and state == AFTER_U else None


def turn_of(state: int) -> int:
    """The state after the speaker whose turn it is, by a rerole or an insert."""
    return AFTER_A if state == AFTER_U else AFTER_U


def product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(matrix: tuple, vector: tuple) -> tuple:
    a, b, c, d = vector
    return tuple(min(w + a, x + b, y + c, z + d) for w, x, y, z in matrix)


def _inserts() -> tuple:
    once = tuple(tuple(0 if i == j else INSERT_COST if j == turn_of(i) else FAR for j in range(4)) for i in range(4))
    return product(once, once)


INSERTS = _inserts()
FINAL = applied(INSERTS, tuple(0 if s in ENDS else FAR for s in range(4)))


@cache
def power(symbol: int, bit: int) -> tuple:
    """The transition of 2**bit rows of this symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return tuple(tuple(min(x, FAR) for x in row) for row in product(half, half))
    initial, fault = divmod(symbol, 3)
    row = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        row[state][state] = DELETE_COST
        if fault != GONE:
            extra = TRUNCATED_COST if fault == CUT else 0
            kept, turned = after(state, initial), turn_of(state)
            row[state][turned] = min(row[state][turned], REROLE_COST + extra)
            if kept is not None:
                row[state][kept] = min(row[state][kept], extra)
    return product(INSERTS, tuple(map(tuple, row)))


def advance(symbol: int, n: int, vector: tuple) -> tuple:
    """Costs before n rows of a symbol from the costs after them."""
    bit = 0
    while n:
        if n & 1:
            vector = applied(power(symbol, bit), vector)
        n, bit = n >> 1, bit + 1
    return vector


def settle(runs: list[list[int]]) -> tuple[int, str]:
    """The least cost of a conversation, and its audit."""
    vectors = [FINAL]
    for symbol, n in reversed(runs):
        vectors.append(advance(symbol, n, vectors[-1]))
    vectors.reverse()
    audit, state = [], EMPTY
    for (symbol, n), end in zip(runs, vectors[1:], strict=True):
        initial, fault = divmod(symbol, 3)
        extra = TRUNCATED_COST if fault == CUT else 0
        while n:
            size = (n - 1) % BLOCK + 1
            n -= size
            held = [advance(symbol, n, end)]
            for _ in range(size):
                held.append(applied(power(symbol, 0), held[-1]))
            for left in range(size, 0, -1):
                now, later = held[left], held[left - 1]
                while True:
                    cost, turned = now[state], turn_of(state)
                    if DELETE_COST + later[state] == cost:
                        audit.append(DELETE)
                        break
                    if INSERT_COST + now[turned] == cost:
                        audit.append(INSERT)
                        state = turned
                        continue
                    kept = after(state, initial)
                    if kept is not None and extra + later[kept] == cost:
                        audit.append(KEEP)
                        state = kept
                    else:
                        audit.append(REROLE)
                        state = turned
                    break
    while state not in ENDS:
        audit.append(INSERT)
        state = turn_of(state)
    return vectors[0][EMPTY], "".join(audit)


def repaired(audit: str, rows: Iterable[tuple[str, str, int]]) -> Iterator[str]:
    """The lines of the repaired conversation; rows are (role, text, copies), of copies only the first can stay."""
    source, spare, state = iter(rows), 0, EMPTY
    for edit in audit:
        if edit == INSERT:
            state = turn_of(state)
            yield "assistant:" if state == AFTER_A else "user:"
            continue
        if spare:
            spare -= 1
            continue
        role, text, copies = next(source)
        spare = copies - 1
        if edit == KEEP:
            state = after(state, INITIALS.index(role[:1]))
            yield f"{role}:{text}"
        elif edit == REROLE:
            state = turn_of(state)
            yield f"{'assistant' if state == AFTER_A else 'user'}:{text}"


def digest(lines: Iterable[str]) -> str:
    total, first = hashlib.sha256(), True
    for line in lines:
        total.update(("" if first else "\n").encode() + line.encode())
        first = False
    return total.hexdigest()


class Piece:
    """What a stretch of a conversation says about itself; stretches in order can be joined."""

    def __init__(self, **fields):
        self.runs: list[list[int]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.head = self.tail = None
        self.__dict__.update(fields)

    def _follow(self, head: str) -> None:
        if self.tail is not None and self.tail + head not in ("su", "ua", "au"):
            self.illegal += 1

    def _run(self, symbol: int, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([symbol, n])

    def add(self, turn: int | None, role: str, copies: int, blank: bool, later: bool, cut: bool) -> None:
        initial = role[:1]
        kind = (INITIALS.index(initial) if initial and initial in INITIALS else 3) * 3
        self._follow(initial)
        self.head = initial if self.head is None else self.head
        self.tail = initial
        self.illegal += copies - 1  # no initial may follow itself
        gone = blank or later
        self._run(kind + (GONE if gone else CUT if cut else CLEAN), 1)
        self._run(kind + GONE, copies - 1)
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies if later else copies - 1
        self.truncated += cut and not gone
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.turns, self.high = self.turns + 1, turn

    def join(self, other: Piece) -> None:
        if other.head is None:
            return
        self._follow(other.head)
        self.head = other.head if self.head is None else self.head
        self.tail = other.tail
        for symbol, n in other.runs:
            self._run(symbol, n)
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.low is not None:
            self.turns -= self.high == other.low
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *settle(self.runs)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage, with the number of their copies and two keys: of the row, of its (role, text)."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    name = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)))
    filled = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), (F.crc32(name.cast("binary")) % 20).alias("damage"),
        *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = filled.where("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("damage") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("said", F.unhex(F.md5(said.cast("binary")))).withColumn(
        "row", F.unhex(F.md5(F.concat(F.col("said"), F.coalesce(F.col("turn").cast("string"), F.lit("")).cast("binary")))))


def faulty(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and faults."""
    many = stage(rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repair-many")
    first = rows.groupBy("said").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull().cast("int")).alias("unnumbered"), F.count("*").alias("n"))
    first = stage(first.where("n > 1").drop("n"), "repair-first")
    same = rows.join(many, "row", "left_semi").groupBy("row", "said", "conv_id", "turn").agg(*(F.first(c).alias(c) for c in ("role", "text")), F.sum("copies").alias("copies"))
    single = rows.join(many, "row", "left_anti")
    later = F.when(F.col("unnumbered") == 1, F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    ink = F.rtrim(F.col("text"), F.lit(SPACES))
    return single.unionByName(same).join(first, "said", "left").select(
        "conv_id", "turn", "role", "text", "copies", (ink == "").alias("blank"), F.coalesce(later, F.lit(False)).alias("later"),
        (~F.right(ink, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_RESULT = [*[pa.int64()] * 6, pa.string()]
_RESULT_NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
#: kind 0: a settled conversation; 1: a row of one that may cross a range; 2: its piece in this range
MIXED = f"kind int, conv_id long, {RESULT}, repaired_sha256 string, part int, seq long, role string, text string, copies long, piece string"
_MIXED = pa.schema([("kind", pa.int32()), ("conv_id", pa.int64()), *zip(_RESULT_NAMES, _RESULT, strict=True), ("repaired_sha256", pa.string()), ("part", pa.int32()),
                    ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("piece", pa.string())])
_NO_RESULT = (None,) * 8
ROWS_OUT = 500


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, out, seq, opened, current, piece, held = TaskContext.get().partitionId(), [], 0, 0, None, Piece(), []

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), _MIXED, strict=True)], schema=_MIXED)
        out.clear()
        return made

    def open_end() -> tuple:
        return 2, current, *_NO_RESULT, part, seq, None, None, None, json.dumps(vars(piece))

    for batch in batches:
        for conv, turn, role, text, copies, blank, later, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not opened or conv != current:
                if opened == 1:
                    out.append(open_end())
                elif opened:
                    result = piece.result()
                    out.append((0, current, *result, digest(repaired(result[-1], held)), None, None, None, None, None, None))
                opened, current, piece, held = opened + 1, conv, Piece(), []
            piece.add(turn, role, copies, blank, later, cut)
            seq += 1
            if opened == 1:  # the range may begin inside this conversation
                out.append((1, conv, *_NO_RESULT, part, seq, role, text, copies, None))
            else:
                held.append((role, text, copies))
            if len(out) >= ROWS_OUT:
                yield flush()
    if opened:
        for at, (role, text, copies) in enumerate(held):
            out.append((1, current, *_NO_RESULT, part, seq - len(held) + at, role, text, copies, None))
            if len(out) >= ROWS_OUT:
                yield flush()
        out.append(open_end())
        yield flush()


def _joined(table: pa.Table) -> pa.Table:
    """All pieces of a conversation, one of each range at most."""
    whole = Piece()
    for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
        whole.join(Piece(**json.loads(row["piece"])))
    values = (table.column("conv_id")[0].as_py(), *whole.result())
    return pa.table([pa.array([v], k) for v, k in zip(values, [pa.int64(), *_RESULT], strict=True)], names=["conv_id", *_RESULT_NAMES])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit stands before its rows."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "audit", "role", "text", "copies")), strict=True)

    source = rows()
    pending = next(source, None)

    def own() -> Iterator[tuple]:
        nonlocal pending
        while (pending := next(source, None)) is not None and pending[0] >= 0:
            yield pending[3:]

    while pending is not None:
        conv, audit, texts = pending[1], pending[2], own()
        total = digest(repaired(audit, texts))
        for _ in texts:  # copies at the end
            pass
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([total])], names=["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """Damages, audits and repairs every conversation; one row for each."""
    rows = faulty(damaged(conversations))
    order = ["conv_id", "turn", "role", "text"]
    mixed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_ranges, MIXED), "repair-ranges", tidy=True)
    columns = ["conv_id", *_RESULT_NAMES, "repaired_sha256"]
    inside = mixed.where("kind = 0").select(columns)
    pieces = mixed.where("kind = 2").select("conv_id", "part", "piece")
    crossing = stage(pieces.groupBy("conv_id").applyInArrow(_joined, f"conv_id long, {RESULT}"), "repair-crossing")
    heads = crossing.select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("seq"), "conv_id", "audit", *(F.lit(None).cast(k).alias(c) for c, k in (("role", "string"), ("text", "string"), ("copies", "long"))))
    texts = mixed.where("kind = 1").select("part", "seq", "conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", "copies")
    streams = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    hashes = streams.mapInArrow(_streamed, "conv_id long, repaired_sha256 string")
    ended = crossing.join(hashes.withColumnRenamed("conv_id", "hashed"), F.col("conv_id").eqNullSafe(F.col("hashed"))).select(columns)
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    left = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.max((F.crc32(name.cast("binary")) % 20 != 0).cast("int")).alias("kept")).where("kept = 0")
    nothing = left.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in _RESULT_NAMES[:-1]), F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
    return inside.unionByName(ended).unionByName(nothing)
