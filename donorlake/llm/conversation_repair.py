"""Conversation structure repair: the cheapest edits that make turns alternate, by Four-Russians block tables.

Rows of a conversation are taken by turn (nulls first; rows of one turn by role, then by the MD5 of their text; equal
rows lie next to each other). Null roles and texts count as one space. A row is *blank* (nothing but blanks), else a
*duplicate* (role and text seen earlier in the conversation), else *truncated* (its last character that is no blank is
none of ``.!?``). Initials of roles have to come out as ``(s?(ua)+)?``. Edits and their costs: Keep 0, Rerole to user or
assistant 3, Delete 4 (required for blank and duplicate rows), Insert an empty user or assistant row 3; a truncated row
that stays adds 3. Of the cheapest edits those with the least initials (D, I, K, R) are taken.

What is left to do from a row on costs so much for each of the four states of that pattern. Less their least, these four
numbers take a few values only. The tables give, for each such vector behind a block of ``BLOCK`` rows and each block,
the vector before it; whole blocks are looked up from the end on. Then blocks are expanded, each backward from the
vector behind it, and their edits picked forward, least initial first; every pick is checked against the exact costs,
so ties go to the least audit. Rows that have to be deleted change no vector and take no part.

How it scales: rows of the same turn, role and text are counted first; then rows without their text are dealt by range of
(conv_id, turn, role, MD5), so a conversation of any length is cut into as many pieces as it needs. A task sums up the
conversations its range may share with others, the first and the last, as a table of vectors and states; the driver
chains these, two rows a task. Texts are joined to what stays by row. Only the hash of ``digest`` reads a conversation's
text in one task, in order and in passing, because a hash of it all cannot be made otherwise.

A conversation without id is one conversation. No rows give no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from donorlake.llm.common import cut, python_workers

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 4
#: Row symbols: 2 * (s, u, a, other) + truncated; rows that have to be deleted.
SYMBOLS, GONE = 8, 8
#: States: nothing yet, after s, after u, after a; where s, u and a lead (-1: nowhere), and what an inserted row leads to.
MOVES = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
ADDED = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
AT_END = (0, 6, 3, 0)
LAST = ("", "II", "I", "")

Vector = tuple[int, int, int, int]


def _normal(costs: Vector) -> Vector:
    least = min(costs)
    return tuple(c - least for c in costs)


def _before(after: Vector, symbol: int) -> Vector:
    """Costs before a row, by state, from the costs behind it."""
    kind, short = divmod(symbol, 2)
    row = []
    for q in range(4):
        options = [DELETE + after[q], REROLE + TRUNCATED * short + after[ADDED[q]]]
        if kind < 3 and MOVES[q][kind] >= 0:
            options.append(KEEP + TRUNCATED * short + after[MOVES[q][kind]])
        row.append(min(options))
    for _ in range(3):
        row = [min(row[q], INSERT + row[ADDED[q]]) for q in range(4)]
    return tuple(row)


@dataclass(frozen=True)
class Tables:
    """``vectors`` by number, the first is the one at the end; ``row`` and ``block``: number behind, symbols -> before."""

    vectors: tuple[Vector, ...]
    row: list[list[int]]
    block: list[list[int]]


@lru_cache(1)
def tables() -> Tables:
    known: dict[Vector, int] = {_normal(AT_END): 0}
    row: list[list[int]] = []
    for vector in known_in_order(known):
        row.append([known.setdefault(_normal(_before(vector, s)), len(known)) for s in range(SYMBOLS)])
    blocks = [[v] for v in range(len(row))]
    for _ in range(BLOCK):  # one more row in front of all blocks so far: its symbol is the lowest digit
        blocks = [[row[v][s] for v in behind for s in range(SYMBOLS)] for behind in blocks]
    return Tables(tuple(known), row, blocks)


def known_in_order(known: dict[Vector, int]) -> Iterator[Vector]:
    """Entries of a table that grows while it is read."""
    at = 0
    while at < len(known):
        yield list(known)[at]
        at += 1


def vectors_before(symbols: bytes, behind: int) -> list[int]:
    """Vector numbers at the block borders, from the front (before all symbols) to the end (``behind``)."""
    t = tables()
    found = [behind]
    whole = len(symbols) // BLOCK * BLOCK
    for s in reversed(symbols[whole:]):
        behind = t.row[behind][s]
    if whole < len(symbols):
        found.append(behind)
    for at in range(whole - BLOCK, -1, -BLOCK):
        code = 0
        for s in reversed(symbols[at : at + BLOCK]):
            code = code * SYMBOLS + s
        behind = t.block[behind][code]
        found.append(behind)
    return found[::-1]


@lru_cache(1 << 18)
def expanded(symbols: bytes, behind: int, state: int) -> tuple[tuple[str, ...], int]:
    """The edits of one block, a string per row (inserted rows come before the row's own edit), and the state behind it."""
    t = tables()
    costs = [t.vectors[behind]]
    for s in reversed(symbols):
        costs.append(_before(costs[-1], s))
    costs.reverse()
    edits = []
    for at, s in enumerate(symbols):
        now, after, done = costs[at], costs[at + 1], ""
        kind, short = divmod(s, 2)
        while True:
            kept = MOVES[state][kind] if kind < 3 else -1
            if now[state] == DELETE + after[state]:
                done += "D"
            elif now[state] == INSERT + now[ADDED[state]]:
                done += "I"
                state = ADDED[state]
                continue
            elif kept >= 0 and now[state] == KEEP + TRUNCATED * short + after[kept]:
                done += "K"
                state = kept
            else:
                done += "R"
                state = ADDED[state]
            break
        edits.append(done)
    return tuple(edits), state


def edits_of(symbols: bytes, behind: int = 0, state: int = 0) -> tuple[list[str], int]:
    """Edits by row for a piece of a conversation, given what is behind it and the state before it."""
    vectors = vectors_before(symbols, behind)
    edits: list[str] = []
    for k, at in enumerate(range(0, len(symbols), BLOCK)):
        some, state = expanded(symbols[at : at + BLOCK], vectors[k + 1], state)
        edits.extend(some)
    return edits, state


def summary(symbols: bytes) -> list[int]:
    """For every vector behind a piece: the vector before it, and the state behind it for every state before it."""
    table = []
    for behind in range(len(tables().vectors)):
        table.append(vectors_before(symbols, behind)[0])
        table.extend(edits_of(symbols, behind, q)[1] for q in range(4))
    return table


# --- rows on Spark -----------------------------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by checksum of ``conv_id:turn`` modulo 20: dropped, emptied, cut, repeated, made user."""
    part = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = F.crc32(part.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        hit.alias("hit"),
    )
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", times.alias("times")).drop("times")


def _read(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest`` and ``key``, which is the same for rows that are alike in all of these."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    return rows.withColumns({"digest": F.md5(F.col("text").cast("binary"))}).withColumns({"key": _key(F.col("turn"))})


def _key(turn: Column) -> Column:
    ids = [F.coalesce(c.cast("string"), F.lit("-")) for c in (F.col("conv_id"), turn)]
    return F.concat_ws(":", F.col("digest"), *ids, F.col("role"))


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows without text, alike ones counted (``n``), with symbol and fault, sorted and dealt by range, written out."""
    read = _read(conversations)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = read.groupBy("conv_id", "turn", "role", "digest", "key", blank.alias("blank"), ended.alias("ended"))
    slim = slim.agg(F.count("*").alias("n"))
    # Nulls come first; a struct orders them so.
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    first = first.select(_key(F.col("first.turn")).alias("key"), F.lit(True).alias("is_first"))
    flagged = slim.join(first, "key", "left")
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    gone = F.col("blank") | F.col("is_first").isNull()
    symbol = F.when(gone, GONE).otherwise(2 * kind + F.when(F.col("ended"), 0).otherwise(1))
    flagged = flagged.select("conv_id", "turn", "role", "digest", "key", "n", "blank", symbol.cast("int").alias("symbol"))
    order = ("conv_id", "turn", "role", "digest")
    python_workers(conversations.sparkSession)
    return cut(flagged.repartitionByRange(*order).sortWithinPartitions(*order))


@dataclass
class Piece:
    """Rows of one conversation within a range."""

    conv_id: object
    rows: list[tuple] = field(default_factory=list)  # turn, role, key, n, blank, symbol
    border: bool = False

    def symbols(self) -> bytes:
        return bytes(row[5] for row in self.rows if row[5] != GONE)

    def ends(self) -> dict:
        """What the neighbouring pieces of the same conversation have to know."""
        first, last = self.rows[0], self.rows[-1]
        return {"first": (first[1][:1], first[0]), "last": (last[1][:1], last[0])}


ROW = ("turn", "role", "key", "n", "blank", "symbol")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """The conversations of a range in order; the first and the last may go on in other ranges (``border``)."""
    now: Piece | None = None
    first = True
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ROW]
        for conv_id, row in zip(batch.column("conv_id").to_pylist(), zip(*columns, strict=True), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    now.border, first = first, False
                    yield now
                now = Piece(conv_id)
            now.rows.append(row)
    if now is not None:
        now.border = True
        yield now


@dataclass(frozen=True)
class Place:
    """Where a piece stands in its conversation: vector behind, state before, last row before, and whether it is last."""

    behind: int = 0
    state: int = 0
    before: tuple | None = None
    last: bool = True


BORDER = "part int, conv_id {id}, table array<int>, first struct<initial:string,turn:bigint>, last struct<initial:string,turn:bigint>"


def places(rows: DataFrame) -> dict[tuple, Place]:
    """Places of the pieces of conversations that are cut, by range and conversation; at most two a range."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    schema = T._parse_datatype_string(BORDER.format(id=conv_type))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for piece in _pieces(batches):
            if piece.border:
                ends = {k: {"initial": i, "turn": t} for k, (i, t) in piece.ends().items()}
                row = {"part": part, "conv_id": piece.conv_id, "table": summary(piece.symbols()), **ends}
                yield pa.RecordBatch.from_pylist([row], schema=_arrow(schema))

    by_conversation: dict = {}
    for row in rows.select("conv_id", *ROW).mapInArrow(borders, schema).collect():
        by_conversation.setdefault(row.conv_id, []).append(row)
    found = {}
    for conv_id, pieces in by_conversation.items():
        pieces.sort(key=lambda row: row.part)
        behind = [0]
        for piece in reversed(pieces):
            behind.append(piece.table[5 * behind[-1]])
        behind.reverse()
        state, before = 0, None
        for k, piece in enumerate(pieces):
            found[piece.part, conv_id] = Place(behind[k + 1], state, before, k + 1 == len(pieces))
            state = piece.table[5 * behind[k + 1] + 1 + state]
            before = (piece["last"].initial, piece["last"].turn)
    return found


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _edits(piece: Piece, place: Place) -> tuple[list[tuple[tuple | None, str]], int]:
    """(row, edits) in order, with ``None`` for what is inserted behind the last row; and the state at the end."""
    edits, state = edits_of(piece.symbols(), place.behind, place.state)
    each = iter(edits)
    out: list[tuple[tuple | None, str]] = []
    for row in piece.rows:
        out.append((row, "D" if row[5] == GONE else next(each)))
    if place.last and LAST[state]:
        out.append((None, LAST[state]))
    return out, state


REPORT = (
    "conv_id {id}, part int, least bigint, most bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint, audit string"
)
LEGAL = {"su", "ua", "au"}


def _report(piece: Piece, place: Place) -> dict:
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
    audit = []
    before = place.before
    least = most = None
    edits, _ = _edits(piece, place)
    for row, edit in edits:
        if row is None:
            audit.append(edit)
            counts["cost"] += INSERT * len(edit)
            continue
        turn, role, _, n, blank, symbol = row
        initial = role[:1]
        extra = n - 1 if symbol != GONE else n
        counts["blank" if blank else "duplicate"] += extra
        if before is not None and before[0] + initial not in LEGAL:
            counts["illegal"] += 1
        counts["illegal"] += n - 1 if initial * 2 not in LEGAL else 0
        if turn is not None:
            counts["turns"] += before is None or before[1] != turn
            least, most = turn if least is None else least, turn
        before = (initial, turn)
        if symbol == GONE:
            audit.append("D" * n)
            counts["cost"] += DELETE * n
            continue
        counts["truncated"] += symbol % 2
        audit.append(edit + "D" * (n - 1))
        counts["cost"] += sum({"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[c] for c in edit) + DELETE * (n - 1)
        counts["cost"] += TRUNCATED * (symbol % 2) * (edit[-1] != "D")
    return {"conv_id": piece.conv_id, "least": least, "most": most, "audit": "".join(audit), **counts}


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_pylist(some, schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=schema)


@dataclass(frozen=True)
class Repair:
    """A repaired table: ``rows`` and ``report``."""

    read: DataFrame
    order: DataFrame
    places: dict[tuple, Place]

    def report(self) -> DataFrame:
        """Per conversation: ``gaps, blank, duplicate, truncated, illegal, cost`` and ``audit``."""
        schema = T._parse_datatype_string(REPORT.format(id=self.order.schema["conv_id"].dataType.simpleString()))
        known, arrow = self.places, _arrow(schema)

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            found = ({"part": part, **_report(p, known.get((part, p.conv_id), Place()))} for p in _pieces(batches))
            yield from _batches(found, arrow)

        each = self.order.select("conv_id", *ROW).mapInArrow(pieces, schema)
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        gaps = F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
        audits = F.sort_array(F.collect_list(F.struct("part", "audit")))
        whole = each.groupBy("conv_id").agg(gaps, *sums, audits.alias("audits"))
        return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join("audits.audit", "").alias("audit"))

    def rows(self) -> DataFrame:
        """What stays, in order of (``conv_id, part, at``): ``turn`` (null if inserted), ``role``, ``text`` and ``edit``."""
        conv_type = self.order.schema["conv_id"].dataType.simpleString()
        schema = T._parse_datatype_string(f"conv_id {conv_type}, part int, at bigint, turn bigint, role string, edit string, key string")
        known, arrow = self.places, _arrow(schema)

        def stays(piece: Piece, place: Place, part: int) -> Iterator[dict]:
            at, state = 0, place.state
            for row, edits in _edits(piece, place)[0]:
                for edit in edits:
                    if edit == "D":
                        continue
                    # Inserted rows have a key of their own, which matches no text and does not put them into one task.
                    role, key, turn = None, f"inserted:{part}:{piece.conv_id}:{at}", None
                    if edit in "KR":
                        turn, role, key = row[:3]
                    state = MOVES[state]["sua".index(role[:1])] if edit == "K" else ADDED[state]
                    role = role if edit == "K" else ROLES[state]
                    yield {"conv_id": piece.conv_id, "part": part, "at": at, "turn": turn, "role": role, "edit": edit, "key": key}
                    at += 1

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            found = (row for p in _pieces(batches) for row in stays(p, known.get((part, p.conv_id), Place()), part))
            yield from _batches(found, arrow)

        kept = self.order.select("conv_id", *ROW).mapInArrow(pieces, schema)
        texts = self.read.groupBy("key").agg(F.max("text").alias("text"))
        joined = kept.join(texts, "key", "left")
        return joined.select("conv_id", "part", "at", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), "edit")


def repair(conversations: DataFrame) -> Repair:
    """Analyse rows of (``conv_id, turn, role, text``); other columns are ignored."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = ordered(rows)
    return Repair(_read(rows), order, places(order))


def digest(rows: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's rows as ``role:text`` lines, read in order and in passing: ``conv_id, sha256``."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    schema = T._parse_datatype_string(f"conv_id {conv_type}, sha256 string")
    arrow = _arrow(schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, state = None, None
        for batch in batches:
            for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or conv_id != now:
                    if state is not None:
                        yield {"conv_id": now, "sha256": state.hexdigest()}
                    now, state = conv_id, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
        if state is not None:
            yield {"conv_id": now, "sha256": state.hexdigest()}

    lines = rows.select("conv_id", "part", "at", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "line")
    return lines.mapInArrow(lambda batches: _batches(hashes(batches), arrow), schema)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table with the report on its damaged rows and the hash of the repaired ones."""
    done = repair(damage(conversations))
    report, hashes = done.report(), digest(done.rows())
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    rows = conversations.select("conv_id").distinct()
    for other in (report, hashes):
        other = other.withColumnRenamed("conv_id", "other_id")
        rows = rows.join(other, F.col("conv_id").eqNullSafe(F.col("other_id")), "left").drop("other_id")
    return rows.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
