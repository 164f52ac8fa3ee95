"""Conversations are repaired by the cheapest edits.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows are kept (0),
get another role (2) or are deleted (3, the only way for blank and repeated rows);
empty rows are inserted (2); a truncated row that stays costs 1. Among the
cheapest edits the ones with the ASCII-least initials (D, I, K, R) are taken.

Method: scalar big-integer weights. What a path has done so far is one integer:
its cost in the high digits, below them the letters of its edits as octal digits
of fixed places, the first letter highest, zeros after the last. An edge adds its
cost and its letter at the path's next place, so the ordinary integer minimum in
each node (rows done, place in the pattern) of the acyclic graph decides cost and
letters at once. The minimum is safe before the end is known: from one start equal
letters lead to equal places in the pattern, so of two paths to one node neither
is the other's beginning, or it would cost less. Letters that all living nodes
share are final; they leave the integers every ``STEP`` rows, so that those stay
short in conversations of any length.

On Spark: damage and faults are columns. A row's repetitions are found from the
least turn of each (conversation, role, text), by hash; equal rows are counted
together before they are shuffled, so a message that a third of all rows repeat
is no hot key. A task reads a conversation as a sorted stream and holds a byte
for each of its rows, which is what the audit of the conversation holds, too. The
texts meet the audit in a second sorted stream, whose rows are hashed as they
come: SHA-256 is sequential, so one conversation is one task, of bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sqlark.llm.common import utf8
from sqlark.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows between two cuts of the letters that are final.
STEP = 64
#: Conversations of up to so many rows whose answers a task remembers, and how many of them.
SHORT, REMEMBERED = 64, 20_000

# Places in the pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE_AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
OTHER, GONE, CUT = 4, 0, 8
LETTERS = str.maketrans("DIKR", "1234")
DIGITS = str.maketrans("1234", "DIKR")
D, I, K, R = 1, 2, 3, 4
#: What it costs at most to do from one place all that can be done from another: a place that is dearer by more is given up.
INSTEAD = {
    (START, SYSTEM): 0, (START, USER): 2, (START, ASSISTANT): 0,
    (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 4, (SYSTEM, START): 7,
    (USER, SYSTEM): 2, (USER, ASSISTANT): 2, (USER, START): 5,
    (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 2, (ASSISTANT, START): 3,
}


def row_code(role: str, truncated: bool) -> int:
    """A row that may stay: its place by the initial of its role, and whether it is truncated."""
    return INITIALS.get(role[:1], OTHER) | (CUT if truncated else 0)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the best edits; a code is ``GONE`` or from ``row_code``."""
    decided: list[str] = []
    live = {START: (0, "")}
    for at in range(0, len(codes), STEP):
        live = _walk(codes[at : at + STEP], live)
        shared = len(commonprefix([letters for _, letters in live.values()]))
        decided.append(next(iter(live.values()))[1][:shared])
        live = {s: (cost, letters[shared:]) for s, (cost, letters) in live.items()}
    ended = _walk(b"", live)
    cost, letters = min(ended[s] for s in (START, ASSISTANT) if s in ended)
    return cost, "".join(decided) + letters


def _walk(codes: bytes, live: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """Cost and letters at each place after the codes and any inserts."""
    places = max(len(letters) for _, letters in live.values()) + 3 * len(codes) + 4
    cost_unit = 1 << 3 * places

    def add(nodes: dict, place: int, path: tuple[int, int], cost: int, letter: int) -> None:
        value, used = path
        value += cost * cost_unit + (letter << 3 * (places - 1 - used))
        if place not in nodes or value < nodes[place][0]:
            nodes[place] = (value, used + 1)

    def inserted(nodes: dict) -> dict:
        for place in (START, SYSTEM, ASSISTANT, USER):
            if place in nodes:
                add(nodes, ROLE_AFTER[place], nodes[place], INSERT, I)
        return nodes

    nodes = {s: (cost * cost_unit + int(letters.translate(LETTERS).ljust(places, "0"), 8), len(letters)) for s, (cost, letters) in live.items()}
    for code in codes:
        after: dict = {}
        for place, path in inserted(nodes).items():
            add(after, place, path, DELETE, D)
            if code == GONE:
                continue
            more = TRUNCATED if code & CUT else 0
            role = code & ~CUT
            add(after, ROLE_AFTER[place], path, REROLE + more, R)
            if role == ROLE_AFTER[place] or (role == SYSTEM and place == START):
                add(after, role, path, KEEP + more, K)
        nodes = after
    nodes = inserted(nodes)
    costs = {s: value // cost_unit for s, (value, _) in nodes.items()}
    return {
        s: (costs[s], format(value % cost_unit, "o").rjust(places, "0")[:used].translate(DIGITS))
        for s, (value, used) in nodes.items()
        if all(costs[s] <= costs[t] + INSTEAD[t, s] for t in nodes if t != s)
    }


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` (0: dropped, 2: repeated) of
    every row, damaged by the CRC-32 of ``conv_id:turn``. Nulls are read as one
    space, except that ``conv_id`` and ``turn`` themselves stay null."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = shown("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _message() -> Column:
    """Tells messages apart by role and text."""
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def _streamed(df: DataFrame, *first: str) -> DataFrame:
    """One conversation after the other, rows by turn (nulls first), role and message."""
    return df.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "role", "message"
    )


def _marks(rows: DataFrame) -> DataFrame:
    """Rows without their texts, equal ones counted, with their faults and whether they are the ``first`` of their message."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        _message().alias("message"),
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
        "copies",
    )
    counted = narrow.groupBy("conv_id", "turn", "role", "message", "blank", "cut").agg(F.sum("copies").alias("copies"))
    first = (
        counted.where(F.col("copies") > 0)
        .groupBy("conv_id", "message")
        .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
        .select(F.col("conv_id").alias("__conv"), F.col("message").alias("__message"), F.col("least.turn").alias("__turn"))
    )
    joined = counted.join(
        first, counted["conv_id"].eqNullSafe(first["__conv"]) & (counted["message"] == first["__message"]), "left"
    )
    return joined.select(*counted.columns, F.col("turn").eqNullSafe(F.col("__turn")).alias("first"))


class _Conversation:
    """Figures of one conversation, from its rows in order."""

    def __init__(self, conv_id):
        self.conv_id, self.codes = conv_id, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.last_turn = None
        self.turns, self.before = 0, None

    def add(self, turn, role: str, blank: bool, cut: bool, copies: int, first: bool) -> None:
        if not copies:
            return
        if turn is not None and (self.turns == 0 or turn != self.last_turn):
            self.least = turn if self.turns == 0 else self.least
            self.turns, self.last_turn = self.turns + 1, turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.illegal += copies - 1  # no initial may follow itself
        self.before = initial
        if blank:
            self.blank += copies
            self.codes += bytes([GONE]) * copies
            return
        if first:
            self.truncated += cut
            self.codes.append(row_code(role, cut))
        self.duplicate += copies - first
        self.codes += bytes([GONE]) * (copies - first)

    def result(self, known: dict) -> tuple:
        codes = bytes(self.codes)
        found = known.get(codes)
        if found is None:
            found = cheapest(codes)
            if len(codes) <= SHORT and len(known) < REMEMBERED:
                known[codes] = found
        gaps = self.last_turn - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *found


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Size of what a task hands on at once.
BATCH_BYTES = 1 << 20


class _Written:
    """Messages of a repaired conversation, from its audit and then its rows in order."""

    def __init__(self, conv_id, audit: str):
        self.conv_id, self.audit, self.at, self.place = conv_id, audit, 0, 0
        self.system = (len(audit) - audit.count("D")) % 2

    def message(self, role: str | None, text: str) -> tuple[int, str, str, str]:
        """Place, edit, role and text of the next message; no role: the one that the pattern has there."""
        role = role or ("user" if (self.place - self.system) % 2 == 0 else "assistant")
        self.at, self.place = self.at + 1, self.place + 1
        return self.place - 1, self.audit[self.at - 1], role, text

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.message(None, "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        letter = self.audit[self.at]
        if letter == "D":
            self.at += 1
        else:
            yield self.message(role if letter == "K" else None, text)


def _beside_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Every conversation's audit (``part`` 0, as ``text``) and after it its rows in order."""
    nothing = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    texts = rows.where(F.col("copies") > 0).select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", _message().alias("message"), "text", F.col("copies").cast("int").alias("copies")
    )
    heads = audits.select(
        "conv_id", F.lit(0).alias("part"), nothing("turn"), nothing("role"), F.lit(None).cast("binary").alias("message"),
        F.col("audit").alias("text"), F.lit(0).alias("copies"),
    )
    return _streamed(texts.union(heads), "part")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Written, Iterator[tuple]]]:
    """For each audit, row and end of a conversation: the conversation and the messages that are due."""
    current = None
    for batch in batches:
        parts, copies = batch.column("part").to_pylist(), batch.column("copies").to_pylist()
        for i, part in enumerate(parts):
            text = batch.column("text")[i].as_py()
            if not part:
                if current is not None:
                    yield current, current.inserts()
                current = _Written(batch.column("conv_id")[i].as_py(), text)
            for _ in range(copies[i]):
                yield current, current.row(batch.column("role")[i].as_py(), text)
    if current is not None:
        yield current, current.inserts()


def _handed_on(results: Iterator[tuple[int, tuple]], names: list[str], types: list[pa.DataType], size: int) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes as batches of about ``size``."""
    held, total = [], 0
    for weight, row in results:
        held.append(row)
        total += weight
        if total >= size:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names)


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost`` and ``audit`` (letters of the edits) of every conversation, as a stored table.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` (how often
    a row stands there; 0 for a row that is gone). Rows are taken by turn, nulls
    first; those of one turn by role, then by a hash of role and text, so equal rows
    stand together. A row has at most one fault: blank, else a repetition of an
    earlier role and text, else truncated. Rows with a null ``conv_id`` are one
    conversation. One without rows costs nothing. Roles and texts must not be null
    (``damaged`` sees to it). Other columns are not read.
    """
    marks = _marks(rows)
    kind, arrow = marks.schema["conv_id"].dataType, to_arrow_type(marks.schema["conv_id"].dataType)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        known: dict = {}
        current = None
        for batch in batches:
            for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "cut", "copies", "first"))):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        yield 100 + len(current.codes), current.result(known)
                    current = _Conversation(conv_id)
                current.add(*row)
        if current is not None:
            yield 100 + len(current.codes), current.result(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _handed_on(results(batches), ["conv_id", *FIGURES, "audit"], [arrow, *[pa.int64()] * len(FIGURES), pa.string()], BATCH_BYTES)

    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{c} bigint' for c in FIGURES)}, audit string"
    return materialize(_streamed(marks).mapInArrow(run, schema), "audits")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The messages of the repaired conversations: ``conv_id``, ``place``, ``edit``
    (K, R or I), ``role`` and ``text``. ``audits`` are those of ``rows``."""
    kind, arrow = rows.schema["conv_id"].dataType, to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        messages = ((100 + len(m[3]), (c.conv_id, *m)) for c, due in _conversations(batches) for m in due)
        types = [arrow, pa.int64(), pa.string(), pa.string(), pa.string()]
        yield from _handed_on(messages, ["conv_id", "place", "edit", "role", "text"], types, BATCH_BYTES)

    return _beside_audits(rows, audits).mapInArrow(
        run, f"conv_id {kind.simpleString()}, place bigint, edit string, role string, text string"
    )


def digest(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with the SHA-256 of each repaired conversation, its ``role:text`` joined by line ends.

    The same messages as ``repaired`` gives, hashed as they come, so that they are not shuffled again.
    """
    kind, arrow = rows.schema["conv_id"].dataType, to_arrow_type(rows.schema["conv_id"].dataType)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        current = state = None
        for conversation, due in _conversations(batches):
            if conversation is not current:
                if current is not None:
                    yield 100, (current.conv_id, state.hexdigest())
                current, state = conversation, hashlib.sha256()
            for place, _, role, text in due:
                state.update(utf8(f"{chr(10) if place else ''}{role}:{text}"))
        if current is not None:
            yield 100, (current.conv_id, state.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _handed_on(results(batches), ["__conv", "repaired_sha256"], [arrow, pa.string()], BATCH_BYTES)

    hashed = _beside_audits(rows, audits).mapInArrow(run, f"__conv {kind.simpleString()}, repaired_sha256 string")
    return audits.join(hashed, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
