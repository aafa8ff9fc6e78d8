"""Conversation structure repair by dynamic programming over a trie of signatures.

A conversation's *signature* has one letter for each row, in order: ``s``, ``u``,
``a`` or ``o`` for a role that begins with s, u, a or otherwise, in upper case where
the row is truncated, and ``x`` where it is blank or a duplicate.  The cheapest
edits depend on the signature alone, so they are computed once for each different
signature.  These are sorted and read in ranges; a range in sorted order is the
depth-first walk of its prefix trie, and the stack of dynamic programming layers
holds the nodes above the current one.  So each layer is computed once for all
signatures of the range that share the prefix, and a signature's answer is read
off at its terminal node.

Edits: keep a row (0), give it the role user or assistant (1), delete it (2),
insert an empty row of either role (5).  A truncated row that stays costs 5 more,
and blank and duplicate rows can only be deleted.  The roles' initials that remain
must read ``(s?(ua)+)?``.

Texts are shuffled once, to be put together in order.  Rows of a conversation
are streamed: what a task holds of one is a letter and a layer (32 bytes) for each
row of the longest conversation, never its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shipping import ship
from .common import stage

#: White space of the contract: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
UNREACHED = 1 << 60
#: What has been put out so far: nothing, a system row last, a user row last, an assistant row last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted row leads from each of them.
INSERTED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LONGEST_GAP = (1 << 63) - 1

FOUND_SCHEMA = "signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


# --- the cheapest edits of a signature ------------------------------------------


def moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """``(edit, next state, cost)`` for a row with this letter, by the edit's initial."""
    out = [("D", state, DELETE)]
    if symbol != "x":
        late, role = TRUNCATED * symbol.isupper(), symbol.lower()
        wanted = INSERTED[state]
        if role == ("a" if wanted == ASSISTANT else "u"):
            out.append(("K", wanted, late))
        elif role == "s" and state == NOTHING:
            out.append(("K", SYSTEM, late))
        out.append(("R", wanted, late + REROLE))
    return out


MOVES = {symbol: [moves(symbol, state) for state in range(4)] for symbol in "suaoSUAOx"}


def with_inserts(layer: list[int]) -> list[int]:
    user = min(layer[USER], min(layer[NOTHING], layer[SYSTEM], layer[ASSISTANT]) + INSERT)
    return [layer[NOTHING], layer[SYSTEM], user, min(layer[ASSISTANT], user + INSERT)]


def step(layer: Iterable[int], symbol: str) -> list[int]:
    """The least cost of each state behind one more row."""
    out = [UNREACHED] * 4
    for cost, row in zip(layer, MOVES[symbol], strict=True):
        for _, state, more in row:
            out[state] = min(out[state], cost + more)
    return with_inserts(out)


ROOT = with_inserts([0, UNREACHED, UNREACHED, UNREACHED])


class Trie:
    """Answers for signatures that come in sorted order.

    ``layers`` has four costs for every node on the way to the current signature;
    ``steps`` counts the layers that were computed.
    """

    def __init__(self):
        self.path, self.layers, self.steps = "", array("q", ROOT), 0

    def answer(self, signature: str) -> tuple[int, str]:
        """The cost and the edits' initials; of equally cheap ones those that come first in ASCII order."""
        shared = common_prefix(self.path, signature)
        del self.layers[4 * (shared + 1) :]
        for symbol in signature[shared:]:
            self.layers.extend(step(self.layers[-4:], symbol))
            self.steps += 1
        self.path = signature
        return self._read()

    def _read(self) -> tuple[int, str]:
        """Mark the states on cheapest ways from the end to the root, then follow the least edits from the root."""
        layers, n = self.layers, len(self.path)
        cost = min(layers[4 * n + NOTHING], layers[4 * n + ASSISTANT])
        marked = bytearray(n + 1)
        marked[n] = sum(1 << q for q in (NOTHING, ASSISTANT) if layers[4 * n + q] == cost)
        for i in range(n, -1, -1):
            here = layers[4 * i : 4 * i + 4]
            if i < n:
                after, row = layers[4 * i + 4 : 4 * i + 8], MOVES[self.path[i]]
                marked[i] = sum(1 << q for q in range(4) if any(marked[i + 1] >> r & 1 and here[q] + more == after[r] for _, r, more in row[q]))
            for q in (USER, NOTHING, SYSTEM, ASSISTANT):
                if marked[i] >> INSERTED[q] & 1 and here[q] + INSERT == here[INSERTED[q]]:
                    marked[i] |= 1 << q
        out, i, state = [], 0, NOTHING
        while True:
            if i == n and state in (NOTHING, ASSISTANT) and layers[4 * n + state] == cost:
                return cost, "".join(out)
            now = layers[4 * i + state]
            found = [(edit, i + 1, r) for edit, r, more in MOVES[self.path[i]][state] if marked[i + 1] >> r & 1 and now + more == layers[4 * i + 4 + r]] if i < n else []
            if marked[i] >> INSERTED[state] & 1 and now + INSERT == layers[4 * i + INSERTED[state]]:
                found.append(("I", i, INSERTED[state]))
            edit, i, state = min(found)
            out.append(edit)


def common_prefix(a: str, b: str) -> int:
    """The length of the longest common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


# --- damage ---------------------------------------------------------------------


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text, present)``: rows damaged by CRC32 of ``conv:turn`` modulo 20.

    0 takes the row away (it stays with ``present`` false, to name its conversation),
    1 empties the text, 2 takes ``.!?`` out, 3 repeats the row, 4 makes it the user's.
    Null values count as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), times.alias("copy")).drop("copy")


# --- faults and signatures --------------------------------------------------------


def _content() -> Column:
    """A digest of role and text; also the order of rows that share turn and role."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation in one task, its rows by turn (nulls first), role and digest, sorted by Spark, which spills."""
    return rows.repartition("conv").sortWithinPartitions("conv", *first, F.asc_nulls_first("turn"), "role", "content")


def diagnose(turns: DataFrame) -> DataFrame:
    """``(conv, signature, gaps, blank, duplicate, truncated, illegal)`` for every conversation of ``(conv, turn, role, text, present)``, stored.

    A row's first fault counts: blank (white space only), duplicate (an earlier row
    has the same role and text), truncated (its last character but for white space
    is none of ``.!?``).  ``gaps`` are turns missing between the first and the last,
    ``illegal`` neighbours other than system-user, user-assistant and assistant-user.
    Rows go by turn, nulls first; those of the same turn by role and a digest of
    their text.  A conversation without present rows has zeros and an empty
    signature.  A null ``conv`` is a conversation, null roles and texts are one
    space, an empty table gives no rows, and other columns are ignored.
    """
    ship(turns.sparkSession)
    said = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv", F.col("turn").cast("long").alias("turn"), said("role"), said("text"), "present")
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    rows = rows.select("conv", "turn", "role", _content().alias("content"), initial.alias("initial"), (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut"), "present")
    # Contents that a conversation has more than once, with the turn where they stand first.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.filter("present and not blank").groupBy("conv", "content").agg(F.count("*").alias("n"), F.min(place).alias("p"))
    first = first.filter("n > 1").select(F.col("conv").alias("first_conv"), F.col("content").alias("first_content"), "p")
    same = F.col("conv").eqNullSafe(F.col("first_conv")) & (F.col("content") == F.col("first_content"))
    rows = rows.join(first, same, "left").select("conv", "turn", "role", "content", "initial", "blank", "cut", "present", F.coalesce(F.col("p") < place, F.lit(False)).alias("again"))
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            ended = []
            for conv, turn, _, content, initial, blank, cut, present, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or own.conv != conv:
                    if own is not None:
                        ended.append(own.row())
                    own = Conversation(conv)
                if present:
                    own.add(turn, content, initial, blank, cut, again)
            yield _found(batch.schema.field(0).type, ended)
        if own is not None:
            yield _found(batch.schema.field(0).type, [own.row()])

    return stage(_in_order(rows).mapInArrow(run, f"conv {kind}, {FOUND_SCHEMA}"), "conversations")


class Conversation:
    """What is known of a conversation from its rows so far."""

    def __init__(self, conv: object):
        self.conv, self.letters = conv, bytearray()
        self.least = self.most = self.last = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, content: bytes, initial: str, blank: bool, cut: bool, again: bool) -> None:
        if turn is not None and turn != self.most:  # turns come in order
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        copy = not blank and (again or self.last == (turn, content))
        self.blank += blank
        self.duplicate += copy
        self.truncated += not blank and not copy and cut
        self.letters += b"x" if blank or copy else (initial.upper() if cut else initial).encode()
        self.before, self.last = initial, (turn, content)

    def row(self) -> tuple:
        gaps = 0 if self.least is None else min(LONGEST_GAP, self.most - self.least + 1 - self.turns)
        return self.conv, self.letters.decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _found(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (kind, pa.string(), *[pa.int64()] * 5)
    names = ["conv", *(x.split()[0] for x in FOUND_SCHEMA.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


# --- edits ------------------------------------------------------------------------


def cheapest_edits(found: DataFrame) -> DataFrame:
    """Add ``cost`` and ``audit`` to every row of ``found``, by its ``signature``; stored.

    ``audit`` has the initials of the cheapest edits in order (Delete, Insert, Keep,
    Rerole), of equally cheap ones those that come first in ASCII order.  Each
    different signature is answered once; ranges of sorted signatures share their
    prefixes' layers.  The empty signature needs no edit.
    """
    ship(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            answers = [trie.answer(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a[0] for a in answers], pa.int64()), pa.array([a[1] for a in answers], pa.string())], names=["signature", "cost", "audit"])

    different = stage(found.select("signature").distinct(), "signatures")
    answers = different.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost long, audit string")
    return stage(found.join(stage(answers, "answers"), "signature"), "edits")


def repaired(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """``(conv, position, role, text, edit)``: the rows of every conversation after its edits.

    ``turns`` are as :func:`diagnose` had them, ``edits`` have ``conv`` and ``audit``.
    Positions count from 0; the rows of a conversation stand together in a
    partition, in order.  A conversation that nothing is left of has no rows.
    """
    ship(turns.sparkSession)
    said = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.filter("present").select("conv", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), said("role"), said("text")).withColumn("content", _content())
    heads = edits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("content"))
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = None
        for batch in batches:
            out: list[tuple] = []
            for conv, head, _, role, text in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if head == 0:
                    if editor is not None:
                        out += editor.inserts()
                    editor = Editor(conv, text)
                else:
                    out += editor.row(role, text)
            yield _rows(batch.schema.field(0).type, out)
        if editor is not None:
            yield _rows(batch.schema.field(0).type, list(editor.inserts()))

    return _in_order(rows.unionByName(heads), "kind").mapInArrow(run, f"conv {kind}, position long, role string, text string, edit string")


class Editor:
    """Carries out a conversation's edits, row by row."""

    def __init__(self, conv: object, audit: str):
        self.conv, self.audit, self.at, self.state, self.count = conv, audit, 0, NOTHING, 0

    def inserts(self) -> Iterator[tuple]:
        """The rows to insert before the next row, or at the end."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = INSERTED[self.state]
            yield self._put(ROLES[self.state], "", "I")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.state = SYSTEM if edit == "K" and role.startswith("s") else INSERTED[self.state]
            yield self._put(role if edit == "K" else ROLES[self.state], text, edit)

    def _put(self, role: str, text: str, edit: str) -> tuple:
        self.count += 1
        return self.conv, self.count - 1, role, text, edit


def _rows(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv": kind, "position": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def transcripts(rows: DataFrame) -> DataFrame:
    """``(conv, sha256)`` of the lines ``role:text`` of :func:`repaired`'s rows, put together by line feeds.

    The rows must come as that function returns them; conversations without rows are not there.
    """
    ship(rows.sparkSession)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = None, None
        names = ["conv", "sha256"]
        for batch in batches:
            ended = []
            for conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if position == 0:
                    if digest is not None:
                        ended.append((own, digest.hexdigest()))
                    own, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in ended], batch.schema.field(0).type), pa.array([r[1] for r in ended], pa.string())], names=names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], batch.schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], names=names)

    return rows.mapInArrow(run, f"conv {kind}, sha256 string")
