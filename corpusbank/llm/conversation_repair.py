"""Cheapest repair of conversations, streamed in turn order.

The rows are dealt out by conversation and sorted by turn inside every partition; ``mapInPandas``
walks through them once and carries, from one Arrow batch to the next, a dynamic program over the
role automaton ``(s?(ua)+)?``: for each of its four states the least cost, the order of the best
edit strings, and a running sha256 of the best repaired text.  Cost vectors repeat, so a step is a
lookup of (vector, kind of row).  A row leaves four bytes of backpointers, which go to an unnamed
scratch file of the task when a conversation is long (like the scratch files of a Spark sort, it is
never read by another task; a lost executor runs the task again).  Memory is bounded by an Arrow
batch and the audit string of one conversation, whatever the length of the conversation.

A conversation is one stream, as its sha256 has to be: a very long one keeps one task busy, without
being held in memory.  Repeated (role, text) pairs are found before by a map-side combined
aggregation, not by a set per conversation; the join with them is broadcast or skew-split by Spark.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own; null
turns come first; rows of equal turn are ordered by role, then text; a repeated row is a duplicate
of the one before; extra columns of any name are ignored; an empty table gives no rows; a gap count
beyond a long is the largest long.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbank.llm.common import table
from corpusbank.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
HELD = 1 << 20  # bytes of backpointers kept in memory for one conversation
LONGEST = 2**63 - 1
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
START, S, U, A = range(4)
#: An inserted or re-labelled row is the one role that may follow.
NEXT = {START: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}
FOLLOWS = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
SPACE = "\x20\t\n\v\f\r"
ENDS = ".!?"


def _options(state: int, initial: str, deleted: bool, truncated: bool):
    """(state after, cost, inserts, letter) of every way to take one row from ``state``."""
    for inserts in range(3):  # a third insert returns to a state met before
        cost = INSERT * inserts
        yield state, cost + DELETE, inserts, "D"
        if not deleted:
            extra = TRUNCATED if truncated else 0
            if state in FOLLOWS.get(initial, ()):
                yield FOLLOWS[initial][state], cost + KEEP + extra, inserts, "K"
            yield NEXT[state], cost + REROLE + extra, inserts, "R"
        state = NEXT[state]


@cache
def step(vector: tuple, initial: str, deleted: bool, truncated: bool):
    """One row: (new vector, added cost, backpointers of the four states).

    A vector holds per state None or (cost above the least, place of its edit string among the
    four).  Strings of different states have the same number of letters other than I and end with
    one, so none is the beginning of another and places decide between them for good.
    """
    best = [None] * 4
    for old, entry in enumerate(vector):
        if entry is None:
            continue
        for new, cost, inserts, letter in _options(old, initial, deleted, truncated):
            found = (entry[0] + cost, entry[1], "I" * inserts + letter, old)
            if best[new] is None or found < best[new]:
                best[new] = found
    least = min(b[0] for b in best if b)
    order = sorted((b[1], b[2], new) for new, b in enumerate(best) if b)
    place = {new: k for k, (_, _, new) in enumerate(order)}
    after = tuple(b and (b[0] - least, place[new]) for new, b in enumerate(best))
    back = tuple(b and (b[3], len(b[2]) - 1, b[2][-1]) for b in best)
    code = bytes(0 if b is None else b[3] | len(b[2]) - 1 << 2 | "DKR".index(b[2][-1]) << 4
                 for b in best)
    return after, least, back, code


FIRST = ((0, 0), None, None, None)
CLOSING = {START: 0, S: 2, U: 1, A: 0}  # inserts that bring a state to an end


class Backpointers:
    """Four bytes a row; a long conversation's go to the task's scratch file."""

    def __init__(self, held: int = HELD):
        self.held, self.recent, self.file, self.written = held, bytearray(), None, 0

    def add(self, code: bytes) -> None:
        self.recent += code
        if len(self.recent) >= self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.write(self.recent)
            self.written += len(self.recent)
            self.recent.clear()

    def backwards(self) -> Iterator[bytes]:
        """The rows' codes, last row first."""
        block, at = bytes(self.recent), self.written
        while True:
            for k in range(len(block) - 4, -1, -4):
                yield block[k:k + 4]
            if not at:
                break
            size = min(at, max(self.held // 4 * 4, 4))
            at -= size
            self.file.seek(at)
            block = self.file.read(size)
        if self.file:
            self.file.close()


class Conversation:
    """The running state of one conversation."""

    def __init__(self, key: str | None, held: int = HELD):
        self.key, self.back, self.vector, self.cost = key, Backpointers(held), FIRST, 0
        self.texts = [hashlib.sha256(), None, None, None]
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.before = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, late: bool) -> None:
        if turn is not None and turn != self.high:  # turns ascend
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        core = text.strip(SPACE)
        deleted = truncated = False
        if not core:
            self.blank += 1
            deleted = True
        elif late or self.before == (turn, role, text):
            self.duplicate += 1
            deleted = True
        elif core[-1] not in ENDS:
            self.truncated += 1
            truncated = True
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in ("su", "ua", "au")
        self.before = (turn, role, text)
        initial = role[:1] if role[:1] in FOLLOWS else ""
        self.vector, added, back, code = step(self.vector, initial, deleted, truncated)
        self.cost += added
        self.back.add(code)
        own = text.encode("utf-8", "surrogatepass")
        self.texts = [b and self._said(b, new, role, own) for new, b in enumerate(back)]

    def _said(self, taken: tuple, new: int, role: str, text: bytes):
        """The sha256 so far with what an edit lets stand."""
        old, inserts, letter = taken
        if not inserts and letter == "D":
            return self.texts[old]
        out = self.texts[old].copy()
        for _ in range(inserts):
            old = self._line(out, old, NEXT[old], b"")
        if letter == "K":
            self._line(out, old, new, text, role)
        elif letter == "R":
            self._line(out, old, new, text)
        return out

    @staticmethod
    def _line(out, old: int, new: int, text: bytes, role: str | None = None) -> int:
        named = (ROLE[new] if role is None else role).encode("utf-8", "surrogatepass")
        out.update((b"" if old == START else b"\n") + named + b":" + text)
        return new

    def report(self) -> tuple:
        _, _, state = min((e[0] + INSERT * CLOSING[s], e[1], s)
                          for s, e in enumerate(self.vector) if e)
        cost = self.cost + self.vector[state][0] + INSERT * CLOSING[state]
        letters = bytearray(b"I" * CLOSING[state])
        text, at = self.texts[state], state
        if CLOSING[state]:
            text = text.copy()
            while at != A:
                at = self._line(text, at, NEXT[at], b"")
        for code in self.back.backwards():
            taken = code[state]
            letters += b"DKR"[taken >> 4:(taken >> 4) + 1] + b"I" * (taken >> 2 & 3)
            state = taken & 3
        letters.reverse()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, min(gaps, LONGEST), self.blank, self.duplicate, self.truncated,
                self.illegal, cost, letters.decode(), text.hexdigest())


REPORT = ("key string, gaps long, blank long, duplicate long, truncated long, illegal long, "
          "cost long, audit string, repaired_sha256 string")
_COLUMNS = [c.split()[0] for c in REPORT.split(", ")]


def reports(frames: Iterator[pd.DataFrame], held: int = HELD) -> Iterator[pd.DataFrame]:
    """One report per conversation from frames sorted by conversation and turn."""
    current, seen = None, False
    for frame in frames:
        done = []
        for key, turn, role, text, late in zip(*(frame[c].tolist() for c in frame.columns)):
            if not seen or key != current.key:
                if seen:
                    done.append(current.report())
                current, seen = Conversation(key, held), True
            if role is not None:  # else only the mark of a conversation without rows
                current.add(None if turn is None else int(turn), role, text, late)
        yield pd.DataFrame(done, columns=_COLUMNS)
    if seen:
        yield pd.DataFrame([current.report()], columns=_COLUMNS)


def _rows(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(_conv, _key, _turn, _role, _text): nulls of role and text are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(
        F.col(conv_id).alias("_conv"), F.col(conv_id).cast("string").alias("_key"),
        F.col(turn).cast("long").alias("_turn"), space(role).alias("_role"),
        space(text).alias("_text"))


def _pair(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def _marked(rows: DataFrame) -> DataFrame:
    """Adds ``_late``: the role and text stand in an earlier turn of the conversation."""
    rows = rows.withColumn("_pair", _pair(F.col("_role"), F.col("_text")))
    first = stage(
        rows.groupBy("_conv", "_pair").agg(
            F.count(F.lit(1)).alias("_n"), F.max(F.col("_turn").isNull()).alias("_open"),
            F.min("_turn").alias("_least"))
        .filter((F.col("_n") > 1) & F.col("_pair").isNotNull())
        .select(F.col("_conv").alias("_of"), F.col("_pair").alias("_same"), "_open", "_least"),
        "repair-repeats")
    late = F.col("_turn").isNotNull() & (F.col("_open") | (F.col("_turn") > F.col("_least")))
    return rows.join(
        first, F.col("_conv").eqNullSafe(F.col("_of")) & (F.col("_pair") == F.col("_same")), "left"
    ).withColumn("_late", F.coalesce(late, F.lit(False)))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("_conv").sortWithinPartitions(
        "_key", F.col("_turn").asc_nulls_first(), "_role", "_text")


def _report(rows: DataFrame, name: str, kind: str) -> DataFrame:
    streamed = _in_order(_marked(rows)).select(
        "_key", F.col("_turn").cast("string").alias("_turn"), "_role", "_text", "_late")
    return streamed.mapInPandas(reports, REPORT).select(
        F.col("key").cast(kind).alias(name), *_COLUMNS[1:])


def repair_report(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: faults, cost, audit string and sha256 of the repaired text."""
    return _report(_rows(rows, conv_id, turn, role, text), conv_id, dict(rows.dtypes)[conv_id])


def _applied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired rows from frames sorted by conversation, the audit before the rows."""
    key, audit, at, state, place = None, "", 0, START, 0
    for frame in frames:
        out = []

        def put(turn, role, text, edit):
            nonlocal state, place
            named = ROLE[NEXT[state]] if role is None else role
            state = FOLLOWS[named[:1]][state]
            out.append((key, place, turn, named, text, edit))
            place += 1

        for conv, kind, turn, role, text in zip(*(frame[c].tolist() for c in frame.columns)):
            if kind == 0:
                key, audit, at, state, place = conv, text, 0, START, 0
                continue
            while audit[at] == "I":
                put(None, None, "", "I")
                at += 1
            if audit[at] != "D":
                put(turn, role if audit[at] == "K" else None, text, audit[at])
            at += 1
            while at < len(audit) and audit[at] == "I":
                put(None, None, "", "I")
                at += 1
        yield pd.DataFrame(out, columns=["key", "place", "turn", "role", "text", "edit"])


def repaired_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), turn, role, text, edit (K, R or I).

    A second pass over the rows in the same order; the audit string of a conversation stands
    before its rows and tells what becomes of each.
    """
    kind = dict(rows.dtypes)[conv_id]
    plain = _rows(rows, conv_id, turn, role, text)
    audits = stage(_report(plain, "_conv", kind), "repair-audits").select(
        "_conv", F.col("_conv").cast("string").alias("_key"), F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"),
        F.col("audit").alias("_text"))
    both = plain.withColumn("_kind", F.lit(1)).unionByName(audits)
    return (
        both.repartition("_conv")
        .sortWithinPartitions("_key", "_kind", F.col("_turn").asc_nulls_first(), "_role", "_text")
        .select("_key", "_kind", F.col("_turn").cast("string").alias("_turn"), "_role", "_text")
        .mapInPandas(_applied, "key string, place long, turn string, role string, text string, "
                               "edit string")
        .select(F.col("key").cast(kind).alias(conv_id), "place", F.col("turn").cast("long"),
                "role", "text", "edit"))


def _damaged(rows: DataFrame) -> DataFrame:
    """Rows of :func:`_rows` damaged by crc32 of ``conv_id:turn``.

    A dropped row keeps its conversation only: its role and text are null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("_key"), F.lit(":"), space("_turn"))) % 20
    copies = F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_hit", hit).select(
        "_conv", "_key", F.when(F.col("_hit") != 0, F.col("_turn")).alias("_turn"),
        F.when(F.col("_hit") == 4, "user").when(F.col("_hit") != 0, F.col("_role"))
        .alias("_role"),
        F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("_text", ENDS, ""))
        .when(F.col("_hit") != 0, F.col("_text")).alias("_text"),
        F.explode(copies).alias("_copy")).drop("_copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired: faults, cost, edits and the text's sha256."""
    rows = table(spark, sf_dir, "conversations")
    plain = _rows(rows, "conv_id", "turn", "role", "text")
    return _report(_damaged(plain), "conv_id", dict(rows.dtypes)["conv_id"])
