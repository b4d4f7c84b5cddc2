"""Conversation structure repair.

A conversation should read (s?(ua)+)?: an optional system turn, then user and assistant by
turns.  Every turn is kept (cost 0), given the other role (2) or deleted (3; a must for blank
and repeated turns), and empty turns may be put in anywhere (2); a truncated turn that stays
costs 1 more.  A backward pass gives the cost to go from every turn and state of the grammar;
a forward walk then takes, among the edits that keep to it, the one of the ASCII-least initial,
which makes the least of all cheapest edit strings.

One shuffle by conversation.  Behind it each row goes twice through a sort that spills: bare
facts first, which become a byte a turn, then the texts, which stream past the finished edits.
So a task holds about six bytes a turn and no texts, however long a conversation is.  The
digest of a conversation is one SHA-256, hence one task reads it from end to end.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what came last
NEXT = (USER, USER, ASSISTANT, USER)  # the turn that may be put in, or made of another
NAMES = ("", "system", "user", "assistant")
KEEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
KINDS = "sua?"  # a symbol is the place in here, plus:
MUST_GO, CUT = 4, 8
FAR = 1 << 30
STOP = ord(".")
BLANK, ENDED = r"^[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"


def settle(base: list[int]) -> tuple[int, ...]:
    """Costs to go once turns may be put in first; two in a row are never worth more."""
    user, assistant = min(base[USER], base[ASSISTANT] + INSERT), min(base[ASSISTANT], base[USER] + INSERT)
    return min(base[START], user + INSERT), min(base[SYSTEM], user + INSERT), user, assistant


END = settle([0, FAR, FAR, 0])
END_CHOICES = bytes(STOP if END[q] == 0 else ord("I") for q in range(4))


def kept_as(symbol: int, state: int) -> int | None:
    return KEEP.get(KINDS[symbol & 3], (None,) * 4)[state]


@lru_cache(maxsize=4096)
def back(after: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int, bytes]:
    """One turn backwards: (costs to go less their least, that least, the choice by state).
    The differences between states are bounded, so few cases ever come up."""
    extra = TRUNCATED if symbol & CUT else 0
    ways: list[dict[str, int]] = []
    for q in range(4):
        way = {"D": after[q] + DELETE}
        if not symbol & MUST_GO:
            way["R"] = after[NEXT[q]] + REROLE + extra
            k = kept_as(symbol, q)
            if k is not None:
                way["K"] = after[k] + extra
        ways.append(way)
    costs = settle([min(w.values()) for w in ways])
    for q in range(4):
        ways[q]["I"] = costs[NEXT[q]] + INSERT
    least = min(costs)
    choices = bytes(min(ord(e) for e, cost in ways[q].items() if cost == costs[q]) for q in range(4))
    return tuple(c - least for c in costs), least, choices


def cheapest(symbols: bytes) -> tuple[int, bytes]:
    """(cost, edits' initials) of a conversation given as symbols."""
    after, total, table = END, 0, bytearray(END_CHOICES)
    for symbol in reversed(symbols):
        after, least, choices = back(after, symbol)
        total += least
        table += choices
    edits, i, state, n = bytearray(), 0, START, len(symbols)
    while (edit := table[4 * (n - i) + state]) != STOP:
        edits.append(edit)
        if edit == ord("K"):
            state = kept_as(symbols[i], state)
        elif edit != ord("D"):
            state = NEXT[state]
        i += edit != ord("I")
    return total + after[START], bytes(edits)


class Conversation:
    """What a task holds of the conversation it reads."""

    def __init__(self, key):
        self.key, self.symbols, self.last = key, bytearray(), None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.edits: bytes | None = None

    def fact(self, turn, initial: str, blank: bool, cut: bool, first: bool, copies: int) -> None:
        """copies equal rows; the first of them is no repetition if first."""
        if not copies:
            return
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        for nth in range(copies):
            again = not first or nth > 0
            self.blank += blank
            self.duplicate += again and not blank
            self.truncated += cut and not again and not blank
            if self.last is not None:
                self.illegal += self.last + initial not in ("su", "ua", "au")
            self.last = initial
            kind = KINDS.index(initial) if initial in ("s", "u", "a") else 3
            self.symbols.append(kind | (MUST_GO if blank or again else CUT if cut else 0))

    def solve(self) -> None:
        self.cost, self.edits = cheapest(bytes(self.symbols))
        self.at, self.state = 0, START

    def turn(self, role: str, text: str, copies: int):
        """The repaired turns (edit, role, text) up to and with the next copies rows."""
        for _ in range(copies):
            yield from self.inserted()
            edit = self.edits[self.at : self.at + 1].decode()
            self.at += 1
            if edit == "K":
                self.state = kept_as(KINDS.index(role[:1]), self.state)
                yield edit, role, text
            elif edit == "R":
                self.state = NEXT[self.state]
                yield edit, NAMES[self.state], text

    def inserted(self):
        while self.edits[self.at : self.at + 1] == b"I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", NAMES[self.state], ""

    @property
    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


def conversations(batches):
    """(Conversation, its repaired turns as an iterator) of rows sorted by conversation, facts
    before texts.  The iterator has to be read before the next one is asked for."""
    rows = (row for b in batches for row in zip(*(b.column(n).to_pylist() for n in ("conv", "part", "turn", "initial", "blank", "cut", "first", "copies", "role", "text"))))
    row = next(rows, None)
    while row is not None:
        c = Conversation(row[0])
        while row is not None and row[0] == c.key and row[1] == 0:
            c.fact(*row[2:8])
            row = next(rows, None)
        c.solve()

        def texts(c=c):
            nonlocal row
            while row is not None and row[0] == c.key:
                yield from c.turn(row[8], row[9], row[7])
                row = next(rows, None)
            yield from c.inserted()

        yield c, texts()


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
FLUSH = 1024  # rows, or:
FLUSH_CHARS = 4_000_000


def summaries(schema: pa.Schema):
    def run(batches):
        out = []
        for c, turns in conversations(batches):
            digest, first = hashlib.sha256(), True
            for _, role, text in turns:
                digest.update((("" if first else "\n") + role + ":").encode())
                digest.update(text.encode())
                first = False
            out.append((c.key, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.cost, c.edits.decode(), digest.hexdigest()))
            if len(out) >= FLUSH or len(c.edits) >= FLUSH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return run


def repaired(schema: pa.Schema):
    def run(batches):
        out, size = [], 0
        for c, turns in conversations(batches):
            for i, (edit, role, text) in enumerate(turns):
                out.append((c.key, i, role, text, edit))
                size += len(text)
                if len(out) >= FLUSH or size >= FLUSH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return run


def in_order(convs: DataFrame, copies: str | None) -> DataFrame:
    """The rows as conversations() wants them: one shuffle, the sorts are within its partitions."""
    n = F.lit(1) if copies is None else F.col(copies)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = convs.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), F.when(n > 0, text).alias("text"), n.cast("bigint").alias("copies"))
    rows = rows.withColumn("name", F.sha2("text", 256)).repartition("conv")
    # The shuffle by conversation serves this window too.
    same = W.partitionBy("conv", "role", "name", F.col("copies") > 0).orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("nth", F.row_number().over(same))
    fact = F.struct(
        F.lit(0).alias("part"), F.substring("role", 1, 1).alias("initial"), F.col("text").rlike(BLANK).alias("blank"),
        (~F.col("text").rlike(ENDED)).alias("cut"), (F.col("nth") == 1).alias("first"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
    )
    no, none = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    whole = F.struct(F.lit(1).alias("part"), none.alias("initial"), no.alias("blank"), no.alias("cut"), no.alias("first"), F.col("role").alias("role"), F.col("text").alias("text"))
    both = rows.select("conv", "turn", "copies", "name", "nth", F.col("role").alias("by_role"), F.explode(F.when(F.col("copies") > 0, F.array(fact, whole)).otherwise(F.array(fact))).alias("r"))
    order = ["conv", "r.part", F.asc_nulls_first("turn"), "by_role", "name", "nth"]
    return both.sortWithinPartitions(*order).select("conv", "r.part", "turn", "r.initial", "r.blank", "r.cut", "r.first", "copies", "r.role", "r.text")


def key_type(convs: DataFrame) -> str:
    return convs.schema["conv_id"].dataType.simpleString()


def run(convs: DataFrame, copies: str | None, make, columns: str) -> DataFrame:
    schema = f"conv_id {key_type(convs)}, {columns}"
    arrow = convs.sparkSession.createDataFrame([], schema).toArrow().schema
    return in_order(convs, copies).mapInArrow(C.frugal(make(arrow)), schema)


def repair(convs: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0, without gaps), role, text, edit (K kept,
    R given another role, I put in); deleted turns aren't there.

    convs: conv_id, turn, role, text; copies names a column that says how often a row counts
    (0: it only names its conversation).  Rows go by turn (nulls first), then role, then the
    SHA-256 of the text.  Null roles and texts count as one space, so a null text is blank; a
    null conv_id is a conversation of its own; other columns are not used.  Repeated rows are
    duplicates; an empty table gives an empty one."""
    return run(convs, copies, repaired, "turn bigint, role string, text string, edit string")


def report(convs: DataFrame, copies: str | None = None) -> DataFrame:
    """One row a conv_id: gaps, faults by kind, cost and edits of the repair, and the SHA-256
    of its repaired turns (role:text, newline-joined).  Rows as in repair(); a conversation
    without rows that count has zeros, no edits and the digest of the empty string."""
    return run(convs, copies, summaries, SUMMARY)


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: by the CRC-32 of conv_id:turn modulo 20, rows that are
    dropped (0 copies), emptied, bared of [.!?], repeated (2 copies) or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return convs.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original conv_id of conversations, damaged and repaired; nulls, ties, repeated rows
    and conversations whose rows all go as in report()."""
    return report(damaged(C.table(spark, sf_dir, "conversations")), "copies")
