"""Repair of damaged conversation structure.

Every turn is a symbol of its role and first fault (blank, duplicate, truncated); the cheapest edits
that give role initials ``(s?(ua)+)?`` are found by ``grammar`` for each *distinct* sequence, so equal
conversations are solved once. Turns are then sorted beside their conversation's edits and replayed.

Texts do not travel for the search: turns are one symbol there, and duplicates are found by the first
turn of each (conversation, role, SHA-256 of the text), aggregated before the shuffle. A conversation's
symbols and edits, a character a turn, are one value, as its result is. The replay of one conversation runs
through one task in bounded memory: its digest depends on the order of all its turns.

Nulls in role and text count as one space. Turns with equal numbers (null first) are ordered by role,
then digest of the text; equal rows stand side by side. Rows with a null conversation form one conversation. Turns
of any length are whole. A conversation of which nothing is left is empty. An empty table gives
no rows. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.llm.common import text_bytes
from codelineage.llm.grammar import ASSISTANT, FILLED, START, SYSTEM, USER, solve

BATCH_SYMBOLS = 1 << 18
CORE = r"[^\x20\x09-\x0D]"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
SEQUENCE = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("symbols", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])
SOLVED = T.StructType([T.StructField("solved", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
TURN = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("edit", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])
DIGEST = T.StructType([T.StructField("digest_id", T.LongType()), T.StructField("repaired_sha256", T.StringType())])


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Turns damaged by the checksum of their key: dropped, emptied, without full stops, repeated or said by the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    left = rows.withColumn("_kind", kind).where("_kind <> 0")
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mark", F.sha2("text", 256))


def _faults(rows: DataFrame) -> DataFrame:
    """One narrow row a turn: its symbol, first fault and whether it follows its neighbour lawfully."""
    when = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    narrow = _marked(rows).select(
        "conv_id", "turn", "role", "mark",
        (~F.col("text").rlike(CORE)).alias("is_blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("is_cut"),
    )
    first = narrow.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m")).agg(F.min(when).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m"))
    seen = narrow.join(first, same).withColumn("later", when > F.col("first")).drop("c", "r", "m", "first")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "mark")
    before = lambda c: F.lag(c).over(order)
    again = before("turn").eqNullSafe(F.col("turn")) & (before("role") == F.col("role")) & (before("mark") == F.col("mark"))
    initial = F.substring("role", 1, 1)
    step = F.concat(F.substring(before("role"), 1, 1), initial)
    fault = (
        F.when(F.col("is_blank"), 1)
        .when(F.col("later") | F.coalesce(again, F.lit(False)), 2)
        .when(F.col("is_cut"), 3)
        .otherwise(0)
    )
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("fault").isin(1, 2), "d").when(F.col("fault") == 3, F.upper(symbol)).otherwise(symbol)
    return (
        seen.withColumns({"fault": fault, "illegal": F.coalesce(~step.isin("su", "ua", "au"), F.lit(False))})
        .select("conv_id", "turn", "role", "mark", "fault", "illegal", symbol.alias("symbol"))
        .sortWithinPartitions("conv_id", "turn", "role", "mark")
    )


class _Open:
    """Counts of the conversation being read."""

    def __init__(self, conv):
        self.conv, self.symbols, self.blank, self.duplicate, self.truncated, self.illegal = conv, [], 0, 0, 0, 0
        self.low = self.last = None
        self.distinct = 0

    def add(self, symbols: bytes, fault: np.ndarray, illegal: np.ndarray, turn: np.ndarray) -> None:
        self.symbols.append(symbols)
        counts = np.bincount(fault, minlength=4)
        self.blank, self.duplicate, self.truncated = self.blank + int(counts[1]), self.duplicate + int(counts[2]), self.truncated + int(counts[3])
        self.illegal += int(illegal.sum())
        if len(turn):
            self.distinct += int((np.diff(turn) != 0).sum()) + (self.last is None or int(turn[0]) != self.last)
            self.low = int(turn[0]) if self.low is None else self.low
            self.last = int(turn[-1])

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.distinct
        return self.conv, b"".join(self.symbols).decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols and counts of every conversation, from turns sorted by conversation."""
    done: list[tuple] = []
    open_: _Open | None = None

    def emit():
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f.name == "symbols" else pa.int64()) for c, f in zip(columns, SEQUENCE)], names=SEQUENCE.names)

    for batch in batches:
        if not batch.num_rows:
            continue
        raw, _ = text_bytes(batch.column("symbol"))
        fault = batch.column("fault").to_numpy()
        illegal = batch.column("illegal").to_numpy(zero_copy_only=False)
        conv, turn = batch.column("conv_id"), batch.column("turn")
        no_conv, no_turn = (c.is_null().to_numpy(zero_copy_only=False) for c in (conv, turn))
        ids, numbers = conv.fill_null(0).to_numpy(), turn.fill_null(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (no_conv[1:] != no_conv[:-1])])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            name = None if no_conv[a] else int(ids[a])
            if open_ is None or open_.conv != name:
                if open_ is not None:
                    done.append(open_.row())
                open_ = _Open(name)
            open_.add(raw[a:b].tobytes(), fault[a:b], illegal[a:b], numbers[a:b][~no_turn[a:b]])
        if done:
            yield emit()
    if open_ is not None:
        done.append(open_.row())
        yield emit()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and edits of distinct sequences, a grammar for about ``BATCH_SYMBOLS`` of them."""

    def answer(sequences):
        costs, audits = zip(*solve(sequences))
        return pa.RecordBatch.from_arrays([pa.array(sequences, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=SOLVED.names)

    held, size = [], 0
    for batch in batches:
        for sequence in batch.column("symbols").to_pylist():
            held.append(sequence)
            size += len(sequence)
            if size >= BATCH_SYMBOLS:
                yield answer(held)
                held, size = [], 0
    if held:
        yield answer(held)


def diagnose(rows: DataFrame) -> DataFrame:
    """(conv_id, symbols, counts of faults, cost, audit) of every conversation with turns."""
    found = _faults(rows).mapInArrow(_sequences, SEQUENCE)
    solved = found.select("symbols").distinct().mapInArrow(_solved, SOLVED)
    return found.join(solved, found.symbols == solved.solved).drop("solved")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, seq, edit, role, text) of the repaired turns, from each conversation's edits followed by its turns in order."""
    names = {USER: "user", ASSISTANT: "assistant"}
    conv = audit = None
    at = seq = 0
    state = START

    def insert():
        nonlocal at, seq, state
        while audit is not None and at < len(audit) and audit[at] == "I":
            state = FILLED[state]
            at, seq = at + 1, seq + 1
            yield conv, seq, "I", names[state], ""

    for batch in batches:
        for new, own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if own is not None:
                yield from insert()
                conv, audit, at, seq, state = new, own, 0, 0, START
                continue
            yield from insert()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            state = FILLED[state] if edit == "R" or role[:1] != "s" else SYSTEM
            seq += 1
            yield conv, seq, edit, names[state] if edit == "R" else role, text
    yield from insert()


def _aligned(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's edits (a row of its own) before its turns in order."""
    marked = _marked(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "mark", "text")
    none = lambda kind: F.lit(None).cast(kind)
    first = audits.select("conv_id", "audit", none("long").alias("turn"), none("string").alias("role"), none("string").alias("mark"), none("string").alias("text"))
    both = marked.unionByName(first).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "mark").select("conv_id", "audit", "role", "text")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The turns after repair: (conv_id, seq, edit, role, text)."""

    def run(batches):
        held, size = [], 0
        for row in _replay(batches):
            held.append(row)
            size += len(row[4]) + 64
            if size >= 1 << 20:
                yield _table(held)
                held, size = [], 0
        if held:
            yield _table(held)

    def _table(held):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=TURN.names)

    return _aligned(rows, audits).mapInArrow(run, TURN)


def _digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` of the repaired turns, joined by newlines; conversations without any are left out."""

    def run(batches):
        ids, digests, digest, last = [], [], None, None
        for conv, seq, _, role, text in _replay(batches):
            if seq == 1:
                if digest is not None:
                    ids.append(last)
                    digests.append(digest.hexdigest())
                digest, last = hashlib.sha256(), conv
            digest.update((("\n" if seq > 1 else "") + role + ":" + text).encode())
            if len(ids) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=DIGEST.names)
                ids, digests = [], []
        if digest is not None:
            ids.append(last)
            digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=DIGEST.names)

    return _aligned(rows, audits).mapInArrow(run, DIGEST)


def repair(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired ``damaged`` turns for every conversation of ``conversations``."""
    found = diagnose(damaged)
    digests = _digests(damaged, found.select("conv_id", "audit"))
    every = conversations.select(F.col("conv_id").alias("every_id")).distinct()
    id_of = lambda other: F.col("every_id").eqNullSafe(F.col(other))
    out = every.join(found, id_of("conv_id"), "left").join(digests, id_of("digest_id"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        F.col("every_id").alias("conv_id"), *[zero(c) for c in (*COUNTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
