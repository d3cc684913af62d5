"""Cheapest repair of conversations into the form ``(s?(ua)+)?`` of role initials, by a rank-compressed dynamic program.

Edits: Keep a turn (0), Rerole it to user or assistant (1), Delete it (2, required where blank or a duplicate), Insert a
turn without text (5); a truncated turn that stays adds 5. Of the cheapest series of edits the one whose initials (the
audit) come first in ASCII order is taken.

One macro edit is a run of inserts and what is done to the turn after it: I..ID, I..IK, I..IR. No such code begins another one, so audits with
equally many turns compare as lists of codes do. A layer of the program (one turn) therefore holds no strings: of each of
the four states of the form the cost above the layer's least, and the rank of its audit among the four. A layer after a turn depends on the
layer before and the kind of the turn only; both have few values, so each step is looked up after the first time. Parents and
codes are kept, four bytes a turn, and the audit is read back from them.

Turns are sorted over ranges of (conversation, turn, role, text's MD5), and a partition's tasks see no texts. A conversation that
crosses partitions is a row of four by four costs and ranks in each; these rows alone meet, one for each partition,
and tell which states each part begins and ends in. So no task holds a conversation, however long, but its audit. Repaired
turns are made in one stream over the texts, sorted by conversation; nothing but the audit is held there.

Edge cases: a null id is a conversation of its own, null turns come first, null roles and texts are one space; equal rows
of one turn are kept apart, and their order is by role, then the text's MD5; a role that begins with none of s, u, a can't
be kept as it is; other columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import store

#: States of the form: nothing yet, after s, after u, after ua. What role each asks for next, and where that leads.
START, S, U, A = range(4)
NEXT = {START: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
KEPT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
LEGAL = ("su", "ua", "au")
#: Faults of turns.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
CODES = [n * "I" + c for n in range(3) for c in "DKR"]
#: Turns in a partition.
EACH = 1 << 15


def _inserts(state: int) -> list[tuple[int, int]]:
    """How many inserts lead where; more than a round of the form never pay."""
    out, seen = [(0, state)], {state}
    while (state := NEXT[state][1]) not in seen:
        seen.add(state)
        out.append((len(out), state))
    return out


@functools.lru_cache(maxsize=64)
def _moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(state before, state after, cost, number of the code)."""
    out = []
    for p in range(4):
        for n, at in _inserts(p):
            out.append((p, at, n * INSERT + DELETE, 3 * n))
            if fault not in (BLANK, DUPLICATE):
                more = n * INSERT + (CUT if fault == TRUNCATED else 0)
                if at in KEPT.get(initial, {}):
                    out.append((p, KEPT[initial][at], more, 3 * n + 1))
                out.append((p, NEXT[at][1], more + REROLE, 3 * n + 2))
    return out


#: Costs (None: not reached) and ranks of the four states.
Layer = tuple[tuple, tuple]


def entered(state: int) -> Layer:
    return tuple(0 if q == state else None for q in range(4)), (0, 0, 0, 0)


def _ranked(best: list) -> tuple:
    order = sorted({x[1:] for x in best if x})
    return tuple(order.index(x[1:]) if x else 0 for x in best)


@functools.lru_cache(maxsize=1 << 16)
def step(layer: Layer, initial: str, fault: int) -> tuple[Layer, int, bytes]:
    """The next layer, what its least cost adds, and of each state a byte: 16 times the parent, plus the code."""
    cost, rank = layer
    best: list = [None] * 4
    for p, q, c, code in _moves(initial, fault):
        if cost[p] is not None:
            x = (cost[p] + c, rank[p], CODES[code], p, code)
            if best[q] is None or x < best[q]:
                best[q] = x
    low = min(x[0] for x in best if x)
    return (tuple(x[0] - low if x else None for x in best), _ranked(best)), low, bytes(16 * x[3] + x[4] if x else 255 for x in best)


def finished(layer: Layer) -> tuple[int, int, int]:
    """Cost, last state and inserts of the best end."""
    _, _, q, n = min((c + n * INSERT, layer[1][q], q, n) for q, c in enumerate(layer[0]) if c is not None for n, at in _inserts(q) if at in (START, A))
    return layer[0][q] + n * INSERT, q, n


def codes_back(back: bytes, state: int) -> tuple[str, int]:
    """The edits that lead to the state, and the state they begin in."""
    out = []
    for k in range(len(back) - 4, -1, -4):
        x = back[k + state]
        out.append(CODES[x % 16])
        state = x // 16
    return "".join(reversed(out)), state


class Run:
    """The turns of one conversation in one partition, from each state they may begin in."""

    def __init__(self, conv, first: bool):
        self.conv, self.first = conv, first
        self.layers = {e: (entered(e), 0, bytearray()) for e in (range(4) if first else (START,))}
        self.faults, self.illegal, self.turns, self.distinct = [0] * 4, 0, [], 0
        self.head, self.tail = None, None

    def add(self, turn, initial: str, fault: int) -> None:
        for e, (layer, total, back) in self.layers.items():
            layer, more, came = step(layer, initial, fault)
            back += came
            self.layers[e] = layer, total + more, back
        self.faults[fault] += 1
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.tail = initial
        if turn is not None and (not self.turns or self.turns[1] != turn):
            self.distinct += 1
            self.turns = [self.turns[0] if self.turns else turn, turn]

    def row(self, part: int, last: bool) -> dict:
        low, high = self.turns or (None, None)
        row = {"conv": self.conv, "part": part, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "n_turns": self.distinct, "low": low, "high": high, "head": self.head, "tail": self.tail}
        if self.first or last:
            cost = [c for e in range(4) for c in ([None if c is None else c + self.layers[e][1] for c in self.layers[e][0][0]] if e in self.layers else [None] * 4)]
            rank = [r for e in range(4) for r in (self.layers[e][0][1] if e in self.layers else (0,) * 4)]
            return row | {"whole": False, "costs": cost, "ranks": rank, "back": [bytes(self.layers[e][2]) if e in self.layers else None for e in range(4)]}
        layer, total, back = self.layers[START]
        cost, q, n = finished(layer)
        return row | {"whole": True, "cost": total + cost, "audit": codes_back(back, q)[0] + n * "I"}


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns")
_RUNS = "conv long, part long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", low long, high long, head string, tail string, whole boolean, cost long, audit string, costs array<long>, ranks array<int>, back array<binary>"
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a sorted partition of (conv, turn, initial, fault, part)."""
    schema = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in _RUNS.split(", "))])
    run, done, part = None, [], 0
    for b in batches:
        for conv, turn, initial, fault, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if run is None or run.conv != conv:
                if run is not None:
                    done.append(run.row(part, False))
                run = Run(conv, first=run is None)
            run.add(turn, initial, fault)
        if len(done) > 1000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if run is not None:
        yield pa.RecordBatch.from_pylist([*done, run.row(part, True)], schema)


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """Which states each part of one conversation begins and ends in; one row for each partition it has turns in."""
    parts = parts.sort_values("part")
    layer, came = entered(START), []
    for costs, ranks in zip(parts["costs"], parts["ranks"], strict=True):
        best: list = [None] * 4
        for e, c in enumerate(layer[0]):
            for q in range(4):
                more = costs[4 * e + q]
                if c is not None and more is not None and more == more:
                    x = (c + int(more), layer[1][e], int(ranks[4 * e + q]), e)
                    if best[q] is None or x < best[q]:
                        best[q] = x
        came.append([x[3] if x else None for x in best])
        layer = tuple(x[0] if x else None for x in best), _ranked([x and x[:3] for x in best])
    cost, state, n = finished(layer)
    out = []
    for k in range(len(parts) - 1, -1, -1):
        one = parts.iloc[k]
        row = {"conv": one["conv"], "part": one["part"], "leaves": state, "n_end": n if k == len(parts) - 1 else 0, "cost": cost if k == 0 else 0, "illegal_more": 0, "turns_more": 0}
        if k:
            before = parts.iloc[k - 1]
            row["illegal_more"] = int(before["tail"] + one["head"] not in LEGAL)
            row["turns_more"] = -int(before["high"] == one["low"])
        state = came[k][state]
        out.append(row | {"enters": state})
    return pd.DataFrame(out).astype({"conv": "Int64"})


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = b.select(["conv", "part"])
        audits = [codes_back(back[e], q)[0] + n * "I" for back, e, q, n in zip(*(b.column(c).to_pylist() for c in ("back", "enters", "leaves", "n_end")), strict=True)]
        yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(audits, pa.string())], ["conv", "part", "audit"])


def _keyed(rows: DataFrame) -> DataFrame:
    fill = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), fill("role").alias("role"), fill("text").alias("text")).withColumn("key", F.unhex(F.md5("text")))


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, key (MD5 of the text), nth (of equal rows of a turn) and the first fault of each of the
    rows (conv_id, turn, role, text). Equal rows are counted before they are dealt out, and what is said again is joined with its
    first place, which the engine splits where one text holds much of a conversation."""
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    each = _keyed(rows).select("conv", "turn", "role", "key", fault.alias("fault")).groupBy("conv", "turn", "role", "key", "fault").agg(F.count("*").alias("n"))
    each = each.withColumn("at", F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn")))
    first = each.groupBy("conv", "role", "key").agg(F.min("at").alias("first_at"), F.count("*").alias("places")).where("places > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "first_at")
    found = each.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k")), "left")
    every = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    again = (F.col("nth") > 1) | F.coalesce(F.col("at") > F.col("first_at"), F.lit(False))
    return every.select("conv", "turn", "role", "key", "nth", F.when(F.col("fault") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


def plan(rows: DataFrame, each: int = EACH) -> DataFrame:
    """conv, audit, cost, gaps, blank, duplicate, truncated and illegal of every conversation in (conv_id, turn, role, text)."""
    found = store.kept(faults(rows), "faults")
    order = ["conv", "turn", "role", "key", "nth"]
    dealt = found.repartitionByRange(max(1, -(-found.count() // each)), *order).withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions(*order)
    runs = store.kept(dealt.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "part").mapInArrow(_scan, _RUNS), "runs")
    open_runs = runs.where("not whole").drop("cost", "audit", "whole")
    states = open_runs.drop("back").groupBy("conv").applyInPandas(_joined, "conv long, part long, enters int, leaves int, n_end int, cost long, illegal_more long, turns_more long")
    states = store.kept(states, "states")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    keyed = states.withColumnsRenamed({"conv": "c", "part": "p"})
    read = open_runs.select("conv", "part", "back").join(keyed, same).select("conv", "part", "back", "enters", "leaves", "n_end").mapInArrow(_read_back, "conv long, part long, audit string")
    rest = open_runs.select("conv", "part", *_COUNTS, "low", "high").unionByName(states.select("conv", "part", F.col("illegal_more").alias("illegal"), F.col("turns_more").alias("n_turns"), "cost"), allowMissingColumns=True)
    parts = runs.where("whole").select("conv", "part", *_COUNTS, "low", "high", "cost", "audit").unionByName(rest, allowMissingColumns=True).unionByName(read, allowMissingColumns=True)
    pieces = F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("part", "audit"))))
    sums = parts.groupBy("conv").agg(*(F.sum(c).alias(c) for c in (*_COUNTS, "cost")), F.min("low").alias("low"), F.max("high").alias("high"), pieces.alias("pieces"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    return sums.select("conv", F.array_join("pieces.audit", "").alias("audit"), "cost", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal")


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns from (conv, kind, turn, role, text): of each conversation first its audit, then its turns."""
    names = ["conv", "place", "turn", "edit", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out, size, conv, audit, at, place, state = [], 0, None, "", 0, 0, START

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def put(turn, edit: str, role: str | None, text: str) -> None:
        nonlocal place, state, size
        ask, after = NEXT[state]
        state = KEPT[role[:1]][state] if edit == "K" else after
        out.append((conv, place, turn, edit, role if edit == "K" else ask, text))
        place, size = place + 1, size + len(text)

    def inserts() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            put(None, "I", None, "")
            at += 1

    for b in batches:
        for c, kind, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind == 0:
                inserts()
                conv, audit, at, place, state = c, text, 0, 0, START
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit != "D":
                put(turn, edit, role, text)
            if size > 1 << 22 or len(out) > 5000:
                yield made()
                out, size = [], 0
    inserts()
    if out:
        yield made()


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv, place, turn, edit (K, R or I), role and text of the repaired conversations. The rows of one conversation come one
    after the other in one partition, in order."""
    texts = _keyed(rows).withColumn("kind", F.lit(1))
    first = plans.select("conv", F.col("audit").alias("text"), F.lit(0).alias("kind"))
    both = texts.unionByName(first, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "key")
    return both.select("conv", "kind", "turn", "role", "text").mapInArrow(_apply, "conv long, place long, turn long, edit string, role string, text string")


def _hash(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    done, conv, body = [], None, None
    for b in batches:
        for c, place, role, text in zip(*(b.column(k).to_pylist() for k in ("conv", "place", "role", "text")), strict=True):
            if place == 0:
                if body:
                    done.append((conv, body.hexdigest()))
                conv, body = c, hashlib.sha256()
            body.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if len(done) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string()), strict=True)], ["conv", "sha256"])
            done = []
    if body:
        done.append((conv, body.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string()), strict=True)], ["conv", "sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its lines ``role:text``, of rows as :func:`repaired` gives them. A hash is made in order: a
    conversation's texts pass through one task, as a stream."""
    return turns.mapInArrow(_hash, "conv long, sha256 string")


def repair(originals: DataFrame, rows: DataFrame, each: int = EACH) -> DataFrame:
    """conv_id of every conversation in ``originals``, with the faults, cost and audit of its ``rows`` and the SHA-256 of what they
    are repaired to."""
    plans = store.kept(plan(rows, each), "plans")
    sums = digests(repaired(rows, plans)).withColumnsRenamed({"conv": "d"})
    every = originals.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(plans, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(sums, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
