"""Operator 8: pack pieces of documents into sequences of fixed capacity by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of lengths (2048 rows at most) says all that a plan needs;
the driver plans on it and never sees a document. The plan: full pieces fill a sequence each. Lengths over capacity / 8
are large: in descending order they are cut into GROUPS groups of equal cardinality and rounded up to the longest of
each; configurations of these few sizes are optimised by column generation (the cutting-stock linear programme) and
rounded down. Actual lengths take the slots, group by group. What is left over, and all small lengths, go best fit, in
descending order, into what the actual lengths leave open. Where small lengths are too few for that room, the sequences
with more room than a limit are dissolved before and their lengths go best fit too; of the plans with the limits of ROOM
the one with the fewest sequences stays. Sequences that look alike are planned as one run, so the plan's size depends on the capacity and on GROUPS, not on
the corpus.

Documents then find their place by length and rank among equals. Ranks are counted in (length, salt) buckets, so that
one length with a third of all pieces is spread over SALTS buckets.

Nulls: null text is an empty document (just the end id); doc_id may be null or repeated, each row is packed. Of equal
pieces, doc_id, then text digest decides the order. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, materialise, short_batches, slices
from .tokenizing import encoder

CAPACITY = 2048
GROUPS = 64
#: Sequences of the groups with more room than this are dissolved; the best of these plans stays.
ROOM = (CAPACITY, 64, 32, 16, 8, 4, 2, 1, 0)
SALTS = 64
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: pieces of the capacity, the first one takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for b in slices(batches):
            rows = []
            for doc_id, own in zip(b.column("doc_id").to_pylist(), known.documents(b.column("text")), strict=True):
                rows += ((doc_id, k, at, n, zlib.crc32(own[at : at + n])) for k, (at, n) in enumerate(cut(len(own), capacity)))
            if rows:
                yield batch_of(PIECES, zip(*rows, strict=True))

    short_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES_SQL)


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity that is worth most. sizes ascend."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        v = best[c - sizes[: fits[c]]] + worth[: fits[c]]
        i = int(v.argmax())
        if v[i] > best[c - 1] + 1e-12:
            best[c], pick[c] = v[i], i
        else:
            best[c], pick[c] = best[c - 1], -1
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each size) and how often to use each, whole parts of the linear optimum: never above demand."""
    basis, x = np.diag(np.floor(capacity / sizes)), demand / np.floor(capacity / sizes)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = knapsack(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out], basis[:, out] = ratio[out], column
    left, used = demand.astype(np.int64).copy(), []
    for j in range(len(sizes)):
        column = basis[:, j].astype(np.int64)
        n = int(min(np.floor(x[j] + 1e-6), *(left[column > 0] // column[column > 0])))
        if n > 0:
            left -= n * column
            used.append((column, n))
    return used


#: Open room -> runs of like sequences that have it: (their pieces as (length, how many), how many sequences).
Runs = dict[int, list[tuple[tuple[tuple[int, int], ...], int]]]


def best_fit(left: dict[int, int], runs: Runs, capacity: int) -> Runs:
    """runs with all lengths of left put in, longest first, each where it leaves the least room."""
    runs = defaultdict(list, {gap: list(r) for gap, r in runs.items() if r})
    has = np.zeros(capacity + 1, dtype=bool)
    has[list(runs)] = True
    for length in sorted(left, reverse=True):
        count = left[length]
        while count > 0:
            fit = np.flatnonzero(has[length:])
            if not len(fit):
                runs[capacity].append(((), -(-count // (capacity // length))))
                has[capacity] = True
                continue
            gap = length + int(fit[0])
            held, n = runs[gap].pop()
            fits = gap // length
            times = min(n, count // fits)
            put, times = (fits, times) if times else (count, 1)
            if n > times:
                runs[gap].append((held, n - times))
            has[gap] = bool(runs[gap])
            runs[gap - put * length].append(((*held, (length, put)), times))
            has[gap - put * length] = True
            count -= put * times
    return runs


def n_sequences(runs: Runs) -> int:
    return sum(n for r in runs.values() for _, n in r)


def grouped(left: dict[int, int], capacity: int, groups: int) -> Runs:
    """Sequences of large lengths by linear grouping; their lengths are taken out of left."""
    large = sorted((n for n in left if capacity // 8 < n < capacity), reverse=True)
    total = sum(left[n] for n in large)
    # a group: runs [length, count] of its members, longest first
    members: list[list[list[int]]] = []
    each, room = -(-total // groups), 0
    for n in large:
        count = left[n]
        while count:
            if not room:
                members.append([])
                room = each
            take = min(count, room)
            members[-1].append([n, take])
            count, room = count - take, room - take
    merged: dict[int, list[list[int]]] = {}
    for g in members:
        merged.setdefault(g[0][0], []).extend(g)
    runs: Runs = defaultdict(list)
    if not merged:
        return runs
    sizes = np.array(sorted(merged))
    queues = [merged[int(s)] for s in sizes]
    demand = np.array([sum(n for _, n in q) for q in queues], dtype=float)
    for column, copies in configurations(sizes, demand, capacity):
        slots = [g for g in range(len(sizes)) for _ in range(int(column[g]))]
        taken = []  # for each slot, runs of actual lengths for its copies
        for g in slots:
            need, own = copies, []
            while need:
                run = queues[g][0]
                k = min(need, run[1])
                own.append((run[0], k))
                need, run[1] = need - k, run[1] - k
                if not run[1]:
                    queues[g].pop(0)
            taken.append(own)
        at, done = [0] * len(slots), [0] * len(slots)
        while copies:  # sequences that hold the same lengths
            n = min(own[at[i]][1] - done[i] for i, own in enumerate(taken))
            held = tuple((own[at[i]][0], 1) for i, own in enumerate(taken))
            for i, own in enumerate(taken):
                left[held[i][0]] -= n
                done[i] += n
                if done[i] == own[at[i]][1]:
                    at[i], done[i] = at[i] + 1, 0
            runs[capacity - sum(length for length, _ in held)].append((held, n))
            copies -= n
    return runs


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length in a sequence, offset of the first of them)."""
    short = {length: n for length, n in histogram.items() if length < capacity}
    fewest, runs = -(-sum(length * n for length, n in short.items()) // capacity), None
    planned = grouped(dict(short), capacity, groups)
    for most in ROOM:
        if runs is None or n_sequences(runs) > fewest:
            kept = {gap: r for gap, r in planned.items() if gap <= most}
            left = dict(short)
            for held, n in (x for r in kept.values() for x in r):
                for length, put in held:
                    left[length] -= put * n
            again = best_fit(left, kept, capacity)
            runs = again if runs is None else min(runs, again, key=n_sequences)
    if full := histogram.get(capacity, 0):
        runs[0].append((((capacity, 1),), full))
    rows: list[tuple[int, int, int, int, int]] = []
    ranks: dict[int, int] = defaultdict(int)
    first = 0
    for gap in sorted(runs):
        for held, n in runs[gap]:
            at = 0
            for length, put in held:
                rows.append((length, ranks[length], first, put, at))
                ranks[length] += put * n
                at += put * length
            first += n
    out = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def place(cuts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, salts: int = SALTS) -> DataFrame:
    """cuts (a table, read twice) with sequence_id and offset."""
    histogram = {r.length: r.n for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table = plan(histogram, capacity, groups)
    starts = (table[:, 0] << 44) + table[:, 1]
    salted = cuts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    buckets = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.join(buckets, ["length", "_salt"]).withColumn("_rank", F.col("_start") + F.row_number().over(order) - 1)
    names = cuts.columns

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
                row = table[np.searchsorted(starts, (length << 44) + rank, "right") - 1]
                within = rank - row[:, 1]
                b = b.select(names)
                b = b.append_column(pa.field("sequence_id", pa.int64()), pa.array(row[:, 2] + within // row[:, 3]))
                yield b.append_column(pa.field("offset", pa.int64()), pa.array(row[:, 4] + within % row[:, 3] * length))

    return ranked.select(*names, "_rank").mapInArrow(put, PIECES_SQL + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Each piece of docs (doc_id, text) with its sequence and its place there."""
    return place(materialise(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer)
