"""Operator 13: repair the turn structure of conversations at the least cost, by an auction over a shortest-path lattice.

A conversation of n rows is a lattice of n + 1 layers with a node for each state of the grammar (s?(ua)+)?: nothing yet,
after a system turn, after a user turn, after an assistant turn. Keep, Rerole and Delete lead to the next layer, Insert
stays in its layer; costs are whole numbers. Auction grows a path from the entry node: the last node's price rises to the
least (cost + price) of its arcs and the path contracts by it, or, if the price is there already, the path extends along
that arc. No price ever exceeds cost + price of an arc, so at the end the shortest paths are just those of tight arcs
(price = cost + price). Among tight arcs that lead to the end the ASCII-least letters are traced. Each state takes one
role, and each letter leads to one node, so the letters fix the repair.

The work of an auction grows with the square of its layers, so longer conversations are cut into PART rows: an auction for
each entry and exit of a part gives its distances, an auction over the lattice of parts (in several levels) gives prices
at their borders, and each part is then traced towards the borders' prices. Work and memory are linear in rows.

Rows flow as tables: numbered faulty rows are written once; the auction reads a few bytes of each; their edits meet the texts
again, which a task reads row by row. A conversation is one value in its digest, so its rows pass through one task in order.

Nulls: null roles and texts are one space, and so are null ids in the key of damage(); null turns come first. A null conv_id
is a conversation. Rows of one turn are ordered by role, then text; repeated rows are duplicates. Without rows (or when
all were dropped) the audit is empty. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, short_batches

#: States: nothing yet, after a system, user or assistant turn; the initial that a state takes besides, and where it leads.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
FINAL = {EMPTY: 0, ASSISTANT: 0}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows, or parts, of one auction.
PART = 24

Row = tuple[str, bool, bool]  # initial, has to go, truncated
Arcs = dict[int, list[tuple[str, int, int]]]  # node -> (letter, cost, node)
_END = -1


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows with faults that a key of the row decides; dropped rows are marked gone."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def _same(*names: str) -> list[Column]:
    """Keys that take null for a value."""
    return [c for n in names for c in (F.col(n).isNull(), F.coalesce(F.col(n).cast("string"), F.lit("")))]


def examine(rows: DataFrame) -> DataFrame:
    """Each row's place in its conversation (from 1; gone rows last) and its first fault: blank, duplicate, truncated or null."""
    order = Window.partitionBy("conv_id").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("digest", F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)))
    # the rows of a text are spread by its digest, whatever conversation they are of
    seen = Window.partitionBy("conv_id", "digest", "gone").orderBy("place")
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(F.col("gone"), None).when(last == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return placed.withColumn("fault", fault).drop("digest")


def lattice(rows: tuple[Row, ...], ends: dict[int, int], last: bool) -> Arcs:
    """Arcs of layers of rows (node = 4 * layer + state); ends: the cost from each state of the last layer to the end.
    Inserting in the last layer is for the part after it, if there is one."""
    arcs: Arcs = {}
    for i, (initial, bad, cut) in enumerate(rows):
        for q, to in NEXT.items():
            out = [("D", DELETE, 4 * (i + 1) + q), ("I", INSERT, 4 * i + to)]
            if not bad:
                if initial == "s" and q == EMPTY:
                    out.append(("K", TRUNCATED * cut, 4 * (i + 1) + SYSTEM))
                elif initial == NAMES[to][0]:
                    out.append(("K", TRUNCATED * cut, 4 * (i + 1) + to))
                out.append(("R", REROLE + TRUNCATED * cut, 4 * (i + 1) + to))
            arcs[4 * i + q] = out
    for q, to in NEXT.items():
        node = 4 * len(rows) + q
        arcs[node] = [("I", INSERT, 4 * len(rows) + to)] if last else []
        if q in ends:
            arcs[node].append(("", ends[q], _END))
    return arcs


def coarse(matrices: list[dict[tuple[int, int], int]], ends: dict[int, int]) -> Arcs:
    """The lattice of parts: an arc from each entry to each exit of a part."""
    arcs: Arcs = {4 * k + q: [] for k in range(len(matrices) + 1) for q in NEXT}
    for k, m in enumerate(matrices):
        for (q, to), cost in m.items():
            arcs[4 * k + q].append(("", cost, 4 * (k + 1) + to))
    for q, cost in ends.items():
        arcs[4 * len(matrices) + q].append(("", cost, _END))
    return arcs


def _reaching(arcs: Arcs, use) -> set[int]:
    """Nodes from which arcs that use() accepts lead to the end."""
    into: dict[int, list[int]] = {}
    for node, out in arcs.items():
        for _, cost, to in out:
            if use(node, cost, to):
                into.setdefault(to, []).append(node)
    found, todo = {_END}, [_END]
    while todo:
        for node in into.get(todo.pop(), ()):
            if node not in found:
                found.add(node)
                todo.append(node)
    return found


def start_prices(arcs: Arcs) -> dict[int, int]:
    """Prices that no arc undercuts: what the cheapest arcs out of each layer from a node's own on add up to, to the end."""
    least: dict[int, int] = {}
    exits = []
    for node, out in arcs.items():
        for _, cost, to in out:
            if to == _END:
                exits.append(cost)
            elif to // 4 > node // 4:
                least[node // 4] = min(cost, least.get(node // 4, cost))
    togo = {max(node // 4 for node in arcs): min(exits)}
    for layer in range(max(togo) - 1, -1, -1):
        togo[layer] = togo[layer + 1] + least[layer]
    return {node: togo[node // 4] for node in arcs} | {_END: 0}


class Auction:
    """Auctions towards one end; the prices of one are where the next begins."""

    def __init__(self, arcs: Arcs):
        open_ = _reaching(arcs, lambda *_: True)
        self.out = {n: [(cost, to) for _, cost, to in arcs[n] if to in open_] for n in open_ if n != _END}
        self.price = {n: p for n, p in start_prices(arcs).items() if n in open_} if len(open_) > 1 else {}

    def run(self, entry: int) -> dict[int, int] | None:
        """Prices (the end's is 0) under which the shortest paths from entry to the end are those of tight arcs; None: no path."""
        if entry not in self.out:
            return None
        price, path = self.price, [entry]
        while path[-1] != _END:
            node = path[-1]
            best, to = min((cost + price[to], to) for cost, to in self.out[node])
            if price[node] < best:  # contract: the node asks more
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:  # extend along a tight arc
                path.append(to)
        return price


def tight(arcs: Arcs, price: dict[int, int]) -> set[int]:
    """Nodes from which tight arcs lead to the end; their prices are distances."""
    return _reaching(arcs, lambda node, cost, to: node in price and to in price and price[node] == cost + price[to])


@lru_cache(maxsize=4096)
def _distances(rows: tuple[Row, ...], last: bool) -> dict[tuple[int, int], int]:
    """Distances from each state before rows to each state after them, for pairs with a path."""
    parts = _parts(rows)
    inner = [_distances(p, last and k == len(parts) - 1) for k, p in enumerate(parts)] if len(parts) > 1 else None
    found = {}
    for to in NEXT:
        auction = Auction(coarse(inner, {to: 0}) if inner else lattice(rows, {to: 0}, last))
        for q in NEXT:
            price = auction.run(q)
            if price is not None:
                found[q, to] = price[q]
    return found


def _parts(rows: tuple[Row, ...]) -> list[tuple[Row, ...]]:
    """At most PART parts, each of PART rows but for the last, or of PART times as many on each further level."""
    size = PART
    while size * PART < len(rows):
        size *= PART
    return [rows[i : i + size] for i in range(0, len(rows), size)] or [rows]


def audit(rows: tuple[Row, ...], entry: int = EMPTY, ends: dict[int, int] | None = None, last: bool = True) -> tuple[str, int, int]:
    """ASCII-least letters of the cheapest edits, the state after them, and their cost with that of the end."""
    ends = FINAL if ends is None else ends
    parts = _parts(rows)
    if len(parts) == 1:
        arcs = lattice(rows, ends, last)
        price = Auction(arcs).run(entry)
        good, node, letters = tight(arcs, price), entry, []
        while True:
            letter, to = min((letter, to) for letter, cost, to in arcs[node] if to in good and price[node] == cost + price[to])
            if to == _END:
                return "".join(letters), node % 4, price[entry]
            letters.append(letter)
            node = to
    arcs = coarse([_distances(p, last and k == len(parts) - 1) for k, p in enumerate(parts)], ends)
    price = Auction(arcs).run(entry)
    good, state, letters = tight(arcs, price), entry, []
    for k, p in enumerate(parts):
        final = k == len(parts) - 1
        borders = ends if final else {q: price[4 * (k + 1) + q] for q in NEXT if 4 * (k + 1) + q in good}
        some, state, _ = audit(p, state, borders, last and final)
        letters.append(some)
    return "".join(letters), state, price[entry]


def steps(letters: str, initials: Iterator[str]) -> Iterator[tuple[list[str], str | None]]:
    """For each row, and once more after the last: names of the turns inserted before it, and its own role ('' keeps, None deletes)."""
    state, before = EMPTY, []
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            before.append(NAMES[state])
            continue
        initial, role = next(initials), None
        if letter == "K":
            state, role = SYSTEM if initial == "s" else NEXT[state], ""
        elif letter == "R":
            state = NEXT[state]
            role = NAMES[state]
        yield before, role
        before = []
    yield before, None


_EDITS = pa.schema([("conv_id", pa.int64()), ("place", pa.int32()), ("before", pa.list_(pa.string())), ("role", pa.string()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of light rows sorted by conversation and place: the edit of each, and in a row of place 0 what all of them come to."""
    key: object = _edit
    held: list[Row] = []
    out: list[tuple] = []

    def close() -> None:
        if key is _edit:
            return
        letters, _, cost = audit(tuple(held))
        pairs = zip(held, held[1:], strict=False)
        out.append((key, 0, None, None, letters, cost, sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairs)))
        for place, (before, role) in enumerate(steps(letters, iter([r[0] for r in held])), 1):
            out.append((key, place, before, role, None, None, None))
        held.clear()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(_EDITS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _EDITS.types, strict=True)], schema=_EDITS)

    for b in batches:
        for conv, gone, initial, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "gone", "initial", "fault")), strict=True):
            if key is _edit or conv != key:
                close()
                key = conv
            if not gone:
                held.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        yield flush()
    close()
    yield flush()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by conversation and place: the digest of the repaired turns, one row after the other."""
    key: object = _hash
    digest, first = hashlib.sha256(), True
    done: tuple[list, list] = ([], [])

    def put(line: str) -> None:
        nonlocal first
        digest.update(line.encode() if first else b"\n" + line.encode())
        first = False

    for b in batches:
        for conv, before, new, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "before", "new", "role", "text")), strict=True):
            if key is _hash or conv != key:
                if key is not _hash:
                    done[0].append(key)
                    done[1].append(digest.hexdigest())
                key, digest, first = conv, hashlib.sha256(), True
            for name in before or ():
                put(f"{name}:")
            if new is not None:
                put(f"{new or role}:{text}")
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.string())], names=["conv_id", "repaired_sha256"])
        done = ([], [])
    if key is not _hash:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def edits(examined: DataFrame) -> DataFrame:
    """conv_id, place, before (roles of the turns to insert before that row; place n + 1 is after all), role (the row's new
    one, '' to keep it, null to delete it); place 0: audit, cost and illegal of the conversation."""
    light = examined.select("conv_id", "place", "gone", F.substring("role", 1, 1).alias("initial"), "fault")
    # a row is a few bytes but not a little work, so the number of partitions is held
    tasks = int(examined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = light.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(_edit, "conv_id long, place int, before array<string>, role string, audit string, cost long, illegal long")


def repaired(examined: DataFrame, edited: DataFrame) -> DataFrame:
    """conv_id, place, before, new, role, text of each row that is not gone, and of the place after the last."""
    own = examined.where(~F.col("gone")).select(*_keys("conv_id"), "place", "role", "text")
    plan = edited.where("place > 0").select("conv_id", *_keys("conv_id"), "place", "before", F.col("role").alias("new"))
    return plan.join(own, ["_none", "_key", "place"], "left").select("conv_id", "place", "before", "new", "role", "text")


def _keys(name: str) -> list[Column]:
    """Of an id that may be null: two columns that are not, for joins."""
    return [c.alias(n) for c, n in zip(_same(name), ("_none", "_key"), strict=True)]


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns of conversations (conv_id, turn, role, text): conv_id, place (from 1, gapless), role, text."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("gone"))
    short_batches(conversations.sparkSession)
    examined = materialise(examine(rows), "examined")
    lines = repaired(examined, edits(examined)).select("conv_id", "place", F.explode(F.concat(
        F.transform(F.col("before"), lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))),
        F.when(F.col("new").isNull(), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(F.when(F.col("new") == "", F.col("role")).otherwise(F.col("new")).alias("role"), "text"))))).alias("line"))
    spread = lines.withColumn("order", F.monotonically_increasing_id())
    return spread.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("place", "order")).alias("place"), "line.role", "line.text")


def query(conversations: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of each damaged conversation."""
    short_batches(conversations.sparkSession)
    examined = materialise(examine(damage(conversations)), "examined")
    edited = materialise(edits(examined), "edits")
    here = F.when(~F.col("gone"), F.col("turn"))
    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    facts = examined.groupBy("conv_id").agg(
        F.coalesce(F.max(here) - F.min(here) + 1 - F.count_distinct(here), F.lit(0)).cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    ordered = repaired(examined, edited).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    digests = ordered.mapInArrow(_hash, "conv_id long, repaired_sha256 string")
    verdict = edited.where("place = 0").select(*_keys("conv_id"), "audit", "cost", "illegal")
    keyed = facts.select("conv_id", *_keys("conv_id"), "gaps", "blank", "duplicate", "truncated")
    whole = keyed.join(verdict, ["_none", "_key"]).join(digests.select(*_keys("conv_id"), "repaired_sha256"), ["_none", "_key"])
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
