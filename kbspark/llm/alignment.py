"""Operator 12: how two tokenizers cut the same texts, and which of their tokens answer each other, by external spill counting.

1. Both encode each text. Where tokens of both end, a group ends; tokens whose bytes overlap are linked. All of it is
   read off marks at byte offsets: between two neighbouring ends of either side lies just one linked pair.
2. The distinct (pair, document) records of a batch of texts are cut by radix (the A id modulo RADIX) and each part is
   written as a run of zstandard frames in side-major order: by A id, B id, document. A part's pairs and their document
   counts are one column, its documents another, so that counting reads no documents.
3. Runs of counts are merged FAN at a time until each part has one: a heap holds the last pair of each run's open frame,
   and all that lies up to the least of these is complete. As all pairs of an A id stand together, its highest count is
   known as soon as the next A id comes. What a merge holds is FAN frames, what it writes is bounded by the vocabularies.
4. The runs of documents meet their part's counts, SHARE runs to a copy, and each gives back sums for its documents.

A pair in every document is one entry of every run, so no id is hot; parts of frequent ids have longer runs, and as many.

Nulls: a null or empty text has no tokens, nor has one that either side does not give back byte by byte (one with U+2581).
doc_id may repeat (each row is a document) or be null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, short_batches, slices
from .tokenizing import n_pieces, pair_of_encoders

RADIX = 64
#: Runs that are merged at once, runs that share one copy of the counts, pairs of a frame.
FAN, SHARE, FRAME = 32, 512, 1 << 15
#: Bytes of text whose records are sorted at once; a longer text is a batch of its own.
BATCH = 4 << 20
_STEP = 1 << 18
_HEAD = struct.Struct("<IIBBB")

_SPILLED = "run binary, bucket int, counts binary, docs binary, doc_index int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_TYPES = (pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_SCHEMA = pa.schema(list(zip([x.split()[0] for x in _SPILLED.split(", ")], _TYPES, strict=True)))


def frame(*columns: np.ndarray) -> bytes:
    """One frame of up to three columns of whole numbers (0 or more), each as narrow as it can be, low bytes first."""
    widths = [max(1, (int(c.max()).bit_length() + 7) // 8) for c in columns]
    planes = b"".join(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, widths, strict=True))
    packed = zstandard.compress(planes, 3)
    return _HEAD.pack(len(columns[0]), len(packed), *widths, *[0] * (3 - len(widths))) + packed


def frames(run: bytes) -> Iterator[list[np.ndarray]]:
    """The columns of each frame of a run, unpacked one frame at a time."""
    at = 0
    while at < len(run):
        n, size, *widths = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        raw, place, out = np.frombuffer(zstandard.decompress(run[at : at + size]), np.uint8), 0, []
        at += size
        for w in filter(None, widths):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :w] = raw[place : place + n * w].reshape(w, n).T
            out.append(wide.view("<u8").ravel().astype(np.int64))
            place += n * w
        yield out


def write_run(pairs: np.ndarray, *columns: np.ndarray) -> bytes:
    """Frames of ascending pairs, as differences within each, beside other columns."""
    return b"".join(frame(np.diff(pairs[i : i + FRAME], prepend=0), *[c[i : i + FRAME] for c in columns]) for i in range(0, len(pairs), FRAME))


def read_run(run: bytes) -> Iterator[list[np.ndarray]]:
    for first, *others in frames(run):
        yield [np.cumsum(first), *others]


def merge(runs: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (pairs, counts), ascending and each pair once, of any number of runs: a k-way merge by a heap.

    The heap knows the last pair of each run's open frame. What lies up to the least of them cannot come any more.
    """
    open_, held = [], []
    for k, run in enumerate(runs):
        source = read_run(run)
        if (block := next(source, None)) is not None:
            open_.append((int(block[0][-1]), k, source))
            held.append((block[0], block[1]))
    heapq.heapify(open_)
    while open_:
        bound = open_[0][0]
        while open_ and open_[0][0] == bound:
            _, k, source = open_[0]
            block = next(source, None)
            if block is None:
                heapq.heappop(open_)
            else:
                held.append((block[0], block[1]))
                heapq.heapreplace(open_, (int(block[0][-1]), k, source))
        # frames that follow begin beyond the bound, so one pass over what is held is enough
        ready, rest = [], []
        for pairs, counts in held:
            cut = int(np.searchsorted(pairs, bound, "right"))
            if cut:
                ready.append((pairs[:cut], counts[:cut]))
            if cut < len(pairs):
                rest.append((pairs[cut:], counts[cut:]))
        held = rest
        pairs, counts = (np.concatenate([x[i] for x in ready]) for i in (0, 1))
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        yield pairs[first], np.add.reduceat(counts, first)


def with_best(blocks: Iterable[tuple[np.ndarray, np.ndarray]], n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole A ids: pairs, counts, and 1 for those with their A id's highest count."""

    def marked(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.diff(pairs // n_b, prepend=-1))
        top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(pairs))))
        return pairs, counts, (counts == top).astype(np.int64)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for block in blocks:
        held.append(block)
        pairs = block[0]
        cut = int(np.searchsorted(pairs, int(pairs[-1]) // n_b * n_b))
        if cut or len(held) > 1 and held[-2][0][-1] // n_b != pairs[0] // n_b:
            held[-1] = (pairs[:cut], block[1][:cut])
            yield marked(*[np.concatenate([h[i] for h in held]) for i in (0, 1)])
            held = [(pairs[cut:], block[1][cut:])]
    if held:
        yield marked(*[np.concatenate([h[i] for h in held]) for i in (0, 1)])


class Sides:
    """Both tokenizers, and what their ids look like."""

    def __init__(self, byte_path: str, piece_path: str):
        self.encoders = pair_of_encoders(byte_path, piece_path)
        self.flat, self.at = [], []
        for e in self.encoders:
            each = e.token_bytes()
            self.flat.append(np.frombuffer(b"".join(each), np.uint8))
            self.at.append(np.cumsum([0, *map(len, each)])[:-1])
        self.sizes = [np.array([len(x) for x in e.token_bytes()], np.int64) for e in self.encoders]
        self.n_b = self.encoders[1].n_ids
        n = max(e.n_ids for e in self.encoders)
        self.width = len(str(n - 1)) + 1
        self.digits = np.zeros((n, self.width), np.uint8)
        for i in range(n):
            own = str(i).encode()
            self.digits[i, : len(own)] = list(own)
        self.n_digits = np.count_nonzero(self.digits, axis=1)

    def joined(self, side: int, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(int(self.sizes[side][ids].sum()), np.uint8)
        place = 0
        for lo in range(0, len(ids), _STEP):
            part = ids[lo : lo + _STEP]
            size = self.sizes[side][part]
            ends = np.cumsum(size)
            total = int(ends[-1])
            out[place : place + total] = self.flat[side][np.repeat(self.at[side][part] - ends + size, size) + np.arange(total)]
            place += total
        return out

    def spelled(self, ids: np.ndarray, after: np.ndarray, document: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Decimal ids, each with the character after it, and the bytes of each document (the number of one for each id)."""
        out, ends = [], np.cumsum(np.bincount(document, self.n_digits[ids] + 1).astype(np.int64)) if len(ids) else np.zeros(0, np.int64)
        for lo in range(0, len(ids), _STEP):
            part, size = ids[lo : lo + _STEP], self.n_digits[ids[lo : lo + _STEP]]
            text = self.digits[part]
            text[np.arange(len(part)), size] = after[lo : lo + _STEP]
            out.append(text[np.arange(self.width) <= size[:, None]].tobytes())
        return b"".join(out), ends


@lru_cache(maxsize=2)
def sides_of(byte_path: str, piece_path: str) -> Sides:
    """One for each worker process."""
    return Sides(byte_path, piece_path)


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    which = np.cumsum(size) // BATCH
    for start, stop in zip(edges := np.flatnonzero(np.diff(which, prepend=-1)).tolist(), [*edges[1:], len(size)], strict=True):
        yield batch.slice(start, stop - start)


def aligned(sides: Sides, texts: pa.Array) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray, np.ndarray]:
    """Columns of each text, and for each link its pair (A id * n_b + B id) and the number of its text."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, "")).cast(pa.large_string())
    ends = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + n + 1]
    raw = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    length = np.diff(ends)
    found = [e.batch(spaced) for e in sides.encoders]
    good = length > 0
    ids, owner = [], []
    for side, (own, begin, end) in enumerate(found):
        if n and not (begin[1:] == end[:-1]).all():
            raise ValueError("ids of texts do not follow each other")
        ids.append(own.astype(np.int64))
        owner.append(np.repeat(np.arange(n), end - begin))
        size = np.bincount(owner[side], sides.sizes[side][ids[side]], n).astype(np.int64)
        good &= size == length
        back, at = sides.joined(side, ids[side]), np.concatenate([[0], np.cumsum(size)])
        for i in np.flatnonzero(good).tolist():
            good[i] = np.array_equal(back[at[i] : at[i + 1]], raw[ends[i] : ends[i + 1]])
    for side in (0, 1):
        use = good[owner[side]]
        ids[side], owner[side] = ids[side][use], owner[side][use]
    total = int(length[good].sum())
    marks, at = [], []
    for side in (0, 1):
        at.append(np.cumsum(sides.sizes[side][ids[side]]) - 1)
        mark = np.zeros(total, bool)
        mark[at[side]] = True
        marks.append(mark)
    cuts = np.flatnonzero(marks[0] | marks[1])
    in_a, in_b = marks[0][cuts], marks[1][cuts]
    of_a, of_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    pairs, document = ids[0][of_a] * sides.n_b + ids[1][of_b], owner[0][of_a]
    count = lambda which: np.bincount(which, minlength=n)[:n]

    last = [marks[1 - side][at[side]] for side in (0, 1)]  # tokens that end a group
    group = [np.cumsum(x) - x for x in last]
    before = [np.concatenate([[0], np.flatnonzero(x) + 1]) for x in last]  # tokens of a side before each group
    place = [np.arange(len(ids[0])) + before[1][group[0]], np.arange(len(ids[1])) + before[0][group[1] + 1]]
    order, after, whose = (np.zeros(len(ids[0]) + len(ids[1]), t) for t in (np.int64, np.uint8, np.int64))
    for side, end in ((0, b"|"), (1, b";")):
        order[place[side]], whose[place[side]] = ids[side], owner[side]
        after[place[side]] = np.where(last[side], end[0], b","[0])
    text, stops = sides.spelled(order, after, whose)
    stops = np.concatenate([[0], stops, np.full(max(0, n - len(stops)), stops[-1] if len(stops) else 0)]).tolist()
    digests = [hashlib.sha256(text[stops[i] : stops[i + 1] - 1]).hexdigest() if ok else "" for i, ok in enumerate(good.tolist())]
    columns = {"n_a": count(owner[0]), "n_b": count(owner[1]), "n_groups": count(document[in_a & in_b]), "n_links": count(document), "groups_sha256": digests}
    return columns, pairs, document


def runs(pairs: np.ndarray, document: np.ndarray, n_docs: int, n_b: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, run of pairs and document counts, run of documents and links) of a batch's links."""
    if not len(pairs):
        return
    keys, times = np.unique(pairs * n_docs + document, return_counts=True)
    pairs, document = keys // n_docs, keys % n_docs
    bucket = pairs // n_b % RADIX
    order = np.argsort(bucket.astype(np.uint8), kind="stable")
    pairs, document, times, bucket = pairs[order], document[order], times[order], bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for lo, hi in zip(starts, [*starts[1:], len(pairs)], strict=True):
        first = np.flatnonzero(np.diff(pairs[lo:hi], prepend=-1))
        counts = np.diff(np.append(first, hi - lo))
        docs = b"".join(frame(document[i : min(i + FRAME, hi)], times[i : min(i + FRAME, hi)]) for i in range(lo, hi, FRAME))
        yield int(bucket[lo]), write_run(pairs[lo:hi][first], counts), docs


def _spill(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(byte_path, piece_path)
        for b in (part for s in slices(batches, 2_048) for part in _batches(s)):
            columns, pairs, document = aligned(sides, b.column("text"))
            name = uuid.uuid4().bytes  # a task's rows count only if all of them are kept
            n = b.num_rows
            own = [pa.array([name] * n, pa.binary()), *[pa.nulls(n, t) for t in _TYPES[1:4]], pa.array(np.arange(n), pa.int32()), b.column("doc_id").cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(columns[c], t) for c, t in zip(_SCHEMA.names[6:], _TYPES[6:], strict=True)]], schema=_SCHEMA)
            for part, counts, docs in runs(pairs, document, n, sides.n_b):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, part, counts, docs), _TYPES, strict=False)] + [pa.nulls(1, t) for t in _TYPES[4:]], schema=_SCHEMA)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches by key, one row at a time."""
    rows = ({c: b.column(c)[i].as_py() for c in b.schema.names} for b in batches for i in range(b.num_rows))
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _merge(final: bool, n_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, share), rows in _grouped(batches, "bucket", "share"):
            blocks = merge([r["counts"] for r in rows])
            merged = b"".join(write_run(*x) for x in (with_best(blocks, n_b) if final else blocks))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((bucket, pa.int32()), (share, pa.int64()), (merged, pa.binary()))], names=["bucket", "share", "counts"])

    return run


def counted(spilled: DataFrame, most: int, n_b: int) -> DataFrame:
    """One row a part (bucket, share 0, counts): pairs, the number of documents of each, and whether it is its A id's highest."""
    level = spilled.select("bucket", "counts", F.xxhash64("run").alias("share"))
    while True:
        shares = -(-most // FAN)
        shared = level.select("bucket", F.pmod("share", F.lit(shares)).alias("share"), "counts").repartition("bucket", "share").sortWithinPartitions("bucket", "share")
        level, most = shared.mapInArrow(_merge(shares == 1, n_b), "bucket int, share long, counts binary"), shares
        if shares == 1:
            return level


def _give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part's counts (first) and runs: sums for the documents of each run."""
    for _, rows in _grouped(batches, "bucket", "share"):
        known: list[np.ndarray] = []
        for r in rows:
            if r["run"] is None:
                known = [np.concatenate(c) for c in zip(*read_run(r["counts"]), strict=True)]
                continue
            pairs, n_docs = (np.concatenate(c) for c in zip(*read_run(r["counts"]), strict=True))
            document, times = (np.concatenate(c) for c in zip(*frames(r["docs"]), strict=True))
            at = np.repeat(np.searchsorted(known[0], pairs), n_docs)
            sums = [np.zeros(int(document.max()) + 1, np.int64) for _ in range(2)]
            np.add.at(sums[0], document, known[2][at] * times)
            np.add.at(sums[1], document, known[1][at] * times)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (r["run"], frame(*sums))], names=["run", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (run,), rows in _grouped(batches, "run"):
        total = [np.zeros(0, np.int64)] * 2
        for r in rows:
            for k, own in enumerate(next(frames(r["sums"]))):
                wide = np.zeros(max(len(own), len(total[k])), np.int64)
                wide[: len(total[k])] = total[k]
                wide[: len(own)] += own
                total[k] = wide
        n = len(total[0])
        yield pa.RecordBatch.from_arrays([pa.array([run] * n, pa.binary()), pa.array(np.arange(n), pa.int32()), *map(pa.array, total)], names=["run", "doc_index", "n_best", "count_sum"])


def align(docs: DataFrame, byte_path: str, piece_path: str) -> tuple[DataFrame, DataFrame]:
    """A row for each document (as query() has it), and the parts' counts (for links())."""
    short_batches(docs.sparkSession)
    spilled = materialise(docs.select("doc_id", "text").mapInArrow(_spill(byte_path, piece_path), _SPILLED), "spilled")
    written = spilled.where("bucket is not null")
    most = written.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    n_b = n_pieces(piece_path)
    counts = counted(written, max(most, 1), n_b)
    shares = max(1, -(-most // SHARE))
    copies = counts.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), F.lit(None).cast("binary").alias("run"), "counts", F.lit(None).cast("binary").alias("docs"))
    parts = copies.unionByName(written.select("bucket", F.pmod(F.xxhash64("run"), F.lit(shares)).alias("share"), "run", "counts", "docs"))
    sums = parts.repartition("bucket", "share").sortWithinPartitions("bucket", "share", F.col("run").asc_nulls_first()).mapInArrow(_give_back, "run binary, sums binary")
    added = sums.repartition("run").sortWithinPartitions("run").mapInArrow(_add_up, "run binary, doc_index int, n_best long, count_sum long")
    rows = spilled.where("bucket is null").select("run", "doc_index", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(added, ["run", "doc_index"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), counts


def links(counts: DataFrame, n_b: int) -> DataFrame:
    """a_id, b_id, n_docs, best: how many documents have each pair linked, and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for whole in b.column("counts"):
                for pairs, n, best in read_run(whole.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs // n_b), pa.array(pairs % n_b), pa.array(n), pa.array(best.astype(bool))], names=["a_id", "b_id", "n_docs", "best"])

    return counts.select("counts").mapInArrow(run, "a_id long, b_id long, n_docs long, best boolean")


def query(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    return align(docs, byte_path, piece_path)[0]
