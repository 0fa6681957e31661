"""Operator 5: quality classifier: random-indexing word vectors, pooled, and a calibrated two-layer numpy network.

Random indexing: every word, and every word form (classes of its first and last characters), has a fixed sparse ternary
index vector drawn from its full hash. A word's vector is the sum of its neighbours' index vectors over the whole corpus;
tasks add them up in VOCABULARY hashed rows and Spark sums the rows, so the model's size is fixed and every text counts.
Words that share a row share its sum, weighted by their counts; the vectors that they give to neighbours stay their own.
A document is pooled to the means of its words' and forms' vectors, the mean of its words' own index vectors of DIRECT
numbers, which no rows are shared for, and the shares of words equal to the one or two before. A two-layer network, trained on the driver on at most SAMPLE labelled documents (those of smallest id hash, the
bound that the contract allows), gives a logit; a temperature fitted on a fifth of them that training did not see
calibrates it.

Only documents with crc32(doc_id as text) mod 3 other than 1 teach; labels, lang, source and doc_id are no inputs.

Nulls: null text is empty and pools to zeros (it has a score). Null doc_ids and labels do not teach and null doc_ids are
not held out. Repeated labels of a document count as the smaller one; of rows with one doc_id the text of the smallest MD5
teaches; repeated rows are scored each. Without two classes
of labels all scores are the share of ones (0.5 if none). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, give_back, short_batches, slices, texts
from .words import Words, each, mixed

WORDS, FORMS, WIDTH = 1 << 16, 1024, 32
VOCABULARY = WORDS + FORMS
NONZEROS = 2
#: Numbers of a word's own index vector, and how many of them are not zero.
DIRECT, DIRECT_NONZEROS = 256, 4
BLOCKS = 65
SAMPLE = 12_000
HIDDEN = 16
EPOCHS = 60
SEED = 7
INPUTS = 2 * WIDTH + 2 + DIRECT
_CLASS = np.array([ord("a") if chr(b).islower() or b >= 128 else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b for b in range(256)], np.uint64)
_BLOCKS = pa.schema([("block", pa.int32()), ("used", pa.binary()), ("sums", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def form_hashes(w: Words) -> np.ndarray:
    cls = _CLASS[w.raw]
    last = w.stops - 1
    form = cls[w.starts]
    for at in (np.minimum(w.starts + 1, last), last, np.maximum(last - 1, w.starts), np.maximum(last - 2, w.starts)):
        form = form * np.uint64(257) + cls[at]
    return mixed(form * np.uint64(0x9E3779B97F4A7C15))


def rows_of(words: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word and of its form in the vocabulary, from their hashes."""
    return (words % np.uint64(WORDS)).astype(np.int64), (WORDS + forms % np.uint64(FORMS)).astype(np.int64)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """NONZEROS cells of each hash's index vector; those of the second half count as negative."""
    h = mixed((hashes ^ np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15))
    first = h % np.uint64(WIDTH)
    second = (first + np.uint64(1) + (h >> np.uint64(16)) % np.uint64(WIDTH - 1)) % np.uint64(WIDTH)
    sign = [(h >> np.uint64(at)) % np.uint64(2) * np.uint64(WIDTH) for at in (40, 41)]
    return np.stack([first + sign[0], second + sign[1]]).astype(np.int64)


def direct_cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DIRECT_NONZEROS cells, and their signs, of each word's index vector of DIRECT numbers."""
    h = mixed((hashes ^ np.uint64(SEED + 1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    cells = np.stack([(h >> np.uint64(12 * k)) % np.uint64(DIRECT) for k in range(DIRECT_NONZEROS)]).astype(np.int64)
    signs = np.stack([(h >> np.uint64(60 + k)) % np.uint64(2) for k in range(DIRECT_NONZEROS)]).astype(np.float64)
    return cells, 1 - 2 * signs


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vocabulary's vectors from all texts of docs; VOCABULARY rows come to the driver.

    A task gives the rows that it has used as BLOCKS values, however many texts it has read; blocks are then added up.
    """
    size = VOCABULARY // BLOCKS
    out = "block int, used binary, sums binary"

    def as_blocks(total: np.ndarray, seen: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        for k, (signed, n) in enumerate(zip(total.reshape(BLOCKS, size, 2, WIDTH), seen.reshape(BLOCKS, size), strict=True)):
            used = np.flatnonzero(n)
            if len(used):
                own = signed[used]
                yield k, used.astype(np.int32).tobytes(), np.concatenate([own[:, 0] - own[:, 1], n[used, None]], axis=1).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(VOCABULARY * 2 * WIDTH, np.int64), np.zeros(VOCABULARY, np.int64)
        for b in slices(batches):
            last: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]

            def use(owners: list[int], w: Words) -> None:
                nonlocal last, seen
                # the last word before comes first again, as it may be a neighbour in the same text
                owner, *hashes = (np.concatenate(x) for x in zip(last, (np.array(owners)[w.part], w.hashes, form_hashes(w)), strict=True))
                last = [owner[-1:], *(h[-1:] for h in hashes)]
                a = np.flatnonzero(owner[1:] == owner[:-1])
                for rows, own in zip(rows_of(*hashes), hashes, strict=True):
                    cell = index_vectors(own)
                    for mine, other in ((a, a + 1), (a + 1, a)):
                        seen += np.bincount(rows[mine], minlength=VOCABULARY)
                        for k in range(NONZEROS):  # in place: counts of all cells beside the total would take as much again
                            np.add.at(total, rows[mine] * (2 * WIDTH) + cell[k, other], 1)

            each(list(texts(b)), use)
        for block in as_blocks(total, seen):
            yield batch_of(_BLOCKS, zip(block, strict=True))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, used, values in zip(*(b.column(c).to_pylist() for c in _BLOCKS.names), strict=True):
                own = sums.setdefault(k, np.zeros((size, WIDTH + 1), np.int64))
                own[np.frombuffer(used, np.int32)] += np.frombuffer(values, np.int64).reshape(-1, WIDTH + 1)
        rows = [(k, np.flatnonzero(x[:, WIDTH]).astype(np.int32).tobytes(), mean(x[x[:, WIDTH] > 0]).tobytes()) for k, x in sums.items()]
        if rows:
            yield batch_of(_BLOCKS, zip(*rows, strict=True))

    def mean(sums: np.ndarray) -> np.ndarray:
        return (sums[:, :WIDTH] / sums[:, WIDTH:]).astype(np.float32)

    vectors = np.zeros((BLOCKS, size, WIDTH), np.float32)
    for r in docs.select("text").mapInArrow(run, out).repartition("block").mapInArrow(add, out).collect():
        vectors[r.block, np.frombuffer(r.used, np.int32)] = np.frombuffer(r.sums, np.float32).reshape(-1, WIDTH)
    return vectors.reshape(VOCABULARY, WIDTH)


def pooled(batch: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """INPUTS numbers for each text."""
    sums, n = np.zeros((len(batch), INPUTS)), np.zeros(len(batch))
    last = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]

    def use(owners: list[int], w: Words) -> None:
        nonlocal last
        if not len(w.hashes):
            return
        owner = np.array(owners)[w.part]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        words, forms = rows_of(w.hashes, form_hashes(w))
        whose = owner[first]
        sums[whose, :WIDTH] += np.add.reduceat(vectors[words], first, axis=0)
        sums[whose, WIDTH : 2 * WIDTH] += np.add.reduceat(vectors[forms], first, axis=0)
        # the two words before come first again, for repeats over the cut of a long text
        owners_before, hashes = (np.concatenate(x) for x in zip(last, (owner, w.hashes), strict=True))
        held, last = len(last[0]), [owners_before[-2:], hashes[-2:]]
        for k in (1, 2):
            again = np.zeros(len(hashes))
            again[k:] = (hashes[k:] == hashes[:-k]) & (owners_before[k:] == owners_before[:-k])
            sums[whose, 2 * WIDTH + k - 1] += np.add.reduceat(again[held:], first)
        low = int(owner[0])
        for cell, sign in zip(*direct_cells(w.hashes), strict=True):
            own = np.bincount((owner - low) * DIRECT + cell, sign, (int(owner[-1]) - low + 1) * DIRECT)
            sums[low : int(owner[-1]) + 1, 2 * WIDTH + 2 :] += own.reshape(-1, DIRECT)
        n[whose] += np.diff(np.append(first, len(owner)))

    each(batch, use)
    return sums / np.maximum(n, 1)[:, None]


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(INPUTS), np.ones(INPUTS), np.zeros((INPUTS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))), 1.0)


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    if len(set(y[own])) < 2:
        held, own = order, order
    centre, scale = x[own].mean(axis=0, dtype=float), x[own].std(axis=0, dtype=float) + 1e-6
    z = ((x[own] - centre) / scale).astype(np.float32)
    p = [rng.normal(0, INPUTS**-0.5, (INPUTS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    t = y[own].astype(float)
    for _ in range(EPOCHS):
        mix = rng.permutation(len(t))
        for at in range(0, len(t), 128):
            i = mix[at : at + 128]
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - t[i]) / len(i)
            back = d[:, None] * p[2] * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    logits, goal = net.logits(x[held]), y[held].astype(float)
    choices = np.exp(np.linspace(0, np.log(16), 80))  # never sharper than trained
    loss = [np.logaddexp(0, np.where(goal == 1, -logits, logits) / c).mean() for c in choices] if len(held) else [0]
    net.temperature = float(choices[int(np.argmin(loss))]) if len(held) else 1.0
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    short_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    chosen = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = pooled(list(texts(b)), vectors)
            yield pa.RecordBatch.from_arrays([b.column("_quality").cast(pa.int32()), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], names=["y", "x"])

    # at most `sample` ids, so the broadcast is bounded; their numbers come to the driver, not their texts
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_quality")
    one = known.groupBy("doc_id").agg(F.min_by("text", F.md5("text")).alias("text"), F.any_value("_quality").alias("_quality"))
    rows = one.select("text", "_quality").mapInArrow(run, "y int, x binary").collect()
    rows.sort()
    x, y = np.zeros((len(rows), INPUTS), np.float32), np.array([r.y for r in rows], int)
    while rows:  # what has been copied goes at once
        x[len(rows) - 1] = np.frombuffer(rows.pop().x, np.float32)
    net = train(x, y)
    del x
    give_back()
    return vectors, net


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    vectors, net = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = net.scores(pooled(list(texts(b)), vectors))
            yield batch_of(_OUT, (b.column("doc_id"), b.column("held_out"), score, (score >= 0.5).astype(np.int32)))

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs, all columns, without those that the classifier rejects (score below 0.5)."""
    vectors, net = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(net.scores(pooled(list(texts(b)), vectors)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
