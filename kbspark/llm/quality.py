"""Operator 3: quality rules, and a hashed n-gram log-likelihood ratio of trusted target to raw corpus.

Base rules count symbols, repeated lines and repeated three-word windows of each whole text. The method counts hashed
byte n-grams of the raw corpus (every document) and of the trusted target (every document that labels mark as good) into
BUCKETS counters each, with a partial sum in each task. A document's score is the mean over its n-grams of
log(p_target / p_raw); it is kept at THRESHOLD or above. Both multinomials are smoothed with SMOOTHING counts a bucket,
and the threshold is a fixed number, so each document's verdict depends on the counts alone.

Only the two counter tables, of BUCKETS longs, go through the driver to the scoring tasks. Trusted texts are chosen by a
semi-join with the labels, hashed on the label side, so texts are not sorted.

Nulls: null text is empty: no words, base_failed. Texts shorter than an n-gram score 0. Without any trusted document all
scores are 0 and the base rules alone decide. Null labels or doc_ids are not trusted. Repeated rows count as often as
they come; repeated labels trust a document if any does. An empty table gives no rows. Clashing names in labels are
harmless: only doc_id and quality are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

N = 3
BUCKETS = 1 << 16
BLOCKS = 64
SMOOTHING = 0.5
#: Kept at a mean log ratio of this or more, in nats an n-gram.
THRESHOLD = -0.5
_SYMBOL = b"#*$%&|<>"
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("llr", pa.float64())])
_SQL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
_STEP = 1 << 20


def hashed(raw: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram of bytes."""
    h = raw[: len(raw) - N + 1].astype(np.uint32)
    for k in range(1, N):
        h = h * np.uint32(0x01000193) ^ raw[k : len(raw) - N + 1 + k]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    chars = b"".join(words)
    wide = len(chars) - len(chars.translate(None, bytes(range(0x80, 0xC0))))  # continuation bytes
    symbols = len(chars) - len(chars.translate(None, _SYMBOL))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words]
        w = np.array(ids, np.int64)
        m = np.int64(len(number))
        if len(number) < 2_000_000:
            windows = (w[:-2] * m + w[1:-1]) * m + w[2:]
        else:  # three ids do not fit 64 bits: number pairs first
            pair = np.unique(w[:-1] * m + w[1:], return_inverse=True)[1]
            windows = pair[:-1] * (pair.max() + 1) + pair[1:]
        order = np.argsort(windows, kind="stable")
        s = windows[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeats = int(covered.sum())
    return n, len(chars) - wide, symbols, len(lines) - len(set(lines)), repeats


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(block, counts) over all texts of docs: BLOCKS rows, each with its part of the BUCKETS counters.

    A task gives its counters as BLOCKS rows however many texts it has read; blocks are then added up as they stream by.
    """
    width = BUCKETS // BLOCKS
    out = "block int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column("text"):
                if x.is_valid and len(raw := np.frombuffer(x.as_buffer(), np.uint8)) >= N:
                    for at in range(0, len(raw) - N + 1, _STEP):
                        total += np.bincount(hashed(raw[at : at + _STEP + N - 1]), minlength=BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "counts": [c.tobytes() for c in total.reshape(BLOCKS, width)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": [c.tobytes() for c in sums.values()]})

    return docs.select("text").mapInArrow(run, out).repartition("block").mapInArrow(add, out)


def log_ratio(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of each bucket; two tables of BUCKETS counters come to the driver."""

    def shares(t: DataFrame) -> tuple[np.ndarray, int]:
        counts = np.zeros((BLOCKS, BUCKETS // BLOCKS))
        for r in t.collect():
            counts[r.block] = np.frombuffer(r.counts, np.int64)
        return np.log((counts.ravel() + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS)), int(counts.sum())

    target, seen = shares(ngram_counts(trusted))
    return target - shares(ngram_counts(docs))[0] if seen else np.zeros(BUCKETS)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_good")).distinct()
    trusted = docs.select("doc_id", "text").join(good.hint("shuffle_hash"), F.col("doc_id") == F.col("_good"), "left_semi")
    ratio = log_ratio(docs, trusted).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = x.as_buffer().to_pybytes() if x.is_valid else b""
                raw = np.frombuffer(text, np.uint8)
                grams = max(0, len(raw) - N + 1)
                llr = sum(float(ratio[hashed(raw[at : at + _STEP + N - 1])].sum()) for at in range(0, grams, _STEP)) / grams if grams else 0.0
                found = base(text)
                failed = found[0] < 50 or 100 * found[4] > 50 * found[0]
                rows.append((doc_id, *found, failed, not failed and llr >= threshold, llr))
            if rows:
                yield batch_of(_OUT, zip(*rows, strict=True))

    return docs.select("doc_id", "text").mapInArrow(run, _SQL)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels)
