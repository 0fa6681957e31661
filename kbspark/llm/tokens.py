"""Operator 9: token ids in shard files of independent zstandard frames with a trailing seek table.

A shard holds a range of doc_ids in ascending order, one ordinary zstandard frame for each document, with the format's own
content checksum. After them a skippable frame holds the seek table: doc_id, token count, packed size and xxh64 of the raw
ids of each. The last 24 bytes find the table and carry its checksum. Readers thus fetch and decompress only the documents
that they want; any zstandard tool can still decompress a whole shard. Ids are stored in 16 bits where the tokenizer's
vocabulary fits, else in 32; an id that does not fit is an error.

Shards are written by tasks under names of their own and count only once the driver has their row, so a lost executor's
half-written shard is never read. Nulls: null text is an empty document (just the end id); a null doc_id comes first.
Repeated doc_ids are stored as often as they come, ordered by a hash of the text, then text, so that many rows of one
doc_id are spread over shards. An empty table makes no shard and an empty result. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, task_dir, short_batches, slices
from .files import opened
from .tokenizing import encoder

LEVEL = 3
#: Skippable frames of the zstandard format begin with this; the second value marks this file format.
SKIPPABLE, MAGIC = 0x184D2A5E, 0x4B42544C
FOOTER = struct.Struct("<QQII")  # table bytes, xxh64 of the table, bytes of an id, magic
#: Neighbouring frames are fetched together up to so many bytes.
FETCH = 8 << 20
SHARD = "shard int, path string, n_docs long, n_tokens long"
OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class ShardWriter:
    """width: bytes of an id."""

    def __init__(self, out, width: int):
        self.out, self.kind, self.width = out, f"<u{width}", width
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.docs: list[tuple[int, int, int, int, int]] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"an id of {ids.max()} takes more than {self.width} bytes")
        raw = ids.astype(self.kind).tobytes()
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.docs.append((doc_id or 0, doc_id is None, len(ids), len(packed), xxhash.xxh64_intdigest(raw) - (1 << 63)))
        self.total += len(ids)

    def close(self) -> None:
        docs = np.array(self.docs, dtype="<i8").reshape(-1, 5)
        table = struct.pack("<Q", len(docs)) + zstandard.compress(docs.T.tobytes(), LEVEL)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + FOOTER.size) + table + FOOTER.pack(len(table), xxhash.xxh64_intdigest(table), self.width, MAGIC))


class ShardReader:
    """Opens a shard by its table; documents are read and decompressed as they are asked for."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, digest, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        table = self.file.read_at(n, size - FOOTER.size - n)
        if magic != MAGIC or xxhash.xxh64_intdigest(table) != digest:
            raise OSError(f"{uri}: the seek table is damaged")
        (n_docs,) = struct.unpack_from("<Q", table)
        self.ids, self.null, self.sizes, self.packed, self.digests = np.frombuffer(zstandard.decompress(table[8:]), "<i8").reshape(5, n_docs)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.at = np.cumsum(self.packed) - self.packed
        self.unpacker = zstandard.ZstdDecompressor()

    def read(self, places: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of the documents at ascending places; runs of neighbours are fetched together."""
        held, first = b"", 0
        for k, i in enumerate(places.tolist()):
            at, n = int(self.at[i]), int(self.packed[i])
            if at + n > first + len(held):
                stop = k
                while stop + 1 < len(places) and places[stop + 1] == places[stop] + 1 and self.at[places[stop + 1]] + self.packed[places[stop + 1]] - at <= FETCH:
                    stop += 1
                last = int(places[stop])
                held, first = self.file.read_at(int(self.at[last] + self.packed[last]) - at, at), at
            raw = self.unpacker.decompress(held[at - first : at - first + n], max_output_size=int(self.sizes[i]) * self.width)
            if xxhash.xxh64_intdigest(raw) - (1 << 63) != self.digests[i]:
                raise OSError(f"the frame of document {i} is damaged")
            yield np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def documents(self, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of the wanted documents that the shard holds."""
        hits = np.flatnonzero(np.isin(self.ids, wanted) & (self.null == 0))
        yield from zip(self.ids[hits].tolist(), self.read(hits), strict=True)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None) -> list:
    """Encode docs (doc_id, text) into shards under folder; returns a row for each shard, in order of doc_id."""
    folder = folder or task_dir(docs.sparkSession, "tokens")
    short_batches(docs.sparkSession)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, known, file = TaskContext.get().partitionId(), encoder(tokenizer), None
        for b in slices(batches):
            if file is None:
                uri = f"{folder}/{k:06d}-{uuid.uuid4().hex}.tok"
                store, path = opened(uri)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                file = store.open_output_stream(path)
                out = ShardWriter(file, 2 if known.n_ids <= 1 << 16 else 4)
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), known.documents(b.column("text")), strict=True):
                out.add(doc_id, ids)
        if file is not None:
            out.close()
            file.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "path": [uri], "n_docs": [len(out.docs)], "n_tokens": [out.total]})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return sorted(ordered.mapInArrow(shard, SHARD).collect())  # a row for each partition


def read_tokens(spark: SparkSession, shards: list) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""
    starts = np.concatenate([[0], np.cumsum([s.n_tokens for s in shards], dtype=np.int64)]).tolist()
    rows = [(s.path, at) for s, at in zip(shards, starts, strict=False)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                r = ShardReader(path)
                crcs = [zlib.crc32(ids) for ids in r.read(np.arange(len(r.ids)))]
                names = [None if gone else i for i, gone in zip(r.ids.tolist(), r.null.tolist(), strict=True)]
                yield batch_of(OUT, (names, r.start + base, r.sizes, crcs))

    return spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer))
