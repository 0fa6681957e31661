"""Chunks of documents and their vectors."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_documents(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """document_id, idx, text: windows of `size` words that overlap; a short text is one chunk, as it is; empty gives none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    d = docs.select(F.col("id").alias("document_id"), "content", words.alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.ceil((F.size("words") - size) / F.lit(float(size - overlap))), F.lit(0)).cast("int")
    d = d.select("document_id", "content", "words", F.posexplode(F.sequence(F.lit(0), last)).alias("idx", "_"))
    text = F.when(F.size("words") <= size, F.col("content")).otherwise(F.array_join(F.slice("words", F.col("idx") * (size - overlap) + 1, F.lit(size)), " "))
    return d.select("document_id", F.col("idx").cast("long").alias("idx"), text.alias("text"))


def sentences(text: str, size: int, overlap: int) -> list[str]:
    """Greedy packs of sentences up to `size` words; up to `overlap` words of whole sentences are carried on."""
    out: list[str] = []
    pack: deque[tuple[str, int]] = deque()
    held = 0  # words in the pack
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        words = s.split()
        for piece in [" ".join(words[i : i + size]) for i in range(0, len(words), size)] if len(words) > size else [s] if s else []:
            n = min(len(words), size) if len(words) <= size else len(piece.split())
            if pack and held + n > size:
                out.append(" ".join(p for p, _ in pack))
                while pack and (held > overlap or held + n > size):
                    held -= pack.popleft()[1]
            pack.append((piece, n))
            held += n
    return [*out, " ".join(p for p, _ in pack)] if pack else out


def chunk_sentences(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s) for i, t in zip(b.column("id").to_pylist(), b.column("content").to_pylist(), strict=True) for k, s in enumerate(sentences(t or "", size, overlap))]
            if rows:
                ids, idx, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("id").type), pa.array(idx, pa.int64()), pa.array(text, pa.string())], names=["document_id", "idx", "text"])

    return docs.select("id", "content").mapInArrow(run, f"document_id {docs.schema['id'].dataType.simpleString()}, idx long, text string")


def chunk_table(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id `doc:idx` and their document's columns."""
    d = docs.select(F.col("id").alias("document_id"), "title", "source_type", "source_id", "created_at")
    return chunks.join(d, "document_id").select(F.concat_ws(":", F.col("document_id").cast("string"), F.col("idx").cast("string")).alias("chunk_id"), "document_id", "text", "title", "source_type", "source_id", "created_at", F.lit("indexed").alias("status"))


def hashing_embedder(texts: list[str], width: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed counts of hashed words."""
    import zlib

    out = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % width] += 1 if h >> 31 else -1
    return out


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashing_embedder, batch: int = 64) -> DataFrame:
    """chunks with vector. A call that fails or returns another number of vectors fails its task: nothing is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = np.asarray(embed([t or "" for t in part.column("text").to_pylist()]), np.float32)
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                yield part.append_column("vector", pa.array(vectors.tolist(), pa.list_(pa.float32())))

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
