"""Operator 2: media columns, by a Spark data source over archives of media members.

`format("media_archive")` writes rows (member, media) as ZIP archives of stored members and reads them back. The reader
plans byte ranges of the archives; a task reads the archive directory, takes the members whose header lies in its range,
and streams them in Arrow batches of bounded bytes. Each member is read by its offset and checked against the
directory's CRC; a failed member is tried again by itself, from a freshly opened file, and after `attempts` tries gives
a row with `error` in place of `media` while the others go on. Archives are written whole under names of their own; a
manifest lists those of tasks that succeeded, and readers see no others.

The query's medium is an 8-bit greyscale PNG of 576 samples a row: the text's UTF-8, then bytes 255 up to a positive
multiple of 576. UTF-8 never has a byte 255, so the unpadded size is read back from the samples.

Nulls: null text is an empty payload (one row of 255); doc_id may be null or repeated. An empty table writes no archive
and gives no rows. A member larger than a batch makes a batch of its own.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import batch_of, task_dir
from .files import opened, write_file

ROW = 576
LEVEL = 6
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
MANIFEST = "manifest.json"
READ = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("media", pa.binary()), ("error", pa.string())])
READ_SQL = "archive string, offset long, member string, media binary, error string"
FEATURES = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_bytes", "payload_bytes")), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PNG = b"\x89PNG\r\n\x1a\n"


def png(payload: bytes, width: int = ROW) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def samples(media: bytes) -> bytes:
    """The samples of a PNG as png() writes it, with every chunk's checksum verified."""
    if not media.startswith(PNG):
        raise ValueError("not a PNG")
    at, width, data = len(PNG), 0, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the share of each quarter of their range."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(float)
    p = counts / counts.sum()
    level = np.arange(256)
    mean = float(p @ level)
    used = p[p > 0]
    return ":".join(f"{x:.4f}" for x in (mean, max(0.0, float(p @ level**2) - mean**2) ** 0.5, -float(used @ np.log2(used)), *p.reshape(4, 64).sum(axis=1)))


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    names: list


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return READ_SQL

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"])


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names: list[str] = []
        buffer = archive = None

        def close() -> None:
            archive.close()
            name = f"{uuid.uuid4().hex}.zip"
            write_file(self.folder, name, buffer.getbuffer())
            names.append(name)

        for b in iterator:
            for k, media in zip(b.column(b.schema.names.index("member")).to_pylist(), b.column(b.schema.names.index("media")), strict=True):
                if archive is None:
                    buffer = io.BytesIO()
                    archive, n = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED, allowZip64=True), 0
                # a fixed date, so that equal members make equal archives
                archive.writestr(zipfile.ZipInfo(f"{k}/{n}.png"), media.as_buffer())
                n += 1
                if buffer.tell() >= ARCHIVE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(names)

    def commit(self, messages: list) -> None:
        names = sorted(n for m in messages if m for n in m.names)
        write_file(self.folder, MANIFEST, json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        store, path = opened(self.folder)
        for m in messages:
            for n in m.names if m else ():
                store.delete_file(f"{path}/{n}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.range = int(options.get("rangeBytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[Range]:
        store, path = opened(self.folder)
        with store.open_input_stream(f"{path}/{MANIFEST}") as f:
            names = json.loads(f.read())
        size = {i.base_name: i.size for i in store.get_file_info(fs.FileSelector(path))}
        return [Range(n, at, at + self.range) for n in names for at in range(0, size[n], self.range)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no archives
            return
        store, path = opened(self.folder)
        uri = f"{path}/{partition.archive}"
        file = store.open_input_file(uri)
        with zipfile.ZipFile(file) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.stop]
        rows, held = [], 0
        file = store.open_input_file(uri)
        for m in sorted(members, key=lambda m: m.header_offset):
            media = error = None
            for attempt in range(self.attempts):
                try:
                    media, error = self.member(file, m), None
                    break
                except (OSError, ValueError, struct.error, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
                    time.sleep(0.1 * attempt)
                    file = store.open_input_file(uri)
            rows.append((partition.archive, m.header_offset, m.filename, media, error))
            held += len(media or b"")
            if held >= BATCH_BYTES:
                yield batch_of(READ, zip(*rows, strict=True))
                rows, held = [], 0
        if rows:
            yield batch_of(READ, zip(*rows, strict=True))

    @staticmethod
    def member(file, m: zipfile.ZipInfo) -> bytes:
        head = file.read_at(30, m.header_offset)
        mark, name, extra = struct.unpack("<4s22xHH", head)
        if mark != b"PK\x03\x04":
            raise ValueError("no member begins here")
        data = file.read_at(m.compress_size, m.header_offset + 30 + name + extra)
        if m.compress_type == zipfile.ZIP_DEFLATED:
            data = zlib.decompress(data, -15)
        elif m.compress_type != zipfile.ZIP_STORED:
            raise ValueError(f"compression {m.compress_type} is not read")
        if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
            raise ValueError("the member is damaged")
        return data


def archive(members: DataFrame, folder: str) -> None:
    """Write rows (member, media) as archives under folder."""
    members.sparkSession.dataSource.register(MediaArchive)
    members.select("member", "media").write.format("media_archive").mode("append").save(folder)


def read_archive(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


def encoded(docs: DataFrame) -> DataFrame:
    """member (the doc_id, or null in letters) and media of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("member", pa.string()), ("media", pa.binary())])
        for b in batches:
            names, media, held = [], [], 0
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                names.append("null" if doc_id is None else str(doc_id))
                media.append(png(raw + b"\xff" * (-len(raw) % ROW if raw else ROW)))
                held += len(media[-1])
                if held >= BATCH_BYTES:
                    yield batch_of(schema, (names, media))
                    names, media, held = [], [], 0
            if names:
                yield batch_of(schema, (names, media))

    return docs.select("doc_id", "text").mapInArrow(run, "member string, media binary")


def features(media: DataFrame) -> DataFrame:
    """What each member holds; a member that could not be read fails the job, so that no document is lost silently."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for member, x, error in zip(b.column("member").to_pylist(), b.column("media"), b.column("error").to_pylist(), strict=True):
                if error:
                    raise OSError(f"{member}: {error}")
                stored = x.as_py()
                payload = samples(stored)
                doc_id = member.partition("/")[0]
                rows.append((None if doc_id == "null" else int(doc_id), len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            if rows:
                yield batch_of(FEATURES, zip(*rows, strict=True))

    return media.select("member", "media", "error").mapInArrow(run, FEATURES_SQL)


def query(docs: DataFrame) -> DataFrame:
    folder = task_dir(docs.sparkSession, "media")
    archive(encoded(docs), folder)
    return features(read_archive(docs.sparkSession, folder))
