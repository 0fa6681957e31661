"""Files in the shared folder, for code inside tasks: any store that Arrow, or fsspec if it is there, can open by URI.

Spark's own names of a store are turned into those that Arrow knows (s3a is s3). Folders that only Hadoop can resolve, as
mount tables, are resolved on the driver before tasks get them (common.task_dir).
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs

#: Hadoop's names of stores that Arrow calls otherwise.
ALIASES = {"s3a": "s3", "s3n": "s3"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.FileSystem.from_uri(f"file://{uri}")
    uri = f"{ALIASES.get(scheme, scheme)}:{rest}"
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as unknown:
        try:
            from fsspec.core import url_to_fs

            store, path = url_to_fs(uri)
        except (ImportError, ValueError):
            raise ValueError(f"tasks cannot open {uri}: {unknown}. Set spark.checkpoint.dir to a folder on file, hdfs, s3a, gs or abfss") from unknown
        return fs.PyFileSystem(fs.FSSpecHandler(store)), path


def write_file(folder: str, name: str, *parts: bytes) -> str:
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        for p in parts:
            out.write(p)
    return f"{folder}/{name}"
