"""A Spark data source for archives: rows of entries, of which only those asked for are inflated.

``spark.read.format("archives").load(pattern)`` after ``register``; ``package.read_archives`` does both.
A task seeks to an archive's directory and then to the entries that it needs, so a scan of the
sections reads no byte of the pictures, and an archive may be larger than one row can hold. Small
archives share a task; a large one is cut by bytes, and each task takes the entries that begin in its
range, so the driver reads no directory.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.types import StructType

SCHEMA = "doc_id string, path string, size bigint, content binary, reason string"
#: The one entry of an archive whose directory can't be read.
BROKEN = "#error"
#: Bytes of a task (option maxBytes), what opening an archive counts as, and the largest entry that a row holds (option maxEntry).
MAX_BYTES, OPEN_COST, MAX_ENTRY = 128 << 20, 4 << 20, (1 << 31) - 1024
#: A batch is told once it has so many rows or bytes.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
UNREADABLE = (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, ValueError, struct.error, zlib.error)


@dataclass
class Slice(S.InputPartition):
    """Archives of one task: (path, from, to), the entries that begin in this range of bytes."""

    files: list[tuple[str, int, int]]


def _system(target: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what stands before that path in names."""
    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", target))
    before = target[: len(target) - len(path)] if target.endswith(path) and "://" in target else "file:" if isinstance(system, fs.LocalFileSystem) else ""
    return system, path, re.sub(r"^file:/*$", "file:", before)


def known(target: str) -> bool:
    """Whether the tasks can seek in files of this file system."""
    try:
        _system(_fixed(target)[0])
        return True
    except (pa.ArrowInvalid, OSError, ImportError):
        return False


def _fixed(target: str) -> tuple[str, list[str]]:
    """The folder before the first name with a wildcard, and the names from there on."""
    names = target.split("/")
    at = next((i for i, n in enumerate(names) if re.search(r"[*?\[]", n)), len(names))
    return "/".join(names[:at]), names[at:]


def listed(target: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path, a folder or a pattern names (a wildcard stands for no slash), in order."""
    fixed, names = _fixed(target)
    system, root, _ = _system(fixed or "/")
    info = system.get_file_info(root)
    if info.type == fs.FileType.File and not names:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound and not names:
        raise FileNotFoundError(target)
    names = names or ["*"]
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=len(names) > 1))
    below = lambda path: path[len(root.rstrip("/")) + 1 :].split("/")
    fits = lambda path: len(below(path)) == len(names) and all(map(fnmatch.fnmatchcase, below(path), names))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and fits(i.path))


def sliced(files: list[tuple[str, int]], most: int) -> list[Slice]:
    """Files cut into ranges of at most ``most`` bytes, small ones together."""
    out, held = [], most
    for path, size in files:
        parts = max(1, -(-size // most))
        for i in range(parts):
            cost = (size // parts) + OPEN_COST
            if held + cost > most:
                out.append(Slice([]))
                held = 0
            out[-1].files.append((path, size * i // parts, size * (i + 1) // parts))
            held += cost
    return out


class Reader(S.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.columns, self.target = schema.names, options["path"]
        self.names = options.get("names")
        self.most, self.largest = int(options.get("maxbytes", MAX_BYTES)), int(options.get("maxentry", MAX_ENTRY))
        self.asked: list[tuple[str, str, object]] = []

    def passes(self, column: str, value: str) -> bool:
        """Whether a value stands every filter that was pushed down on its column."""
        does: dict[str, Callable] = {
            "EqualTo": lambda x: value == x, "EqualNullSafe": lambda x: value == x, "In": lambda x: value in x, "IsNotNull": lambda x: True,
            "StringStartsWith": lambda x: value.startswith(x), "StringEndsWith": lambda x: value.endswith(x), "StringContains": lambda x: x in value,
        }
        return all(does[kind](x) for c, kind, x in self.asked if c == column)

    def _before(self) -> str:
        return _system(_fixed(self.target)[0] or "/")[2]

    def partitions(self) -> list[Slice]:
        before = self._before()
        return sliced([f for f in listed(self.target) if self.passes("doc_id", before + f[0])], self.most) or [Slice([])]

    def opened(self, path: str):
        return _system(_fixed(self.target)[0] or "/")[0].open_input_file(path)

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.string(), "path": pa.string(), "size": pa.int64(), "content": pa.binary(), "reason": pa.string()}
        rows: list[dict] = []
        held = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[c]) for c in self.columns], self.columns)

        for row in self.entries(part):
            rows.append(row)
            held += len(row.get("content") or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield told()
                rows, held = [], 0
        yield told()

    def entries(self, part: Slice) -> Iterator[dict]:
        before = self._before()
        for path, low, high in part.files:
            try:
                with self.opened(path) as file, zipfile.ZipFile(file) as archive:
                    for info in sorted(archive.infolist(), key=lambda i: i.header_offset):
                        if low <= info.header_offset < high and not info.is_dir() and self.passes("path", info.filename) and (not self.names or re.search(self.names, info.filename)):
                            yield {"doc_id": before + path, "path": info.filename, "size": info.file_size} | self.content(archive, info)
            except UNREADABLE as e:
                if low == 0 and self.passes("path", BROKEN):
                    yield {"doc_id": before + path, "path": BROKEN, "content": str(e).encode(), "reason": str(e)}

    def content(self, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> dict:
        if "content" not in self.columns:
            return {}
        if info.file_size > self.largest:
            return {"reason": f"larger than {self.largest} bytes"}
        try:
            return {"content": archive.read(info)}
        except UNREADABLE as e:
            return {"reason": str(e)}


class PushingReader(Reader):
    """Takes filters on path and doc_id; needs spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters):
        for f in filters:
            kind, column = type(f).__name__, getattr(f, "attribute", ())
            if column in (("path",), ("doc_id",)) and kind in ("EqualTo", "EqualNullSafe", "In", "IsNotNull", "StringStartsWith", "StringEndsWith", "StringContains"):
                self.asked.append((column[0], kind, getattr(f, "value", None)))
            else:
                yield f


class Archives(S.DataSource):
    """Options: ``names`` (a regular expression: other entries are left out), ``maxBytes`` of a task, ``maxEntry`` (larger entries have a
    null content and a reason), ``pushdown`` (take filters). A schema without ``content`` lists the directories and inflates nothing."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        if unknown := set(schema.names) - {c.split()[0] for c in SCHEMA.split(", ")}:
            raise ValueError(f"archives have no columns {sorted(unknown)}")
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(schema, dict(self.options))


def load(spark: SparkSession, target: str, columns: str = SCHEMA, **options) -> DataFrame:
    """Entries of the archives that target names. ``names`` leaves entries out at the source and is always safe.

    With ``pushdown=True`` (and spark.sql.python.filterPushdown.enabled) filters on path and doc_id
    reach the source too. Spark 4.1 keeps what was pushed for one query of a DataFrame for the next
    of the same one, so such a DataFrame is for one query; load another for another.
    """
    spark.dataSource.register(Archives)
    return spark.read.format("archives").schema(columns).options(**options).load(target)


def save(archives: DataFrame, root: str) -> DataFrame:
    """Write (doc_id, archive) to root/(the document's base name)-(a digest of its name).zip; (doc_id, file, reason), one row a document.

    root must be a folder that all executors share; a file has its name once it is whole, so a task
    that is run again does no harm. A null archive keeps its reason.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder, before = _system(root)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            out = []
            for doc_id, archive, reason in zip(batch["doc_id"], batch["archive"], batch["reason"], strict=True):
                if archive is None:
                    out.append((doc_id, None, reason))
                    continue
                stem = os.path.splitext(os.path.basename(doc_id))[0] or "document"
                name = f"{folder}/{stem}-{hashlib.sha256(doc_id.encode()).hexdigest()[:12]}.zip"
                part = f"{name}.{os.getpid()}.tmp"
                with system.open_output_stream(part) as f:
                    f.write(bytes(archive))
                system.move(part, name)
                out.append((doc_id, before + name, None))
            yield pd.DataFrame(out, columns=["doc_id", "file", "reason"])

    return archives.select("doc_id", "archive", "reason").mapInPandas(write, "doc_id string, file string, reason string")
