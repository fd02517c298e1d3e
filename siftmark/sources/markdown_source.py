"""Markdown files under root directories as a Spark data source.

``spark.read.format("siftmark_files")`` gives a row per file with the columns of the
schema asked for, out of ``root``, ``path`` (relative to it), ``_seq`` (the number of the
root), ``file`` (the place, as raw bytes), ``bytes`` and ``source`` (the text). Files are
opened only if ``source`` is asked for, and their sizes looked up only if needed.

Options: ``roots`` and ``ignore`` are JSON lists; ``partition_bytes`` of text make a
partition; after ``inline_entries`` entries the planner stops listing, and what folders
are still open then are walked by a task each. Ignore globs, and conditions on ``path``
and ``root``, are applied while walking: other files are neither listed nor read.

Hidden names, ``node_modules`` and ``target`` below a root are passed over, links are not
followed, and unreadable folders or files (invalid UTF-8 included) are logged and left
out. Roots must be mounted on the driver and on every executor.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from ..config import MARKDOWN_EXTENSIONS
from ..functions.globs import ignore_test

log = logging.getLogger("siftmark")

NAME = "siftmark_files"
SCHEMA = "root string, path string, _seq int, file binary, bytes long, source string"
_ARROW = {
    "root": pa.string(), "path": pa.string(), "_seq": pa.int32(),
    "file": pa.binary(), "bytes": pa.int64(), "source": pa.string(),
}
_SKIPPED_NAMES = ("node_modules", "target")
_FLUSH_CHARS, _FLUSH_ROWS = 8 << 20, 10_000
PARTITION_BYTES = 32 << 20
_OPEN_BYTES = 64 << 10  # what opening a file costs, in bytes read
_PUSHED = "spark.sql.python.filterPushdown.enabled"


def is_skipped_name(name: str) -> bool:
    return name.startswith(".") or name in _SKIPPED_NAMES


def is_markdown(name: str) -> bool:
    stem, dot, extension = name.rpartition(".")
    return bool(stem and dot) and extension in MARKDOWN_EXTENSIONS


@dataclass(frozen=True)
class Entry:
    """A file or a folder of a root; ``place`` holds raw bytes, so any name survives."""

    seq: int
    root: str
    path: str
    place: bytes
    is_dir: bool
    size: int = 0


@dataclass
class Files(D.InputPartition):
    """Listed files, or a folder to walk."""

    files: list[Entry] = field(default_factory=list)
    folder: Entry | None = None


@dataclass
class Wanted:
    """Conditions on ``path`` and ``root`` that files must meet, and ignore globs."""

    ignore: list[str]
    conditions: list[tuple[str, str, tuple]] = field(default_factory=list)

    _TESTS = {
        "in": lambda value, these: value in these,
        "starts": lambda value, these: value.startswith(these),
        "ends": lambda value, these: value.endswith(these),
        "contains": lambda value, these: these[0] in value,
    }

    def take(self, condition: D.Filter) -> bool:
        """Whether the condition is one that the walk applies."""
        kinds = {
            D.EqualTo: "in", D.EqualNullSafe: "in", D.In: "in", D.StringStartsWith: "starts",
            D.StringEndsWith: "ends", D.StringContains: "contains",
        }
        kind, column = kinds.get(type(condition)), getattr(condition, "attribute", ())
        if kind is None or tuple(column) not in (("path",), ("root",)):
            return False
        value = condition.value
        values = tuple(value) if isinstance(value, (list, tuple)) else (value,)
        if not all(isinstance(v, str) for v in values):
            return False
        self.conditions.append((kind, column[0], values))
        return True

    def file(self, entry: Entry) -> bool:
        return all(self._TESTS[k](getattr(entry, c), v) for k, c, v in self.conditions)

    def folder(self, entry: Entry) -> bool:
        """Whether files below the folder can meet the conditions."""
        below = f"{entry.path}/" if entry.path else ""
        for kind, column, values in self.conditions:
            if column == "root":
                if not self._TESTS[kind](entry.root, values):
                    return False
            elif kind == "in" and not any(v.startswith(below) for v in values):
                return False
            elif kind == "starts" and not any(
                v.startswith(below) or below.startswith(v) for v in values
            ):
                return False
        return True


def _list_folder(folder: Entry, sized: bool) -> Iterator[Entry]:
    """Sub-folders and markdown files of one folder."""
    try:
        with os.scandir(folder.place) as entries:
            for entry in entries:
                name = entry.name.decode("utf-8", "replace")
                is_dir = entry.is_dir(follow_symlinks=False)
                wanted = is_dir or (entry.is_file(follow_symlinks=False) and is_markdown(name))
                if wanted and not is_skipped_name(name):
                    path = f"{folder.path}/{name}" if folder.path else name
                    size = entry.stat(follow_symlinks=False).st_size if sized and not is_dir else 0
                    yield Entry(folder.seq, folder.root, path, entry.path, is_dir, size)
    except OSError as err:
        log.warning("could not list a folder of root %s: %s", folder.root, err)


def _root_entries(roots: Sequence[str]) -> Iterator[Entry]:
    for seq, root in enumerate(roots):
        place = os.fsencode(root)
        if os.path.isdir(root):
            yield Entry(seq, root, "", place, True)
        elif os.path.isfile(root) and is_markdown(os.path.basename(root)):
            yield Entry(seq, root, "", place, False, os.path.getsize(root))
        elif not os.path.exists(root):
            log.warning("root %s does not exist", root)


def read_text(place: bytes) -> str | None:
    try:
        with open(place, encoding="utf-8", newline="") as handle:
            return handle.read()
    except (OSError, UnicodeDecodeError) as err:
        log.warning("left out %s: %s", os.fsdecode(place), err)
        return None


class MarkdownReader(D.DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        unknown = set(columns) - set(_ARROW)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}; there are {list(_ARROW)}")
        self.columns = columns
        self.roots = json.loads(options.get("roots", "[]"))
        self.wanted = Wanted(json.loads(options.get("ignore", "[]")))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.inline_entries = int(options.get("inline_entries", 10_000))
        self.sized = bool({"source", "bytes"} & set(columns))

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        return [f for f in filters if not self.wanted.take(f)]

    def _grown(self, folder: Entry) -> Iterator[Entry]:
        """What a folder holds of use."""
        ignored = ignore_test(self.wanted.ignore)
        for entry in _list_folder(folder, self.sized):
            if entry.is_dir:
                wanted = self.wanted.folder(entry)
            else:
                wanted = not ignored(entry.path) and self.wanted.file(entry)
            if wanted:
                yield entry

    def partitions(self) -> Sequence[Files]:
        folders, files = [], []
        for entry in _root_entries(self.roots):
            if entry.is_dir:
                if self.wanted.folder(entry):
                    folders.append(entry)
            elif self.wanted.file(entry):
                files.append(entry)
        while folders and len(files) + len(folders) < self.inline_entries:
            folder = folders.pop()
            held = list(islice(self._grown(folder), self.inline_entries + 1))
            if len(held) > self.inline_entries:  # too big for the planner: leave it to a task
                folders.append(folder)
                break
            for entry in held:
                (folders if entry.is_dir else files).append(entry)
        parts, size = [Files()], 0
        for entry in sorted(files, key=lambda e: (e.seq, e.path)):
            cost = entry.size + _OPEN_BYTES if "source" in self.columns else 1_000
            if parts[-1].files and size + cost > self.partition_bytes:
                parts.append(Files())
                size = 0
            parts[-1].files.append(entry)
            size += cost
        return [p for p in parts if p.files] + [Files(folder=f) for f in folders] or [Files()]

    def _walk(self, folder: Entry) -> Iterator[Entry]:
        stack = [self._grown(folder)]
        while stack:
            entry = next(stack[-1], None)
            if entry is None:
                stack.pop()
            elif entry.is_dir:
                stack.append(self._grown(entry))
            else:
                yield entry

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        entries = self._walk(partition.folder) if partition.folder else iter(partition.files)
        rows, held = [], 0
        for entry in entries:
            row = {
                "root": entry.root, "path": entry.path, "_seq": entry.seq,
                "file": entry.place, "bytes": entry.size,
            }
            if "source" in self.columns:
                row["source"] = read_text(entry.place)
                if row["source"] is None:
                    continue
                held += len(row["source"])
            rows.append(row)
            if held > _FLUSH_CHARS or len(rows) >= _FLUSH_ROWS:
                yield self._batch(rows)
                rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r[c] for r in rows], _ARROW[c]) for c in self.columns]
        return pa.RecordBatch.from_arrays(columns, names=self.columns)


class MarkdownFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MarkdownReader:
        return MarkdownReader(self.options, schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions pushed into it."""
    spark.conf.set(_PUSHED, "true")
    spark.dataSource.register(MarkdownFiles)


def read_markdown(
    spark: SparkSession,
    roots: Sequence[str],
    ignore: Sequence[str] = (),
    schema: str = "root string, path string, source string",
    **options: object,
):
    """The files as a DataFrame of the columns in ``schema``."""
    register(spark)
    reader = spark.read.format(NAME).schema(schema)
    reader = reader.option("roots", json.dumps(list(roots))).option("ignore", json.dumps(list(ignore)))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
