"""Markdown documents of a configuration, in order.

The files are listed by the ``siftmark_files`` data source, without their texts; the
listing is written and put in order, and only then are the contents read, by executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..operators.chunking import order_documents
from ..session import materialize
from .markdown_source import is_markdown, is_skipped_name, read_markdown, read_text

__all__ = ["is_markdown", "is_skipped_name", "list_files", "load_documents", "read_files"]

_FLUSH_CHARS = 8 << 20


def list_files(spark: SparkSession, cfg: Config, inline_entries: int = 10_000) -> DataFrame:
    """(root, path, file, _seq) of every markdown file, ignore globs applied."""
    schema = "root string, path string, file binary, _seq int"
    return read_markdown(spark, cfg.roots, cfg.ignore, schema, inline_entries=inline_entries)


def read_files(listing: DataFrame) -> DataFrame:
    """Add each file's text as ``source``, partition order kept; unreadable files drop out."""
    fields = [f for f in listing.schema.fields if f.name != "file"]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("source", T.StringType(), False)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.select(names)
            rows, texts, held = [], [], 0
            for row, file in enumerate(batch.column("file").to_pylist()):
                text = read_text(file)
                if text is not None:
                    rows.append(row)
                    texts.append(text)
                    held += len(text)
                if held >= _FLUSH_CHARS:
                    yield _with_texts(carried, rows, texts)
                    rows, texts, held = [], [], 0
            if rows:
                yield _with_texts(carried, rows, texts)

    return listing.mapInArrow(read, schema)


def _with_texts(carried: pa.RecordBatch, rows: list[int], texts: list[str]) -> pa.RecordBatch:
    kept = carried.take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [*kept.columns, pa.array(texts, pa.string())], names=[*carried.schema.names, "source"]
    )


def load_documents(spark: SparkSession, cfg: Config) -> DataFrame:
    """Readable markdown documents of all roots, in (root, path) order."""
    seen = Observation()
    listed = list_files(spark, cfg).observe(seen, F.count(F.lit(1)).alias("n"))
    listed = materialize(listed, "listing")
    return read_files(order_documents(listed, seen.get["n"]))
