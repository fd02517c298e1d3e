"""Documents to heading-aware chunks with dense, order-stable ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.markdown import pieces
from ..schemas import PIECES
from .ordering import NumberedTable, number_in_place, range_partition

_PIECE_ARROW = {
    "heading_path": pa.list_(pa.string()),
    "text": pa.string(),
    "line_start": pa.int64(),
    "line_end": pa.int64(),
}
_FLUSH_CHARS = 8 << 20


def path_components(path: Column | str) -> Column:
    """Sort key that compares paths component by component, as file trees do."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    inner = F.filter(parts, lambda part, i: (part != "") & ((part != ".") | (i == 0)))
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("")), inner)).otherwise(inner)


def chunk_documents(docs: DataFrame, cfg: Config) -> DataFrame:
    """Split every ``source`` into pieces; row-local, no shuffle, partition order kept.

    All columns of ``docs`` other than ``source`` are repeated on each piece.
    """
    kept = [f for f in docs.schema.fields if f.name != "source"]
    order = [f.name for f in kept]
    schema = T.StructType([*kept, *[f for f in PIECES.fields if f.name in _PIECE_ARROW]])
    budget, overlap = cfg.chunk_tokens, cfg.chunk_overlap

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("source")
            carried = batch.select(order)
            origin: list[int] = []
            found: list[tuple] = []
            held = 0
            for row in range(batch.num_rows):
                for piece in pieces(sources[row].as_py(), budget, overlap):
                    origin.append(row)
                    found.append(piece)
                    held += len(piece.text)
                if held >= _FLUSH_CHARS:
                    yield _assemble(carried, origin, found)
                    origin, found, held = [], [], 0
            if found:
                yield _assemble(carried, origin, found)

    return docs.select(*order, "source").mapInArrow(split, schema)


def _assemble(carried: pa.RecordBatch, origin: list[int], found: list[tuple]) -> pa.RecordBatch:
    repeated = carried.take(pa.array(origin, pa.int64()))
    columns = [pa.array(c, t) for c, t in zip(zip(*found), _PIECE_ARROW.values())]
    return pa.RecordBatch.from_arrays(
        [*repeated.columns, *columns], names=[*carried.schema.names, *_PIECE_ARROW]
    )


def path_key(path: Column | str) -> Column:
    """A string that compares as the components of the path do."""
    return F.array_join(path_components(path), "\x01")


def document_order_key(docs: DataFrame) -> Column:
    """One string whose byte order is the (root, path, repeated root) order.

    U+0001 stands for ``/`` and U+0000 ends a field, so a shorter path sorts before
    its own extensions and separators sort before every other character.
    """
    fields = [path_key(name) for name in ("root", "path")]
    if "_seq" in docs.columns:
        fields.append(F.lpad(F.col("_seq").cast("string"), 10, "0"))
    return F.concat_ws("\x00", *fields)


def order_documents(docs: DataFrame, total: int | None = None) -> DataFrame:
    """Put documents into (root, path) order across and within partitions.

    Works on any relation with ``root`` and ``path``: for files it runs on the bare
    listing, before contents are read. ``total`` is the number of rows, if known.
    """
    ties = ["source"] if "source" in docs.columns else []
    return range_partition(docs, document_order_key(docs), ties, total)


def build_chunks(ordered_docs: DataFrame, cfg: Config) -> NumberedTable:
    """Chunk table with ids ``0..n`` in (root, path, piece) order, written once.

    The chunker runs after the exchange, so text crosses the network at most once
    and ids follow from per-partition row counts.
    """
    columns = [f.name for f in PIECES.fields]
    chunked = chunk_documents(ordered_docs, cfg).select(*columns)
    return number_in_place(chunked, "id", "chunks", path_key("path"))
