"""Point lookups of chunks and whole documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_rows
from .chunking import path_key
from .ordering import NumberedTable

SEPARATOR = "\n\n"


def normal_path(path: str) -> str:
    """Repeated, trailing and ``.`` components do not make a different path."""
    path = re.sub(r"(?<=/)(?:\.?/)+", "", path)
    path = re.sub(r"(?<=[^/])/\.?$", "", path)
    return path


def document_chunks(chunks: DataFrame | NumberedTable, path: str) -> DataFrame:
    """Chunks of one document in order; same-named files of other roots merge.

    Of a numbered table with zones only the slabs that can hold the path are opened.
    """
    path = normal_path(path)
    if isinstance(chunks, NumberedTable):
        named = local_rows(chunks.staged.sparkSession, path=[path])
        chunks = chunks.around(named.select(path_key("path").alias("k")).first().k)
    return chunks.where(F.col("path") == path).orderBy("id")


def document_parts(chunks: DataFrame) -> DataFrame:
    """Every document as ordered parts: (path, id, part).

    Concatenating the parts of a path in id order gives its full text. Only the
    first chunk per path is aggregated, never a document's text, so one path
    holding most of the corpus costs no more than any other.
    """
    leaders = chunks.groupBy("path").agg(F.min("id").alias("id")).select("id", F.lit("").alias("sep"))
    joined = chunks.select("id", "path", "text").join(leaders, "id", "left")
    part = F.concat(F.coalesce("sep", F.lit(SEPARATOR)), "text")
    return joined.select("path", "id", part.alias("part"))


def document_text(chunks: DataFrame | NumberedTable, path: str) -> str | None:
    """Full text of one document, streamed partition by partition."""
    rows = document_chunks(chunks, path).select("text").toLocalIterator()
    texts = [row.text for row in rows]
    return SEPARATOR.join(texts) if texts else None
