"""Documents that already live in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import ignore_regex


def documents_from_table(
    df: DataFrame, path: Column, source: Column, root: Column | None = None
) -> DataFrame:
    """Shape any table into (root, path, source)."""
    return df.select(
        (root if root is not None else F.lit("")).alias("root"),
        path.alias("path"),
        source.alias("source"),
    )


def drop_ignored(docs: DataFrame, globs: tuple[str, ...]) -> DataFrame:
    """Drop documents whose relative path matches a glob (a root itself never does)."""
    pattern = ignore_regex(globs)
    if pattern is None:
        return docs
    return docs.where((F.col("path") == "") | ~F.col("path").rlike(pattern))
