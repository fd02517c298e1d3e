"""Printing hits, chunks and statistics."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Row


def to_json(value: Any) -> str:
    """Pretty JSON of a row, a list of rows or a plain object."""
    if isinstance(value, Row):
        value = value.asDict(recursive=True)
    elif isinstance(value, (list, tuple)):
        value = [v.asDict(recursive=True) if isinstance(v, Row) else v for v in value]
    return json.dumps(value, indent=2, ensure_ascii=False)


def to_text(hits: Iterable[Row]) -> str:
    """Numbered list: score, place and heading trail, then the first snippet line."""
    lines = []
    for number, hit in enumerate(hits, 1):
        trail = " > ".join(hit.heading_path)
        place = f"{hit.path}:{hit.line_start}-{hit.line_end}"
        first = hit.snippet.split("\n", 1)[0].removesuffix("\r")
        lines.append(f"{number:>2}. [{hit.score:.4f}] {place}  {trail}\n    {first}")
    return "\n".join(lines)
