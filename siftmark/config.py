"""Run configuration and the engine's public constants."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

# Results depend on every one of them.
DEFAULT_MODEL_REPO = "BAAI/bge-small-en-v1.5"
DEFAULT_EMBED_DIM = 384
K1 = 1.2
B = 0.75
HEADING_BOOST = 2.0
RRF_K = 60.0
PHRASE_BONUS = 0.02
SNIPPET_CHARS = 400
MAX_TOKENS = 512
BATCH_SIZE = 32
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
MARKDOWN_EXTENSIONS = ("md", "mdx", "markdown")

ENV_PREFIX = "SIFTMARK_"


@dataclass(frozen=True)
class Config:
    """What to ingest and how to rank it.

    ``chunk_tokens`` / ``chunk_overlap`` count whitespace tokens;
    ``per_page`` is the number of hits kept per path (0 = no collapsing).
    ``stem=False`` indexes tokens verbatim. ``default_top_k`` is what ``SearchEngine.search`` uses when no ``k`` is given.
    """

    roots: tuple[str, ...] = ()
    model_repo: str = DEFAULT_MODEL_REPO
    model_dir: str | None = None
    chunk_tokens: int = 256
    chunk_overlap: int = 32
    default_top_k: int = 8
    lexical_only: bool = False
    cache_dir: str | None = None
    ignore: tuple[str, ...] = ()
    per_page: int = 1
    stem: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "roots", tuple(str(r) for r in self.roots))
        object.__setattr__(self, "ignore", tuple(self.ignore))
        for name in ("chunk_tokens", "chunk_overlap", "default_top_k", "per_page"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")


def env_list(name: str, env: Mapping[str, str] | None = None) -> list[str]:
    """Colon-separated list from ``SIFTMARK_<name>``; empty when unset."""
    raw = (env if env is not None else os.environ).get(ENV_PREFIX + name, "")
    return raw.split(":") if raw else []


def env_value(name: str, env: Mapping[str, str] | None = None) -> str | None:
    return (env if env is not None else os.environ).get(ENV_PREFIX + name) or None


@dataclass(frozen=True)
class Weights:
    """Per-list weights of the rank fusion."""

    lexical: float = 1.0
    dense: float = 1.0


DEFAULT_WEIGHTS = Weights()

__all__ = [name for name in dir() if name.isupper()] + [
    "Config",
    "Weights",
    "env_list",
    "env_value",
]
