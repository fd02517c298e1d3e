"""Hybrid (lexical + dense) search over markdown collections on Spark."""

from .config import Config, Weights
from .plans.engine import SearchEngine

__version__ = "0.2.0"

__all__ = ["Config", "SearchEngine", "Weights", "__version__"]
