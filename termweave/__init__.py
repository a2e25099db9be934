"""Semantic enrichment analysis on Spark: concepts of entities, tested against a background."""

__version__ = "0.1.0"

from termweave.engine import Engine, Result  # noqa: E402

__all__ = ["Engine", "Result"]
