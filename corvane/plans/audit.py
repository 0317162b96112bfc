"""The audit plan: pages to signals to scores, one lazy plan with one shuffle per chunk aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvane.operators import signals


def audit(docs: DataFrame, chunks: DataFrame | None = None, page: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """One row a document with its signals, score, contributions and advice."""
    return signals.scored(signals.measured(docs, chunks, page), weights)
