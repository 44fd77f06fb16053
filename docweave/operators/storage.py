"""Intermediate tables that several later steps use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """``df`` worked out a single time for several uses: written to the session's checkpoint folder, or kept by Spark where none is set, as in tests."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
