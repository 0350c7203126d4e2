"""Timestamp helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(col: Column) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ columns
    (NTZ values are read as UTC wall time; sessions run in UTC)."""
    return F.unix_micros(col.cast("timestamp"))
