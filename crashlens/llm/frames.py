"""Small helpers for operators that take frames with columns they know nothing about."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores appended until no column of ``taken`` has it (Spark's names ignore case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def with_field(df: DataFrame, keep: list[str], name: str, kind: T.DataType) -> T.StructType:
    """Schema of the columns ``keep`` of ``df`` and one more."""
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind)])
