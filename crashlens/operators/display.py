"""Display schema: column names, location codes, reason text.

Pure projections: no shuffle, safe on any table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import scalars as S
from .quality import ERROR_REASONS

INTERNAL_TO_DISPLAY = dict(D.DISPLAY_COLUMNS)
DISPLAY_TO_INTERNAL = {v: k for k, v in INTERNAL_TO_DISPLAY.items()}


def to_display(df: DataFrame) -> DataFrame:
    """P28 + P29 + P30: internal -> display names, AG_CH -> CH_AG, reasons renamed."""
    out = df
    if "CantonCode" in out.columns:
        out = out.withColumn("CantonCode", S.location_to_display("CantonCode"))
    if ERROR_REASONS in out.columns:
        out = out.withColumn(ERROR_REASONS, S.reasons_to_display(ERROR_REASONS))
    return out.withColumnsRenamed({k: v for k, v in INTERNAL_TO_DISPLAY.items() if k in out.columns})


def to_internal(df: DataFrame) -> DataFrame:
    """P28 + P29: display -> internal names, CH_AG -> AG_CH."""
    out = df.withColumnsRenamed({k: v for k, v in DISPLAY_TO_INTERNAL.items() if k in df.columns})
    if "CantonCode" in out.columns:
        out = out.withColumn("CantonCode", S.location_to_internal("CantonCode"))
    return out


def preview(df: DataFrame, n: int = 15, order_by: list[str] | None = None) -> DataFrame:
    """T4: first ``n`` rows in a stated order (a preview is the feature here)."""
    cols = order_by or df.columns
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in cols]).limit(n)
