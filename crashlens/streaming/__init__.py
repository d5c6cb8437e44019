"""The row-wise stages on a stream.

The source workflow has no streaming operator (no watermark, window or state),
so nothing stream-specific is built. Normalisation, the row checks and the
night flag are row-wise, and the twilight lookup is a stream-static broadcast
join, so the batch functions apply unchanged to ``readStream`` input; this
module only wires them and guards against stateful use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import normalise, quality


def harmonised_stream(de_stream: DataFrame, ch_stream: DataFrame) -> DataFrame:
    """Harmonised rows of two streaming raw extracts, with ``ErrorReasons``
    ('' for clean rows); stateless, so any output mode works."""
    if not (de_stream.isStreaming and ch_stream.isStreaming):
        raise ValueError("both inputs must be streaming DataFrames")
    merged = normalise.harmonise(de_stream, ch_stream)
    flagged = quality.flag_errors(merged)
    from pyspark.sql import functions as F
    return flagged.withColumn(quality.ERROR_REASONS, F.array_join(quality.REASONS, "; ")).drop(quality.REASONS)
