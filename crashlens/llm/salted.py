"""Equi-joins in which one key may hold a third of all rows of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 200_000      # rows of a narrow right side that are broadcast (counted before)
SHARE = 1_000        # a key with more than 1 / SHARE of the rows is dealt over several tasks
LEAST = 10_000       # ... and more than this many


def join(left: DataFrame, right: DataFrame, on: list[str], count: str, row: str, n_rows: int, how: str = "left",
         small: int = SMALL) -> DataFrame:
    """``left`` joined with ``right``, which is a written table with one row per key and, in ``count``, a
    number of left rows of that key that sum to ``n_rows`` at most. ``row`` is a left column that differs
    from row to row. Keys must not be null.

    A right side of at most ``small`` rows (counted) is broadcast. Beyond, both sides are shuffled, and a key
    with over ``n_rows`` / 1,000 rows is dealt over parts of that size: there are at most 1,000 such keys, so
    their list is broadcast, and the right rows are repeated per part (at most 1,000 more in all, twice)."""
    if right.count() <= small:
        return left.join(F.broadcast(right), on, how)
    limit = max(LEAST, n_rows // SHARE)
    parts = F.expr(f"cast(ceil(`{count}` / {limit}) as int)")
    hot = right.filter(F.col(count) > limit).select(*on, parts.alias("_parts"))
    dealt = (left.join(F.broadcast(hot), on, "left")
             .withColumn("_part", F.pmod(F.xxhash64(row), F.coalesce("_parts", F.lit(1)).cast("bigint")).cast("int")).drop("_parts"))
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), parts) - 1)))
    return dealt.join(copies, [*on, "_part"], how).drop("_part")
