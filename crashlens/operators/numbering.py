"""Running totals over a whole table, without one task per key.

A window over ``partitionBy(key).orderBy(order)`` puts a key into one task. Here the rows are cut into
ranges of (key, order), so a key that holds a third of all rows spreads over a third of the ranges:

1. the rows are dealt by ``repartitionByRange`` and written once with the number of their range (the
   bounds come from a sample, so two runs of the same plan may cut differently; the written table can
   not);
2. totals per (key, range) are counted with map-side partial aggregation. Neighbouring ranges share at
   most one key, so the keys that lie in several ranges have at most two entries per range: their
   running offsets are broadcast, with that bound;
3. totals run inside a (key, range) cell, and the cell's offset is added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.raw import materialise

_RANGE, _TIE = "_range", "_tie"
_ROW_BITS = 33  # monotonically_increasing_id: the partition's number above this many bits of row numbers


def _ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _asc(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() for c in columns]


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` written once, dealt by ranges of (keys, order), with ``_range`` (its range's number) and ``_tie``
    (a number per row, which parts equal rows). NULLs come first."""
    numbered = df.withColumn(_TIE, F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(ranges or _ranges(df), *_asc(keys), *_asc(order), F.col(_TIE))
    return materialise(dealt.withColumn(_RANGE, F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column | None],
                   ties: Sequence[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with, per entry of ``totals`` (output name -> BIGINT weight, None: 1 a row), the sum of the
    weights of all earlier rows of its key (0 for the first). Rows of a key run in ``order``, NULLs first;
    rows equal in it in the order of ``ties`` (default: all other columns), and what is equal in these, too, in
    any order. NULL keys are one key. Without ``keys`` the whole
    table is one run.
    """
    keys, order = list(keys), list(order)
    order += [c for c in (df.columns if ties is None else ties) if c not in keys and c not in order]
    weights = {name: F.lit(1).cast("bigint") if w is None else w.cast("bigint") for name, w in totals.items()}
    rows = in_ranges(df, keys, order, ranges)

    cells = rows.groupBy(*keys, _RANGE).agg(*[F.sum(w).alias(f"_sum_{name}") for name, w in weights.items()])
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # keys in one range only need no offset
    spread = (cells.withColumn("_ranges", F.count(F.lit(1)).over(by_key))
              .select(*keys, _RANGE, "_ranges", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in weights])
              .where(F.col("_ranges") > 1).drop("_ranges"))

    cell = Window.partitionBy(*keys, _RANGE).orderBy(*_asc(order), _TIE).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", *[F.coalesce(F.sum(w).over(cell), F.lit(0)).alias(f"_in_{n}") for n, w in weights.items()])
    left, right = inside.alias("l"), F.broadcast(spread).alias("r")
    same = F.col(f"l.{_RANGE}") == F.col(f"r.{_RANGE}")
    for k in keys:
        same = same & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    return left.join(right, same, "left").select(
        *[F.col(f"l.`{c}`").alias(c) for c in df.columns],
        *[(F.col(f"l._in_{n}") + F.coalesce(F.col(f"r._off_{n}"), F.lit(0))).alias(n) for n in weights])
