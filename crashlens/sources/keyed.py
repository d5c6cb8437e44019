"""Tables written in buckets of a key, so that joins and aggregations by that key need no exchange.

A bucket cannot be split, so a key with many rows would make one long task. Keys with over one thousandth of all rows (at
most a thousand; found by a sketch of the key column, as only speed depends on them) are kept in a table of their
own, without buckets: their rows stay spread, and whatever has one row per such key can be broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raw import checkpoint_dir, materialise, partitions_for, register_removal

HOT_KEYS = 1_000
LEAST_ROWS = 10_000   # a key with fewer rows is never hot


@dataclass
class KeyedTable:
    """``cold``: rows in buckets of the key; ``hot``: rows of hot keys (None: there are none)."""

    cold: DataFrame
    hot: DataFrame | None
    name: str

    def rows(self) -> DataFrame:
        return self.cold if self.hot is None else self.cold.unionByName(self.hot)

    def by_key(self, work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
        """``work`` done on rows that share no key with each other, and united; its second argument says whether the rows
        have few keys (at most ``HOT_KEYS``)."""
        out = work(self.cold, False)
        return out if self.hot is None else out.unionByName(work(self.hot, True))

    def drop(self) -> None:
        """Take the table off the session's catalogue; its files go when the session ends."""
        self.cold.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def _marker(keys: Sequence[str]) -> Column:
    return F.concat_ws("\x01", *[F.col(k).cast("string") for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], least: int = LEAST_ROWS) -> list[str]:
    """Texts of the keys that hold over 1 / ``HOT_KEYS`` of the rows, or a little less: one pass over the key columns."""
    top, n = df.select(_marker(keys).alias("k")).agg(F.expr(f"approx_top_k(k, {HOT_KEYS}, {20 * HOT_KEYS})"), F.count(F.lit(1))).first()
    return [r["item"] for r in top or [] if r["count"] > max(least, n // HOT_KEYS)]


def write_keyed(df: DataFrame, keys: Sequence[str], name: str, partition_by: Sequence[str] = (), buckets: int | None = None,
                least: int = LEAST_ROWS) -> KeyedTable:
    """Write ``df`` under the shared checkpoint folder in ``buckets`` (default: as many as ``raw.partitions_for`` its files)
    of its key columns, which must not be null."""
    spark = df.sparkSession
    n = buckets or partitions_for(df)
    hot = hot_keys(df, keys, least)
    is_hot = _marker(keys).isin(hot) if hot else F.lit(False)
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{table}"
    register_removal(spark, path)
    w = (df.where(~is_hot) if hot else df).repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path)
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(table)
    cold = spark.table(table).select(*df.columns)
    return KeyedTable(cold, materialise(df.where(is_hot), f"{name}-hot", partition_by) if hot else None, table)
