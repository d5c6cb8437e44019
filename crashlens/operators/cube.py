"""Counts from which every analysis (G1-G10, X3, X4) can be folded.

A row of the table of counts stands for all rows that agree in ``DIMENSIONS``; ``ROWS`` says how many. Its size is bounded
by the domains (per year 42 regions x 12 months x 7 weekdays x 4 dayparts x 25 hours x 3 severities x 2 x 2, of
which data fill a small part), not by the rows behind it. Counts add up, so tables of different rows merge by adding, and a
year is put in place of what the table had of it without reading the others (``sources.raw``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import raw
from .night import NIGHT
from .stats import ROWS

DIMENSIONS = ["AccidentYear", "CantonCode", "AccidentMonth", "AccidentWeekDay", "AccidentHour", "AccidentHourNumeric",
              "AccidentSeverityCategory", "AccidentInvolvingMotorcycle", NIGHT]
_NUMBERS = {"AccidentYear": T.LongType(), "AccidentHourNumeric": T.LongType(), "AccidentInvolvingMotorcycle": T.LongType(),
            NIGHT: T.IntegerType(), ROWS: T.LongType()}
SCHEMA = T.StructType([T.StructField(c, _NUMBERS.get(c, T.StringType())) for c in [*DIMENSIONS, ROWS]])


def counts(night: DataFrame) -> DataFrame:
    """The table of counts of classified rows: one aggregation with map-side partial counts."""
    return night.groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias(ROWS))


def merged(*tables: DataFrame) -> DataFrame:
    """One table of counts from several, of different rows of the same or of different years."""
    stacked = tables[0]
    for t in tables[1:]:
        stacked = stacked.unionByName(t)
    return stacked.groupBy(*DIMENSIONS).agg(F.sum(ROWS).alias(ROWS))


def write(table: DataFrame, path: str, years: Sequence[int] | None = None) -> list[int]:
    """Put the given years of ``table`` (default: those it holds) in place of the stored ones; a year's counts are few
    rows, so they go to one file."""
    return raw.replace_years(table.coalesce(1), path, years)


def add(table: DataFrame, path: str) -> list[int]:
    """Add counts of further rows to the stored years that they fall in. Rows without a year are not stored."""
    spark = table.sparkSession
    new = raw.materialise(table.where(F.col("AccidentYear").isNotNull()), "counts")
    years = [r[0] for r in new.select("AccidentYear").distinct().collect()]  # a row per year
    old = read(spark, path).where(F.col("AccidentYear").isin(years))
    return write(merged(old, new), path, years)  # in place of the old counts, which stay readable till then


def read(spark: SparkSession, path: str) -> DataFrame:
    return raw.read_years(spark, path, SCHEMA)
