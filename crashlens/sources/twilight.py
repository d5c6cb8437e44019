"""Twilight dimension: from a cached JSON file (S5) or computed.

Both return the same schema, one row per (region_key, year, month):

    region_key STRING, year INT, month INT, ref_date DATE,
    begin_utc TIMESTAMP_NTZ, end_utc TIMESTAMP_NTZ,
    dawn_hour INT, dusk_hour INT, daylight_hours DOUBLE

The rows with a region are at most 17 x 12 per year and reference day; only those are
broadcast. The dimension never grows with the accident data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import scalars as S
from ..functions import solar

CACHE_SCHEMA = "map<string, struct<begin: string, end: string>>"


def region_points_df(spark: SparkSession) -> DataFrame:
    """The 17 reference points with the key text the cache uses ("lat,lng")."""
    rows = [(k, lat, lng, zone, f"{lat},{lng}") for k, lat, lng, zone in D.region_points()]
    return spark.createDataFrame(rows, "region_key string, lat double, lng double, zone string, point string")


def _finish(df: DataFrame) -> DataFrame:
    return df.select(
        "region_key",
        F.year("ref_date").alias("year"),
        F.month("ref_date").alias("month"),
        "ref_date",
        "begin_utc",
        "end_utc",
        S.local_hour("begin_utc", F.col("zone")).alias("dawn_hour"),
        S.local_hour("end_utc", F.col("zone")).alias("dusk_hour"),
        S.span_hours(F.col("begin_utc"), F.col("end_utc")).alias("daylight_hours"),
    )


def _iso_to_utc_ntz(c):
    """'2024-05-15T02:29:54+00:00' -> TIMESTAMP_NTZ in UTC (offset applied)."""
    local = F.to_timestamp_ntz(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    tail = F.substring(c, 20, 6)
    has_off = F.length(tail) == 6
    sign = F.when(F.substring(tail, 1, 1) == "-", -1).otherwise(1)
    mins = sign * (F.substring(tail, 2, 2).cast("int") * 60 + F.substring(tail, 5, 2).cast("int"))
    return F.when(has_off, F.timestamp_add("MINUTE", -mins, local)).otherwise(local)


def load_twilight_cache(spark: SparkSession, path: str) -> DataFrame:
    """The ``"lat,lng,date" -> {begin, end}`` JSON cache as a dimension.

    Every key is kept: daylight means take all points of the file. A point that is
    not one of the 17 reference points has no region, zone or local hours (NULL).
    """
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.explode(F.from_json("value", CACHE_SCHEMA)).alias("k", "v"))
    parsed = entries.select(
        F.substring_index("k", ",", 2).alias("point"),
        F.to_date(F.substring_index("k", ",", -1)).alias("ref_date"),
        _iso_to_utc_ntz(F.col("v.begin")).alias("begin_utc"),
        _iso_to_utc_ntz(F.col("v.end")).alias("end_utc"),
    )
    pts = F.broadcast(region_points_df(spark))
    return _finish(parsed.join(pts, "point", "left"))


def solar_twilight(spark: SparkSession, years: int | Iterable[int] = D.DEFAULT_YEAR,
                   day: int = D.REFERENCE_DAY) -> DataFrame:
    """Civil twilight on the ``day``-th of every month, computed per point."""
    years = [years] if isinstance(years, int) else list(years)
    # 17 points x 12 months per year, expanded row-wise (fixed size).
    grid = (region_points_df(spark)
            .withColumn("y", F.explode(F.array(*[F.lit(y) for y in years])))
            .withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
            .withColumn("ref_date", F.make_date("y", "m", F.lit(day))))
    begin, end = solar.twilight_minutes(F.col("lat"), F.col("lng"), F.col("ref_date"))
    grid = grid.select(
        "region_key", "zone", "ref_date",
        solar.minutes_to_utc(F.col("ref_date"), begin).alias("begin_utc"),
        solar.minutes_to_utc(F.col("ref_date"), end).alias("end_utc"),
    )
    return _finish(grid)
