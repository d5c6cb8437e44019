"""Solar job: error of using one reference day per month.

For every reference point and day of the year, civil twilight is computed on
Spark (X1 equations); per (point, month) the result is the largest distance,
in local-clock minutes, between any day's dawn or dusk and the reference
day's. Inputs are 17 points x 366 days; groups are one point-month (<= 31
rows), so the window never holds more than a month of one point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import solar
from ..sources.twilight import region_points_df


def twilight_days(spark: SparkSession, year: int = D.DEFAULT_YEAR) -> DataFrame:
    """Civil twilight of every day of ``year`` at every point, as local-clock minutes."""
    days = F.sequence(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31)))
    grid = region_points_df(spark).withColumn("day", F.explode(days))
    begin, end = solar.twilight_minutes(F.col("lat"), F.col("lng"), F.col("day"))

    def local_minutes(utc):
        t = F.convert_timezone(F.lit("UTC"), F.col("zone"), utc)
        return F.hour(t) * 60 + F.minute(t) + F.second(t) / 60.0

    return grid.select(
        "region_key", "day", F.month("day").alias("month"), F.dayofmonth("day").alias("dom"),
        local_minutes(solar.minutes_to_utc(F.col("day"), begin)).alias("dawn_min"),
        local_minutes(solar.minutes_to_utc(F.col("day"), end)).alias("dusk_min"),
    )


def date_error_matrix(spark: SparkSession, year: int = D.DEFAULT_YEAR, day: int = D.REFERENCE_DAY) -> DataFrame:
    """Per (region_key, month): max over the month's days of
    max(|dawn - dawn on day ``day``|, |dusk - dusk on day ``day``|), in minutes."""
    d = twilight_days(spark, year)
    w = Window.partitionBy("region_key", "month")
    ref_dawn = F.max(F.when(F.col("dom") == day, F.col("dawn_min"))).over(w)
    ref_dusk = F.max(F.when(F.col("dom") == day, F.col("dusk_min"))).over(w)
    d = d.withColumn("delta", F.greatest(F.abs(F.col("dawn_min") - ref_dawn), F.abs(F.col("dusk_min") - ref_dusk)))
    return d.groupBy("region_key", "month").agg(F.max("delta").alias("max_delta_min"),
                                                F.round(F.max("delta")).cast("int").alias("max_delta_rounded"))
