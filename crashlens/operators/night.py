"""Night classification.

The twilight dimension holds at most 17 reference points x 12 months per
year, whatever the accident volume, so it is broadcast: the accident table is
classified in one map stage with no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import scalars as S
from ..sources.raw import require_columns

NIGHT = "NightAccident"


def twilight_pairs(df: DataFrame) -> DataFrame:
    """Distinct (CantonCode, month number) pairs present in the data."""
    return df.select("CantonCode", S.month_number("AccidentMonth").alias("month")).distinct()


BROADCAST_YEARS = 1_000  # years of twilight (17 x 12 narrow rows each) that are broadcast


def years_met(df: DataFrame) -> list[int]:
    """The distinct years in ``df`` for which there is a calendar (1 to 9999); one row per year to the driver."""
    year = F.col("AccidentYear").try_cast("int")
    return sorted(r[0] for r in df.select(year.alias("y")).where(F.col("y").between(1, 9999)).distinct().collect())


def classify_all_years(df: DataFrame, twilight_of: Callable[[list[int]], DataFrame], on_missing_hour: str = "day",
                       on_missing_twilight: str = "null") -> DataFrame:
    """J3 for every year in the data: ``twilight_of`` makes the twilight table of the years met, and a row takes its
    own year's. Rows without a year that a calendar knows have no twilight."""
    years = years_met(df)
    return classify_night(df, twilight_of(years or [D.DEFAULT_YEAR]), None, on_missing_hour, on_missing_twilight, n_years=len(years))


def classify_night(df: DataFrame, twilight: DataFrame, year: int | None = D.DEFAULT_YEAR,
                   on_missing_hour: str = "day", on_missing_twilight: str = "null", n_years: int = 1) -> DataFrame:
    """J3 + P26: add ``NightAccident`` (1 = before dawn hour or after dusk hour), by the twilight of ``year``, or of each row's
    own year where ``year`` is None (``n_years`` of them in the twilight table).

    ``on_missing_hour``: 'day' classifies a missing hour as day (command-line
    behaviour); 'error' makes the job fail on such a row (dashboard behaviour).
    ``on_missing_twilight``: a (region, month) that the twilight table lacks gives
    NULL ('null': the row counts as neither night nor day) or fails ('error').
    """
    require_columns(df, ["AccidentMonth", "CantonCode", "AccidentHourNumeric"], "night classification")
    # One row per (point, month) and year: the reference day. The 17 reference points bound the broadcast
    # side at 17 x 12 rows a year, whatever the cache file holds, and the years are counted.
    known_points = (F.dayofmonth("ref_date") == D.REFERENCE_DAY) & F.col("region_key").isNotNull()
    if year is not None:
        known_points = known_points & (F.col("year") == F.lit(year))
    dim = twilight.where(known_points).select(F.col("region_key").alias("_rk"), F.col("month").alias("_m"), F.col("year").alias("_y"),
                                              F.col("dawn_hour").alias("_dawn"), F.col("dusk_hour").alias("_dusk"))
    keyed = df.withColumn("_rk", S.region_key("CantonCode")).withColumn("_m", S.month_number("AccidentMonth"))
    on = ["_rk", "_m"]
    if year is None:
        require_columns(df, ["AccidentYear"], "night classification over all years")
        keyed, on = keyed.withColumn("_y", F.col("AccidentYear").try_cast("int")), [*on, "_y"]
    else:
        dim = dim.drop("_y")
    j = keyed.join(F.broadcast(dim) if n_years <= BROADCAST_YEARS else dim, on, "left")
    hour = F.col("AccidentHourNumeric")
    if on_missing_hour == "error":
        hour = F.when(hour.isNull(), F.raise_error(F.lit("numeric hour missing for a row"))).otherwise(hour)
    elif on_missing_hour != "day":
        raise ValueError("on_missing_hour must be 'day' or 'error'")
    if on_missing_twilight == "error":
        unknown = F.raise_error(F.concat_ws(" ", F.lit("no twilight for"), "CantonCode", "AccidentMonth")).cast("int")
    elif on_missing_twilight == "null":
        unknown = F.lit(None).cast("int")
    else:
        raise ValueError("on_missing_twilight must be 'null' or 'error'")
    known = F.col("_dawn").isNotNull() & F.col("_dusk").isNotNull()
    out = j.withColumn(NIGHT, F.when(known, S.night_flag(hour, "_dawn", "_dusk")).otherwise(unknown))
    return out.select(*df.columns, NIGHT)
