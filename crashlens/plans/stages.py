"""The end-to-end preparation chain as one lazy plan.

    raw DE, raw CH -> normalise -> union -> reasons -> clean -> year
                   -> + numeric hour -> + night flag

Every stage is a DataFrame; nothing runs until an action. Catalyst sees the
whole chain, so the only shuffles are the hour lookup aggregation and its
join; the twilight join is a broadcast of a fixed-size dimension. All
analyses read ``night`` (or ``final``); on a cluster, write ``night`` once
(Parquet partitioned by year, see :func:`materialise_night`) and read it back.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..operators import cube, joins, night, normalise, quality
from ..sources import fixtures, keyed, raw, twilight as tw


class Stages:
    """Every stage of the chain, declared on first use (so a query analyses
    only the stages it reads) and then reused."""

    def __init__(self, de_raw: DataFrame, ch_raw: DataFrame, year: int = D.DEFAULT_YEAR,
                 twilight: DataFrame | None = None, on_missing_hour: str = "day", null_check: str = "required",
                 materialise: bool = False):
        self.de_raw, self.ch_raw, self.year = de_raw, ch_raw, year
        self._twilight, self.on_missing_hour, self.null_check = twilight, on_missing_hour, null_check
        self.materialise = materialise
        raw.size_shuffles(de_raw, ch_raw)

    @cached_property
    def harmonised(self) -> DataFrame:
        """Harmonised rows plus the hour-lookup columns; with ``materialise`` written once (:attr:`prepared`), so the raw
        extracts are read and checked exactly once for the whole chain."""
        if self.materialise:
            return self.prepared.rows()
        return normalise.harmonise(self.de_raw, self.ch_raw, lookup_columns=True)

    @cached_property
    def prepared(self) -> keyed.KeyedTable:
        """Harmonised rows with the lookup columns, their key and one number of reason bits, written under the shared
        checkpoint folder by year and in buckets of the key.

        The raw extracts are read and normalised once: hot keys, buckets and hot rows are all taken from that one copy. The
        bits are settled above the union of the sources; pushed into a source's loop, they make its generated method
        larger than the JVM compiles (8,000 bytes), so that every row is interpreted."""
        base = joins.with_key(normalise.harmonise(self.de_raw, self.ch_raw, lookup_columns=True))
        bits = quality.settled(quality.reason_bits(base.select(*normalise.HARMONISED), self.null_check))
        checked = raw.materialise(base.withColumn(quality.BITS, bits), "harmonised")
        return keyed.write_keyed(checked, joins.KEY, "prepared", partition_by=("AccidentYear",))

    @cached_property
    def checked(self) -> quality.PreparedRows:
        """Error rows, clean rows and reports from the stored reason bits."""
        names = quality.reason_names(self.merged, self.null_check)
        return quality.PreparedRows(self.harmonised.select(*normalise.HARMONISED, quality.BITS), names)

    @cached_property
    def merged(self) -> DataFrame:
        return self.harmonised.select(*normalise.HARMONISED)

    @cached_property
    def errors(self) -> DataFrame:
        if self.materialise:
            return self.checked.errors()
        return quality.find_errors(self.merged, self.null_check)

    @cached_property
    def clean(self) -> DataFrame:
        if self.materialise:  # plain filters, so a year filter on top prunes the scan
            return self.checked.clean()
        return quality.clean_rows(self.merged, self.null_check)

    @cached_property
    def final(self) -> DataFrame:
        if self.materialise:
            return quality.filter_year(self.clean, self.year)
        # Year first, then the row checks: both are row-wise, so the result
        # equals filtering the clean rows, but the checks only see one year.
        return quality.clean_rows(quality.filter_year(self.merged, self.year), self.null_check)

    @cached_property
    def hours(self) -> DataFrame:
        if self.materialise:
            return self.prepared.by_key(lambda part, few: joins.keyed_hours(part))
        return joins.keyed_hours(self.harmonised)

    def _with_hour(self, year: int | None) -> DataFrame:
        if not self.materialise:
            return joins.add_numeric_hour(self.clean if year is None else self.final, self.hours)

        def rows(part: DataFrame) -> DataFrame:
            clean = part.where(F.col(quality.BITS) == 0)
            return (clean if year is None else quality.filter_year(clean, year)).select(*normalise.HARMONISED, *joins.KEY)

        return joins.add_hour_in_buckets(self.prepared, rows)

    @cached_property
    def with_hour(self) -> DataFrame:
        return self._with_hour(self.year)

    @cached_property
    def night_all_years(self) -> DataFrame:
        """Clean rows of every year with hour and night flag, each by its own year's twilight (computed)."""
        spark = self.de_raw.sparkSession
        return night.classify_all_years(self._with_hour(None), lambda ys: tw.solar_twilight(spark, ys), self.on_missing_hour)

    @cached_property
    def counts(self) -> DataFrame:
        """The table of counts of the analysis year, written once; all analyses can be folded from it."""
        return raw.materialise(cube.counts(self.night), "counts")

    @cached_property
    def twilight(self) -> DataFrame:
        if self._twilight is not None:
            return self._twilight
        return tw.solar_twilight(self.de_raw.sparkSession, self.year)

    @cached_property
    def night(self) -> DataFrame:
        return night.classify_night(self.with_hour, self.twilight, self.year, self.on_missing_hour)


def build_stages(de_raw: DataFrame, ch_raw: DataFrame, year: int = D.DEFAULT_YEAR,
                 twilight: DataFrame | None = None, on_missing_hour: str = "day",
                 null_check: str = "required", materialise: bool = False) -> Stages:
    """Declare the chain over two raw extracts."""
    return Stages(de_raw, ch_raw, year, twilight, on_missing_hour, null_check, materialise)


def fixture_stages(spark: SparkSession, sf_dir: str, year: int = D.DEFAULT_YEAR,
                   twilight: DataFrame | None = None, materialise: bool = False) -> Stages:
    """The chain over the fixture extracts derived from ``lineitem``."""
    return build_stages(fixtures.raw_de(spark, sf_dir, with_ordinal=True),
                        fixtures.raw_ch(spark, sf_dir, with_ordinal=True), year, twilight, materialise=materialise)


def file_stages(spark: SparkSession, de_path: str, ch_path: str, year: int = D.DEFAULT_YEAR,
                twilight_cache: str | None = None, materialise: bool = True, fmt: str | None = None) -> Stages:
    """The chain over raw files (CSV with sniffed separators and headers, or Parquet), in the order of their names; by
    default the harmonised table is written once and every stage reads it."""
    de = raw.read_raw(spark, de_path, fmt=fmt, ordered=True, required=normalise.DE_REQUIRED)
    ch = raw.read_raw(spark, ch_path, fmt=fmt, ordered=True, repair=raw.repair_ch_header, required=normalise.CH_REQUIRED)
    dim = tw.load_twilight_cache(spark, twilight_cache) if twilight_cache else None
    return build_stages(de, ch, year, dim, materialise=materialise)


def materialise_night(stages: Stages, name: str = "night") -> DataFrame:
    """Write the night table once under the shared checkpoint folder and read it
    back, cutting the lineage for all downstream analyses."""
    return raw.materialise(stages.night, name, partition_by=("AccidentYear",))
