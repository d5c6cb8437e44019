"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query rebuilds the stage chain from the driver's tables (the fixture
extracts derive from ``lineitem``), so its work grows with the data. Double
columns are rounded to 6 decimals so results hash the same on any engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..operators import display, joins, normalise, quality
from ..operators import stats as T
from ..operators.night import twilight_pairs
from ..sources import fixtures
from ..sources.raw import size_shuffles
from . import analyses as A
from .stages import Stages, fixture_stages

Query = Callable[[SparkSession, str], DataFrame]


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


_STAGES: dict[tuple[int, str, bool], tuple[SparkSession, Stages]] = {}


def stages_for(spark: SparkSession, sf_dir: str, prepared: bool = False) -> Stages:
    """One stage chain per (session, data folder), shared by all queries.

    The lazy chain shares plan objects only (nothing is cached in memory): every
    query still runs from the raw tables, but Catalyst analysis of the common
    stages is done once instead of once per query. With ``prepared``, the chain
    whose harmonised table the first query writes and the others read; the
    table of counts is shared in the same way.
    """
    key = (id(spark), sf_dir, prepared)
    hit = _STAGES.get(key)
    # The entry holds the session itself (so its id cannot be reused) and is
    # dropped once that session's context has been stopped.
    if hit is None or hit[0] is not spark or spark.sparkContext._jsc is None:
        hit = (spark, fixture_stages(spark, sf_dir, materialise=prepared))
        _STAGES[key] = hit
    return hit[1]


def _q(fn: Callable[[Stages], DataFrame], prepared: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(fn(stages_for(spark, sf_dir, prepared)))
    run.__doc__ = fn.__doc__
    return run


def _twilight_pairs(s: Stages) -> DataFrame:
    p = twilight_pairs(s.final)
    from ..functions import scalars as S
    known = (F.col("year") == s.year) & (F.dayofmonth("ref_date") == D.REFERENCE_DAY) & F.col("region_key").isNotNull()
    dim = s.twilight.where(known).select(F.col("region_key"), F.col("month").alias("_m"), "dawn_hour", "dusk_hour")
    j = p.withColumn("region_key", S.region_key("CantonCode"))
    return j.join(F.broadcast(dim), (j["region_key"] == dim["region_key"]) & (j["month"] == dim["_m"]), "left") \
        .select("CantonCode", "month", j["region_key"], "dawn_hour", "dusk_hour")


QUERIES: dict[str, Callable[[Stages], DataFrame]] = {
    # stage tables
    "harmonised": lambda s: s.merged,
    "error_rows": lambda s: s.errors,
    "clean_rows": lambda s: s.clean,
    "clean_rows_multiset": lambda s: joins.remove_error_entries(s.merged, s.errors.drop(quality.ERROR_REASONS)),
    "final_year": lambda s: s.final,
    "with_hour": lambda s: s.with_hour,
    "night_classified": lambda s: s.night,
    # quality reports
    "unmapped_values": lambda s: normalise.unmapped_report(s.de_raw, s.ch_raw),
    "merged_null_counts": lambda s: quality.null_counts(s.merged),
    "problem_values": lambda s: quality.problem_values(s.merged),
    "error_summary": lambda s: quality.error_summary(s.merged),
    "error_enriched": lambda s: quality.enrich_errors(s.errors),
    "reason_counts": lambda s: quality.reason_counts(s.errors),
    "table_profile": lambda s: quality.table_profile(s.merged),
    "duplicate_uids": lambda s: quality.duplicate_count(s.merged, "AccidentUID"),
    "quick_insights": lambda s: quality.quick_insights(s.final),
    "source_profile": lambda s: quality.source_profile(s.de_raw, s.ch_raw),
    "source_daypart_counts": lambda s: quality.source_daypart_counts(s.de_raw, s.ch_raw),
    "hour_match": lambda s: quality.hour_match_count(s.with_hour),
    "hour_lookup": lambda s: joins.hour_lookup(s.de_raw, s.ch_raw),
    "occurrence_numbers": lambda s: joins.occurrence_number(s.merged, normalise.HARMONISED, out="occurrence"),
    "twilight_pairs": _twilight_pairs,
    # display schema
    "display_final": lambda s: display.to_display(s.final),
    "display_errors": lambda s: display.to_display(s.errors),
    # G1
    "g1_motorcycle_severity": lambda s: A.motorcycle_severity(s.final),
    "g1_chi2": lambda s: A.motorcycle_severity_test(s.final),
    "g1_expected": lambda s: A.motorcycle_severity_expected(s.final),
    # G2
    "g2_daypart_counts": lambda s: A.daypart_counts(s.final),
    "g2_daynight_share": lambda s: A.daynight_share(s.final),
    "g2_daypart_severity": lambda s: A.daypart_severity(s.final),
    "g2_severe_share": lambda s: A.severe_share_by_daypart(s.final),
    "g2_chi2": lambda s: A.daypart_tests(s.final),
    # G3
    "g3_winter_share": lambda s: A.winter_share(s.final),
    "g3_month_share": lambda s: A.month_share(s.final),
    "g3_season_severity": lambda s: A.season_severity(s.final),
    "g3_severe_by_season": lambda s: A.severe_by_season(s.final),
    "g3_chi2": lambda s: A.winter_tests(s.final),
    # G4
    "g4_weekday": lambda s: A.weekday_stats(s.final),
    "g4_winners": lambda s: A.weekday_winners(s.final),
    "g4_chi2": lambda s: A.weekday_test(s.final),
    # G5
    "g5_night_split": lambda s: A.night_split(s.night),
    "g5_night_motorcycle": lambda s: A.night_motorcycle(s.night),
    "g5_night_severity": lambda s: A.night_severity(s.night),
    "g5_chi2": lambda s: A.night_tests(s.night),
    "g5_night_by_month": lambda s: A.night_by_month(s.night),
    "g5_month_winners": lambda s: A.night_month_winners(s.night),
    "g5_night_by_hour": lambda s: A.night_by_hour(s.night),
    "g5_bin_shares": lambda s: A.bin_shares(s.night),
    # G6
    "g6_night_by_season": lambda s: A.night_by_season(s.night),
    # G7
    "g7_rate_vs_daylight": lambda s: A.rate_vs_daylight(s.night, s.twilight),
    "g7_correlation": lambda s: A.daylight_correlation(s.night, s.twilight),
    "g7_season_rates": lambda s: A.season_rates(s.night),
    "g7_chi2": lambda s: A.winter_summer_test(s.night),
    # G8 / G9 / G10
    "g8_confusion": lambda s: A.confusion_matrix(s.night),
    "g8_errors_by_hour": lambda s: A.errors_by_hour(s.night),
    "g8_fn_by_bin": lambda s: A.fn_by_bin(s.night),
    "g9_misclass_by_month": lambda s: A.misclass_by_month(s.night),
    "g10_monthly_table": lambda s: A.monthly_comparison(s.night, s.twilight),
    # X3 / X4
    "x3_block_check": lambda s: A.block_check(s.night),
    "x4_region_rates": lambda s: A.region_rates(s.night),
}


# the same analyses, folded from the table of counts
FOLDED = {f"cube_{name}": name for name in QUERIES if name[:2] in ("g1", "g2", "g3", "g4", "g5", "g6", "g7", "g8", "g9", "x3", "x4")}


class _Folded:
    """Stages whose ``final`` and ``night`` are the written table of counts."""

    def __init__(self, stages: Stages):
        self.final = self.night = stages.counts
        self.twilight = stages.twilight


QUERIES["cube"] = lambda s: s.counts.withColumnRenamed(T.ROWS, "n")
QUERIES["night_all_years"] = lambda s: s.night_all_years
QUERIES |= {name: (lambda s, fn=QUERIES[of]: fn(_Folded(s))) for name, of in FOLDED.items()}

# stages and reports from the prepared table: harmonised rows with reason bits, written by year and in buckets of the key
PREPARED: dict[str, Callable[[Stages], DataFrame]] = {
    "prepared_error_rows": lambda s: s.errors,
    "prepared_clean_rows": lambda s: s.clean,
    "prepared_final_year": lambda s: s.final,
    "prepared_error_summary": lambda s: s.checked.summary(),
    "prepared_reason_counts": lambda s: s.checked.reason_counts(),
    "prepared_problem_values": lambda s: s.checked.problem_values(),
    "prepared_error_enriched": lambda s: s.checked.enriched(),
    "prepared_with_hour": lambda s: s.with_hour,
    "prepared_night_classified": lambda s: s.night,
    "prepared_night_all_years": lambda s: s.night_all_years,
}

PLACE = ["CantonCode", "AccidentMonth"]


_CHECKED: dict[tuple[int, str], tuple[SparkSession, quality.PreparedRows]] = {}


def _text_rows(spark: SparkSession, sf_dir: str) -> quality.PreparedRows:
    """The text table with its reason bits, checked and written by the first query of a session that needs it."""
    key = (id(spark), sf_dir)
    hit = _CHECKED.get(key)
    if hit is None or hit[0] is not spark or spark.sparkContext._jsc is None:
        hit = (spark, quality.PreparedRows.of(fixtures.prepared(spark, sf_dir).select(*normalise.HARMONISED)))
        _CHECKED[key] = hit
    return hit[1]


def _partial_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared rows with an unreadable flag or severity as an error table, those without a region 40 times: on a few
    columns it has fewer copies of most rows than the table, and more of some."""
    t = fixtures.prepared(spark, sf_dir).where("AccidentInvolvingMotorcycle = 'maybe' or AccidentSeverityCategory = 'unknown'")
    return t.withColumn("copy", F.explode(F.expr("if(CantonCode is null, sequence(1, 40), array(1))")))


def _multiset_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fixtures.prepared(spark, sf_dir).select(*PLACE, "AccidentWeekDay")
    return joins.remove_error_entries(table, _partial_errors(spark, sf_dir).select(*PLACE, "AccidentWeekDay"))


def _multiset_fewer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fixtures.prepared(spark, sf_dir).select("row_id", *PLACE, "AccidentHour")
    return joins.remove_error_entries(table, _partial_errors(spark, sf_dir).select(*PLACE), order_by=["row_id"])


def _occurrence_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fixtures.prepared(spark, sf_dir).select("row_id", *PLACE)
    return joins.occurrence_number(table, PLACE, order_by=["row_id"], out="occurrence")


# operators on a prepared text table and on overlapping hour files, where every rule has rows that reach it
TABLE_QUERIES: dict[str, Query] = {
    "text_error_rows": lambda spark, d: _text_rows(spark, d).errors(),
    "text_clean_rows": lambda spark, d: _text_rows(spark, d).clean(),
    "text_final_year": lambda spark, d: quality.filter_year(_text_rows(spark, d).clean()),
    "text_problem_values": lambda spark, d: _text_rows(spark, d).problem_values(),
    "text_error_summary": lambda spark, d: _text_rows(spark, d).summary(),
    "text_error_enriched": lambda spark, d: _text_rows(spark, d).enriched(),
    "text_fully_invalid": lambda spark, d: _text_rows(spark, d).enriched(fully=True),
    "text_reason_counts": lambda spark, d: _text_rows(spark, d).reason_counts(),
    "multiset_partial": _multiset_partial,
    "multiset_fewer_columns": _multiset_fewer_columns,
    "occurrence_by_place": _occurrence_by_place,
    "hour_lookup_file_order": lambda spark, d: joins.hour_lookup(*fixtures.hours_in_file_order(spark, d)),
    "hour_lookup_shared_keys": lambda spark, d: joins.hour_lookup(fixtures.hours_de(spark, d), fixtures.hours_ch(spark, d)),
}


def _t(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        size_shuffles(fixtures.lineitem(spark, sf_dir))
        return round_doubles(fn(spark, sf_dir))
    return run


def queries() -> dict[str, Query]:
    return {name: _q(fn) for name, fn in QUERIES.items()} | {name: _q(fn, True) for name, fn in PREPARED.items()} | {name: _t(fn) for name, fn in TABLE_QUERIES.items()}
