"""Composed analyses G1-G10 and the validation checks X3, X4.

Inputs: ``final`` (clean rows of the analysis year) for G1-G4, ``night``
(``final`` + numeric hour + night flag) for G5-G10, and the twilight
dimension for daylight; a year of the table of counts (:mod:`..operators.cube`) stands in for
either. Each function returns a DataFrame; each does a single
partially aggregated pass over its input, and everything after that pass
(shares, ranks, tests, fits) runs on a result bounded by the category domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import scalars as S
from ..operators import stats as T

SEV = "AccidentSeverityCategory"
MOTO_LABELS = ["Ohne Motorrad", "Mit Motorrad"]
DAYNIGHT_LABELS = ["Tag", "Nacht/Abend"]
NIGHT_LABELS = ["Tag", "Nacht"]
SCOPES = [T.OVERALL] + D.COUNTRY_CODES


def _moto_label() -> Column:
    return F.when(S.is_motorcycle(), F.lit(MOTO_LABELS[1])).otherwise(F.lit(MOTO_LABELS[0]))


def _pct(num: str, den: str, zero_when_empty: bool = False) -> Column:
    v = F.try_divide(F.col(num) * 100.0, F.col(den))
    return F.coalesce(v, F.lit(0.0)) if zero_when_empty else v


def _test(counts: DataFrame, name: str, row: str, col: str, by=()) -> DataFrame:
    return T.chi_square(counts, row, col, by=by).select(F.lit(name).alias("test"), "*")


def _country(df: DataFrame) -> DataFrame:
    return df.withColumn("country", S.country("CantonCode"))


# --- G1: motorcycle x severity -------------------------------------------------

def motorcycle_severity(final: DataFrame) -> DataFrame:
    """G1: severity row % by motorcycle involvement, overall and per country."""
    g = T.grid_counts(T.with_scope(final), _moto_label(), MOTO_LABELS, F.col(SEV), D.SEVERITY_LABELS,
                      by=[T.SCOPE], row_name="motorcycle", col_name="severity")
    return g.withColumn("row_pct", T.share("n", [T.SCOPE, "motorcycle"]))


def motorcycle_severity_test(final: DataFrame) -> DataFrame:
    """G1: chi-square motorcycle x severity, overall and per country (Q4)."""
    g = motorcycle_severity(final)
    return _test(g, "motorcycle_x_severity", "motorcycle", "severity", by=[T.SCOPE])


def motorcycle_severity_expected(final: DataFrame) -> DataFrame:
    """G1: observed and expected counts of the test, overall and per country."""
    return T.expected_counts(motorcycle_severity(final), "motorcycle", "severity", by=[T.SCOPE])


# --- G2: daypart -----------------------------------------------------------------

def daypart_counts(final: DataFrame) -> DataFrame:
    """Accidents and share per daypart, overall and per country."""
    g = T.spine_counts(T.with_scope(final), "AccidentHour", D.DAYPART_REPORT_ORDER, by=[T.SCOPE], key_name="daypart")
    return g.withColumn("pct", T.share("n", [T.SCOPE]))


def daynight_share(final: DataFrame) -> DataFrame:
    """Day vs evening/night: accidents, share, severe share (dashboard preset)."""
    d = final.withColumn("_dn", S.daynight_group())
    g = T.spine_metrics(d, "_dn", DAYNIGHT_LABELS, metrics={"n": None, "severe_n": S.is_severe(SEV, "serious_or_fatal")},
                        key_name="daynight")
    return g.withColumn("pct", T.share("n")).withColumn("severe_pct", _pct("severe_n", "n", True))


def daypart_severity(final: DataFrame) -> DataFrame:
    """Severity row % by daypart, overall and per country."""
    g = T.grid_counts(T.with_scope(final), F.col("AccidentHour"), D.DAYPART_REPORT_ORDER, F.col(SEV),
                      D.SEVERITY_LABELS, by=[T.SCOPE], row_name="daypart", col_name="severity")
    return g.withColumn("row_pct", T.share("n", [T.SCOPE, "daypart"]))


def severe_share_by_daypart(final: DataFrame) -> DataFrame:
    """Severe share per daypart and country, under both severe presets (Q1)."""
    g = T.spine_metrics(_country(final), "AccidentHour", D.DAYPART_REPORT_ORDER, by=["country"],
                        metrics={"n": None,
                                 "severe_only_n": S.is_severe(SEV, "serious_only"),
                                 "severe_or_fatal_n": S.is_severe(SEV, "serious_or_fatal")},
                        key_name="daypart")
    return (g.withColumn("severe_only_pct", _pct("severe_only_n", "n"))
            .withColumn("severe_or_fatal_pct", _pct("severe_or_fatal_n", "n")))


def daypart_tests(final: DataFrame) -> DataFrame:
    """Chi-square daypart x severity and day/night x severity."""
    return T.chi_square(T.named_grids(final, [
        ("daypart_x_severity", F.col("AccidentHour"), D.DAYPART_REPORT_ORDER, F.col(SEV), D.SEVERITY_LABELS, None),
        ("daynight_x_severity", S.daynight_group(), DAYNIGHT_LABELS, F.col(SEV), D.SEVERITY_LABELS, None),
    ]), "r", "c", by=["test"])


# --- G3: winter ------------------------------------------------------------------

def _season(df: DataFrame, scheme: str = "winter_vs_rest") -> DataFrame:
    return df.withColumn("season", S.season(S.month_number("AccidentMonth"), scheme))


def winter_share(final: DataFrame) -> DataFrame:
    """Winter (Dez-Feb) accidents and share per country."""
    g = T.spine_metrics(_country(final), "country", D.COUNTRY_CODES,
                        metrics={"n": None, "winter_n": S.month_number("AccidentMonth").isin(12, 1, 2)})
    return g.withColumn("winter_pct", _pct("winter_n", "n"))


def month_share(final: DataFrame) -> DataFrame:
    """Monthly share of the year's accidents per country."""
    g = T.spine_counts(_country(final), "AccidentMonth", D.MONTH_LABELS, by=["country"], key_name="month")
    return g.withColumn("pct", T.share("n", ["country"]))


def season_severity(final: DataFrame) -> DataFrame:
    """Severity row % in winter vs rest of year, per country."""
    seasons = ["Winter", D.SEASON_SCHEMES["winter_vs_rest"][1]]
    g = T.grid_counts(_season(_country(final)), F.col("season"), seasons, F.col(SEV), D.SEVERITY_LABELS,
                      by=["country"], row_name="season", col_name="severity")
    return g.withColumn("row_pct", T.share("n", ["country", "season"]))


def severe_by_season(final: DataFrame) -> DataFrame:
    """Severe share per country and season under both presets (command
    line: winter share of 'serious only'; dashboard: 'serious or fatal')."""
    seasons = ["Winter", D.SEASON_SCHEMES["winter_vs_rest"][1]]
    g = T.spine_metrics(_season(_country(final)), "season", seasons, by=["country"],
                        metrics={"n": None,
                                 "severe_only_n": S.is_severe(SEV, "serious_only"),
                                 "severe_or_fatal_n": S.is_severe(SEV, "serious_or_fatal")})
    return (g.withColumn("severe_only_pct", _pct("severe_only_n", "n"))
            .withColumn("severe_or_fatal_pct", _pct("severe_or_fatal_n", "n")))


def winter_tests(final: DataFrame) -> DataFrame:
    """Chi-square country x season, and country x severity within winter."""
    d = _season(_country(final))
    seasons = ["Winter", D.SEASON_SCHEMES["winter_vs_rest"][1]]
    return T.chi_square(T.named_grids(d, [
        ("country_x_season", F.col("country"), D.COUNTRY_CODES, F.col("season"), seasons, None),
        ("winter_country_x_severity", F.col("country"), D.COUNTRY_CODES, F.col(SEV), D.SEVERITY_LABELS,
         F.col("season") == "Winter"),
    ]), "r", "c", by=["test"])


# --- G4: weekday -----------------------------------------------------------------

def weekday_stats(final: DataFrame) -> DataFrame:
    """Per weekday (overall and per country): accidents, share, fatal
    count and rate, fatal-with-motorcycle count and its share of fatal."""
    fatal = S.is_fatal(SEV)
    g = T.spine_metrics(T.with_scope(final), "AccidentWeekDay", D.WEEKDAY_LABELS, by=[T.SCOPE],
                        metrics={"n": None, "fatal_n": fatal, "fatal_moto_n": fatal & S.is_motorcycle()},
                        key_name="weekday")
    return (g.withColumn("share_pct", T.share("n", [T.SCOPE]))
            .withColumn("fatal_rate", _pct("fatal_n", "n", True))
            .withColumn("fatal_moto_rate", _pct("fatal_moto_n", "fatal_n", True)))


def weekday_winners(final: DataFrame) -> DataFrame:
    """G4 + T3: busiest weekday, deadliest by rate (among days with accidents)
    and by count, per scope; ties go to the earlier weekday (Q13)."""
    w = weekday_stats(final)

    def best(metric: str, cond: Column | None = None) -> Column:
        s = F.struct(F.col(metric).alias("m"), (-F.col("ordinal")).alias("o"), F.col("weekday").alias("d"),
                     F.col("fatal_moto_n").alias("fm"), F.col("fatal_n").alias("f"))
        return F.max(s if cond is None else F.when(cond, s))

    agg = w.groupBy(T.SCOPE).agg(best("n").alias("a"), best("fatal_rate", F.col("n") > 0).alias("b"),
                                 best("fatal_n").alias("c"))
    return agg.select(
        T.SCOPE,
        F.col("a.d").alias("busiest_day"), F.col("a.m").alias("busiest_n"),
        F.col("b.d").alias("deadliest_day"), F.col("b.m").alias("deadliest_rate"),
        F.col("c.d").alias("most_fatal_day"), F.col("c.m").alias("most_fatal_n"),
        F.col("b.fm").alias("deadliest_fatal_moto_n"), F.col("b.f").alias("deadliest_fatal_n"),
        F.col("a.fm").alias("busiest_fatal_moto_n"), F.col("a.f").alias("busiest_fatal_n"),
    )


def weekday_test(final: DataFrame) -> DataFrame:
    """Chi-square weekday x severity (empty weekdays dropped)."""
    g = T.grid_counts(final, F.col("AccidentWeekDay"), D.WEEKDAY_LABELS, F.col(SEV), D.SEVERITY_LABELS,
                      row_name="r", col_name="c")
    return _test(g, "weekday_x_severity", "r", "c")


# --- G5: night -------------------------------------------------------------------

def _is_night() -> Column:
    return F.col("NightAccident") == 1


def night_split(night: DataFrame) -> DataFrame:
    """day/night counts and shares, overall and per country."""
    g = T.spine_metrics(T.with_scope(night), T.SCOPE, SCOPES, metrics={"n": None, "n_night": _is_night()})
    return (g.drop("ordinal").withColumn("n_day", F.col("n") - F.col("n_night"))
            .withColumn("night_pct", _pct("n_night", "n")).withColumn("day_pct", _pct("n_day", "n")))


def night_motorcycle(night: DataFrame) -> DataFrame:
    """Motorcycle row % by day/night, overall and per country."""
    g = T.grid_counts(T.with_scope(night), S.night_label(), NIGHT_LABELS, _moto_label(), MOTO_LABELS,
                      by=[T.SCOPE], row_name="daynight", col_name="motorcycle")
    return g.withColumn("row_pct", T.share("n", [T.SCOPE, "daynight"]))


def night_severity(night: DataFrame) -> DataFrame:
    """Severity row % by day/night, overall and per country."""
    g = T.grid_counts(T.with_scope(night), S.night_label(), NIGHT_LABELS, F.col(SEV), D.SEVERITY_LABELS,
                      by=[T.SCOPE], row_name="daynight", col_name="severity")
    return g.withColumn("row_pct", T.share("n", [T.SCOPE, "daynight"]))


def night_tests(night: DataFrame) -> DataFrame:
    """Chi-square day/night x motorcycle and day/night x severity."""
    return T.chi_square(T.named_grids(night, [
        ("night_x_motorcycle", S.night_label(), NIGHT_LABELS, _moto_label(), MOTO_LABELS, None),
        ("night_x_severity", S.night_label(), NIGHT_LABELS, F.col(SEV), D.SEVERITY_LABELS, None),
    ]), "r", "c", by=["test"])


def night_by_month(night: DataFrame) -> DataFrame:
    """Night accidents, total and night rate per month (0 when empty),
    overall and per country."""
    g = T.spine_metrics(T.with_scope(night), "AccidentMonth", D.MONTH_LABELS, by=[T.SCOPE],
                        metrics={"n": None, "n_night": _is_night()}, key_name="month")
    return g.withColumn("night_pct", _pct("n_night", "n", True))


def night_month_winners(night: DataFrame) -> DataFrame:
    """G5 + T3: month with most night accidents and month with the highest rate; rates rank as shown,
    rounded to one decimal, and the earlier month wins a tie."""
    m = night_by_month(night).withColumn("shown_pct", F.round("night_pct", 1))
    key = lambda c: F.max(F.struct(F.col(c).alias("m"), (-F.col("ordinal")).alias("o"), F.col("month").alias("l")))
    agg = m.groupBy(T.SCOPE).agg(key("n_night").alias("a"), key("shown_pct").alias("b"))
    return agg.select(T.SCOPE, F.col("a.l").alias("most_night_month"), F.col("a.m").alias("most_night_n"),
                      F.col("b.l").alias("top_rate_month"), F.col("b.m").alias("top_rate_pct"))


def night_by_hour(night: DataFrame) -> DataFrame:
    """G5/G6 + A19: night share per numeric hour 0-23 with the hour's daypart bin
    (share NULL for an hour without accidents)."""
    g = T.spine_metrics(night, "AccidentHourNumeric", list(range(24)),
                        metrics={"n": None, "n_night": _is_night()}, key_name="hour")
    return (g.drop("ordinal").withColumn("hour_bin", S.hour_bin("hour"))
            .withColumn("night_pct", _pct("n_night", "n")))


def bin_shares(night: DataFrame) -> DataFrame:
    """G5/G6 + A18: % of night accidents outside the 'Nacht' bin, and % of the
    'Nacht' bin that is effectively day."""
    in_bin = F.col("AccidentHour") == "Nacht"
    g = night.agg(
        T.n_rows(night, _is_night()).alias("n_night"),
        T.n_rows(night, _is_night() & in_bin).alias("n_night_in_bin"),
        T.n_rows(night, in_bin).alias("n_bin"),
        T.n_rows(night, in_bin & ~_is_night()).alias("n_bin_day"),
    )
    return (g.withColumn("night_outside_bin_pct",
                         F.lit(100.0) - F.try_divide(F.col("n_night_in_bin") * 100.0, F.col("n_night")))
            .withColumn("bin_day_pct", _pct("n_bin_day", "n_bin")))


# --- G6: night by season -----------------------------------------------------------

def night_by_season(night: DataFrame) -> DataFrame:
    """Night rate per meteorological season."""
    groups, _ = D.SEASON_SCHEMES["meteorological"]
    d = _season(night, "meteorological")
    g = T.spine_metrics(d, "season", [s for s, _ in groups], metrics={"n": None, "n_night": _is_night()})
    return g.withColumn("night_pct", _pct("n_night", "n", True))


# --- G7: winter time -------------------------------------------------------------

def monthly_daylight(twilight: DataFrame, year: int = D.DEFAULT_YEAR) -> DataFrame:
    """Mean daylight (dawn to dusk, hours) per month over all points, unweighted."""
    ref_day = F.dayofmonth("ref_date") == D.REFERENCE_DAY
    return (twilight.where((F.col("year") == year) & ref_day).groupBy(F.col("month").alias("month_num"))
            .agg(F.avg("daylight_hours").alias("daylight_hours")))


def rate_vs_daylight(night: DataFrame, twilight: DataFrame, year: int = D.DEFAULT_YEAR) -> DataFrame:
    """G7 + J6: monthly night rate next to mean daylight (12 rows)."""
    m = night_by_month(night).where(F.col(T.SCOPE) == T.OVERALL).drop(T.SCOPE)
    day = monthly_daylight(twilight, year)   # at most 12 rows: safe to broadcast
    return m.join(F.broadcast(day), m["ordinal"] == day["month_num"], "left").drop("month_num")


def daylight_correlation(night: DataFrame, twilight: DataFrame, year: int = D.DEFAULT_YEAR) -> DataFrame:
    """G7 + A11/A12: Pearson r, r^2 and linear fit of night rate on daylight."""
    return T.correlation(rate_vs_daylight(night, twilight, year).where(F.col("n") > 0), "daylight_hours", "night_pct")


def season_rates(night: DataFrame) -> DataFrame:
    """G7 + A20: night rate in summer (Mai-Aug), transition and winter (Nov-Feb),
    and the winter/summer factor."""
    order = ["Sommer", "Übergang", "Winter"]
    d = _season(night, "daylight_thirds")
    g = T.spine_metrics(d, "season", order, metrics={"n": None, "n_night": _is_night()})
    g = g.withColumn("night_pct", _pct("n_night", "n"))
    w = F.max(F.when(F.col("season") == "Winter", F.col("night_pct"))).over(Window.partitionBy())
    s = F.max(F.when(F.col("season") == "Sommer", F.col("night_pct"))).over(Window.partitionBy())
    return g.withColumn("winter_summer_factor", F.try_divide(w, s))


def winter_summer_test(night: DataFrame) -> DataFrame:
    """Chi-square winter vs summer x night flag (2x2, Yates)."""
    d = _season(night, "daylight_thirds")
    g = T.grid_counts(d, F.col("season"), ["Winter", "Sommer"], F.col("NightAccident"), [0, 1],
                      row_name="r", col_name="c")
    return _test(g, "season_x_night", "r", "c")


# --- G8/G9: bin vs twilight -----------------------------------------------------------

def _cells(night: DataFrame) -> DataFrame:
    b = F.col("AccidentHour") == "Nacht"
    a = _is_night()
    cell = (F.when(b & a, "TP").when(b & ~a, "FP").when(~b & a, "FN").when(~b & ~a, "TN"))
    return night.withColumn("cell", cell)


def confusion_matrix(night: DataFrame) -> DataFrame:
    """G8 + A14: TN / FP / FN / TP counts and % of all rows."""
    g = T.spine_counts(_cells(night), "cell", ["TN", "FP", "FN", "TP"])
    return g.withColumn("pct", T.share("n"))


def errors_by_hour(night: DataFrame) -> DataFrame:
    """G8 + A15: false positives and false negatives per numeric hour."""
    d = _cells(night).where(F.col("cell").isin("FP", "FN") & F.col("AccidentHourNumeric").isNotNull())
    return (d.groupBy("cell", F.col("AccidentHourNumeric").alias("hour")).agg(T.n_rows(d).alias("n"))
            .orderBy("cell", "hour"))


def fn_by_bin(night: DataFrame) -> DataFrame:
    """G8 + A21: false negatives per daypart bin and their share of all FN."""
    d = _cells(night)
    g = T.spine_metrics(d, "AccidentHour", ["Vormittag", "Nachmittag", "Abend"],
                        metrics={"n": F.col("cell") == "FN"}, key_name="daypart")
    return g.withColumn("pct", T.share("n"))


def misclass_by_month(night: DataFrame) -> DataFrame:
    """G9 + A16 + A8: per month: false positives, and false negatives by bin."""
    d = _cells(night)
    fn = F.col("cell") == "FN"
    hour = F.col("AccidentHour")
    g = T.spine_metrics(d, "AccidentMonth", D.MONTH_LABELS, key_name="month", metrics={
        "fp_n": F.col("cell") == "FP",
        "fn_vormittag": fn & (hour == "Vormittag"),
        "fn_nachmittag": fn & (hour == "Nachmittag"),
        "fn_abend": fn & (hour == "Abend"),
    })
    return g.withColumn("fn_total", F.col("fn_vormittag") + F.col("fn_nachmittag") + F.col("fn_abend"))


# --- G10: monthly comparison table ------------------------------------------------------

def monthly_comparison(night: DataFrame, twilight: DataFrame, year: int = D.DEFAULT_YEAR) -> DataFrame:
    """G10 + A17 + P32: per month: daylight, bin night, twilight night, both,
    only twilight, only bin, total and twilight rate, plus German display text."""
    b = F.col("AccidentHour") == "Nacht"
    a = _is_night()
    g = T.spine_metrics(night, "AccidentMonth", D.MONTH_LABELS, key_name="month", metrics={
        "bin_night": b, "api_night": a, "both_night": b & a, "only_api": ~b & a, "only_bin": b & ~a, "total": None})
    g = g.withColumn("api_rate", _pct("api_night", "total", True))
    day = monthly_daylight(twilight, year)
    g = g.join(F.broadcast(day), g["ordinal"] == day["month_num"], "left").drop("month_num")
    return g.select(
        "*",
        S.german_hours("daylight_hours").alias("daylight_text"),
        *[S.german_int(c).alias(f"{c}_text") for c in
          ["bin_night", "api_night", "both_night", "only_api", "only_bin", "total"]],
        S.german_percent("api_rate").alias("api_rate_text"),
    )


# --- X3 / X4 -------------------------------------------------------------------------

def block_check(night: DataFrame) -> DataFrame:
    """Night share per 6-hour block of the numeric hour."""
    d = night.withColumn("block", S.hour_bin())
    g = T.spine_metrics(d, "block", D.DAYPART_LABELS, metrics={"n": None, "n_night": _is_night()})
    return g.withColumn("night_pct", _pct("n_night", "n"))


def region_rates(night: DataFrame) -> DataFrame:
    """Night rate per region (German states, Swiss cantons)."""
    return (night.groupBy("CantonCode").agg(T.n_rows(night).alias("n"), T.n_rows(night, _is_night()).alias("n_night"))
            .withColumn("country", S.country("CantonCode"))
            .withColumn("night_pct", _pct("n_night", "n")))
