"""Statistics against the published goldens."""

import math

import pytest
from pyspark.sql import functions as F

from crashlens.operators import stats as T
from crashlens.sources import twilight as tw

# Published monthly night / total accidents, Jan..Dez.
NIGHT = [5248, 3637, 3066, 2006, 1815, 1471, 1578, 2239, 3132, 4531, 6042, 6355]
TOTAL = [17988, 16555, 20430, 23711, 28193, 28702, 29054, 28653, 27775, 24376, 21892, 18333]
DAYLIGHT = [9.6, 11.1, 13.0, 15.1, 17.0, 18.2, 17.6, 15.8, 13.8, 11.8, 10.1, 9.2]


def _counts(spark, cells):
    return spark.createDataFrame(cells, "r string, c string, n bigint")


def test_chi2_yates_golden(spark):
    # Winter (Nov-Feb) vs summer (Mai-Aug) x night: published chi2 17,603 (Yates).
    cells = [("Winter", "1", 21282), ("Winter", "0", 74768 - 21282), ("Sommer", "1", 7103), ("Sommer", "0", 114602 - 7103)]
    r = T.chi_square(_counts(spark, cells), "r", "c").collect()[0]
    assert r.dof == 1 and abs(r.chi2 - 17603.10) < 0.01 and r.p_value == 0.0 and r.significant
    r2 = T.chi_square(_counts(spark, cells), "r", "c", yates=False).collect()[0]
    assert abs(r2.chi2 - 17604.85) < 0.01


def _chi2_python(table):
    rows = [sum(r) for r in table]
    cols = [sum(c) for c in zip(*table)]
    n = sum(rows)
    return sum((table[i][j] - rows[i] * cols[j] / n) ** 2 / (rows[i] * cols[j] / n)
               for i in range(len(rows)) for j in range(len(cols)))


def test_chi2_rxc_with_zero_cell_and_zero_row(spark):
    table = [[10, 0, 5], [3, 8, 9], [7, 7, 1], [0, 0, 0]]  # last row all zero -> dropped
    cells = [(f"r{i}", f"c{j}", v) for i, row in enumerate(table) for j, v in enumerate(row)]
    r = T.chi_square(_counts(spark, cells), "r", "c").collect()[0]
    assert r.dof == 4 and r.n_total == 50
    assert math.isclose(r.chi2, _chi2_python(table[:3]), rel_tol=1e-12)


def test_p_value_matches_tabulated_quantiles(spark):
    # 95% quantiles of the chi-square distribution for dof 1..4.
    q95 = {1: 3.841459, 2: 5.991465, 3: 7.814728, 4: 9.487729}
    rows = [(d, q) for d, q in q95.items()]
    df = spark.createDataFrame(rows, "dof int, chi2 double")
    p = df.select("dof", F.reflect(F.lit("org.apache.commons.math3.special.Gamma"), F.lit("regularizedGammaQ"),
                                   (F.col("dof") / 2.0), (F.col("chi2") / 2.0)).cast("double").alias("p")).collect()
    for r in p:
        assert abs(r.p - 0.05) < 1e-6


def test_two_by_two_dof_and_single_row(spark):
    r = T.chi_square(_counts(spark, [("a", "x", 5), ("a", "y", 7)]), "r", "c").collect()[0]
    assert r.dof == 0 and r.chi2 == 0.0 and r.p_value == 1.0


def test_correlation_golden(spark):
    rates = [n * 100.0 / t for n, t in zip(NIGHT, TOTAL)]
    day = tw.solar_twilight(spark, 2024).groupBy("month").agg(F.avg("daylight_hours").alias("d")).orderBy("month")
    daylight = [r.d for r in day.collect()]
    assert [round(d, 1) for d in daylight] == DAYLIGHT
    df = spark.createDataFrame(list(zip(daylight, rates)), "x double, y double")
    r = T.correlation(df, "x", "y").collect()[0]
    assert round(r.r, 4) == -0.9605 and round(r.r2, 4) == 0.9226
    assert round(r.slope, 2) == -3.09 and round(r.intercept, 1) == 57.8


def test_season_totals_and_factor():
    w = [0, 1, 10, 11]  # Jan Feb Nov Dez
    s = [4, 5, 6, 7]    # Mai..Aug
    wn, wt = sum(NIGHT[i] for i in w), sum(TOTAL[i] for i in w)
    sn, st = sum(NIGHT[i] for i in s), sum(TOTAL[i] for i in s)
    assert (wn, wt, sn, st) == (21282, 74768, 7103, 114602)
    assert round((wn / wt) / (sn / st), 1) == 4.6


def test_spine_fill_and_row_pct(spark):
    df = spark.createDataFrame([("Mo", "Tot"), ("Mo", "Leicht"), ("Di", "Leicht")], "d string, s string")
    g = T.grid_counts(df, F.col("d"), ["Mo", "Di", "Mi"], F.col("s"), ["Tot", "Leicht"], row_name="d", col_name="s")
    g = g.withColumn("pct", T.share("n", ["d"]))
    rows = {(r.d, r.s): (r.n, r.pct) for r in g.collect()}
    assert rows[("Mi", "Tot")] == (0, None) and rows[("Mo", "Tot")] == (1, 50.0)
    sums = g.groupBy("d").agg(F.sum("pct").alias("t")).collect()
    assert all(r.t is None or abs(r.t - 100.0) < 1e-9 for r in sums)


def test_argmax_tie_goes_to_first_in_spine(spark):
    df = spark.createDataFrame([("Mo", 1, 5), ("Di", 2, 7), ("Mi", 3, 7)], "label string, ordinal int, n int")
    r = T.argmax(df, "label", "n", "ordinal").collect()[0]
    assert (r.label, r.value) == ("Di", 7)


@pytest.mark.parametrize("scheme,month,label", [("winter_vs_rest", 12, "Winter"), ("winter_vs_rest", None, "Rest des Jahres"),
                                                ("meteorological", 4, "Frühling"), ("daylight_thirds", 11, "Winter")])
def test_season_schemes(spark, scheme, month, label):
    from crashlens.functions import scalars as S
    df = spark.createDataFrame([(month,)], "m int")
    assert df.select(S.season(F.col("m"), scheme)).collect()[0][0] == label


def test_confusion_cells_sum_to_total(spark):
    from crashlens.plans import analyses as A
    from crashlens.plans.stages import fixture_stages
    from .conftest import SF001
    night = fixture_stages(spark, SF001).night
    cm = {r.cell: (r.n, r.pct) for r in A.confusion_matrix(night).collect()}
    assert sum(n for n, _ in cm.values()) == night.count()
    assert abs(sum(p for _, p in cm.values()) - 100.0) < 1e-9
    by_month = A.misclass_by_month(night).agg(F.sum("fp_n").alias("fp"), F.sum("fn_total").alias("fn")).collect()[0]
    assert (by_month.fp, by_month.fn) == (cm["FP"][0], cm["FN"][0])
