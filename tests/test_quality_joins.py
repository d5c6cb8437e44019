"""Quality operators and joins: multiset properties and J4 edge cases."""

import pytest
from pyspark.sql import functions as F

from crashlens.operators import joins, quality
from crashlens.plans.stages import fixture_stages

from .conftest import SF001

COLS = "AccidentUID string, AccidentYear bigint, AccidentMonth string, AccidentWeekDay string, AccidentHour string, " \
       "CantonCode string, AccidentSeverityCategory string, AccidentInvolvingMotorcycle bigint"


def _key(t):
    return tuple((x is None, str(x)) for x in t)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=_key)


def test_clean_union_errors_is_merged(spark):
    st = fixture_stages(spark, SF001)
    merged, clean = _rows(st.merged), _rows(st.clean)
    errors = _rows(st.errors.drop("ErrorReasons"))
    assert sorted(clean + errors, key=_key) == merged
    assert len(errors) > 0


def test_j4_equals_mask_removal(spark):
    st = fixture_stages(spark, SF001)
    removed = joins.remove_error_entries(st.merged, st.errors.drop("ErrorReasons"))
    assert _rows(removed) == _rows(st.clean)


def test_j4_removes_one_of_two_equal_rows_with_nulls(spark):
    row = ("7", None, "Jan", "Mo", "Nacht", None, "Tot", 1)
    df = spark.createDataFrame([row, row, ("8", 2024, "Feb", "Di", "Abend", "ZH_CH", "Leicht", 0)], COLS)
    err = spark.createDataFrame([row], COLS)
    out = _rows(joins.remove_error_entries(df, err))
    assert out.count(row) == 1 and len(out) == 2


def test_j4_empty_errors_and_no_common_columns(spark):
    df = spark.createDataFrame([("1", 2024, "Jan", "Mo", "Nacht", "ZH_CH", "Tot", 1)], COLS)
    empty = spark.createDataFrame([], COLS)
    assert _rows(joins.remove_error_entries(df, empty)) == _rows(df)
    assert _rows(joins.remove_error_entries(df, spark.createDataFrame([], "x int"))) == _rows(df)
    with pytest.raises(ValueError):
        joins.remove_error_entries(df, spark.createDataFrame([(1,)], "x int"))


def test_j4_subset_of_columns_removes_earliest(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").coalesce(1)
    err = spark.createDataFrame([("a",)], "k string")
    assert _rows(joins.remove_error_entries(df, err, order_by=["v"])) == [("a", 2), ("b", 3)]


def test_occurrence_number(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, v int")
    out = {(r.k, r.v): r._occ for r in joins.occurrence_number(df, ["k"], ["v"]).collect()}
    assert sorted(out[(k, v)] for (k, v) in out if k == "a") == [0, 1]
    assert sorted(out[(k, v)] for (k, v) in out if k is None) == [0, 1]
    assert out[("b", 5)] == 0


def test_hour_lookup_prefers_swiss_then_first(spark):
    de = spark.createDataFrame([(" X1 ", "5"), ("X2", "x"), ("X3", "7"), ("X3", "9")], "UIDENTSTLAE string, USTUNDE string") \
        .withColumn("_ord", F.monotonically_increasing_id())
    ch = spark.createDataFrame([("X1", "3.0"), ("X2", "06-12")], "AccidentUID string, AccidentHour string") \
        .withColumn("_ord", F.monotonically_increasing_id())
    got = dict((r[0], r[1]) for r in joins.hour_lookup(de, ch).collect())
    assert got == {"X1": 3, "X3": 7}


def test_enrich_errors_fully_and_partly(spark):
    df = spark.createDataFrame([(None,) * 8, ("1", None, "Jan", "Mo", "Nacht", "ZH_CH", "Tot", 1)], COLS)
    errs = quality.enrich_errors(quality.find_errors(df)).orderBy("IssueCount").collect()
    assert (errs[0].IssueCount, errs[0].IsFullyInvalid, errs[0].ProblemColumns) == (1, False, "AccidentYear")
    assert (errs[1].IssueCount, errs[1].IsFullyInvalid, errs[1].ProblemColumnsCount) == (8, True, 8)
    s = quality.error_summary(df).collect()[0]
    assert (s.n_error_rows, s.n_fully_invalid, s.n_partly_invalid, s.mean_issues) == (2, 1, 1, 4.5)


def test_invalid_values_are_reported(spark):
    df = spark.createDataFrame([("1", 2024, "Foo", "Mo", "Nacht", "ZH_CH", "Tot", 2)], COLS)
    r = quality.find_errors(df).collect()[0]
    assert r.ErrorReasons == "Invalid:AccidentMonth; Invalid:AccidentInvolvingMotorcycle"
    pv = {(x.kind, x.column_name, x.bad_value): x.n for x in quality.problem_values(df).collect()}
    assert pv == {("Invalid", "AccidentMonth", "Foo"): 1, ("Invalid", "AccidentInvolvingMotorcycle", "2"): 1}


def test_duplicates_and_profile(spark):
    df = spark.createDataFrame([("1",), ("1",), (None,), (None,), ("2",)], "AccidentUID string")
    assert quality.duplicate_count(df).collect()[0].n_duplicates == 2
    p = quality.table_profile(df).collect()[0]
    assert (p.n_rows, p.n_columns, p.empty_cells) == (5, 1, 2)


def test_hour_lookup_from_harmonised_equals_raw_lookup(spark):
    st = fixture_stages(spark, SF001)
    assert _rows(joins.hour_lookup_from(st.harmonised)) == _rows(joins.hour_lookup(st.de_raw, st.ch_raw))


def test_materialised_chain_equals_lazy_chain(spark):
    from crashlens.plans.stages import Stages
    lazy = fixture_stages(spark, SF001)
    mat = Stages(lazy.de_raw, lazy.ch_raw, materialise=True)
    assert _rows(mat.night) == _rows(lazy.night)


def test_j4_hot_group_across_partitions(spark):
    hot = [("h", 1)] * 900
    df = spark.createDataFrame(hot + [("x", i) for i in range(100)], "k string, v int").repartition(8)
    err = spark.createDataFrame([("h", 1)] * 300 + [("x", 5), ("zz", 0)], "k string, v int")
    out = joins.remove_error_entries(df, err)
    counts = {r.k: r.n for r in out.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert counts == {"h": 600, "x": 99}
    # fewer columns compared: 300 of the 'h' rows and one 'x' row go
    sub = joins.remove_error_entries(df, err.select("k").where("k != 'x'"))
    counts = {r.k: r.n for r in sub.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert counts == {"h": 600, "x": 100}
