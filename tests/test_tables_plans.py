"""Rules that the prepared text table reaches, the stable chi-square, and the shape of executed plans."""

from __future__ import annotations

from fractions import Fraction

import pytest

from crashlens.operators import joins, stats
from crashlens.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _run(spark, name):
    return catalog.queries()[name](spark, SF)


def test_prepared_table_reaches_every_rule(spark):
    reasons = {r["reason"] for r in _run(spark, "text_reason_counts").collect()}
    assert {"Invalid:AccidentYear", "Invalid:AccidentMonth", "Invalid:AccidentWeekDay", "Invalid:AccidentHour",
            "Invalid:AccidentSeverityCategory", "Invalid:AccidentInvolvingMotorcycle", "Missing:CantonCode"} <= reasons
    summary = _run(spark, "text_error_summary").first()
    assert summary["n_fully_invalid"] > 0 and summary["n_partly_invalid"] > 0
    assert _run(spark, "text_fully_invalid").count() == summary["n_fully_invalid"]
    assert _run(spark, "text_problem_values").filter("bad_value is not null").count() > 0


def test_partial_removal_leaves_survivors(spark):
    kept = _run(spark, "multiset_partial").count()
    assert 0 < kept < spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_copies_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(joins, "CHUNK", 4)
    df = spark.createDataFrame([("a",)] * 11 + [("b",)] * 4 + [("c",)], "k string")
    got = sorted((r.k, r.n) for r in joins.occurrence_number(df, ["k"], out="n").collect())
    assert got == [("a", i) for i in range(11)] + [("b", i) for i in range(4)] + [("c", 0)]
    errors = spark.createDataFrame([("a",)] * 2 + [("b",)] * 9, "k string")
    left = sorted(r.k for r in joins.remove_error_entries(df, errors).collect())
    assert left == ["a"] * 9 + ["c"]


@pytest.mark.parametrize("scale", [1, 10**10, 10**12])
def test_chi_square_does_not_cancel(spark, scale):
    table = [[7 * scale, 3 * scale + 1, 2 * scale], [14 * scale, 6 * scale, 4 * scale + 3], [0, 0, 0]]
    rows = [(str(i), str(j), n) for i, line in enumerate(table) for j, n in enumerate(line)]
    got = stats.chi_square(spark.createDataFrame(rows, "r string, c string, n long"), "r", "c").first()
    used = table[:2]
    total = sum(map(sum, used))
    exact = Fraction(0)
    for line in used:
        for j, n in enumerate(line):
            e = Fraction(sum(line) * (used[0][j] + used[1][j]), total)
            exact += (n - e) ** 2 / e
    assert got["dof"] == 2 and got["n_total"] == total
    assert got["chi2"] == pytest.approx(float(exact), rel=1e-2, abs=1e-9)


def test_chi_square_fills_absent_cells(spark):
    full = [("a", "x", 5), ("a", "y", 0), ("b", "x", 3), ("b", "y", 9), ("c", "x", 1), ("c", "y", 4)]
    schema = "r string, c string, n long"
    one = stats.chi_square(spark.createDataFrame(full, schema), "r", "c").first()
    two = stats.chi_square(spark.createDataFrame([r for r in full if r[2]], schema), "r", "c").first()
    assert one == two
    cells = stats.expected_counts(spark.createDataFrame(full, schema), "r", "c").collect()
    assert len(cells) == 6
    assert {(r.r, r.c): round(r.expected, 6) for r in cells}[("a", "y")] == round(5 * 13 / 22, 6)


def test_tests_read_their_input_once(spark):
    for name, scans in (("g2_chi2", 2), ("g3_chi2", 2), ("g5_chi2", 4)):
        assert _plan(_run(spark, name)).count("Scan parquet") == scans, name


def test_hour_lookup_is_shuffled_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _plan(_run(spark, "with_hour")).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scopes_double_counts_and_not_rows(spark):
    plan = _plan(_run(spark, "g1_motorcycle_severity"))
    rows_below_first_aggregate = plan[plan.rindex("HashAggregate"):]
    assert "explode" not in rows_below_first_aggregate


def test_clean_then_year_prunes_the_prepared_table(spark):
    from crashlens.operators import quality
    from crashlens.plans.stages import build_stages
    from pyspark.sql import functions as F

    from crashlens.sources import fixtures

    lazy = build_stages(fixtures.raw_de(spark, SF, True), fixtures.raw_ch(spark, SF, True))
    stored = build_stages(fixtures.raw_de(spark, SF, True), fixtures.raw_ch(spark, SF, True), materialise=True)
    plan = _plan(quality.filter_year(stored.clean, stored.year))
    assert "PartitionFilters: [isnotnull(AccidentYear" in plan
    for name in ("clean", "errors", "final"):
        a, b = getattr(lazy, name), getattr(stored, name)
        assert a.dtypes == b.dtypes
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_unknown_formats_are_refused(spark, tmp_path):
    from crashlens.sources import raw

    rows = spark.range(2).selectExpr("cast(id as string) k")
    rows.write.parquet(str(tmp_path / "table"))
    assert raw.read_raw(spark, str(tmp_path / "table")).columns == ["k"]  # told by the files in the folder
    rows.coalesce(1).write.text(str(tmp_path / "lines.dat"))  # one file: its first line is the header
    with pytest.raises(ValueError):
        raw.read_raw(spark, str(tmp_path / "lines.dat"))
    assert raw.read_raw(spark, str(tmp_path / "lines.dat"), fmt="csv").count() == 1
    with pytest.raises(ValueError):
        raw.read_raw(spark, "x.xlsx")


def test_cache_keeps_points_outside_the_regions(spark, tmp_path):
    import json

    from crashlens.functions import domains as D
    from crashlens.plans import analyses
    from crashlens.sources.twilight import load_twilight_cache

    _, lat, lng, _ = D.region_points()[0]
    cell = {"begin": "2024-01-15T06:00:00+00:00", "end": "2024-01-15T16:00:00+00:00"}
    far = {"begin": "2024-01-15T06:00:00+00:00", "end": "2024-01-15T18:00:00+00:00"}
    path = tmp_path / "cache.json"
    path.write_text(json.dumps({f"{lat},{lng},2024-01-15": cell, "1.5,2.5,2024-01-15": far}))
    cache = load_twilight_cache(spark, str(path))
    assert cache.filter("region_key is null").count() == 1
    assert [r.daylight_hours for r in analyses.monthly_daylight(cache).collect()] == [11.0]


def test_hour_files_share_out_the_table(spark):
    from pyspark.sql import functions as F

    from crashlens.sources import fixtures

    d = "/root/testdata/sf0.01"
    table = fixtures.lineitem(spark, d)
    de, ch = fixtures.hours_de(spark, d), fixtures.hours_ch(spark, d)
    assert de.count() + ch.count() == table.count()
    keys = {r[0].strip() for f in (de.select("UIDENTSTLAE"), ch.select("AccidentUID")) for r in f.distinct().collect()}
    assert len(keys) == table.select("l_orderkey").distinct().count()
    assert de.join(ch, F.trim("UIDENTSTLAE") == F.trim("AccidentUID")).limit(1).count() == 1
