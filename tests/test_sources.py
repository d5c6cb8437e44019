"""File sources and sinks (S1-S4, S6-S8) and the file-based chain."""

import pytest

from crashlens.operators import normalise
from crashlens.plans.stages import file_stages, fixture_stages
from crashlens.sources import fixtures, raw

from .conftest import SF001


def _write_csv(df, path, sep):
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(str(path))


def test_separator_detection_and_string_read(spark, tmp_path):
    de = fixtures.raw_de(spark, SF001)
    _write_csv(de, tmp_path / "de", ";")
    assert raw.detect_separator(spark, str(tmp_path / "de")) == ";"
    back = raw.read_raw(spark, str(tmp_path / "de"))
    assert back.columns == de.columns and all(t == "string" for _, t in back.dtypes)
    assert back.count() == de.count()


def test_header_repair_and_contract(spark):
    ch = fixtures.raw_ch(spark, SF001).withColumnRenamed("AccidentSeverityCategory", "AccidentSeverityCaytegory")
    assert "AccidentSeverityCategory" in raw.repair_ch_header(ch).columns
    assert normalise.normalise_ch(ch).count() == ch.count()
    with pytest.raises(ValueError, match="Data_DE lacks UJAHR"):
        normalise.normalise_de(fixtures.raw_de(spark, SF001).drop("UJAHR"))


def test_excel_is_rejected(spark):
    with pytest.raises(ValueError, match="Excel"):
        raw.read_raw(spark, "/tmp/x.xlsx")


def test_partitioned_write_prunes_years(spark, tmp_path):
    st = fixture_stages(spark, SF001)
    out = str(tmp_path / "clean")
    raw.write_table(st.clean, out)
    back = spark.read.parquet(out).where("AccidentYear = 2024")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(AccidentYear" in plan
    assert back.count() == st.final.count()


def test_file_chain_matches_fixture_chain(spark, tmp_path):
    de, ch = fixtures.raw_de(spark, SF001), fixtures.raw_ch(spark, SF001)
    _write_csv(de, tmp_path / "de", ";")
    _write_csv(ch, tmp_path / "ch", ",")
    st = file_stages(spark, str(tmp_path / "de"), str(tmp_path / "ch"))
    ref = fixture_stages(spark, SF001)
    key = lambda t: tuple((x is None, str(x)) for x in t)
    got = sorted((tuple(r) for r in st.night.collect()), key=key)
    want = sorted((tuple(r) for r in ref.night.collect()), key=key)
    assert got == want


def test_materialise_night_partitioned_by_year(spark):
    from crashlens.plans.stages import materialise_night
    st = fixture_stages(spark, SF001)
    night = materialise_night(st, "night_test")
    assert night.columns == st.night.columns
    assert night.count() == st.night.count()
    plan = night.where("AccidentYear = 2024")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(AccidentYear" in plan


def test_missing_marks_become_null(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nNA,1\nn/a,NaN\nok,null\n")
    rows = raw.read_raw(spark, str(tmp_path / "x.csv")).collect()
    assert [tuple(r) for r in rows] == [(None, "1"), (None, None), ("ok", None)]


def test_files_with_swapped_headers_are_read_by_name(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d" / "b.csv").write_text("y;x\r\n3;4\r\n")
    (tmp_path / "d" / "c.csv").write_text("")
    rows = raw.read_raw(spark, str(tmp_path / "d")).collect()
    assert sorted((r.x, r.y) for r in rows) == [("1", "2"), ("4", "3")]


def test_text_error_table_is_parsed_leniently(spark):
    from crashlens.operators import joins
    df = spark.createDataFrame([("a", 2024), ("b", 2024), ("c", None)], "k string, AccidentYear bigint")
    err = spark.createDataFrame([("a", "2024.0"), ("c", "n/a")], "k string, AccidentYear string")
    assert sorted(r.k for r in joins.remove_error_entries(df, err).collect()) == ["b", "c"]
