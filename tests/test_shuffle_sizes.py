"""Shuffles that begin with as many partitions as their input asks for."""

import pytest

from crashlens.plans.stages import build_stages
from crashlens.sources import raw

INITIAL, ADVISORY = raw.INITIAL_PARTITIONS, raw.ADVISORY_SIZE


@pytest.fixture
def own_settings(spark):
    before = {k: spark.conf.get(k, None) for k in (INITIAL, ADVISORY)}
    for k in before:
        spark.conf.unset(k)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _extracts(spark, folder):
    rows = spark.range(3000)
    de = rows.selectExpr("concat('d', id) UIDENTSTLAE", "'2024' UJAHR", "'5' UMONAT", "'2' UWOCHENTAG", "string(id % 24) USTUNDE", "'9' ULAND", "'3' UKATEGORIE", "'0' IstKrad")
    ch = rows.selectExpr("concat('c', id) AccidentUID", "'2024' AccidentYear", "'5' AccidentMonth", "'aw401' AccidentWeekDay", "string(id % 24) AccidentHour", "'ZH' CantonCode",
                         "'as3' AccidentSeverityCategory", "'false' AccidentInvolvingMotorcycle")
    for name, df in (("de", de), ("ch", ch)):
        df.coalesce(1).write.parquet(str(folder / name))
    return spark.read.parquet(str(folder / "de")), spark.read.parquet(str(folder / "ch"))


def test_hour_join_begins_with_partitions_by_input(spark, tmp_path, monkeypatch, own_settings):
    extracts = _extracts(spark, tmp_path)
    build_stages(*extracts)
    assert spark.conf.get(INITIAL, None) is None  # small input: the session's number will do
    monkeypatch.setattr(raw, "PARTITION_BYTES", 1000)
    n = raw.partitions_for(*extracts)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = build_stages(*extracts).with_hour
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert any("Exchange hashpartitioning(_key" in line and f", {n})" in line for line in plan.split("\n"))
    assert rows.where("AccidentHourNumeric is not null").count() == 6000


def test_settings_of_the_session_stay(spark, tmp_path, monkeypatch, own_settings):
    extracts = _extracts(spark, tmp_path)
    spark.conf.set(INITIAL, "5000")
    spark.conf.set(ADVISORY, "3m")
    monkeypatch.setattr(raw, "PARTITION_BYTES", 1000)
    build_stages(*extracts)
    assert spark.conf.get(INITIAL) == "5000" and spark.conf.get(ADVISORY) == "3m"
