"""Twilight dimension (S5, X1) against FIXTURES.md section 3, and the driver contract."""

import json
import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from crashlens.functions import domains as D
from crashlens.sources import twilight as tw

from .conftest import SF001

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _fixture_table():
    text = open(os.path.join(HERE, "FIXTURES.md"), encoding="utf-8").read()
    section = text.split("## 3.")[1].split("## 4.")[0]
    table = {}
    for line in section.splitlines():
        m = re.match(r"\|\s*(\w+_DE|CH)\s*\|(.*)\|\s*$", line)
        if m:
            cells = [c.strip() for c in m.group(2).split("|")]
            table[m.group(1)] = [tuple(int(x) for x in c.split("/")) for c in cells]
    return table


def test_solar_dimension_matches_published_hours(spark):
    want = _fixture_table()
    assert len(want) == 17
    got = {(r.region_key, r.month): (r.dawn_hour, r.dusk_hour) for r in tw.solar_twilight(spark, 2024).collect()}
    mismatches = [(k, m) for k, row in want.items() for m, hrs in enumerate(row, 1) if got[(k, m)] != hrs]
    assert mismatches == []


def test_cache_loader(spark, tmp_path):
    lat, lng = D.DE_POINTS["SH_DE"]
    cache = {f"{lat},{lng},2024-05-15": {"begin": "2024-05-15T02:29:54+00:00", "end": "2024-05-15T20:05:15+00:00"},
             f"{D.CH_POINT[0]},{D.CH_POINT[1]},2024-01-15": {"begin": "2024-01-15T07:33:56+01:00",
                                                              "end": "2024-01-15T16:38:43+00:00"},
             "1.0,2.0,2024-01-15": {"begin": "2024-01-15T06:00:00+00:00", "end": "2024-01-15T16:00:00+00:00"}}
    p = tmp_path / "cache.json"
    p.write_text(json.dumps(cache))
    rows = {(r.region_key, r.month): r for r in tw.load_twilight_cache(spark, str(p)).collect()}
    assert set(rows) == {("SH_DE", 5), ("CH", 1), (None, 1)}  # a point outside the regions stays, without one
    assert (rows[("SH_DE", 5)].dawn_hour, rows[("SH_DE", 5)].dusk_hour) == (4, 22)
    assert rows[("CH", 1)].dawn_hour == 7  # 06:33:56 UTC after applying the +01:00 offset
    assert abs(rows[("SH_DE", 5)].daylight_hours - (17 * 3600 + 35 * 60 + 21) / 3600) < 1e-9


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 36 and set(df.columns) >= {"scope", "month", "n", "n_night", "night_pct"}


def test_queries_have_oracles():
    from crashlens.plans import catalog, oracle
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(E.queries()) >= set(catalog.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["harmonised", "night_classified", "g1_chi2", "g4_winners", "g7_correlation",
                                  "g10_monthly_table", "clean_rows_multiset", "error_enriched"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF001}/lineitem.parquet')")
    sdf = E.queries()[name](spark, SF001)
    cols = sorted(sdf.columns)
    key = lambda t: tuple((x is None, str(x)) for x in t)
    s = sorted((tuple(r[c] for c in cols) for r in sdf.collect()), key=key)
    res = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in res.description]
    d = sorted((tuple(row[names.index(c)] for c in cols) for row in res.fetchall()), key=key)
    assert sorted(names) == cols
    assert s == d


def test_cache_with_extra_days_keeps_one_row_per_month(spark, tmp_path):
    from crashlens.operators.night import classify_night
    lat, lng = D.DE_POINTS["BE_DE"]
    cache = {f"{lat},{lng},2024-01-{d:02d}": {"begin": "2024-01-15T06:30:26+00:00", "end": "2024-01-15T16:00:48+00:00"}
             for d in (14, 15, 16)}
    p = tmp_path / "cache.json"
    p.write_text(json.dumps(cache))
    dim = tw.load_twilight_cache(spark, str(p))
    df = spark.createDataFrame([("1", "Jan", "BE_DE", 5)], "AccidentUID string, AccidentMonth string, CantonCode string, AccidentHourNumeric bigint")
    out = classify_night(df, dim).collect()
    assert len(out) == 1 and out[0].NightAccident == 1


def test_missing_hour_day_or_error(spark):
    from crashlens.operators.night import classify_night
    dim = tw.solar_twilight(spark, 2024)
    df = spark.createDataFrame([("1", "Jan", "ZH_CH", None)], "AccidentUID string, AccidentMonth string, CantonCode string, AccidentHourNumeric bigint")
    assert classify_night(df, dim).collect()[0].NightAccident == 0
    with pytest.raises(Exception, match="numeric hour missing"):
        classify_night(df, dim, on_missing_hour="error").collect()


def test_missing_twilight_is_unknown_or_an_error(spark):
    from crashlens.operators.night import classify_night
    dim = tw.solar_twilight(spark, 2024)
    df = spark.createDataFrame([("1", "Jan", "XX_DE", 3)], "AccidentUID string, AccidentMonth string, CantonCode string, AccidentHourNumeric bigint")
    assert classify_night(df, dim).collect()[0].NightAccident is None
    with pytest.raises(Exception, match="no twilight for XX_DE Jan"):
        classify_night(df, dim, on_missing_twilight="error").collect()
