"""Running totals over ranges, and the plans of the multiset removal."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from crashlens.functions import scalars as S
from crashlens.operators import joins, normalise, quality, stats
from crashlens.operators.numbering import in_ranges, running_totals
from crashlens.plans.stages import fixture_stages

from .conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(n, seed=0):
    r = random.Random(seed)
    return [(None if (x := r.randrange(6)) == 5 else ("hot" if x < 3 else f"k{r.randrange(40)}"), r.choice([None, *range(9)]), r.randrange(4)) for _ in range(n)]


@pytest.mark.parametrize("keys", [["k"], [], ["k", "o"]])
def test_running_totals(spark, keys):
    rows = _rows(700)
    df = spark.createDataFrame(rows, "k string, o int, w int").repartition(5)
    got = running_totals(df, keys, ["o"], {"place": None, "before": F.col("w")}).collect()
    groups = defaultdict(list)
    for row in rows:
        groups[tuple(dict(zip("kow", row))[k] for k in keys)].append(row)
    want = Counter()
    low = lambda v: (v is not None, v or "")
    for group in groups.values():
        total = 0
        for i, row in enumerate(sorted(group, key=lambda r: ((r[1] is not None, r[1] or 0), low(r[0]), r[2]))):
            want[(*row, i, total)] += 1
            total += row[2]
    assert Counter(map(tuple, got)) == want


def test_nothing_to_number(spark):
    assert running_totals(spark.createDataFrame([], "k string, o int"), ["k"], ["o"], {"n": None}).collect() == []


def test_a_hot_key_spreads_over_ranges(spark):
    """A key with a third of all rows lies in a good part of the ranges, and no window holds it whole."""
    df = spark.range(24_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 977)).alias("k"), F.col("id").alias("o"))
    cells = in_ranges(df, ["k"], ["o"], 16).groupBy("_range").agg(F.count_if(F.col("k") == "hot").alias("hot"), F.count(F.lit(1)).alias("n")).collect()
    assert len(cells) == 16 and sum(c.hot > 0 for c in cells) >= 5 and max(c.n for c in cells) < 24_000 / 16 * 2
    told = running_totals(df, ["k"], ["o"], {"n": None}, ranges=16)
    plan = _plan(told)
    assert "hashpartitioning(k" in plan and plan.count("Window [") >= 1
    for line in plan.splitlines():
        if "Window [" in line and "_in_n" in line:
            assert "[k" in line and "_range" in line
    assert told.where("k = 'hot'").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (0, 7999, 8000)


def test_multiset_removal_is_one_exchange_without_a_join(spark):
    st = fixture_stages(spark, SF001)
    plan = _plan(joins.remove_error_entries(st.merged, st.errors.drop(quality.ERROR_REASONS)))
    body = plan.split("== Initial Plan ==")[-1]
    assert body.count("Exchange ") == 1 and "Join" not in body and body.count("FileScan parquet") <= 4


@pytest.mark.parametrize("order", [None, ["o"], ["o", "k"]])
def test_first_matching_rows_go(spark, order):
    rows, errors = _rows(300, 1), [(k,) for k, _, _ in _rows(60, 2)] + [("absent",)] * 3
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, o int, w int, id int").repartition(4)
    err = spark.createDataFrame(errors, "k string")
    left = joins.remove_error_entries(df, err, order).collect()
    gone = Counter(e[0] for e in errors)
    want = []
    for k in {r[0] for r in rows}:
        mine = sorted(((*r, i) for i, r in enumerate(rows) if r[0] == k), key=lambda r: ((r[1] is not None, r[1] or 0), r[2] if order is None else 0, r[3] if order is None else 0))
        want += mine[gone[k]:]
    if order is None:
        assert sorted(map(str, map(tuple, left))) == sorted(map(str, want))
    else:  # rows equal in the order may stand in for one another
        assert Counter((r.k, r.o) for r in left) == Counter((r[0], r[1]) for r in want)


# --- numbers and blanks -------------------------------------------------------------------------

def test_numbers_are_not_java_syntax(spark):
    cells = {"5": 5, " 5 ": 5, "\xa05": 5, "5 ": 5, "5.0": 5, "1e2": 100, "+7": 7, "5d": None, "5D": None, "1f": None, "1F": None, "0x1p3": None,
             "0X1P3": None, "5\xa05": None, "": None, "nan": None, "inf": None, "5.5": None, "x": None, None: None}
    df = spark.createDataFrame([(k,) for k in cells], "c string")
    assert {r.c: r.n for r in df.select("c", S.lenient_int("c").alias("n")).collect()} == cells
    texts = ["\xa0k　", " k", "k\x85", "\x1ck\x1f ", "k​"]
    got = spark.createDataFrame([(t,) for t in texts], "c string").select(S.clean_text("c")).collect()
    assert [r[0] for r in got] == [t.strip() for t in texts]


# --- the chi-square tail --------------------------------------------------------------------------

def test_upper_gamma_quantiles(spark):
    """Published quantiles of the chi-square distribution, and exact tails for 2 and 4 degrees of freedom."""
    import math
    table = [(1, 3.841458820694124, 0.05), (1, 6.6348966010212145, 0.01), (2, 5.991464547107979, 0.05), (3, 7.814727903251179, 0.05),
             (5, 11.070497693516351, 0.05), (10, 18.307038053275146, 0.05), (10, 23.209251158954356, 0.01), (30, 43.77297182574219, 0.05),
             (100, 124.34211340400407, 0.05), (6, 0.0, 1.0)]
    table += [(2, x, math.exp(-x / 2)) for x in (1e-9, 0.5, 3.0, 40.0, 700.0)] + [(4, x, math.exp(-x / 2) * (1 + x / 2)) for x in (0.1, 5.0, 90.0, 1000.0)]
    df = spark.createDataFrame([(float(d), x, p) for d, x, p in table], "dof double, x double, p double")
    got = df.select("p", stats.upper_gamma(F.col("dof") / 2, F.col("x") / 2).alias("q")).collect()
    for r in got:
        assert r.q == pytest.approx(r.p, rel=1e-10, abs=1e-300)


def test_typed_reader_column_choice_and_preview(spark, tmp_path):
    """S3, S4 and T4 as a user calls them."""
    from crashlens.operators import display
    from crashlens.sources import raw
    (tmp_path / "x.csv").write_text("AccidentUID;n;extra\n007;4;a\n008;x;b\n")
    typed = raw.read_csv_typed(spark, str(tmp_path / "x.csv"), "AccidentUID string, n int, extra string", sep=";")
    assert [tuple(r) for r in typed.collect()] == [("007", 4, "a"), ("008", None, "b")]
    few = raw.select_columns(typed, ["n", "AccidentUID"], "table")
    assert few.columns == ["n", "AccidentUID"]
    with pytest.raises(raw.SchemaMismatch, match="table lacks nope"):
        raw.select_columns(typed, ["nope"], "table")
    assert normalise.HARMONISED and display.preview(typed, 1).count() == 1
