"""Folders of several files: their order, their headers, and tables that are replaced year by year."""

import gzip
import random

import pytest

from crashlens.operators import cube, joins, normalise
from crashlens.plans import analyses as A
from crashlens.plans.stages import file_stages, fixture_stages
from crashlens.sources import fixtures, raw

from .conftest import SF001


# --- J2 / W2: first hour in the order of files and lines -------------------------------------

@pytest.fixture
def small_splits(spark):
    """Splits of 4 kB, so that one file has many."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "4096")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_first_hour_comes_from_the_first_file(spark, tmp_path, small_splits):
    """Spark reads the large file's splits first; names decide all the same, and lines inside a file."""
    folder = tmp_path / "de"
    folder.mkdir()
    (folder / "a.csv").write_text("UIDENTSTLAE;USTUNDE\n" + "".join(f"k{i};1\n" for i in range(0, 6000, 7)))
    lines = [(i, h) for h in (2, 3, 4) for i in range(6000)]
    (folder / "b.csv").write_text("UIDENTSTLAE;USTUNDE\n" + "".join(f"k{i};{h}\n" for i, h in lines))
    with gzip.open(folder / "c.csv.gz", "wt") as f:
        f.write("USTUNDE;UIDENTSTLAE\n" + "".join(f"5;k{i}\n" for i in range(6100)))
    de = raw.read_raw(spark, str(folder), ordered=True)
    assert de.rdd.getNumPartitions() > 20
    ch = spark.createDataFrame([], "AccidentUID string, AccidentHour string")
    got = {r.AccidentUID: r.AccidentHourNumeric for r in joins.hour_lookup(de, ch).collect()}
    assert got == {f"k{i}": 1 if i < 6000 and i % 7 == 0 else 2 if i < 6000 else 5 for i in range(6100)}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_ordinal_is_the_order_of_names_and_lines(spark, tmp_path, small_splits, fmt):
    r = random.Random(4)
    wanted, n = [], 0
    for name, rows in (("b", 900), ("a", 20), ("c", 2500), ("d", 1)):
        table = spark.createDataFrame([(str(i), "x" * r.randrange(30)) for i in range(n, n + rows)], "id string, pad string").coalesce(1)
        part = str(tmp_path / "parts" / name)
        (table.write.option("header", True).csv(part) if fmt == "csv" else table.write.parquet(part))
        file = next((tmp_path / "parts" / name).glob(f"part-*.{'csv' if fmt == 'csv' else 'snappy.parquet'}"))
        (tmp_path / "all").mkdir(exist_ok=True)
        file.rename(tmp_path / "all" / f"{name}.{fmt}")
        wanted.append((name, [str(i) for i in range(n, n + rows)]))
        n += rows
    got = [x.id for x in raw.read_raw(spark, str(tmp_path / "all"), fmt=fmt, ordered=True).orderBy(raw.ORDINAL).collect()]
    assert got == [i for _, ids in sorted(wanted) for i in ids]


# --- S1 / S8: headers that differ from file to file --------------------------------------------

def test_reordered_and_misspelt_headers(spark, tmp_path):
    rows = [[c if c is not None else "" for c in r] for r in fixtures.raw_ch(spark, SF001).collect()]
    names = fixtures.raw_ch(spark, SF001).columns
    folder = tmp_path / "ch"
    folder.mkdir()
    thirds = [rows[i::3] for i in range(3)]
    turned = list(reversed(range(len(names))))
    misspelt = ["AccidentSeverityCaytegory" if c == "AccidentSeverityCategory" else c for c in names]
    for name, sep, header, part in (("1.csv", ",", names, thirds[0]), ("2.csv", ";", [names[i] for i in turned], [[r[i] for i in turned] for r in thirds[1]]),
                                    ("3.csv", "\t", misspelt, thirds[2])):
        (folder / name).write_text("\n".join(sep.join(line) for line in [header, *part]) + "\n")
    whole = raw.read_raw(spark, str(folder), repair=raw.repair_ch_header, required=normalise.CH_REQUIRED)
    single = [raw.read_raw(spark, str(folder / f"{i}.csv"), repair=raw.repair_ch_header) for i in (1, 2, 3)]
    pick = lambda t: [tuple(r) for r in t.select(*names).collect()]
    key = lambda t: tuple((x is None, x) for x in t)
    assert len(whole.columns) == len(names)
    assert sorted(pick(whole), key=key) == sorted((r for t in single for r in pick(t)), key=key)
    assert whole.count() == len(rows)


def test_a_file_without_a_required_column_is_named(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d" / "b.csv").write_text("x,z\n1,2\n")
    with pytest.raises(raw.SchemaMismatch, match="b.csv.* lacks y"):
        raw.read_raw(spark, str(tmp_path / "d"), required=["x", "y"])
    rows = raw.read_raw(spark, str(tmp_path / "d")).select("x", "y", "z").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("1", "2", None), ("1", None, "2")], key=str)


def test_file_chain_over_several_files_keeps_the_first_hour(spark, tmp_path):
    """The chain from a folder of files equals the chain from one file with the same lines."""
    header = "UIDENTSTLAE;UJAHR;UMONAT;UWOCHENTAG;USTUNDE;ULAND;UKATEGORIE;IstKrad"
    line = lambda k, h: f"{k};2024;5;2;{h};9;3;0"
    first, second = [line(f"u{i % 50}", i % 24) for i in range(120)], [line(f"u{i}", 23 - i % 24) for i in range(400)]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.csv").write_text("\n".join([header, *first]) + "\n")
    (tmp_path / "many" / "b.csv").write_text("\n".join([header, *second]) + "\n")
    (tmp_path / "one.csv").write_text("\n".join([header, *first, *second]) + "\n")
    (tmp_path / "ch.csv").write_text("AccidentUID,AccidentYear,AccidentMonth,AccidentWeekDay,AccidentHour,CantonCode,"
                                     "AccidentSeverityCategory,AccidentInvolvingMotorcycle\nc1,2024,5,aw401,7,ZH,as3,false\n")
    rows = [sorted(map(tuple, file_stages(spark, str(tmp_path / p), str(tmp_path / "ch.csv")).night.collect())) for p in ("many", "one.csv")]
    assert rows[0] == rows[1] and len(rows[0]) == 521


# --- S6: years replaced one by one ------------------------------------------------------------

def _years(spark, path, schema):
    return sorted((r.AccidentYear, r.k) for r in raw.read_years(spark, path, schema).collect())


def test_replacing_a_year_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "table")
    table = spark.createDataFrame([(2023, "a"), (2023, "b"), (2024, "c"), (2025, "d")], "AccidentYear bigint, k string")
    assert raw.read_years(spark, path, table.schema).collect() == []
    assert raw.replace_years(table, path) == [2023, 2024, 2025]
    before = raw.read_years(spark, path, table.schema)  # a reader that began before
    assert raw.replace_years(spark.createDataFrame([(2024, "x"), (2023, "not asked for")], table.schema), path, [2024]) == [2024]
    assert _years(spark, path, table.schema) == [(2023, "a"), (2023, "b"), (2024, "x"), (2025, "d")]
    assert sorted(r.k for r in before.collect()) == ["a", "b", "c", "d"]
    raw.replace_years(table.where("false"), path, [2025])
    assert _years(spark, path, table.schema) == [(2023, "a"), (2023, "b"), (2024, "x")]
    assert raw.drop_old_batches(spark, path) == 2
    assert _years(spark, path, table.schema) == [(2023, "a"), (2023, "b"), (2024, "x")]
    plan = raw.read_years(spark, path, table.schema).where("AccidentYear = 2024")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(AccidentYear" in plan


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    table = spark.createDataFrame([(2023, "a"), (2024, "b")], "AccidentYear bigint, k string")
    raw.replace_years(table, path)
    broken = spark.range(2000).selectExpr("2024L as AccidentYear", "if(id = 1999, raise_error('broken'), string(id)) as k").repartition(4)
    with pytest.raises(Exception, match="broken"):
        raw.replace_years(broken, path, [2024])
    assert _years(spark, path, table.schema) == [(2023, "a"), (2024, "b")]


# --- the table of counts ------------------------------------------------------------------------

def test_counts_of_two_years_add_up_to_one_run(spark, tmp_path):
    night = raw.materialise(fixture_stages(spark, SF001).night_all_years, "all-years")
    path = str(tmp_path / "counts")
    years = [r[0] for r in night.select("AccidentYear").distinct().collect()]
    assert len(years) > 3
    for year in years:  # year by year, and one of them in two parts
        part = night.where(night.AccidentYear == year)
        if year == years[0]:
            cube.add(cube.counts(part.where("AccidentMonth < 'J'")), path)
            cube.add(cube.counts(part.where("AccidentMonth >= 'J'")), path)
        else:
            cube.write(cube.counts(part), path, [year])
    rows = lambda t: sorted((tuple(r) for r in t.select(*cube.DIMENSIONS, cube.ROWS).collect()), key=str)
    stored = cube.read(spark, path)
    assert rows(stored) == rows(cube.counts(night)) == rows(cube.merged(*[cube.counts(night.where(night.AccidentYear == y)) for y in years]))
    # an analysis over several years, from rows and from counts
    for fn in (A.night_by_month, A.weekday_winners, A.confusion_matrix, A.region_rates, A.daypart_tests, A.bin_shares):
        assert sorted(map(str, fn(night).collect())) == sorted(map(str, fn(stored).collect()))


def test_each_year_has_its_own_twilight(spark):
    from crashlens.sources.twilight import solar_twilight
    night = fixture_stages(spark, SF001).night_all_years
    assert night.where("NightAccident is null").count() == 0
    years = {r.AccidentYear for r in night.select("AccidentYear").distinct().collect()}
    dim = {(r.region_key, r.year, r.month): (r.dawn_hour, r.dusk_hour) for r in solar_twilight(spark, sorted(years)).collect()}
    months = {m: i + 1 for i, m in enumerate(__import__("crashlens.functions.domains", fromlist=["x"]).MONTH_LABELS)}
    for r in night.collect():
        dawn, dusk = dim["CH" if r.CantonCode.endswith("_CH") else r.CantonCode, r.AccidentYear, months[r.AccidentMonth]]
        h = r.AccidentHourNumeric
        assert r.NightAccident == int(h is not None and (h < dawn or h > dusk))


# --- the prepared table: buckets of the key, reason bits ------------------------------------------

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_hour_join_on_buckets_needs_no_exchange(spark, no_broadcast, monkeypatch):
    prepared = fixture_stages(spark, SF001, materialise=True)
    lazy = fixture_stages(spark, SF001)
    assert prepared.prepared.hot is None
    plan = _plan(prepared.with_hour)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "PartitionFilters: [isnotnull(AccidentYear" in plan
    assert "PushedFilters: [IsNotNull(_bits), EqualTo(_bits,0)]" in plan
    assert "Exchange" in _plan(lazy.with_hour)
    key = lambda r: str(tuple(r))
    assert sorted(prepared.with_hour.collect(), key=key) == sorted(lazy.with_hour.collect(), key=key)
    prepared.prepared.drop()


def test_hot_keys_stay_out_of_the_buckets(spark, no_broadcast):
    from crashlens.operators.normalise import LOOKUP_HOUR, LOOKUP_RANK
    from crashlens.sources import keyed
    rows = [(None if i % 3 == 0 else "hot" if i % 5 == 0 else f"k{i % 400}", i % 24, i) for i in range(3000)]
    base = spark.createDataFrame([(k, 2024, h, i) for k, h, i in rows], f"AccidentUID string, AccidentYear bigint, {LOOKUP_HOUR} bigint, {LOOKUP_RANK} bigint")
    table = keyed.write_keyed(joins.with_key(base), joins.KEY, "t", ["AccidentYear"], least=100)
    assert {(r.AccidentUID) for r in table.hot.select("AccidentUID").distinct().collect()} == {None, "hot"}
    assert table.cold.where("AccidentUID is null or AccidentUID = 'hot'").count() == 0 and table.rows().count() == 3000
    out = joins.add_hour_in_buckets(table, lambda part: part.select("AccidentUID", LOOKUP_RANK, *joins.KEY))
    first = {}
    for k, h, i in rows:
        first.setdefault(k, h)
    assert sorted((r[LOOKUP_RANK], r.AccidentHourNumeric) for r in out.collect()) == [(i, first[k]) for k, _, i in rows]
    cold = _plan(joins.add_hour_in_buckets(keyed.KeyedTable(table.cold, None, ""), lambda part: part.select("AccidentUID", *joins.KEY)))
    assert "Exchange" not in cold


def test_reports_read_the_bits_alone(spark):
    from crashlens.operators import quality
    table = quality.PreparedRows.of(fixtures.prepared(spark, SF001).select(*normalise.HARMONISED))
    for report in (table.summary(), table.reason_counts()):
        assert "ReadSchema: struct<_bits:bigint>" in _plan(report)
    text = fixtures.prepared(spark, SF001).select(*normalise.HARMONISED)
    assert table.summary().collect() == quality.error_summary(text).collect()
    key = lambda r: str(tuple(r))
    assert sorted(table.enriched().collect(), key=key) == sorted(quality.enrich_errors(quality.find_errors(text)).collect(), key=key)
    assert sorted(table.enriched(fully=False).collect(), key=key) == sorted(quality.split_errors(quality.enrich_errors(quality.find_errors(text)), False).collect(), key=key)
    wide = text.select("*", *[text.CantonCode.alias(f"c{i}") for i in range(60)])
    with pytest.raises(ValueError, match="do not fit"):
        quality.reason_bits(wide, "all")


def test_extracts_are_normalised_once_in_small_loops(spark, monkeypatch, capsys):
    """Hot keys, buckets and hot rows come from one copy, and the JVM compiles the loops that make it (up to 8,000 bytes)."""
    from crashlens.plans import stages
    made, materialise = [], raw.materialise
    monkeypatch.setattr(stages.raw, "materialise", lambda df, name, *a: made.append((name, df)) or materialise(df, name, *a))
    table = fixture_stages(spark, SF001, materialise=True).prepared
    assert [name for name, _ in made] == ["harmonised"] and table.rows().count() == made[0][1].count()
    capsys.readouterr()
    made[0][1].explain("codegen")
    sizes = [int(line.split("maxMethodCodeSize:")[1].split(";")[0]) for line in capsys.readouterr().out.split("\n") if "maxMethodCodeSize:" in line]
    assert sizes and max(sizes) < 8000
    table.drop()


def test_buckets_grow_with_the_input(spark, tmp_path, monkeypatch):
    from crashlens.sources import keyed
    rows = spark.range(5000).selectExpr("string(id) as AccidentUID", "id % 7 as AccidentYear")
    rows.coalesce(1).write.parquet(str(tmp_path / "some rows"))
    base = joins.with_key(spark.read.parquet(str(tmp_path / "some rows")))
    assert raw.partitions_for(base) == int(spark.conf.get("spark.sql.shuffle.partitions")) == raw.partitions_for(rows)
    monkeypatch.setattr(raw, "PARTITION_BYTES", 1000)
    n = raw.partitions_for(base, base)
    assert n > 8
    table = keyed.write_keyed(base, joins.KEY, "t")
    assert table.cold.groupBy(*joins.KEY).count().rdd.getNumPartitions() == n
    table.drop()
