"""Edge rows of FIXTURES.md section 4."""

from pyspark.sql import functions as F

from crashlens.functions import domains as D
from crashlens.functions import scalars as S
from crashlens.operators import normalise


def _one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_hour_to_daypart(spark):
    vals = [" 05 ", "5.0", "23.9", "24", "-0.5", "06-12", "Abend", "x", None]
    assert _one_col(spark, vals, S.hour_to_daypart) == [
        "Nacht", "Nacht", "Abend", None, "Nacht", "Vormittag", "Abend", None, None]


def test_motorcycle_flag(spark):
    vals = ["1", "TRUE", "False", "1.0", " 1", "tRuE", "0.0", "ja", None]
    assert _one_col(spark, vals, S.motorcycle_flag) == [1, 1, 0, 1, None, None, 0, None, None]


def test_lenient_int(spark):
    vals = ["2024", "2024.0", "n/a", "1.5", " 7 ", "NaN", None, "1e3", "+5"]
    assert _one_col(spark, vals, S.lenient_int) == [2024, 2024, None, None, 7, None, None, 1000, 5]


def test_canton_lookup(spark):
    vals = [" ZH ", "ZG", "FL", None]
    assert _one_col(spark, vals, lambda c: S.lookup(S.clean_text(c), D.CH_REGIONS)) == ["ZH_CH", None, "FL_CH", None]


def test_night_flag(spark):
    df = spark.createDataFrame([(6,), (7,), (17,), (18,), (None,)], "h int")
    got = [r[0] for r in df.select(S.night_flag(F.col("h"), F.lit(7), F.lit(17))).collect()]
    assert got == [1, 0, 0, 1, 0]


def test_location_flip_and_round_trip(spark):
    vals = ["AG_CH", "ch_ag", "ABC", "A_B_C", None]
    assert _one_col(spark, vals, S.location_to_display) == ["CH_AG", "CH_AG", "ABC", "A_B_C", None]
    internal = ["AG_CH", "BW_DE", "ZH_CH"]
    back = _one_col(spark, internal, lambda c: S.location_to_internal(S.location_to_display(c)))
    assert back == internal


def test_severe_presets(spark):
    vals = ["Tot", "Schwer", "Leicht", " schwer ", None]
    assert _one_col(spark, vals, lambda c: S.is_severe(c, "serious_or_fatal")) == [True, True, False, True, False]
    assert _one_col(spark, vals, lambda c: S.is_severe(c, "serious_only")) == [False, True, False, True, False]
    assert _one_col(spark, vals, S.is_fatal) == [True, False, False, False, False]


def test_normalise_header_typo_and_missing_uid(spark):
    ch = spark.createDataFrame(
        [("2024", "1", "aw401", "5", "ZH", "as4", "true")],
        "AccidentYear string, AccidentMonth string, AccidentWeekDay string, AccidentHour string, "
        "CantonCode string, AccidentSeverityCaytegory string, AccidentInvolvingMotorcycle string")
    row = normalise.normalise_ch(ch).collect()[0]
    assert row.AccidentUID is None and row.AccidentSeverityCategory is None  # as4 -> NULL (Q6)
    assert (row.AccidentMonth, row.AccidentWeekDay, row.AccidentHour, row.CantonCode) == ("Jan", "Mo", "Nacht", "ZH_CH")
    assert row.AccidentInvolvingMotorcycle == 1


def test_normalise_de_codes(spark):
    de = spark.createDataFrame(
        [(" 42 ", "2024", "12", "1", "18", "16", "1", "0")],
        "UIDENTSTLAE string, UJAHR string, UMONAT string, UWOCHENTAG string, USTUNDE string, "
        "ULAND string, UKATEGORIE string, IstKrad string")
    r = normalise.normalise_de(de).collect()[0]
    assert tuple(r) == ("42", 2024, "Dez", "So", "Abend", "TH_DE", "Tot", 0)


def test_display_schema_round_trip(spark):
    from crashlens.operators import display
    df = spark.createDataFrame([("1", 2024, "Jan", "Mo", "Nacht", "AG_CH", "Tot", 1, "Missing:AccidentYear; Invalid:CantonCode")],
                               "AccidentUID string, AccidentYear bigint, AccidentMonth string, AccidentWeekDay string, "
                               "AccidentHour string, CantonCode string, AccidentSeverityCategory string, "
                               "AccidentInvolvingMotorcycle bigint, ErrorReasons string")
    out = display.to_display(df).collect()[0]
    assert out.Location == "CH_AG" and out.Accident_ID == "1" and out.Motorcycle_Involved == 1
    assert out.ErrorReasons == "Missing:Year; Invalid:Location"
    back = display.to_internal(display.to_display(df.drop("ErrorReasons")))
    assert back.columns == df.drop("ErrorReasons").columns
    assert back.collect() == df.drop("ErrorReasons").collect()
