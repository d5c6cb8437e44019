"""Raw-source fixture views derived from the driver's ``lineitem`` table.

The two SELECTs are the fixture definitions of FIXTURES.md section 2. They use
integer arithmetic and casts only, so the same text runs on Spark SQL and on
DuckDB (the correctness oracle). Every column is STRING, like a CSV read with
inference switched off. Work grows with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import domains as D
from .raw import ORDINAL, read_raw

RAW_DE_SQL = """SELECT
  CASE WHEN u % 97 = 0 THEN NULL ELSE ' ' || CAST(u AS VARCHAR(20)) END AS UIDENTSTLAE,
  CASE WHEN u % 101 = 0 THEN 'n/a' ELSE CAST(year(l_shipdate) + 25 AS VARCHAR(20)) END AS UJAHR,
  CASE WHEN u % 89 = 0 THEN '13' ELSE CAST(month(l_shipdate) AS VARCHAR(20)) END AS UMONAT,
  CAST(1 + u % 7 AS VARCHAR(20)) AS UWOCHENTAG,
  CASE WHEN u % 83 = 0 THEN '99' WHEN u % 79 = 0 THEN 'x' ELSE CAST((u * 7) % 24 AS VARCHAR(20)) END AS USTUNDE,
  CAST(1 + l_suppkey % 16 AS VARCHAR(20)) AS ULAND,
  CASE WHEN u % 71 = 0 THEN '4' WHEN l_orderkey % 37 = 0 THEN '1' WHEN u % 5 = 0 THEN '2' ELSE '3' END AS UKATEGORIE,
  CASE WHEN u % 67 = 0 THEN 'ja' WHEN l_quantity < 8 THEN '1' ELSE '0' END AS IstKrad
FROM (SELECT *, l_orderkey * 10 + l_linenumber AS u FROM {lineitem}) t
WHERE l_orderkey % 3 <> 0"""

RAW_CH_SQL = """SELECT
  'CH' || CAST(u AS VARCHAR(20)) || ' ' AS AccidentUID,
  CAST(year(l_shipdate) + 25 AS VARCHAR(20)) AS AccidentYear,
  CAST(month(l_shipdate) AS VARCHAR(20)) AS AccidentMonth,
  CASE WHEN u % 61 = 0 THEN 'aw499' ELSE 'aw40' || CAST(1 + u % 7 AS VARCHAR(20)) END AS AccidentWeekDay,
  CASE WHEN u % 59 = 0 THEN '06-12' WHEN u % 53 = 0 THEN 'Abend' WHEN u % 47 = 0 THEN CAST((u * 5) % 24 AS VARCHAR(20)) || '.0' ELSE CAST((u * 5) % 24 AS VARCHAR(20)) END AS AccidentHour,
  CASE l_suppkey % 6 WHEN 0 THEN 'ZH' WHEN 1 THEN 'BE' WHEN 2 THEN 'VD' WHEN 3 THEN 'AG' WHEN 4 THEN 'GE' ELSE CASE WHEN u % 5 = 0 THEN 'ZG' ELSE 'TI' END END AS CantonCode,
  CASE WHEN u % 43 = 0 THEN 'as4' WHEN l_orderkey % 41 = 0 THEN 'as1' WHEN u % 4 = 0 THEN 'as2' ELSE 'as3' END AS AccidentSeverityCategory,
  CASE WHEN u % 67 = 0 THEN 'ja' WHEN l_quantity < 9 THEN 'true' ELSE 'False' END AS AccidentInvolvingMotorcycle
FROM (SELECT *, l_orderkey * 10 + l_linenumber AS u FROM {lineitem}) t
WHERE l_orderkey % 3 = 0"""

def _pick(number: str, labels: list[str]) -> str:
    return "CASE " + number + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(labels)) + " END"


# A prepared table as text, as a user's own file may hold it: 8 columns with labels that no list
# knows, years that are no numbers, unreadable flags, gaps, and rows in which every field is bad.
PREPARED_SQL = f"""SELECT
  CASE WHEN u % 211 = 0 OR u % 61 = 0 THEN NULL ELSE 'P' || CAST(u AS VARCHAR(20)) END AS AccidentUID,
  CASE WHEN u % 211 = 0 OR u % 53 = 0 THEN 'n/a' WHEN u % 47 = 0 THEN NULL WHEN u % 43 = 0 THEN '2024.0'
       ELSE CAST(year(l_shipdate) + 25 AS VARCHAR(20)) END AS AccidentYear,
  CASE WHEN u % 211 = 0 OR u % 41 = 0 THEN 'Month ' || CAST(month(l_shipdate) AS VARCHAR(20)) WHEN u % 37 = 0 THEN NULL
       ELSE {_pick("month(l_shipdate) - 1", D.MONTH_LABELS)} END AS AccidentMonth,
  CASE WHEN u % 211 = 0 OR u % 59 = 0 THEN 'Someday' ELSE {_pick("u % 7", D.WEEKDAY_LABELS)} END AS AccidentWeekDay,
  CASE WHEN u % 211 = 0 OR u % 67 = 0 THEN CAST(u % 24 AS VARCHAR(20)) ELSE {_pick("u % 4", D.DAYPART_LABELS)} END AS AccidentHour,
  CASE WHEN u % 211 = 0 OR u % 71 = 0 THEN NULL ELSE {_pick("l_suppkey % 4", ["BE_DE", "BY_DE", "ZH_CH", "AG_CH"])} END AS CantonCode,
  CASE WHEN u % 211 = 0 OR u % 73 = 0 THEN 'unknown' ELSE {_pick("l_orderkey % 3", D.SEVERITY_LABELS[:3])} END AS AccidentSeverityCategory,
  CASE WHEN u % 211 = 0 OR u % 79 = 0 THEN 'maybe' WHEN u % 83 = 0 THEN NULL WHEN l_quantity < 9 THEN '1' ELSE '0' END AS AccidentInvolvingMotorcycle,
  u AS row_id
FROM (SELECT *, l_orderkey * 10 + l_linenumber AS u FROM {{lineitem}}) t"""

# Hours of both sources, which share out the table, with keys that they share (an order's number) and
# several hours a key; the file order is a column.
HOURS_DE_SQL = """SELECT 'K' || CAST(l_orderkey AS VARCHAR(20)) AS UIDENTSTLAE,
  CASE WHEN u % 5 = 0 THEN 'x' ELSE CAST((u * 7) % 24 AS VARCHAR(20)) END AS USTUNDE, u AS _ord
FROM (SELECT *, l_orderkey * 10 + l_linenumber AS u FROM {lineitem}) t WHERE l_linenumber > 2"""
HOURS_CH_SQL = """SELECT ' K' || CAST(l_orderkey AS VARCHAR(20)) AS AccidentUID,
  CASE WHEN u % 3 = 0 THEN '06-12' ELSE CAST((u * 5) % 24 AS VARCHAR(20)) END AS AccidentHour, u AS _ord
FROM (SELECT *, l_orderkey * 10 + l_linenumber AS u FROM {lineitem}) t WHERE l_linenumber <= 2"""

# The same two hour files, in the order of the table's rows in its files.
HOURS_DE_FILE_SQL, HOURS_CH_FILE_SQL = (sql.replace(", u AS _ord", "") for sql in (HOURS_DE_SQL, HOURS_CH_SQL))


def lineitem(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    return read_raw(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet", fmt="parquet", ordered=ordered)


def _fixture(spark: SparkSession, sf_dir: str, sql: str, with_ordinal: bool) -> DataFrame:
    if with_ordinal:  # the file order of the row that a raw row derives from (Q12)
        sql = sql.replace("SELECT", f"SELECT {ORDINAL},", 1)
    return spark.sql(sql, lineitem=lineitem(spark, sf_dir, with_ordinal))


def raw_de(spark: SparkSession, sf_dir: str, with_ordinal: bool = False) -> DataFrame:
    """German raw extract (8 STRING columns)."""
    return _fixture(spark, sf_dir, RAW_DE_SQL, with_ordinal)


def raw_ch(spark: SparkSession, sf_dir: str, with_ordinal: bool = False) -> DataFrame:
    """Swiss raw extract (8 STRING columns)."""
    return _fixture(spark, sf_dir, RAW_CH_SQL, with_ordinal)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared table as text (8 STRING columns and row_id, its file order)."""
    return _fixture(spark, sf_dir, PREPARED_SQL, False)


def hours_de(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, HOURS_DE_SQL, False)


def hours_ch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, HOURS_CH_SQL, False)


def hours_in_file_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """German and Swiss hours, ranked by the place of their rows in the files."""
    return _fixture(spark, sf_dir, HOURS_DE_FILE_SQL, True), _fixture(spark, sf_dir, HOURS_CH_FILE_SQL, True)


def duckdb_views() -> dict[str, str]:
    """The same fixture SQL for DuckDB, keyed by view name."""
    return {"raw_de": RAW_DE_SQL.format(lineitem="lineitem"),
            "raw_ch": RAW_CH_SQL.format(lineitem="lineitem")}
