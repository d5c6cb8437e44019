"""Harmonise the two national extracts to one 8-column schema.

Each normaliser is a single ``select`` of column expressions: a narrow,
codegen'd map stage with no shuffle, so it scales linearly with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import scalars as S
from ..sources.raw import ORDINAL, repair_ch_header, require_columns

HARMONISED = [
    "AccidentUID",
    "AccidentYear",
    "AccidentMonth",
    "AccidentWeekDay",
    "AccidentHour",
    "CantonCode",
    "AccidentSeverityCategory",
    "AccidentInvolvingMotorcycle",
]

DE_REQUIRED = ["UJAHR", "UMONAT", "UWOCHENTAG", "USTUNDE", "ULAND", "UKATEGORIE", "IstKrad"]
CH_REQUIRED = ["AccidentYear", "AccidentMonth", "AccidentWeekDay", "AccidentHour", "CantonCode",
               "AccidentSeverityCategory", "AccidentInvolvingMotorcycle"]

# (target column, source column, how the source value is read before the lookup)
DE_MAPPINGS = [
    ("AccidentMonth", "UMONAT", "int"),
    ("AccidentWeekDay", "UWOCHENTAG", "int"),
    ("CantonCode", "ULAND", "int"),
    ("AccidentSeverityCategory", "UKATEGORIE", "int"),
]
CH_MAPPINGS = [
    ("AccidentMonth", "AccidentMonth", "int"),
    ("AccidentWeekDay", "AccidentWeekDay", "text"),
    ("CantonCode", "CantonCode", "text"),
    ("AccidentSeverityCategory", "AccidentSeverityCategory", "text"),
]
_MONTHS = {i + 1: m for i, m in enumerate(D.MONTH_LABELS)}
DE_MAPS = {"AccidentMonth": _MONTHS, "AccidentWeekDay": D.DE_WEEKDAY,
           "CantonCode": D.DE_STATES, "AccidentSeverityCategory": D.DE_SEVERITY}
CH_MAPS = {"AccidentMonth": _MONTHS, "AccidentWeekDay": D.CH_WEEKDAY,
           "CantonCode": D.CH_REGIONS, "AccidentSeverityCategory": D.CH_SEVERITY}


def _source_value(df: DataFrame, col: str, how: str):
    return S.lenient_int(col) if how == "int" else S.clean_text(col)


def _uid(df: DataFrame, col: str):
    return S.clean_text(col) if col in df.columns else F.lit(None).cast("string")


LOOKUP_HOUR = "_hour_num"
LOOKUP_RANK = "_rank"
# Source priority for "first hour per key": Swiss rows before German ones (Q12),
# packed above the file order into one BIGINT (see joins.hour_lookup).
SOURCE_BIT = 1 << 62


def _lookup_columns(raw: DataFrame, hour: str, priority: int):
    order = F.col(ORDINAL) if ORDINAL in raw.columns else F.lit(0).cast("bigint")
    return {LOOKUP_HOUR: S.lenient_int(hour),
            LOOKUP_RANK: F.lit(priority * SOURCE_BIT).cast("bigint") + order}


def _normalise(raw: DataFrame, uid: str, year: str, hour: str, moto: str, mappings, maps, keep,
               extra: dict | None = None) -> DataFrame:
    """Two projections: parse every raw cell once (trimmed text or number),
    then map. Keeping the parsed values as columns stops the lookups from
    re-inlining the parse expressions, which keeps plans and generated code
    small."""
    extra = extra or {}
    parsed = raw.select(
        _uid(raw, uid).alias("_uid"),
        S.lenient_number(year).alias("_year"),
        S.clean_text(hour).alias("_hour_t"),
        S.hour_bin_index(S.lenient_number(hour)).alias("_hour_i"),
        F.col(moto).alias("_moto"),
        *[(S.lenient_number(src) if how == "int" else S.clean_text(src)).alias(f"_src_{i}")
          for i, (_, src, how) in enumerate(mappings)],
        *[F.col(k) if isinstance(k, str) else k for k in keep],
        *[c.alias(name) for name, c in extra.items()],
    )
    mapped = {}
    for i, (target, _, how) in enumerate(mappings):
        v = S.int_from_number(f"_src_{i}") if how == "int" else F.col(f"_src_{i}")
        mapped[target] = S.lookup(v, maps[target])
    return parsed.select(
        F.col("_uid").alias("AccidentUID"),
        S.int_from_number("_year").alias("AccidentYear"),
        mapped["AccidentMonth"].alias("AccidentMonth"),
        mapped["AccidentWeekDay"].alias("AccidentWeekDay"),
        S.daypart_from_parts("_hour_t", "_hour_i").alias("AccidentHour"),
        mapped["CantonCode"].alias("CantonCode"),
        mapped["AccidentSeverityCategory"].alias("AccidentSeverityCategory"),
        S.motorcycle_flag("_moto").alias("AccidentInvolvingMotorcycle"),
        *keep,
        *extra.keys(),
    )


def normalise_de(raw: DataFrame, keep: tuple = (), lookup_columns: bool = False) -> DataFrame:
    """German extract -> harmonised 8 columns (+ ``keep`` columns, + the
    hour-lookup columns when asked)."""
    require_columns(raw, DE_REQUIRED, "Data_DE")
    extra = _lookup_columns(raw, "USTUNDE", 1) if lookup_columns else None
    return _normalise(raw, "UIDENTSTLAE", "UJAHR", "USTUNDE", "IstKrad", DE_MAPPINGS, DE_MAPS, tuple(keep), extra)


def normalise_ch(raw: DataFrame, keep: tuple = (), lookup_columns: bool = False) -> DataFrame:
    """Swiss extract -> harmonised 8 columns (header typo repaired first, S8)."""
    raw = repair_ch_header(raw)
    require_columns(raw, CH_REQUIRED, "Data_CH")
    extra = _lookup_columns(raw, "AccidentHour", 0) if lookup_columns else None
    return _normalise(raw, "AccidentUID", "AccidentYear", "AccidentHour", "AccidentInvolvingMotorcycle",
                      CH_MAPPINGS, CH_MAPS, tuple(keep), extra)


def harmonise(de_raw: DataFrame, ch_raw: DataFrame, lookup_columns: bool = False) -> DataFrame:
    """UNION ALL of the normalised sources, DE first, with the published types.

    ``lookup_columns`` also keeps, per raw row, its parsed numeric hour and its
    (source, file order) rank, so the hour lookup can be built from this one
    table instead of a second read of the raw extracts.
    """
    extra = [LOOKUP_HOUR, LOOKUP_RANK] if lookup_columns else []
    merged = normalise_de(de_raw, lookup_columns=lookup_columns).unionByName(
        normalise_ch(ch_raw, lookup_columns=lookup_columns))
    return merged.select(
        *[F.col(c).cast("bigint").alias(c) if c in ("AccidentYear", "AccidentInvolvingMotorcycle")
          else F.col(c) for c in HARMONISED], *extra
    )


def unmapped_report(de_raw: DataFrame, ch_raw: DataFrame) -> DataFrame:
    """Values present in a source column that have no mapping, in long form
    ``(dataset, source_column, target_column, bad_value, n)``.

    Cells are unpivoted row-wise and counted with a partial (map-side)
    aggregation, so no set of values is gathered into one task.
    """
    parts = []
    for dataset, raw, mappings, maps in (("DE", de_raw, DE_MAPPINGS, DE_MAPS),
                                         ("CH", repair_ch_header(ch_raw), CH_MAPPINGS, CH_MAPS)):
        # cells are parsed in a projection of their own, once each
        parsed = raw.select(*[_source_value(raw, source, how).alias(f"_src_{i}") for i, (_, source, how) in enumerate(mappings)])
        cells = []
        for i, (target, source, _) in enumerate(mappings):
            src = F.col(f"_src_{i}")
            mapped = S.lookup(src, maps[target])
            cells.append(F.struct(
                F.lit(source).alias("source_column"), F.lit(target).alias("target_column"),
                F.when(src.isNotNull() & mapped.isNull(), src.cast("string")).alias("bad_value")))
        bad = parsed.select(F.inline(F.array(*cells))).where(F.col("bad_value").isNotNull())
        parts.append(bad.groupBy("source_column", "target_column", "bad_value")
                     .agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit(dataset)))
    out = parts[0].unionByName(parts[1])
    return out.select("dataset", "source_column", "target_column", "bad_value", "n")
