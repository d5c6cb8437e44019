"""Data-quality operators.

Every check is a column expression over one row; reports are single
aggregations (partial, map-side) or ``groupBy`` on small keys. Nothing is
collected to the driver and no per-row Python runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import scalars as S
from ..sources.raw import materialise, require_columns
from .normalise import HARMONISED, normalise_ch, normalise_de

REQUIRED_COLUMNS = list(HARMONISED)
VALID_VALUES = {
    "AccidentMonth": D.MONTH_LABELS,
    "AccidentWeekDay": D.WEEKDAY_LABELS,
    "AccidentHour": D.DAYPART_LABELS,
    "AccidentSeverityCategory": D.SEVERITY_LABELS,
}
REASONS = "_reasons"
ERROR_REASONS = "ErrorReasons"


def _checks(df: DataFrame, null_check: str = "required") -> list[tuple[str, str, Column, Column]]:
    """(kind, column, hit, offending value) for every check, in report order.

    ``null_check``: 'required' checks the 8 harmonised columns (dashboard
    behaviour), 'all' checks every column of ``df`` (command-line, Q8).
    """
    require_columns(df, REQUIRED_COLUMNS, "quality check")
    null_cols = REQUIRED_COLUMNS if null_check == "required" else list(df.columns)
    out = [("Missing", c, F.col(c).isNull(), F.lit(None).cast("string")) for c in null_cols]
    for c, valid in VALID_VALUES.items():
        v = F.col(c).cast("string")
        out.append(("Invalid", c, F.col(c).isNotNull() & ~v.isin(valid), v))
    year = F.col("AccidentYear")
    out.append(("Invalid", "AccidentYear",
                year.isNotNull() & S.lenient_number(year).isNull(), year.cast("string")))
    moto = F.col("AccidentInvolvingMotorcycle")
    out.append(("Invalid", "AccidentInvolvingMotorcycle",
                moto.isNotNull() & S.motorcycle_flag(moto).isNull(), moto.cast("string")))
    return out


def reason_names(df: DataFrame, null_check: str = "required") -> list[str]:
    """'Missing:c' / 'Invalid:c' of every check, in report order: the i-th is bit i of :func:`reason_bits`."""
    return [f"{kind}:{c}" for kind, c, _, _ in _checks(df, null_check)]


def reason_array(df: DataFrame, null_check: str = "required") -> Column:
    """ARRAY<STRING> of 'Missing:c' / 'Invalid:c' reasons, empty when clean."""
    items = [F.when(hit, F.lit(f"{kind}:{c}")) for kind, c, hit, _ in _checks(df, null_check)]
    return F.array_compact(F.array(*items))


def flag_errors(df: DataFrame, null_check: str = "required") -> DataFrame:
    """Adds the reason array as column ``_reasons`` (one narrow projection)."""
    return df.withColumn(REASONS, reason_array(df, null_check))


# --- reason bits: the checks of a prepared table, made once and stored as one number a row ------------

BITS = "_bits"


def reason_bits(df: DataFrame, null_check: str = "required") -> Column:
    """One BIGINT with a bit per failed check, 0 when clean."""
    hits = [hit for _, _, hit, _ in _checks(df, null_check)]
    if len(hits) > 63:
        raise ValueError(f"{len(hits)} checks do not fit into one BIGINT: use flag_errors, or null_check='required'")
    return reduce(lambda a, b: a + b, [F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, hit in enumerate(hits)])


def _mask(names: Sequence[str], column: str) -> int:
    return sum(1 << i for i, name in enumerate(names) if name.split(":", 1)[1] == column)


def _has(mask: int) -> Column:
    return F.col(BITS).bitwiseAND(F.lit(mask).cast("bigint")) != 0


def _named(names: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(_has(1 << i), F.lit(name)) for i, name in enumerate(names)]))


def _all_required(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [_has(_mask(names, c)) for c in REQUIRED_COLUMNS])


class PreparedRows:
    """Error rows, clean rows and reports (D6-D8, D11-D16) of a table whose reason bits are stored with its rows. Bits
    are tested and counted; the text of reasons is made for display only."""

    def __init__(self, table: DataFrame, names: Sequence[str]):
        self.table, self.names = table, list(names)
        self.columns = [c for c in table.columns if c != BITS]

    @classmethod
    def of(cls, df: DataFrame, null_check: str = "required", name: str = "prepared") -> PreparedRows:
        """Check the rows of ``df`` once and write them with their bits."""
        names = reason_names(df, null_check)
        return cls(materialise(df.withColumn(BITS, reason_bits(df, null_check)), name), names)

    def errors(self) -> DataFrame:
        bad = self.table.where(F.col(BITS) != 0)
        return bad.select(*self.columns, F.array_join(_named(self.names), "; ").alias(ERROR_REASONS))

    def clean(self) -> DataFrame:
        return self.table.where(F.col(BITS) == 0).select(*self.columns)

    def summary(self) -> DataFrame:
        """D12, D14, D16 from one aggregation of the bits: no other column is read."""
        bad, fully, issues = F.col(BITS) != 0, _all_required(self.names), F.bit_count(BITS)
        got = self.table.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_error_rows"), F.count_if(fully).alias("n_fully_invalid"),
                             F.coalesce(F.sum(issues), F.lit(0)).alias("n_issues"))
        rate = F.coalesce(F.try_divide(F.col("n_error_rows") * 100.0, F.col("n_rows")), F.lit(0.0))
        mean = F.coalesce(F.try_divide(F.col("n_issues").cast("double"), F.col("n_error_rows")), F.lit(0.0))
        return got.select("n_rows", "n_error_rows", rate.alias("error_rate_pct"), "n_fully_invalid",
                          (F.col("n_error_rows") - F.col("n_fully_invalid")).alias("n_partly_invalid"), mean.alias("mean_issues"))

    def reason_counts(self) -> DataFrame:
        """Rows are counted per different number (few), and only these are taken apart."""
        per = self.table.where(F.col(BITS) != 0).groupBy(BITS).agg(F.count(F.lit(1)).alias("n"))
        return per.select(F.explode(_named(self.names)).alias("reason"), "n").groupBy("reason").agg(F.sum("n").alias("n"))

    def problem_values(self) -> DataFrame:
        """Offending cells; clean rows and good cells are passed over by their bits."""
        cells = []
        for i, name in enumerate(self.names):
            kind, c = name.split(":", 1)
            value = F.col(c).cast("string") if kind == "Invalid" else F.lit(None).cast("string")
            cells.append(F.when(_has(1 << i), F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column_name"), value.alias("bad_value"))))
        found = self.table.where(F.col(BITS) != 0).select(F.inline(F.array_compact(F.array(*cells))))
        return found.groupBy("kind", "column_name", "bad_value").agg(F.count(F.lit(1)).alias("n"))

    def enriched(self, fully: bool | None = None) -> DataFrame:
        """Error rows with their issues, all or only the fully (partly) invalid ones, which the bits tell."""
        rows = self.table.where(F.col(BITS) != 0)
        if fully is not None:
            rows = rows.where(_all_required(self.names) if fully else ~_all_required(self.names))
        columns = sorted({name.split(":", 1)[1] for name in self.names})
        hit = F.array_compact(F.array(*[F.when(_has(_mask(self.names, c)), F.lit(c)) for c in columns]))
        return rows.select(*self.columns, F.array_join(_named(self.names), "; ").alias(ERROR_REASONS), F.bit_count(BITS).alias("IssueCount"),
                           F.array_join(hit, ", ").alias("ProblemColumns"), F.size(hit).alias("ProblemColumnsCount"),
                           _all_required(self.names).alias("IsFullyInvalid"))


def settled(value: Column) -> Column:
    """``value``, for a column that rows are filtered by, computed once where it stands.

    A filter on a derived flag is pushed down through the normalisation
    projections, and Catalyst then inlines every check, and every expression
    the checks depend on, into the scan-side predicate, evaluating the whole
    normalisation twice or more per row (measured 4 times as slow). Behind a
    branch on a row number, which is never taken, the flag counts as an
    expression that must not be moved or copied: the filter stays right above
    it, in the same generated loop.
    """
    return F.when(F.monotonically_increasing_id() < 0, F.lit(None)).otherwise(value)


def find_errors(df: DataFrame, null_check: str = "required") -> DataFrame:
    """Error rows with their reasons joined by '; ' in ``ErrorReasons``."""
    flagged = df.withColumn(REASONS, settled(reason_array(df, null_check)))
    bad = flagged.where(F.size(REASONS) > 0)
    return bad.withColumn(ERROR_REASONS, F.array_join(REASONS, "; ")).drop(REASONS)


def clean_rows(df: DataFrame, null_check: str = "required") -> DataFrame:
    """Rows without any reason (the mask complement of ``find_errors``)."""
    wrong = reduce(lambda a, b: a | b, [hit for _, _, hit, _ in _checks(df, null_check)])
    return df.withColumn(REASONS, settled(wrong)).where(~F.col(REASONS)).drop(REASONS)


def filter_year(df: DataFrame, year: int = D.DEFAULT_YEAR) -> DataFrame:
    """Keep one accident year; prunes partitions when stored by year.

    An integral column is compared directly (a plain, pushable predicate);
    text is parsed leniently first.
    """
    col = F.col("AccidentYear")
    if dict(df.dtypes).get("AccidentYear") in ("bigint", "int", "smallint", "tinyint"):
        return df.where(col == F.lit(year))
    return df.where(S.lenient_int(col) == F.lit(year))


def null_counts(df: DataFrame) -> DataFrame:
    """NULL count of every column in one pass, long form (column_name, position, n_null)."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                      F.col(f"c{i}").cast("bigint").alias("n_null")) for i, c in enumerate(df.columns)]
    return agg.select(F.inline(F.array(*pairs)))


def problem_values(df: DataFrame, null_check: str = "required") -> DataFrame:
    """Offending cells per check in long form (kind, column_name, bad_value, n).

    Missing cells report a NULL value. Counted with a partial aggregation.
    """
    cells = [F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column_name"),
                      hit.alias("hit"), val.alias("bad_value"))
             for kind, c, hit, val in _checks(df, null_check)]
    hits = df.select(F.inline(F.array(*cells))).where("hit")
    return hits.groupBy("kind", "column_name", "bad_value").agg(F.count(F.lit(1)).alias("n"))


def error_summary(df: DataFrame, null_check: str = "required") -> DataFrame:
    """Rows, error rows, error rate (%), fully / partly invalid
    error rows and mean number of issues per error row, in one aggregation."""
    flagged = flag_errors(df, null_check)
    n_issue = F.size(REASONS)
    fully = _fully_invalid(F.transform(F.col(REASONS), _reason_column))
    return flagged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(n_issue > 0).alias("n_error_rows"),
        F.count_if((n_issue > 0) & fully).alias("n_fully_invalid"),
        F.count_if((n_issue > 0) & ~fully).alias("n_partly_invalid"),
        F.sum(F.when(n_issue > 0, n_issue)).alias("n_issues"),
    ).select(
        "n_rows", "n_error_rows",
        F.coalesce(F.try_divide(F.col("n_error_rows") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("error_rate_pct"),
        "n_fully_invalid", "n_partly_invalid",
        F.coalesce(F.try_divide(F.col("n_issues").cast("double"), F.col("n_error_rows")), F.lit(0.0)).alias("mean_issues"),
    )


def _fully_invalid(problem_cols: Column) -> Column:
    required = F.array(*[F.lit(c) for c in REQUIRED_COLUMNS])
    return F.size(F.array_except(required, problem_cols)) == 0


def _reason_column(r: Column) -> Column:
    """'Missing:AccidentYear' -> 'AccidentYear' (text after the first ':')."""
    return F.when(F.instr(r, ":") > 0, F.trim(F.element_at(F.split(r, ":", 2), 2))).otherwise(F.trim(r))


def _reason_list(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def enrich_errors(errors: DataFrame) -> DataFrame:
    """IssueCount, ProblemColumns (sorted distinct, ', '-joined),
    ProblemColumnsCount and IsFullyInvalid (all 8 required columns affected),
    derived from the ``ErrorReasons`` text."""
    if ERROR_REASONS not in errors.columns:
        return errors.select("*", F.lit(0).alias("IssueCount"), F.lit("").alias("ProblemColumns"),
                             F.lit(0).alias("ProblemColumnsCount"), F.lit(False).alias("IsFullyInvalid"))
    reasons = _reason_list(F.col(ERROR_REASONS))
    cols = F.array_sort(F.array_distinct(F.transform(reasons, _reason_column)))
    return errors.select(
        "*",
        F.size(reasons).alias("IssueCount"),
        F.array_join(cols, ", ").alias("ProblemColumns"),
        F.size(cols).alias("ProblemColumnsCount"),
        _fully_invalid(cols).alias("IsFullyInvalid"),
    )


def split_errors(enriched: DataFrame, fully: bool) -> DataFrame:
    """Only the fully (or only the partly) invalid error rows."""
    return enriched.where(F.col("IsFullyInvalid") == F.lit(fully))


def reason_counts(errors: DataFrame) -> DataFrame:
    """Frequency of every reason (split on ';', trimmed, empties dropped)."""
    reasons = errors.select(F.explode(_reason_list(F.col(ERROR_REASONS))).alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, empty cells and % empty, in one aggregation."""
    ncols = len(df.columns)
    empty = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    prof = df.agg(F.count(F.lit(1)).alias("n_rows"), empty.cast("bigint").alias("empty_cells"))
    return prof.select(
        "n_rows", F.lit(ncols).alias("n_columns"), "empty_cells",
        F.coalesce(F.try_divide(F.col("empty_cells") * 100.0, F.col("n_rows") * ncols), F.lit(0.0)).alias("empty_pct"),
    )


def duplicate_count(df: DataFrame, col: str = "AccidentUID") -> DataFrame:
    """Rows whose key already occurred (all but the first; NULLs form one key).

    Counted per key with a partial aggregation, so a hot key costs one row
    per map task in the shuffle.
    """
    per_key = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"),
                       F.count(F.lit(1)).alias("n_keys"))


def quick_insights(df: DataFrame) -> DataFrame:
    """Rows, busiest weekday (ties: first in weekday order), fatal and
    motorcycle counts and shares. Two small aggregations, no join."""
    spine = F.array_position(F.array(*[F.lit(w) for w in D.WEEKDAY_LABELS]), F.col("AccidentWeekDay"))
    per_day = df.groupBy("AccidentWeekDay").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(S.is_fatal()).alias("fatal"),
        F.count_if(S.is_motorcycle()).alias("moto"),
    )
    key = F.when(F.col("AccidentWeekDay").isNotNull(),
                 F.struct(F.col("n"), (-F.coalesce(spine, F.lit(99))).alias("o"), F.col("AccidentWeekDay")))
    res = per_day.agg(
        F.sum("n").alias("n_rows"),
        F.max(key).alias("top"),
        F.sum("fatal").alias("fatal_n"),
        F.sum("moto").alias("motorcycle_n"),
    )
    return res.select(
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
        F.col("top.AccidentWeekDay").alias("top_weekday"),
        F.col("top.n").cast("bigint").alias("top_weekday_n"),
        F.coalesce("fatal_n", F.lit(0)).cast("bigint").alias("fatal_n"),
        F.coalesce(F.try_divide(F.col("fatal_n") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("fatal_pct"),
        F.coalesce("motorcycle_n", F.lit(0)).cast("bigint").alias("motorcycle_n"),
        F.coalesce(F.try_divide(F.col("motorcycle_n") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("motorcycle_pct"),
    )


def _tagged_sources(de_raw: DataFrame, ch_raw: DataFrame) -> DataFrame:
    return (normalise_de(de_raw).withColumn("dataset", F.lit("DE"))
            .unionByName(normalise_ch(ch_raw).withColumn("dataset", F.lit("CH"))))


def source_profile(de_raw: DataFrame, ch_raw: DataFrame) -> DataFrame:
    """Per source: row count, min/max year and motorcycle 1/0 counts."""
    t = _tagged_sources(de_raw, ch_raw)
    return t.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("AccidentYear").alias("min_year"),
        F.max("AccidentYear").alias("max_year"),
        F.count_if(F.col("AccidentInvolvingMotorcycle") == 1).alias("n_motorcycle_1"),
        F.count_if(F.col("AccidentInvolvingMotorcycle") == 0).alias("n_motorcycle_0"),
    )


def source_daypart_counts(de_raw: DataFrame, ch_raw: DataFrame) -> DataFrame:
    """Daypart distribution per source (NULL dayparts not counted)."""
    t = _tagged_sources(de_raw, ch_raw).where(F.col("AccidentHour").isNotNull())
    return t.groupBy("dataset", "AccidentHour").agg(F.count(F.lit(1)).alias("n"))


def hour_match_count(with_hour: DataFrame) -> DataFrame:
    """Rows that received a numeric hour, out of all rows."""
    return with_hour.agg(F.count("AccidentHourNumeric").alias("n_matched"),
                         F.count(F.lit(1)).alias("n_rows"))
