"""Aggregations and statistics.

Pattern: one aggregation over the big table with map-side partial
aggregation, producing a result whose size is bounded by the category domains
(months x dayparts x ...). Windows, shares and tests then run on that small
result only. Zero-filled category spines come from conditional counts over a
fixed value list read off the small aggregated result (no join, no cross
product).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

SCOPE = "scope"
OVERALL = "Gesamt"
ROWS = "_rows"  # in a table of counts (operators.cube): how many rows a row stands for


def n_rows(df: DataFrame, cond: Column | None = None) -> Column:
    """Aggregate: the rows of ``df`` (where ``cond`` holds); a row of counts stands for ``ROWS`` of them."""
    if ROWS not in df.columns:
        return F.count(F.lit(1)) if cond is None else F.count_if(F.coalesce(cond, F.lit(False)))
    return F.coalesce(F.sum(ROWS if cond is None else F.when(cond, F.col(ROWS))), F.lit(0))


def with_scope(df: DataFrame, country_col: Column | None = None) -> DataFrame:
    """Marks each row with its country scope. The counts below add the overall scope from the counts
    per country, after the aggregation of the rows, so no row is doubled."""
    c = country_col if country_col is not None else S.country("CantonCode")
    return df.withColumn(SCOPE, c)


def _add_overall(counts: DataFrame, col: str) -> DataFrame:
    """Aggregated counts per country once more under the overall scope; summed up by the next aggregation."""
    return counts.withColumn(col, F.explode(F.array(F.lit(OVERALL), F.col(col))))


def spine_metrics(df: DataFrame, key: Column | str, spine: Sequence, by: Sequence[str] = (),
                  metrics: dict[str, Column | None] | None = None, key_name: str | None = None) -> DataFrame:
    """A1 + A5 + A7 + J5 + T1: conditional counts per value of ``key`` over a
    fixed ordered value list, zero-filled, long form
    ``(by..., key_name, ordinal, metric...)``. ``metrics`` maps an output name
    to a row condition (None = every row). Values outside the list (and NULL)
    are ignored, like ``reindex``.

    Two steps: a hash aggregation by (groups, key) with map-side partial
    aggregation (constant work per input row), then the zero-filled spine is
    read off that small result with conditional sums (work proportional to
    the number of distinct keys, not rows).
    """
    k = F.col(key) if isinstance(key, str) else key
    name = key_name or (key if isinstance(key, str) else "value")
    metrics = metrics or {"n": None}
    counts = df.groupBy(*by, k.alias("_key")).agg(
        *[n_rows(df, cond).alias(f"_m{j}") for j, cond in enumerate(metrics.values())])
    if isinstance(key, str) and key == SCOPE:
        counts = _add_overall(counts, "_key")
    elif SCOPE in by:
        counts = _add_overall(counts, SCOPE)
    aggs, cells = [], []
    for i, v in enumerate(spine):
        fields = [F.lit(v).alias(name), F.lit(i + 1).alias("ordinal")]
        for j, m in enumerate(metrics):
            aggs.append(F.coalesce(F.sum(F.when(F.col("_key") == F.lit(v), F.col(f"_m{j}"))), F.lit(0))
                        .alias(f"_v{i}_{j}"))
            fields.append(F.col(f"_v{i}_{j}").cast("bigint").alias(m))
        cells.append(F.struct(*fields))
    return counts.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def spine_counts(df: DataFrame, key: Column | str, spine: Sequence, by: Sequence[str] = (),
                 key_name: str | None = None) -> DataFrame:
    """A1 + J5 + T1: zero-filled counts ``(by..., key_name, ordinal, n)``."""
    return spine_metrics(df, key, spine, by, {"n": None}, key_name)


def grid_counts(df: DataFrame, row: Column, row_spine: Sequence, col: Column, col_spine: Sequence,
                by: Sequence[str] = (), row_name: str = "row", col_name: str = "col") -> DataFrame:
    """A3 + A8: two-way counts over fixed row and column value lists, zero-filled,
    long form ``(by..., row_name, row_ord, col_name, col_ord, n)``; a hash
    aggregation by (groups, row, col), then zero-filled on the small result."""
    counts = df.groupBy(*by, row.alias("_r"), col.alias("_c")).agg(n_rows(df).alias("_n"))
    if SCOPE in by:
        counts = _add_overall(counts, SCOPE)
    aggs, cells = [], []
    for i, rv in enumerate(row_spine):
        for j, cv in enumerate(col_spine):
            alias = f"_c{i}_{j}"
            hit = (F.col("_r") == F.lit(rv)) & (F.col("_c") == F.lit(cv))
            aggs.append(F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias(alias))
            cells.append(F.struct(F.lit(rv).alias(row_name), F.lit(i + 1).alias("row_ord"),
                                  F.lit(cv).alias(col_name), F.lit(j + 1).alias("col_ord"),
                                  F.col(alias).cast("bigint").alias("n")))
    return counts.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def named_grids(df: DataFrame, tables: Sequence[tuple], name: str = "test") -> DataFrame:
    """Several two-way tables from one aggregation of the rows, long form ``(name, r, c, n)``, zero-filled.

    A table is (name, row, row_spine, col, col_spine, condition or None); row, col and condition are
    expressions over ``df``. Rows are counted once by all distinct expressions; the tables are folded
    from those counts, whose number is bounded by the category domains."""
    keys, fields = [], []

    def key(c: Column | None) -> Column:
        if c is None:
            return F.lit(True)
        text = str(c)
        if text not in fields:
            fields.append(text)
            keys.append(c.alias(f"_k{len(keys)}"))
        return F.col(f"_k{fields.index(text)}")

    parts = [(t, key(r), rs, key(c), cs, key(cond)) for t, r, rs, c, cs, cond in tables]
    counts = df.groupBy(*keys).agg(n_rows(df).alias("_n"))
    aggs, cells = [], []
    for t, r, rs, c, cs, cond in parts:
        for rv in rs:
            for cv in cs:
                alias = f"_v{len(aggs)}"
                aggs.append(F.coalesce(F.sum(F.when(cond & (r == F.lit(rv)) & (c == F.lit(cv)), F.col("_n"))), F.lit(0)).alias(alias))
                cells.append(F.struct(F.lit(t).alias(name), F.lit(rv).alias("r"), F.lit(cv).alias("c"), F.col(alias).cast("bigint").alias("n")))
    return counts.agg(*aggs).select(F.inline(F.array(*cells)))


def share(n: str | Column, over: Sequence[str] = ()) -> Column:
    """N * 100 / sum(n) over the partition; NULL when the total is 0.

    Use only on aggregated (domain-sized) frames.
    """
    c = F.col(n) if isinstance(n, str) else n
    total = F.sum(c).over(Window.partitionBy(*over))
    return F.try_divide(c * 100.0, total)


def argmax(df: DataFrame, label: str, metric: str, ordinal: str, by: Sequence[str] = (),
           where: Column | None = None, out_label: str = "label", out_value: str = "value") -> DataFrame:
    """The label with the largest metric per group; ties go to the smallest
    ordinal (first in spine order). Runs on aggregated frames."""
    d = df if where is None else df.where(where)
    key = F.struct(F.col(metric).alias("m"), (-F.col(ordinal)).alias("o"), F.col(label).alias("l"))
    return d.groupBy(*by).agg(F.max(key).alias("_best")).select(
        *by, F.col("_best.l").alias(out_label), F.col("_best.m").alias(out_value))


def _table_cells(counts: DataFrame, row: str, col: str, n: str, by: Sequence[str]) -> DataFrame:
    """Every cell of each contingency table, zeros included, without the rows and columns whose margin is
    zero: (by..., _r, _c, _o, _rsum, _csum, _ntot, _nr, _nc). A table without counts keeps one row of NULLs.

    ``counts`` is long form, bounded by the category domains; cells may be absent or repeated."""
    cell = F.struct(F.col(row).alias("r"), F.col(col).alias("c"), F.col(n).cast("double").alias("o"))
    tables = counts.groupBy(*by).agg(F.collect_list(F.when(F.col(n) > 0, cell)).alias("_cells"))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["o"])

    def labels(field: str) -> Column:
        return F.array_compact(F.array_distinct(F.transform("_cells", lambda x: x[field])))

    wide = (tables.withColumn("_cells", F.filter("_cells", lambda x: x["r"].isNotNull() & x["c"].isNotNull()))
            .withColumn("_ntot", total(F.col("_cells"))).withColumn("_rows", labels("r")).withColumn("_cols", labels("c"))
            .withColumn("_nr", F.size("_rows")).withColumn("_nc", F.size("_cols")))
    cells = wide.withColumn("_r", F.explode_outer("_rows")).withColumn("_c", F.explode_outer("_cols"))
    in_row, in_col = (lambda x: x["r"] == F.col("_r")), (lambda x: x["c"] == F.col("_c"))
    return cells.select(*by, "_r", "_c", total(F.filter("_cells", lambda x: in_row(x) & in_col(x))).alias("_o"),
                        total(F.filter("_cells", in_row)).alias("_rsum"), total(F.filter("_cells", in_col)).alias("_csum"),
                        "_ntot", "_nr", "_nc")


def expected_counts(counts: DataFrame, row: str, col: str, n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """A10: observed and expected count (row total x column total / table total) of every cell."""
    x = _table_cells(counts, row, col, n, by).where(F.col("_r").isNotNull())
    return x.select(*by, F.col("_r").alias(row), F.col("_c").alias(col), F.col("_o").cast("bigint").alias("observed"),
                    (F.col("_rsum") / F.col("_ntot") * F.col("_csum")).alias("expected"))


# fixed values: coefficients of Lanczos' approximation of the gamma function (g = 7, n = 9)
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(a: Column) -> Column:
    """ln of the gamma function for a >= 1/2."""
    x = a - 1.0
    series = reduce(lambda acc, c: acc + c, [F.lit(c) / (x + float(i + 1)) for i, c in enumerate(_LANCZOS[1:])], F.lit(_LANCZOS[0]))
    t = x + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.log(t) - t + F.log(series)


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a >= 1/2: below a + 1 as one less the power series of P,
    beyond as the continued fraction (modified Lentz). Both are folded over as many terms as they can
    need; terms that no longer change the sum leave it as it is."""
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    terms = F.sequence(F.lit(1), (F.lit(60) + F.sqrt(a + x) * 8).cast("int"))
    one = F.lit(1.0)

    total = F.aggregate(terms, F.struct((one / a).alias("term"), (one / a).alias("sum")), lambda s, k: F.struct(
        (s["term"] * x / (a + k)).alias("term"), (s["sum"] + s["term"] * x / (a + k)).alias("sum")), lambda s: s["sum"])

    tiny = F.lit(1e-300)
    b0 = x + 1.0 - a

    def lentz(s: Column, k: Column) -> Column:
        an, b = -k * (k - a), x + 1.0 - a + k * 2.0
        d, c = b + an * s["d"], b + an / s["c"]
        d, c = F.when(d == 0, tiny).otherwise(d), F.when(c == 0, tiny).otherwise(c)
        return F.struct((one / d).alias("d"), c.alias("c"), (s["h"] * c / d).alias("h"))

    start = F.struct((one / b0).alias("d"), (one / tiny).alias("c"), (one / b0).alias("h"))
    fraction = F.aggregate(terms, start, lentz, lambda s: s["h"])
    return F.when(x <= 0, one).when(x < a + 1.0, F.greatest(F.lit(0.0), one - front * total)).otherwise(front * fraction)


def chi_square(counts: DataFrame, row: str, col: str, n: str = "n", by: Sequence[str] = (),
               yates: bool = True) -> DataFrame:
    """A10: Pearson chi-square test of independence per table.

    ``counts`` is a long-form contingency table (absent cells count 0). Rows
    and columns with a zero margin are dropped (where a textbook routine would
    fail), dof = (r-1)(c-1); with dof = 1 the Yates continuity correction
    y = min(0.5, |o-e|) is applied. The statistic is sum((|o-e|-y)^2 / e) over
    all cells, zeros included: no difference of large sums is taken.

    Output per table: chi2, dof, n_total, p_value (upper tail: the regularised
    incomplete gamma function as column expressions), significant (p < 0.05).
    A table without counts has dof 0, chi2 0 and p 1.
    """
    x = _table_cells(counts, row, col, n, by)
    e = F.col("_rsum") / F.col("_ntot") * F.col("_csum")
    off = F.abs(F.col("_o") - e)
    one = (F.col("_nr") - 1) * (F.col("_nc") - 1) == 1
    y = F.when(one & F.lit(yates), F.least(F.lit(0.5), off)).otherwise(F.lit(0.0))
    term = F.when(F.col("_r").isNotNull() & F.col("_c").isNotNull(), F.pow(off - y, 2) / e)
    res = x.groupBy(*by).agg(F.sum(term).alias("_chi2"), F.max("_nr").alias("_nr"), F.max("_nc").alias("_nc"),
                             F.max("_ntot").alias("_ntot"))
    dof = F.when(F.coalesce("_nr", F.lit(0)) == 0, F.lit(0)).otherwise((F.col("_nr") - 1) * (F.col("_nc") - 1)).cast("int")
    res = res.select(*by, F.when(dof == 0, F.lit(0.0)).otherwise(F.col("_chi2")).alias("chi2"), dof.alias("dof"),
                     F.coalesce(F.col("_ntot"), F.lit(0.0)).cast("bigint").alias("n_total"))
    p = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(upper_gamma(F.col("dof") / 2.0, F.col("chi2") / 2.0))
    return res.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """A11 + A12: Pearson r, r^2, slope and intercept of y on x (one aggregation)."""
    return df.agg(
        F.corr(y, x).alias("r"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.count(F.lit(1)).alias("n_points"),
    )
