"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL restates each operator's semantics over the same parquet views; it is
generated from the same fixed code lists (:mod:`crashlens.functions.domains`)
so that both sides agree on the domain, while the logic is written
separately, in plain SQL (CASE lookups, VALUES spines, window margins).
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from ..functions import domains as D
from ..operators.cube import DIMENSIONS
from ..sources.fixtures import HOURS_CH_FILE_SQL, HOURS_CH_SQL, HOURS_DE_FILE_SQL, HOURS_DE_SQL, PREPARED_SQL, duckdb_views

RAD = repr(math.pi / 180.0)
DEG = repr(180.0 / math.pi)
BLANKS = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS = "(" + " || ".join(f"chr({c})" for c in BLANKS) + ")"
REQ = ["AccidentUID", "AccidentYear", "AccidentMonth", "AccidentWeekDay", "AccidentHour", "CantonCode",
       "AccidentSeverityCategory", "AccidentInvolvingMotorcycle"]
VALID = {"AccidentMonth": D.MONTH_LABELS, "AccidentWeekDay": D.WEEKDAY_LABELS,
         "AccidentHour": D.DAYPART_LABELS, "AccidentSeverityCategory": D.SEVERITY_LABELS}


# --- scalar SQL builders -------------------------------------------------------

def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def in_list(vals) -> str:
    return "(" + ", ".join(lit(v) for v in vals) + ")"


def trim(x: str) -> str:
    return f"trim(CAST({x} AS VARCHAR), {WS})"


def num(x: str) -> str:
    t = f"TRY_CAST({trim(x)} AS DOUBLE)"
    return f"(CASE WHEN isfinite({t}) AND NOT regexp_matches(CAST({x} AS VARCHAR), '[dDfFxXpP]') THEN {t} END)"


def lint(x: str) -> str:
    n = num(x)
    return f"(CASE WHEN {n} = floor({n}) THEN TRY_CAST({n} AS BIGINT) END)"


def cmap(x: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {x} {whens} END)"


def daypart(x: str) -> str:
    t = trim(x)
    h = num(x)
    labels = [name for _, _, name in D.DAYPART_BOUNDS]
    bins = " ".join(f"WHEN {i} THEN {lit(name)}" for i, name in enumerate(labels))
    return (f"COALESCE(CASE WHEN {t} IN {in_list(D.DAYPART_LABELS)} THEN {t} END, {cmap(t, D.DAYPART_RANGES)}, "
            f"CASE WHEN {h} > -1 AND {h} < 24 THEN (CASE CAST(trunc({h}) AS BIGINT) // 6 {bins} END) END)")


def moto(x: str) -> str:
    return f"CAST({cmap(f'CAST({x} AS VARCHAR)', D.MOTORCYCLE_TEXT)} AS BIGINT)"


def country(x: str = "CantonCode") -> str:
    return f"(CASE WHEN length({x}) >= 2 THEN right({x}, 2) ELSE {x} END)"


def month_num(x: str = "AccidentMonth") -> str:
    return f"CAST({cmap(x, D.MONTH_NUMBER)} AS INTEGER)"


def is_fatal(x: str = "AccidentSeverityCategory") -> str:
    return f"coalesce(lower({trim(x)}) IN {in_list(D.FATAL_LABELS)}, false)"


def is_severe(preset: str, x: str = "AccidentSeverityCategory") -> str:
    return f"coalesce(lower({trim(x)}) IN {in_list(D.SEVERE_PRESETS[preset])}, false)"


def is_moto(x: str = "AccidentInvolvingMotorcycle") -> str:
    return f"coalesce(TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE) = 1, false)"


def season(scheme: str, m: str) -> str:
    groups, fallback = D.SEASON_SCHEMES[scheme]
    whens = " ".join(f"WHEN {m} IN {in_list(ms)} THEN {lit(label)}" for label, ms in groups)
    return f"(CASE {whens} ELSE {lit(fallback)} END)"


def moto_label() -> str:
    return f"(CASE WHEN {is_moto()} THEN 'Mit Motorrad' ELSE 'Ohne Motorrad' END)"


def night_label() -> str:
    return "(CASE NightAccident WHEN 0 THEN 'Tag' WHEN 1 THEN 'Nacht' END)"


def daynight() -> str:
    return cmap("AccidentHour", D.DAYNIGHT_GROUP)


def hour_bin(x: str = "AccidentHourNumeric") -> str:
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 5 THEN 'Nacht' WHEN {x} <= 11 THEN 'Vormittag' "
            f"WHEN {x} <= 17 THEN 'Nachmittag' ELSE 'Abend' END)")


def pct(n: str, d: str, zero: bool = False) -> str:
    e = f"(CAST({n} AS DOUBLE) * 100.0 / nullif(CAST({d} AS DOUBLE), 0))"
    return f"coalesce({e}, 0.0)" if zero else e


def share(n: str, over: list[str] = ()) -> str:
    part = f"PARTITION BY {', '.join(over)}" if over else ""
    return pct(n, f"sum({n}) OVER ({part})")


def german_int(x: str) -> str:
    return f"replace(format('{{:,}}', {x}), ',', '.')"


def german_1f(x: str) -> str:
    return f"replace(printf('%.1f', {x}), '.', ',')"


# --- the stage chain -----------------------------------------------------------

def _norm(src: str, uid: str | None, cols: dict) -> str:
    uid_sql = trim(uid) if uid else "CAST(NULL AS VARCHAR)"
    return (f"SELECT {uid_sql} AS AccidentUID, {cols['year']} AS AccidentYear, {cols['month']} AS AccidentMonth, "
            f"{cols['weekday']} AS AccidentWeekDay, {cols['hour']} AS AccidentHour, {cols['canton']} AS CantonCode, "
            f"{cols['severity']} AS AccidentSeverityCategory, {cols['moto']} AS AccidentInvolvingMotorcycle FROM {src}")


MONTHS = {i + 1: m for i, m in enumerate(D.MONTH_LABELS)}
NORM_DE = _norm("raw_de", "UIDENTSTLAE", {
    "year": lint("UJAHR"), "month": cmap(lint("UMONAT"), MONTHS), "weekday": cmap(lint("UWOCHENTAG"), D.DE_WEEKDAY),
    "hour": daypart("USTUNDE"), "canton": cmap(lint("ULAND"), D.DE_STATES),
    "severity": cmap(lint("UKATEGORIE"), D.DE_SEVERITY), "moto": moto("IstKrad")})
NORM_CH = _norm("raw_ch", "AccidentUID", {
    "year": lint("AccidentYear"), "month": cmap(lint("AccidentMonth"), MONTHS),
    "weekday": cmap(trim("AccidentWeekDay"), D.CH_WEEKDAY), "hour": daypart("AccidentHour"),
    "canton": cmap(trim("CantonCode"), D.CH_REGIONS), "severity": cmap(trim("AccidentSeverityCategory"), D.CH_SEVERITY),
    "moto": moto("AccidentInvolvingMotorcycle")})


def _checks() -> list[tuple[str, str, str, str]]:
    out = [("Missing", c, f"{c} IS NULL", "CAST(NULL AS VARCHAR)") for c in REQ]
    for c, valid in VALID.items():
        out.append(("Invalid", c, f"({c} IS NOT NULL AND {c} NOT IN {in_list(valid)})", f"CAST({c} AS VARCHAR)"))
    out.append(("Invalid", "AccidentYear", f"(AccidentYear IS NOT NULL AND {num('AccidentYear')} IS NULL)",
                "CAST(AccidentYear AS VARCHAR)"))
    out.append(("Invalid", "AccidentInvolvingMotorcycle",
                f"(AccidentInvolvingMotorcycle IS NOT NULL AND {moto('AccidentInvolvingMotorcycle')} IS NULL)",
                "CAST(AccidentInvolvingMotorcycle AS VARCHAR)"))
    return out


REASONS = "concat_ws('; ', " + ", ".join(f"CASE WHEN {hit} THEN '{k}:{c}' END" for k, c, hit, _ in _checks()) + ")"
COLS8 = ", ".join(REQ)
POINTS = "VALUES " + ", ".join(f"({lit(k)}, {lat!r}, {lng!r}, {lit(z)})" for k, lat, lng, z in D.region_points())


def _twilight(year: int = D.DEFAULT_YEAR) -> str:
    return _twilight_of(f"make_date({year}, CAST(g.m AS INTEGER), {D.REFERENCE_DAY})", "range(1, 13) g(m)")


def _twilight_of(day: str, months: str) -> str:
    r = lambda x: f"(({x}) * {RAD})"
    return f"""
tw0 AS (SELECT p.region_key, p.lat, p.lng, p.zone, g.m AS month, {day} AS ref_date
        FROM ({POINTS}) p(region_key, lat, lng, zone), {months}),
tw1 AS (SELECT *, ((CAST(ref_date - DATE '1970-01-01' AS DOUBLE) + 2440588.0) - 2451545.0) / 36525.0 AS t FROM tw0),
tw2 AS (SELECT *, (((280.46646 + t * (36000.76983 + t * 0.0003032)) % 360.0) + 360.0) % 360.0 AS l0,
               357.52911 + t * (35999.05029 - t * 0.0001537) AS ma,
               0.016708634 - t * (0.000042037 + t * 0.0000001267) AS e,
               125.04 - t * 1934.136 AS omega FROM tw1),
tw3 AS (SELECT *, l0 + (sin({r('ma')}) * (1.914602 - t * (0.004817 + t * 0.000014))
                       + sin({r('ma * 2')}) * (0.019993 - t * 0.000101) + sin({r('ma * 3')}) * 0.000289)
                  - 0.00569 - sin({r('omega')}) * 0.00478 AS app_long,
               23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0
                  + cos({r('omega')}) * 0.00256 AS eps FROM tw2),
tw4 AS (SELECT *, asin(sin({r('eps')}) * sin({r('app_long')})) AS decl, pow(tan({r('eps / 2')}), 2) AS y FROM tw3),
tw5 AS (SELECT *, ((y * sin({r('l0')} * 2) - e * sin({r('ma')}) * 2 + e * y * sin({r('ma')}) * cos({r('l0')} * 2) * 4
                   - y * y * sin({r('l0')} * 4) * 0.5 - e * e * sin({r('ma')} * 2) * 1.25) * {DEG}) * 4 AS eot,
               {math.cos(math.radians(D.CIVIL_TWILIGHT_ZENITH))!r} / (cos({r('lat')}) * cos(decl))
                  - tan({r('lat')}) * tan(decl) AS cos_ha FROM tw4),
tw6 AS (SELECT *, 720.0 - lng * 4 - eot AS noon,
               CASE WHEN abs(cos_ha) <= 1 THEN acos(cos_ha) * {DEG} END AS ha FROM tw5),
tw7 AS (SELECT region_key, zone, CAST(month AS INTEGER) AS month, CAST(year(ref_date) AS BIGINT) AS year,
               CAST(ref_date AS TIMESTAMP) + to_seconds(CAST(round((noon - ha * 4) * 60) AS BIGINT)) AS begin_utc,
               CAST(ref_date AS TIMESTAMP) + to_seconds(CAST(round((noon + ha * 4) * 60) AS BIGINT)) AS end_utc FROM tw6),
twilight AS (SELECT region_key, month, year,
               CAST(hour(timezone(zone, timezone('UTC', begin_utc))) AS INTEGER) AS dawn_hour,
               CAST(hour(timezone(zone, timezone('UTC', end_utc))) AS INTEGER) AS dusk_hour,
               (epoch(end_utc) - epoch(begin_utc)) / 3600.0 AS daylight_hours FROM tw7),"""


def chain(year: int = D.DEFAULT_YEAR) -> str:
    v = duckdb_views()
    region_key = "(CASE WHEN ends_with(w.CantonCode, '_CH') THEN 'CH' ELSE w.CantonCode END)"
    return f"""WITH
raw_de AS ({v['raw_de']}),
raw_ch AS ({v['raw_ch']}),
norm_de AS ({NORM_DE}),
norm_ch AS ({NORM_CH}),
merged AS (SELECT * FROM norm_de UNION ALL SELECT * FROM norm_ch),
flagged AS (SELECT *, {REASONS} AS ErrorReasons FROM merged),
errors AS (SELECT * FROM flagged WHERE ErrorReasons <> ''),
clean AS (SELECT {COLS8} FROM flagged WHERE ErrorReasons = ''),
final AS (SELECT * FROM clean WHERE AccidentYear = {year}),
hours_src AS (SELECT {trim('AccidentUID')} AS uid, {lint('AccidentHour')} AS h, 0 AS src FROM raw_ch
              UNION ALL SELECT {trim('UIDENTSTLAE')}, {lint('USTUNDE')}, 1 FROM raw_de),
hours AS (SELECT uid, arg_min(h, src) AS AccidentHourNumeric FROM hours_src WHERE h IS NOT NULL GROUP BY uid),
with_hour AS (SELECT f.AccidentUID, f.AccidentYear, f.AccidentMonth, f.AccidentWeekDay, f.AccidentHour,
                     h.AccidentHourNumeric, f.CantonCode, f.AccidentSeverityCategory, f.AccidentInvolvingMotorcycle
              FROM final f LEFT JOIN hours h ON f.AccidentUID IS NOT DISTINCT FROM h.uid),{_twilight(year)}
night AS (SELECT w.*, CAST(CASE WHEN coalesce(w.AccidentHourNumeric < t.dawn_hour OR w.AccidentHourNumeric > t.dusk_hour, false)
                           THEN 1 ELSE 0 END AS INTEGER) AS NightAccident
          FROM with_hour w LEFT JOIN twilight t ON t.region_key = {region_key} AND t.month = {month_num('w.AccidentMonth')})"""


def all_years() -> str:
    """Like chain(), with clean rows of every year, each under its own year's twilight."""
    head = chain()
    start, end = head.index("with_hour AS ("), head.index("tw0 AS (")
    days = f"make_date(CAST(g.y AS INTEGER), CAST(g.m AS INTEGER), {D.REFERENCE_DAY})"
    months = "(SELECT m, y FROM range(1, 13) r(m), (SELECT DISTINCT AccidentYear AS y FROM clean)) g"
    return (head[:start] + head[start:end].replace("FROM final f", "FROM clean f").rstrip() + _twilight_of(days, months)
            + head[head.index("\nnight AS ("):].replace("ON t.region_key", "ON t.year = w.AccidentYear AND t.region_key"))


# --- aggregate helpers -----------------------------------------------------------

def spine(src: str, key: str, values, by: list[str] = (), metrics: dict | None = None, key_name: str = "value") -> str:
    """Zero-filled conditional counts over a value list, like stats.spine_metrics."""
    metrics = metrics or {"n": None}
    vals = "VALUES " + ", ".join(f"({lit(v)}, {i + 1})" for i, v in enumerate(values))
    bsel = ", ".join(by)
    groups = f"(SELECT DISTINCT {bsel} FROM {src})" if by else "(SELECT 1 AS _one)"
    cnt = ", ".join(f"count_if({'true' if c is None else c}) AS {m}" for m, c in metrics.items())
    gb = ", ".join([*by, "_k"])
    counts = f"(SELECT {bsel + ', ' if by else ''}{key} AS _k, {cnt} FROM {src} GROUP BY {gb})"
    on = " AND ".join([f"c.{b} IS NOT DISTINCT FROM g.{b}" for b in by] + ["c._k = s._v"])
    outs = ", ".join(f"CAST(coalesce(c.{m}, 0) AS BIGINT) AS {m}" for m in metrics)
    gcols = ", ".join(f"g.{b}" for b in by)
    return (f"SELECT {gcols + ', ' if by else ''}s._v AS {key_name}, CAST(s._o AS INTEGER) AS ordinal, {outs} "
            f"FROM {groups} g CROSS JOIN ({vals}) s(_v, _o) LEFT JOIN {counts} c ON {on}")


def grid(src: str, row: str, rows, col: str, cols, by: list[str] = (), row_name: str = "row", col_name: str = "col") -> str:
    """Zero-filled two-way counts, like stats.grid_counts."""
    rv = "VALUES " + ", ".join(f"({lit(v)}, {i + 1})" for i, v in enumerate(rows))
    cv = "VALUES " + ", ".join(f"({lit(v)}, {i + 1})" for i, v in enumerate(cols))
    bsel = ", ".join(by)
    groups = f"(SELECT DISTINCT {bsel} FROM {src})" if by else "(SELECT 1 AS _one)"
    gb = ", ".join([*by, "_r", "_c"])
    counts = f"(SELECT {bsel + ', ' if by else ''}{row} AS _r, {col} AS _c, count(*) AS n FROM {src} GROUP BY {gb})"
    on = " AND ".join([f"c.{b} IS NOT DISTINCT FROM g.{b}" for b in by] + ["c._r = r._v", "c._c = k._v"])
    gcols = ", ".join(f"g.{b}" for b in by)
    return (f"SELECT {gcols + ', ' if by else ''}r._v AS {row_name}, CAST(r._o AS INTEGER) AS row_ord, "
            f"k._v AS {col_name}, CAST(k._o AS INTEGER) AS col_ord, CAST(coalesce(c.n, 0) AS BIGINT) AS n "
            f"FROM {groups} g CROSS JOIN ({rv}) r(_v, _o) CROSS JOIN ({cv}) k(_v, _o) LEFT JOIN {counts} c ON {on}")


def gamma_q(a: str, x: str) -> str:
    """Upper regularised incomplete gamma Q(a, x) = 1 - sum_k x^(a+k) e^-x / Gamma(a+k+1)."""
    n = f"CAST(ceil({x} + 12 * sqrt({x}) + 40) AS BIGINT)"
    series = f"list_sum([exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1)) FOR k IN range(0, {n})])"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - {series}) END)"


def chi2(counts: str, row: str, col: str, by: list[str] = (), name: str | None = None) -> str:
    """Chi-square per table over a long counts relation, like stats.chi_square."""
    pb = ", ".join(by)
    p = lambda extra: f"PARTITION BY {', '.join([*by, *extra])}" if (by or extra) else ""
    gb = f"GROUP BY {pb}" if by else ""
    sel_by = f"{pb}, " if by else ""
    x = (f"SELECT {sel_by}_o, _rsum, _csum, _ntot, row_number() OVER ({p(['_r'])} ORDER BY _c) = 1 AS _fr, "
         f"row_number() OVER ({p(['_c'])} ORDER BY _r) = 1 AS _fc FROM (SELECT *, sum(_o) OVER ({p(['_r'])}) AS _rsum, "
         f"sum(_o) OVER ({p(['_c'])}) AS _csum, sum(_o) OVER ({p([])}) AS _ntot FROM "
         f"(SELECT {sel_by}{row} AS _r, {col} AS _c, CAST(n AS DOUBLE) AS _o FROM ({counts}) WHERE n > 0))")
    t = (f"SELECT {sel_by}max(_ntot) AS _ntot, count_if(_fr) AS _nr, count_if(_fc) AS _nc, sum(_o * _o / (_rsum * _csum / _ntot)) AS _ssum, "
         f"sum(CASE WHEN _fr THEN 1.0 / _rsum END) AS _ir, sum(CASE WHEN _fc THEN 1.0 / _csum END) AS _ic, "
         f"max(abs(_o - _rsum * _csum / _ntot)) AS _dev FROM ({x}) {gb}")
    s = (f"SELECT {sel_by}CAST(CASE WHEN _ntot IS NULL THEN 0 ELSE (_nr - 1) * (_nc - 1) END AS INTEGER) AS dof, "
         f"_ntot, _ssum, _ir, _ic, _dev FROM ({t})")
    c = (f"SELECT {sel_by}CASE WHEN dof = 0 THEN 0.0 WHEN dof = 1 THEN pow(_dev - least(0.5, _dev), 2) * _ntot * _ir * _ic "
         f"ELSE greatest(_ssum - _ntot, 0.0) END AS chi2, dof, CAST(coalesce(_ntot, 0) AS BIGINT) AS n_total FROM ({s})")
    pv = f"CASE WHEN dof = 0 THEN 1.0 ELSE {gamma_q('dof / 2.0', 'chi2 / 2.0')} END"
    label = f"{lit(name)} AS test, " if name else ""
    return f"SELECT {label}{sel_by}chi2, dof, n_total, {pv} AS p_value, ({pv}) < 0.05 AS significant FROM ({c})"


# --- per-query SQL ---------------------------------------------------------------

SCOPED = "(SELECT *, unnest(['Gesamt', " + country() + "]) AS scope FROM {t})"
COUNTRIED = "(SELECT *, " + country() + " AS country FROM {t})"
SEV = "AccidentSeverityCategory"
MOTO = ["Ohne Motorrad", "Mit Motorrad"]
SEASONS_WR = ["Winter", D.SEASON_SCHEMES["winter_vs_rest"][1]]
NIGHT1 = "NightAccident = 1"


def _with(body: str, extra: str) -> str:
    return f"SELECT *, {extra} FROM ({body})"


def _seasoned(t: str, scheme: str) -> str:
    return f"(SELECT *, {season(scheme, month_num())} AS season FROM {t})"


def _celled() -> str:
    b, a = "(AccidentHour = 'Nacht')", f"({NIGHT1})"
    return (f"(SELECT *, CASE WHEN {b} AND {a} THEN 'TP' WHEN {b} AND NOT {a} THEN 'FP' "
            f"WHEN NOT {b} AND {a} THEN 'FN' WHEN NOT {b} AND NOT {a} THEN 'TN' END AS cell FROM night)")


def _flip(x: str) -> str:
    t = trim(x)
    p1, p2 = f"upper(split_part({t}, '_', 1))", f"upper(split_part({t}, '_', 2))"
    two = f"len(string_split({t}, '_')) = 2"
    cc = in_list(D.COUNTRY_CODES)
    return (f"(CASE WHEN {t} IS NULL THEN NULL WHEN {two} AND {p1} IN {cc} THEN {p1} || '_' || {p2} "
            f"WHEN {two} AND {p2} IN {cc} THEN {p2} || '_' || {p1} ELSE {t} END)")


def _display(t: str, with_reasons: bool) -> str:
    cols = [f"{c} AS {D.DISPLAY_COLUMNS[c]}" if c != "CantonCode" else f"{_flip(c)} AS Location" for c in REQ]
    if with_reasons:
        r = "ErrorReasons"
        for internal, disp in D.DISPLAY_COLUMNS.items():
            r = f"replace({r}, {lit(internal)}, {lit(disp)})"
        cols.append(f"{r} AS ErrorReasons")
    return f"SELECT {', '.join(cols)} FROM {t}"


def _unmapped() -> str:
    from ..operators.normalise import CH_MAPPINGS, CH_MAPS, DE_MAPPINGS, DE_MAPS
    parts = []
    for ds, src_t, mappings, maps in (("DE", "raw_de", DE_MAPPINGS, DE_MAPS), ("CH", "raw_ch", CH_MAPPINGS, CH_MAPS)):
        for target, source, how in mappings:
            src = lint(source) if how == "int" else trim(source)
            parts.append(f"SELECT '{ds}' AS dataset, '{source}' AS source_column, '{target}' AS target_column, "
                         f"CAST({src} AS VARCHAR) AS bad_value, count(*) AS n FROM {src_t} "
                         f"WHERE {src} IS NOT NULL AND {cmap(src, maps[target])} IS NULL GROUP BY ALL")
    return " UNION ALL ".join(parts)


def _problem_values() -> str:
    parts = [f"SELECT '{k}' AS kind, '{c}' AS column_name, {v} AS bad_value FROM merged WHERE {hit}"
             for k, c, hit, v in _checks()]
    return f"SELECT kind, column_name, bad_value, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def _error_summary() -> str:
    checks = _checks()
    issues = " + ".join(f"CAST({hit} AS INTEGER)" for _, _, hit, _ in checks)
    per_col = []
    for c in REQ:
        hits = [hit for _, col, hit, _ in checks if col == c]
        per_col.append("(" + " OR ".join(hits) + ")")
    fully = " AND ".join(per_col)
    x = f"SELECT {issues} AS k, ({fully}) AS fully FROM merged"
    return (f"SELECT count(*) AS n_rows, count_if(k > 0) AS n_error_rows, {pct('count_if(k > 0)', 'count(*)', True)} AS error_rate_pct, "
            f"count_if(k > 0 AND fully) AS n_fully_invalid, count_if(k > 0 AND NOT fully) AS n_partly_invalid, "
            f"coalesce(CAST(sum(CASE WHEN k > 0 THEN k END) AS DOUBLE) / nullif(count_if(k > 0), 0), 0.0) AS mean_issues FROM ({x})")


def _reason_parts(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ';'), lambda s: trim(s)), lambda s: s <> '')"


def _error_enriched() -> str:
    parts = _reason_parts("ErrorReasons")
    cols = (f"list_sort(list_distinct(list_transform({parts}, lambda s: CASE WHEN instr(s, ':') > 0 "
            f"THEN trim(substr(s, instr(s, ':') + 1)) ELSE trim(s) END)))")
    req = "[" + ", ".join(lit(c) for c in REQ) + "]"
    return (f"SELECT *, CAST(len({parts}) AS INTEGER) AS IssueCount, array_to_string({cols}, ', ') AS ProblemColumns, "
            f"CAST(len({cols}) AS INTEGER) AS ProblemColumnsCount, "
            f"len(list_filter({req}, lambda r: NOT list_contains({cols}, r))) = 0 AS IsFullyInvalid FROM errors")


def _quick_insights() -> str:
    order = "[" + ", ".join(lit(w) for w in D.WEEKDAY_LABELS) + "]"
    top = (f"(SELECT AccidentWeekDay AS d, count(*) AS n, coalesce(list_position({order}, AccidentWeekDay), 99) AS o "
           f"FROM final WHERE AccidentWeekDay IS NOT NULL GROUP BY AccidentWeekDay ORDER BY n DESC, o ASC LIMIT 1)")
    return (f"SELECT count(*) AS n_rows, (SELECT d FROM {top}) AS top_weekday, (SELECT n FROM {top}) AS top_weekday_n, "
            f"count_if({is_fatal()}) AS fatal_n, {pct(f'count_if({is_fatal()})', 'count(*)', True)} AS fatal_pct, "
            f"count_if({is_moto()}) AS motorcycle_n, {pct(f'count_if({is_moto()})', 'count(*)', True)} AS motorcycle_pct FROM final")


def _weekday() -> str:
    fatal = is_fatal()
    s = spine(SCOPED.format(t="final"), "AccidentWeekDay", D.WEEKDAY_LABELS, ["scope"],
              {"n": None, "fatal_n": fatal, "fatal_moto_n": f"{fatal} AND {is_moto()}"}, "weekday")
    return _with(s, f"{share('n', ['scope'])} AS share_pct, {pct('fatal_n', 'n', True)} AS fatal_rate, "
                    f"{pct('fatal_moto_n', 'fatal_n', True)} AS fatal_moto_rate")


def _weekday_winners() -> str:
    w = _weekday()
    rk = lambda order: f"row_number() OVER (PARTITION BY scope ORDER BY {order}, ordinal)"
    x = (f"SELECT *, {rk('n DESC')} AS ra, {rk('CASE WHEN n > 0 THEN 0 ELSE 1 END, fatal_rate DESC')} AS rb, "
         f"{rk('fatal_n DESC')} AS rc FROM ({w})")
    return (f"SELECT scope, max(CASE WHEN ra = 1 THEN weekday END) AS busiest_day, max(CASE WHEN ra = 1 THEN n END) AS busiest_n, "
            f"max(CASE WHEN rb = 1 AND n > 0 THEN weekday END) AS deadliest_day, max(CASE WHEN rb = 1 AND n > 0 THEN fatal_rate END) AS deadliest_rate, "
            f"max(CASE WHEN rc = 1 THEN weekday END) AS most_fatal_day, max(CASE WHEN rc = 1 THEN fatal_n END) AS most_fatal_n, "
            f"max(CASE WHEN rb = 1 AND n > 0 THEN fatal_moto_n END) AS deadliest_fatal_moto_n, "
            f"max(CASE WHEN rb = 1 AND n > 0 THEN fatal_n END) AS deadliest_fatal_n, "
            f"max(CASE WHEN ra = 1 THEN fatal_moto_n END) AS busiest_fatal_moto_n, max(CASE WHEN ra = 1 THEN fatal_n END) AS busiest_fatal_n "
            f"FROM ({x}) GROUP BY scope")


def _night_by_month() -> str:
    s = spine(SCOPED.format(t="night"), "AccidentMonth", D.MONTH_LABELS, ["scope"], {"n": None, "n_night": NIGHT1}, "month")
    return _with(s, f"{pct('n_night', 'n', True)} AS night_pct")


def _month_winners() -> str:
    m = _with(_night_by_month(), "round(night_pct, 1) AS shown_pct")
    rk = lambda c: f"row_number() OVER (PARTITION BY scope ORDER BY {c} DESC, ordinal)"
    return (f"SELECT scope, max(CASE WHEN ra = 1 THEN month END) AS most_night_month, max(CASE WHEN ra = 1 THEN n_night END) AS most_night_n, "
            f"max(CASE WHEN rb = 1 THEN month END) AS top_rate_month, max(CASE WHEN rb = 1 THEN shown_pct END) AS top_rate_pct "
            f"FROM (SELECT *, {rk('n_night')} AS ra, {rk('shown_pct')} AS rb FROM ({m})) GROUP BY scope")


def _daylight() -> str:
    return "(SELECT month AS month_num, avg(daylight_hours) AS daylight_hours FROM twilight GROUP BY month)"


def _rate_vs_daylight() -> str:
    m = _night_by_month()
    return (f"SELECT m.month, m.ordinal, m.n, m.n_night, m.night_pct, d.daylight_hours FROM ({m}) m "
            f"LEFT JOIN {_daylight()} d ON m.ordinal = d.month_num WHERE m.scope = 'Gesamt'")


def _tests(*items) -> str:
    return " UNION ALL ".join(chi2(counts, "r", "c", name=name) for name, counts in items)


def _grid_rc(src, row, rows, col, cols):
    return grid(src, row, rows, col, cols, row_name="r", col_name="c")


def _monthly_table() -> str:
    b, a = "AccidentHour = 'Nacht'", NIGHT1
    s = spine("night", "AccidentMonth", D.MONTH_LABELS, metrics={
        "bin_night": b, "api_night": a, "both_night": f"{b} AND {a}", "only_api": f"NOT ({b}) AND {a}",
        "only_bin": f"{b} AND NOT ({a})", "total": None}, key_name="month")
    s = _with(s, f"{pct('api_night', 'total', True)} AS api_rate")
    j = f"SELECT s.*, d.daylight_hours FROM ({s}) s LEFT JOIN {_daylight()} d ON s.ordinal = d.month_num"
    texts = [f"coalesce({german_1f('daylight_hours')} || ' h', '-') AS daylight_text"]
    texts += [f"{german_int(c)} AS {c}_text" for c in ["bin_night", "api_night", "both_night", "only_api", "only_bin", "total"]]
    texts.append(f"{german_1f('api_rate')} || ' %' AS api_rate_text")
    return _with(j, ", ".join(texts))


def _pairs() -> str:
    rk = "(CASE WHEN ends_with(p.CantonCode, '_CH') THEN 'CH' ELSE p.CantonCode END)"
    return (f"SELECT p.CantonCode, p.month, {rk} AS region_key, t.dawn_hour, t.dusk_hour FROM "
            f"(SELECT DISTINCT CantonCode, {month_num()} AS month FROM final) p "
            f"LEFT JOIN twilight t ON t.region_key = {rk} AND t.month = p.month")


def bodies() -> dict[str, str]:
    scoped_final, scoped_night = SCOPED.format(t="final"), SCOPED.format(t="night")
    cfinal = COUNTRIED.format(t="final")
    wr = _seasoned(cfinal, "winter_vs_rest")
    q: dict[str, str] = {
        "harmonised": "SELECT * FROM merged",
        "error_rows": "SELECT * FROM errors",
        "clean_rows": "SELECT * FROM clean",
        "clean_rows_multiset": f"SELECT * FROM merged EXCEPT ALL SELECT {COLS8} FROM errors",
        "final_year": "SELECT * FROM final",
        "with_hour": "SELECT * FROM with_hour",
        "night_classified": "SELECT * FROM night",
        "unmapped_values": _unmapped(),
        "merged_null_counts": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {i} AS position, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null FROM merged"
            for i, c in enumerate(REQ)),
        "problem_values": _problem_values(),
        "error_summary": _error_summary(),
        "error_enriched": _error_enriched(),
        "reason_counts": f"SELECT r AS reason, count(*) AS n FROM (SELECT unnest({_reason_parts('ErrorReasons')}) AS r FROM errors) GROUP BY r",
        "table_profile": ("SELECT count(*) AS n_rows, 8 AS n_columns, CAST(" + " + ".join(f"count_if({c} IS NULL)" for c in REQ)
                          + " AS BIGINT) AS empty_cells, coalesce(CAST(" + " + ".join(f"count_if({c} IS NULL)" for c in REQ)
                          + " AS DOUBLE) * 100.0 / nullif(CAST(count(*) * 8 AS DOUBLE), 0), 0.0) AS empty_pct FROM merged"),
        "duplicate_uids": "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates, count(*) AS n_keys FROM (SELECT AccidentUID, count(*) AS n FROM merged GROUP BY AccidentUID)",
        "quick_insights": _quick_insights(),
        "source_profile": " UNION ALL ".join(
            f"SELECT '{ds}' AS dataset, count(*) AS n_rows, min(AccidentYear) AS min_year, max(AccidentYear) AS max_year, "
            f"count_if(AccidentInvolvingMotorcycle = 1) AS n_motorcycle_1, count_if(AccidentInvolvingMotorcycle = 0) AS n_motorcycle_0 FROM {t}"
            for ds, t in (("DE", "norm_de"), ("CH", "norm_ch"))),
        "source_daypart_counts": " UNION ALL ".join(
            f"SELECT '{ds}' AS dataset, AccidentHour, count(*) AS n FROM {t} WHERE AccidentHour IS NOT NULL GROUP BY AccidentHour"
            for ds, t in (("DE", "norm_de"), ("CH", "norm_ch"))),
        "hour_match": "SELECT count(AccidentHourNumeric) AS n_matched, count(*) AS n_rows FROM with_hour",
        "hour_lookup": "SELECT uid AS AccidentUID, AccidentHourNumeric FROM hours",
        "occurrence_numbers": f"SELECT *, CAST(row_number() OVER (PARTITION BY {COLS8}) - 1 AS BIGINT) AS occurrence FROM merged",
        "twilight_pairs": _pairs(),
        "display_final": _display("final", False),
        "display_errors": _display("errors", True),
        "g1_motorcycle_severity": _with(grid(scoped_final, moto_label(), MOTO, SEV, D.SEVERITY_LABELS, ["scope"], "motorcycle", "severity"),
                                        f"{share('n', ['scope', 'motorcycle'])} AS row_pct"),
        "g1_chi2": chi2(grid(scoped_final, moto_label(), MOTO, SEV, D.SEVERITY_LABELS, ["scope"], "motorcycle", "severity"),
                        "motorcycle", "severity", ["scope"], "motorcycle_x_severity"),
        "g1_expected": (f"SELECT scope, motorcycle, severity, n AS observed, CAST(rn AS DOUBLE) * cn / tn AS expected FROM (SELECT *, "
                        f"sum(n) OVER (PARTITION BY scope, motorcycle) AS rn, sum(n) OVER (PARTITION BY scope, severity) AS cn, "
                        f"sum(n) OVER (PARTITION BY scope) AS tn FROM ("
                        + grid(scoped_final, moto_label(), MOTO, SEV, D.SEVERITY_LABELS, ["scope"], "motorcycle", "severity")
                        + ")) WHERE rn > 0 AND cn > 0"),
        "g2_daypart_counts": _with(spine(scoped_final, "AccidentHour", D.DAYPART_REPORT_ORDER, ["scope"], key_name="daypart"),
                                   f"{share('n', ['scope'])} AS pct"),
        "g2_daynight_share": _with(spine("final", daynight(), ["Tag", "Nacht/Abend"],
                                         metrics={"n": None, "severe_n": is_severe("serious_or_fatal")}, key_name="daynight"),
                                   f"{share('n')} AS pct, {pct('severe_n', 'n', True)} AS severe_pct"),
        "g2_daypart_severity": _with(grid(scoped_final, "AccidentHour", D.DAYPART_REPORT_ORDER, SEV, D.SEVERITY_LABELS, ["scope"], "daypart", "severity"),
                                     f"{share('n', ['scope', 'daypart'])} AS row_pct"),
        "g2_severe_share": _with(spine(cfinal, "AccidentHour", D.DAYPART_REPORT_ORDER, ["country"],
                                       {"n": None, "severe_only_n": is_severe("serious_only"),
                                        "severe_or_fatal_n": is_severe("serious_or_fatal")}, "daypart"),
                                 f"{pct('severe_only_n', 'n')} AS severe_only_pct, {pct('severe_or_fatal_n', 'n')} AS severe_or_fatal_pct"),
        "g2_chi2": _tests(("daypart_x_severity", _grid_rc("final", "AccidentHour", D.DAYPART_REPORT_ORDER, SEV, D.SEVERITY_LABELS)),
                          ("daynight_x_severity", _grid_rc("final", daynight(), ["Tag", "Nacht/Abend"], SEV, D.SEVERITY_LABELS))),
        "g3_winter_share": _with(spine(cfinal, "country", D.COUNTRY_CODES,
                                       metrics={"n": None, "winter_n": f"{month_num()} IN (12, 1, 2)"}, key_name="country"),
                                 f"{pct('winter_n', 'n')} AS winter_pct"),
        "g3_month_share": _with(spine(cfinal, "AccidentMonth", D.MONTH_LABELS, ["country"], key_name="month"),
                                f"{share('n', ['country'])} AS pct"),
        "g3_season_severity": _with(grid(wr, "season", SEASONS_WR, SEV, D.SEVERITY_LABELS, ["country"], "season", "severity"),
                                    f"{share('n', ['country', 'season'])} AS row_pct"),
        "g3_severe_by_season": _with(spine(wr, "season", SEASONS_WR, ["country"],
                                           {"n": None, "severe_only_n": is_severe("serious_only"),
                                            "severe_or_fatal_n": is_severe("serious_or_fatal")}, "season"),
                                     f"{pct('severe_only_n', 'n')} AS severe_only_pct, {pct('severe_or_fatal_n', 'n')} AS severe_or_fatal_pct"),
        "g3_chi2": _tests(("country_x_season", _grid_rc(wr, "country", D.COUNTRY_CODES, "season", SEASONS_WR)),
                          ("winter_country_x_severity", _grid_rc(f"(SELECT * FROM {wr} WHERE season = 'Winter')", "country",
                                                                 D.COUNTRY_CODES, SEV, D.SEVERITY_LABELS))),
        "g4_weekday": _weekday(),
        "g4_winners": _weekday_winners(),
        "g4_chi2": _tests(("weekday_x_severity", _grid_rc("final", "AccidentWeekDay", D.WEEKDAY_LABELS, SEV, D.SEVERITY_LABELS))),
        "g5_night_split": (f"SELECT scope, n, n_night, n - n_night AS n_day, {pct('n_night', 'n')} AS night_pct, "
                           f"{pct('n - n_night', 'n')} AS day_pct FROM ("
                           + spine(scoped_night, "scope", ["Gesamt"] + D.COUNTRY_CODES, metrics={"n": None, "n_night": NIGHT1},
                                   key_name="scope") + ")"),
        "g5_night_motorcycle": _with(grid(scoped_night, night_label(), ["Tag", "Nacht"], moto_label(), MOTO, ["scope"], "daynight", "motorcycle"),
                                     f"{share('n', ['scope', 'daynight'])} AS row_pct"),
        "g5_night_severity": _with(grid(scoped_night, night_label(), ["Tag", "Nacht"], SEV, D.SEVERITY_LABELS, ["scope"], "daynight", "severity"),
                                   f"{share('n', ['scope', 'daynight'])} AS row_pct"),
        "g5_chi2": _tests(("night_x_motorcycle", _grid_rc("night", night_label(), ["Tag", "Nacht"], moto_label(), MOTO)),
                          ("night_x_severity", _grid_rc("night", night_label(), ["Tag", "Nacht"], SEV, D.SEVERITY_LABELS))),
        "g5_night_by_month": _night_by_month(),
        "g5_month_winners": _month_winners(),
        "g5_night_by_hour": (f"SELECT hour, n, n_night, {hour_bin('hour')} AS hour_bin, {pct('n_night', 'n')} AS night_pct FROM ("
                             + spine("night", "AccidentHourNumeric", list(range(24)), metrics={"n": None, "n_night": NIGHT1},
                                     key_name="hour") + ")"),
        "g5_bin_shares": ("SELECT *, 100.0 - " + pct("n_night_in_bin", "n_night") + " AS night_outside_bin_pct, "
                          + pct("n_bin_day", "n_bin") + " AS bin_day_pct FROM (SELECT count_if(NightAccident = 1) AS n_night, "
                          "count_if(NightAccident = 1 AND AccidentHour = 'Nacht') AS n_night_in_bin, count_if(AccidentHour = 'Nacht') AS n_bin, "
                          "count_if(AccidentHour = 'Nacht' AND NOT (NightAccident = 1)) AS n_bin_day FROM night)"),
        "g6_night_by_season": _with(spine(_seasoned("night", "meteorological"), "season",
                                          [s for s, _ in D.SEASON_SCHEMES["meteorological"][0]],
                                          metrics={"n": None, "n_night": NIGHT1}, key_name="season"),
                                    f"{pct('n_night', 'n', True)} AS night_pct"),
        "g7_rate_vs_daylight": _rate_vs_daylight(),
        "g7_correlation": (f"SELECT corr(night_pct, daylight_hours) AS r, regr_r2(night_pct, daylight_hours) AS r2, "
                           f"regr_slope(night_pct, daylight_hours) AS slope, regr_intercept(night_pct, daylight_hours) AS intercept, "
                           f"count(*) AS n_points FROM ({_rate_vs_daylight()}) WHERE n > 0"),
        "g7_season_rates": _with(_with(spine(_seasoned("night", "daylight_thirds"), "season", ["Sommer", "Übergang", "Winter"],
                                             metrics={"n": None, "n_night": NIGHT1}, key_name="season"),
                                       f"{pct('n_night', 'n')} AS night_pct"),
                                 "max(CASE WHEN season = 'Winter' THEN night_pct END) OVER () / "
                                 "nullif(max(CASE WHEN season = 'Sommer' THEN night_pct END) OVER (), 0) AS winter_summer_factor"),
        "g7_chi2": _tests(("season_x_night", _grid_rc(_seasoned("night", "daylight_thirds"), "season", ["Winter", "Sommer"], "NightAccident", [0, 1]))),
        "g8_confusion": _with(spine(_celled(), "cell", ["TN", "FP", "FN", "TP"], key_name="cell"), f"{share('n')} AS pct"),
        "g8_errors_by_hour": (f"SELECT cell, AccidentHourNumeric AS hour, count(*) AS n FROM {_celled()} "
                              f"WHERE cell IN ('FP', 'FN') AND AccidentHourNumeric IS NOT NULL GROUP BY ALL"),
        "g8_fn_by_bin": _with(spine(_celled(), "AccidentHour", ["Vormittag", "Nachmittag", "Abend"], metrics={"n": "cell = 'FN'"},
                                    key_name="daypart"), f"{share('n')} AS pct"),
        "g9_misclass_by_month": _with(spine(_celled(), "AccidentMonth", D.MONTH_LABELS, key_name="month", metrics={
            "fp_n": "cell = 'FP'", "fn_vormittag": "cell = 'FN' AND AccidentHour = 'Vormittag'",
            "fn_nachmittag": "cell = 'FN' AND AccidentHour = 'Nachmittag'", "fn_abend": "cell = 'FN' AND AccidentHour = 'Abend'"}),
            "fn_vormittag + fn_nachmittag + fn_abend AS fn_total"),
        "g10_monthly_table": _monthly_table(),
        "x3_block_check": _with(spine(f"(SELECT *, {hour_bin()} AS block FROM night)", "block", D.DAYPART_LABELS,
                                      metrics={"n": None, "n_night": NIGHT1}, key_name="block"),
                                f"{pct('n_night', 'n')} AS night_pct"),
        "x4_region_rates": (f"SELECT CantonCode, count(*) AS n, count_if({NIGHT1}) AS n_night, {country()} AS country, "
                            f"{pct(f'count_if({NIGHT1})', 'count(*)')} AS night_pct FROM night GROUP BY CantonCode"),
    }
    return q


def table_chain(year: int = D.DEFAULT_YEAR) -> str:
    """Like chain(), from the prepared text table and the overlapping hour files."""
    return f"""WITH
prepared AS ({PREPARED_SQL.format(lineitem='lineitem')}),
hours_de AS ({HOURS_DE_SQL.format(lineitem='lineitem')}),
hours_ch AS ({HOURS_CH_SQL.format(lineitem='lineitem')}),
merged AS (SELECT {COLS8} FROM prepared),
flagged AS (SELECT *, {REASONS} AS ErrorReasons FROM merged),
errors AS (SELECT * FROM flagged WHERE ErrorReasons <> ''),
clean AS (SELECT {COLS8} FROM flagged WHERE ErrorReasons = ''),
partial_errors AS (SELECT * FROM prepared, unnest(CASE WHEN CantonCode IS NULL THEN range(40) ELSE [1] END)
                   WHERE AccidentInvolvingMotorcycle = 'maybe' OR AccidentSeverityCategory = 'unknown')"""


def table_bodies(year: int = D.DEFAULT_YEAR) -> dict[str, str]:
    q = bodies()
    place = "CantonCode, AccidentMonth"
    return {
        "text_error_rows": q["error_rows"],
        "text_clean_rows": q["clean_rows"],
        "text_final_year": f"SELECT * FROM clean WHERE {num('AccidentYear')} = {year}",
        "text_problem_values": q["problem_values"],
        "text_error_summary": q["error_summary"],
        "text_error_enriched": q["error_enriched"],
        "text_fully_invalid": f"SELECT * FROM ({q['error_enriched']}) WHERE IsFullyInvalid",
        "text_reason_counts": q["reason_counts"],
        "multiset_partial": (f"SELECT {place}, AccidentWeekDay FROM prepared EXCEPT ALL "
                             f"SELECT {place}, AccidentWeekDay FROM partial_errors"),
        "multiset_fewer_columns": (
            f"SELECT p.row_id, p.CantonCode, p.AccidentMonth, p.AccidentHour FROM (SELECT *, row_number() OVER (PARTITION BY {place} "
            f"ORDER BY row_id) AS nth FROM prepared) p LEFT JOIN (SELECT {place}, count(*) AS k FROM partial_errors GROUP BY ALL) e "
            f"ON p.CantonCode IS NOT DISTINCT FROM e.CantonCode AND p.AccidentMonth IS NOT DISTINCT FROM e.AccidentMonth "
            f"WHERE p.nth > coalesce(e.k, 0)"),
        "occurrence_by_place": (f"SELECT row_id, {place}, CAST(row_number() OVER (PARTITION BY {place} ORDER BY row_id) - 1 AS BIGINT) "
                                f"AS occurrence FROM prepared"),
        "hour_lookup_file_order": (
            f"WITH placed AS (SELECT *, row_number() OVER () AS _ord FROM lineitem), "
            f"de AS ({HOURS_DE_FILE_SQL.format(lineitem='placed').replace('SELECT', 'SELECT _ord,', 1)}), "
            f"ch AS ({HOURS_CH_FILE_SQL.format(lineitem='placed').replace('SELECT', 'SELECT _ord,', 1)}) "
            f"SELECT uid AS AccidentUID, h AS AccidentHourNumeric FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY src, _ord) AS nth "
            f"FROM (SELECT {trim('AccidentUID')} AS uid, {lint('AccidentHour')} AS h, 0 AS src, _ord FROM ch "
            f"UNION ALL SELECT {trim('UIDENTSTLAE')}, {lint('USTUNDE')}, 1, _ord FROM de) WHERE h IS NOT NULL) WHERE nth = 1"),
        "hour_lookup_shared_keys": (
            f"SELECT uid AS AccidentUID, h AS AccidentHourNumeric FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY src, _ord) AS nth "
            f"FROM (SELECT {trim('AccidentUID')} AS uid, {lint('AccidentHour')} AS h, 0 AS src, _ord FROM hours_ch "
            f"UNION ALL SELECT {trim('UIDENTSTLAE')}, {lint('USTUNDE')}, 1, _ord FROM hours_de) WHERE h IS NOT NULL) WHERE nth = 1"),
    }


LINEITEM_TYPES = ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, "
                  "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, "
                  "l_linestatus VARCHAR, l_shipdate TIMESTAMP")


def _output_types(sql: str) -> list[tuple[str, str]]:
    """(name, type) of the output columns of ``sql``, found by binding it
    (DESCRIBE) against an empty ``lineitem`` of the driver's schema."""
    try:
        import duckdb
    except ImportError:  # pragma: no cover
        return []
    con = duckdb.connect()
    try:
        con.execute(f"CREATE TABLE lineitem ({LINEITEM_TYPES})")
        return [(r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()]
    except duckdb.Error:
        return []
    finally:
        con.close()


def oracle_sql(year: int = D.DEFAULT_YEAR) -> dict[str, str]:
    """Full DuckDB SQL text per query (memoised; binding all of them takes seconds)."""
    return dict(_oracle_sql(year))


@lru_cache(maxsize=4)
def _oracle_sql(year: int) -> dict[str, str]:
    """Full DuckDB SQL text per query: the shared chain + the body, with every
    DOUBLE column rounded to 6 decimals (as the Spark side does) and HUGEINT
    counts narrowed to BIGINT."""
    out = {}
    every = bodies()
    dims = ", ".join(DIMENSIONS)
    every["cube"] = f"SELECT {dims}, count(*) AS n FROM night GROUP BY ALL"
    every |= {f"cube_{name}": sql for name, sql in every.items() if re.match("[gx][0-9]+_", name)}
    every |= {f"prepared_{name}": every[name] for name in ("error_rows", "clean_rows", "final_year", "error_summary", "reason_counts",
                                                           "problem_values", "error_enriched", "with_hour", "night_classified")}
    todo = [(chain(year), *x) for x in every.items()]
    todo += [(all_years(), name, "SELECT * FROM night") for name in ("night_all_years", "prepared_night_all_years")]
    todo += [(table_chain(year), *x) for x in table_bodies(year).items()]
    for head, name, body in todo:
        sql = f"{head},\n_q AS ({body})\nSELECT * FROM _q"
        rep = []
        for c, t in _output_types(sql):
            if t in ("DOUBLE", "FLOAT"):
                rep.append(f'round("{c}", 6) AS "{c}"')
            elif t == "HUGEINT":  # DuckDB widens some counts; Spark counts are BIGINT
                rep.append(f'CAST("{c}" AS BIGINT) AS "{c}"')
        if rep:
            sql = f"{head},\n_q AS ({body})\nSELECT * REPLACE ({', '.join(rep)}) FROM _q"
        out[name] = sql
    return out
