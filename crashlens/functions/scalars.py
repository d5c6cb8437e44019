"""Row-wise column expressions.

Every function takes and returns ``pyspark.sql.Column`` objects and uses only
built-in functions, so whole-stage codegen covers them; no Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains as D

# fixed values: what ``str.strip()`` removes, and characters of Java number syntax (type suffixes, hexadecimal) that are no
# number elsewhere; a finite decimal number holds none of the latter
_WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_JAVA_ONLY = "dDfFxXpP"
_WIDE_BLANKS = "".join(c for c in _WHITESPACE if ord(c) > 0x20)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stripped(text: Column) -> Column:
    """``text`` without surrounding blanks; only text beyond ASCII is held against the long list (half the time per cell)."""
    ascii_blanks = "".join(c for c in _WHITESPACE if ord(c) < 0x80)
    return F.when(F.octet_length(text) == F.length(text), F.trim(text, F.lit(ascii_blanks))).otherwise(F.trim(text, F.lit(_WHITESPACE)))


def clean_text(c) -> Column:
    """Text form of a key, surrounding whitespace removed."""
    return _stripped(_col(c).cast("string"))


def lenient_number(c) -> Column:
    """Text -> DOUBLE, NULL when not numeric or NaN (one reference to the input).

    Spark's cast follows Java number syntax and trims ASCII blanks; one ``translate`` before it spoils what is a
    number in Java only ('5d', '0x1p3') and turns other blanks into ones that it trims."""
    text = F.translate(_col(c).cast("string"), _JAVA_ONLY + _WIDE_BLANKS, "?" * len(_JAVA_ONLY) + " " * len(_WIDE_BLANKS))
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def int_from_number(v) -> Column:
    """DOUBLE -> BIGINT when integral, else NULL."""
    v = _col(v)
    return F.when(v % 1 == 0, v.try_cast("bigint"))


def lenient_int(c) -> Column:
    """Text -> BIGINT; non-numeric or non-integral text gives NULL (Q19)."""
    return int_from_number(lenient_number(c))


_MAPS: dict[tuple, Column] = {}


def _map_literal(mapping: Mapping) -> Column:
    # Literal-only Column objects are reusable across DataFrames; building
    # each map once saves hundreds of driver-to-JVM calls per plan.
    key = tuple(mapping.items())
    if key not in _MAPS:
        _MAPS[key] = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return _MAPS[key]


def lookup(c, mapping: Mapping) -> Column:
    """Dictionary lookup; keys outside the map give NULL."""
    return F.try_element_at(_map_literal(mapping), _col(c))


def hour_bin_index(num) -> Column:
    """Numeric hour (DOUBLE) -> 0..3 index of its 6-hour daypart, truncating
    toward zero so -0.5 counts as hour 0 (Q7); NULL outside (-1, 24)."""
    h = _col(num)
    return F.when((h > -1) & (h < 24), F.floor(h.cast("int") / 6).cast("int"))


def daypart_from_parts(text, bin_index) -> Column:
    """P10 on pre-parsed parts: label > range text > numeric bin."""
    t, idx = _col(text), _col(bin_index)
    label = F.when(t.isin(D.DAYPART_LABELS), t)
    ranged = lookup(t, D.DAYPART_RANGES)
    # An explicit CASE: element_at over a literal array does not give NULL
    # for a NULL index on this Spark version.
    numeric = None
    for i, (_, _, name) in enumerate(D.DAYPART_BOUNDS):
        numeric = F.when(idx == i, F.lit(name)) if numeric is None else numeric.when(idx == i, F.lit(name))
    return F.coalesce(label, ranged, numeric)


def hour_to_daypart(c) -> Column:
    """P10: daypart from a raw hour. Priority: label > range text > number 0-23."""
    return daypart_from_parts(clean_text(c), hour_bin_index(lenient_number(c)))


def motorcycle_flag(c) -> Column:
    """Accepted 0/1 spellings -> BIGINT 0/1, everything else NULL (Q18)."""
    return lookup(_col(c).cast("string"), D.MOTORCYCLE_TEXT).cast("bigint")


def country(c="CantonCode") -> Column:
    """Country code = last two characters of the region code."""
    s = _col(c).cast("string")
    return F.when(F.length(s) >= 2, F.substring(s, -2, 2)).otherwise(s)


def daynight_group(c="AccidentHour") -> Column:
    """Daypart -> 'Tag' or 'Nacht/Abend'."""
    return lookup(c, D.DAYNIGHT_GROUP)


def month_number(c="AccidentMonth") -> Column:
    """Month label -> 1..12."""
    return lookup(c, D.MONTH_NUMBER).cast("int")


def season(month_num, scheme: str = "winter_vs_rest") -> Column:
    """Season label for a month number under one of three schemes (Q9).

    Months outside every listed group (including NULL) take the scheme's
    fallback label (Q10), which is NULL for schemes without one.
    """
    groups, fallback = D.SEASON_SCHEMES[scheme]
    m = _col(month_num)
    expr = None
    for label, months in groups:
        cond = m.isin(months)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(fallback)) if fallback is not None else expr


def _norm_label(c) -> Column:
    return F.lower(clean_text(c))


def is_fatal(c="AccidentSeverityCategory") -> Column:
    """Fatal flag (trimmed, lower-cased label in the fatal set); NULL -> false."""
    return F.coalesce(_norm_label(c).isin(D.FATAL_LABELS), F.lit(False))


def is_severe(c="AccidentSeverityCategory", preset: str | Iterable[str] = "serious_or_fatal") -> Column:
    """Severe flag under a named preset or an explicit label list (Q1)."""
    labels = D.SEVERE_PRESETS[preset] if isinstance(preset, str) else list(preset)
    return F.coalesce(_norm_label(c).isin(labels), F.lit(False))


def is_motorcycle(c="AccidentInvolvingMotorcycle") -> Column:
    """P20: motorcycle involved (value == 1); NULL or text -> false."""
    return F.coalesce(_col(c).cast("string").try_cast("double") == 1, F.lit(False))


def night_label(c="NightAccident") -> Column:
    """0/1 night flag -> 'Tag' / 'Nacht'."""
    return lookup(c, {0: "Tag", 1: "Nacht"})


def hour_bin(c="AccidentHourNumeric") -> Column:
    """Numeric hour -> daypart bin (<=5 Nacht, <=11 Vormittag, <=17 Nachmittag, else Abend)."""
    h = _col(c)
    return (F.when(h.isNull(), F.lit(None).cast("string"))
            .when(h <= 5, "Nacht").when(h <= 11, "Vormittag").when(h <= 17, "Nachmittag")
            .otherwise("Abend"))


def local_hour(utc_ntz, zone) -> Column:
    """Local wall-clock hour of a UTC TIMESTAMP_NTZ in the given zone (DST-aware).

    Independent of the session time zone.
    """
    z = zone if isinstance(zone, Column) else F.lit(zone)
    return F.hour(F.convert_timezone(F.lit("UTC"), z, _col(utc_ntz)))


def region_key(c="CantonCode") -> Column:
    """Twilight reference point of a region code (all Swiss cantons share one)."""
    s = _col(c)
    return F.when(s.endswith("_CH"), F.lit(D.CH_REGION_KEY)).otherwise(s)


def night_flag(hour, dawn_hour, dusk_hour) -> Column:
    """1 when hour < dawn or hour > dusk; the edge hours count as day.

    A missing hour (or missing twilight) compares as false and gives 0, like
    the command-line workflow (Q3). NaN never reaches here (lenient_int).
    """
    h = _col(hour)
    pred = (h < _col(dawn_hour)) | (h > _col(dusk_hour))
    return F.when(F.coalesce(pred, F.lit(False)), 1).otherwise(0).cast("int")


def span_hours(begin, end) -> Column:
    """Hours between two UTC TIMESTAMP_NTZ values (independent of the
    session time zone, so no DST shift of the session zone leaks in)."""
    return F.timestamp_diff("SECOND", _col(begin), _col(end)) / 3600.0


def _flip_location(c, to_display: bool) -> Column:
    text = F.trim(_col(c).cast("string"), F.lit(_WHITESPACE))
    parts = F.split(text, "_")
    left = F.upper(F.try_element_at(parts, F.lit(1)))
    right = F.upper(F.try_element_at(parts, F.lit(2)))
    two = F.size(parts) == 2
    left_is_country = left.isin(D.COUNTRY_CODES)
    right_is_country = right.isin(D.COUNTRY_CODES)
    if to_display:   # country first: AG_CH -> CH_AG
        a, b = F.concat_ws("_", left, right), F.concat_ws("_", right, left)
    else:            # country last: CH_AG -> AG_CH
        a, b = F.concat_ws("_", right, left), F.concat_ws("_", left, right)
    return (F.when(text.isNull(), F.lit(None).cast("string"))
            .when(two & left_is_country, a)
            .when(two & right_is_country, b)
            .otherwise(text))


def location_to_display(c="CantonCode") -> Column:
    """Internal region code AG_CH -> display CH_AG (trim, upper; other shapes kept)."""
    return _flip_location(c, True)


def location_to_internal(c="Location") -> Column:
    """Display code CH_AG -> internal AG_CH."""
    return _flip_location(c, False)


def reasons_to_display(c="ErrorReasons") -> Column:
    """Rename internal column names inside the reason text."""
    out = _col(c)
    for internal, display in D.DISPLAY_COLUMNS.items():
        out = F.replace(out, F.lit(internal), F.lit(display))
    return out


def german_int(c) -> Column:
    """1234567 -> '1.234.567'."""
    return F.translate(F.format_number(_col(c), 0), ",", ".")


def german_percent(c) -> Column:
    """12.345 -> '12,3 %'."""
    return F.concat(F.translate(F.format_string("%.1f", _col(c).cast("double")), ".", ","), F.lit(" %"))


def german_hours(c) -> Column:
    """9.61 -> '9,6 h'; NULL -> '-'."""
    return F.coalesce(
        F.concat(F.translate(F.format_string("%.1f", _col(c).cast("double")), ".", ","), F.lit(" h")),
        F.lit("-"),
    )
