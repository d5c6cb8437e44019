"""Code lists, lookup tables and constants of the accident data model.

FIXED VALUES. Everything in this module must equal the conventions of the two
national accident sources and of the original workflow, or results change.
They are stated plainly, in natural order, and nowhere else in the package.
"""

from __future__ import annotations

# --- FIXED VALUES: harmonised category domains (natural order) ---------------

MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"]
WEEKDAY_LABELS = ["Mo", "Di", "Mi", "Do", "Fr", "Sa", "So"]
DAYPART_LABELS = ["Nacht", "Vormittag", "Nachmittag", "Abend"]
SEVERITY_LABELS = ["Tot", "Schwer", "Leicht"]

# Display order used by the daypart analysis (morning first).
DAYPART_REPORT_ORDER = ["Vormittag", "Nachmittag", "Abend", "Nacht"]

# --- FIXED VALUES: German source (DE) codes ------------------------------------

# UWOCHENTAG: 1 = Sunday, 2 = Monday ... 7 = Saturday.
DE_WEEKDAY = {1: "So", 2: "Mo", 3: "Di", 4: "Mi", 5: "Do", 6: "Fr", 7: "Sa"}
# UKATEGORIE: 1 killed, 2 seriously injured, 3 slightly injured.
DE_SEVERITY = {1: "Tot", 2: "Schwer", 3: "Leicht"}
# ULAND: federal state number -> region code.
DE_STATES = {
    1: "SH_DE", 2: "HH_DE", 3: "NI_DE", 4: "HB_DE", 5: "NW_DE", 6: "HE_DE",
    7: "RP_DE", 8: "BW_DE", 9: "BY_DE", 10: "SL_DE", 11: "BE_DE", 12: "BB_DE",
    13: "MV_DE", 14: "SN_DE", 15: "ST_DE", 16: "TH_DE",
}

# --- FIXED VALUES: Swiss source (CH) codes -------------------------------------

CH_WEEKDAY = {
    "aw401": "Mo", "aw402": "Di", "aw403": "Mi", "aw404": "Do",
    "aw405": "Fr", "aw406": "Sa", "aw407": "So",
}
# as4 is deliberately absent: such rows get a NULL severity and drop as errors.
CH_SEVERITY = {"as1": "Tot", "as2": "Schwer", "as3": "Leicht"}
# 26 keys; ZG is absent and FL present, exactly as in the original mapping.
CH_CANTONS = [
    "AG", "AI", "AR", "BE", "BL", "BS", "FR", "GE", "GL", "GR", "JU", "LU", "NE",
    "NW", "OW", "SG", "SH", "SO", "SZ", "TG", "TI", "UR", "VD", "VS", "ZH", "FL",
]
CH_SEVERITY_TYPO = "AccidentSeverityCaytegory"

# --- FIXED VALUES: hour and flag encodings -------------------------------------

# Pre-binned hour ranges as they appear in some extracts.
DAYPART_RANGES = {"00-06": "Nacht", "06-12": "Vormittag", "12-18": "Nachmittag", "18-24": "Abend"}
# Numeric hour bins: [0,6) Nacht, [6,12) Vormittag, [12,18) Nachmittag, [18,24) Abend.
DAYPART_BOUNDS = [(0, 6, "Nacht"), (6, 12, "Vormittag"), (12, 18, "Nachmittag"), (18, 24, "Abend")]

# Accepted spellings of the motorcycle flag (case-sensitive, untrimmed).
MOTORCYCLE_TEXT = {
    "0": 0, "1": 1, "0.0": 0, "1.0": 1,
    "false": 0, "true": 1, "False": 0, "True": 1, "FALSE": 0, "TRUE": 1,
}

# Lower-cased labels counted as fatal, and the two "severe" presets.
FATAL_LABELS = ["tot", "tod", "toedlich", "tödlich"]
SEVERE_PRESETS = {
    # dashboard definition: fatal or seriously injured
    "serious_or_fatal": ["tot", "tod", "toedlich", "tödlich", "schwer"],
    # command-line definition: its list misses "tot", so fatal rows fall out
    "serious_only": ["schwer", "tod", "tödlich", "schwerverletzt"],
}

# Daypart -> coarse day/night group.
DAYNIGHT_GROUP = {"Vormittag": "Tag", "Nachmittag": "Tag", "Abend": "Nacht/Abend", "Nacht": "Nacht/Abend"}

# --- FIXED VALUES: season schemes ----------------------------------------------

# scheme -> (ordered list of (label, month numbers), label for everything else)
SEASON_SCHEMES = {
    "winter_vs_rest": ([("Winter", [12, 1, 2])], "Rest des Jahres"),
    "meteorological": (
        [("Winter", [12, 1, 2]), ("Frühling", [3, 4, 5]), ("Sommer", [6, 7, 8]), ("Herbst", [9, 10, 11])],
        None,
    ),
    "daylight_thirds": (
        [("Winter", [11, 12, 1, 2]), ("Sommer", [5, 6, 7, 8]), ("Übergang", [3, 4, 9, 10])],
        None,
    ),
}

# --- FIXED VALUES: output (display) column names -------------------------------

DISPLAY_COLUMNS = {
    "AccidentUID": "Accident_ID",
    "AccidentYear": "Year",
    "AccidentMonth": "Month",
    "AccidentWeekDay": "Weekday",
    "AccidentHour": "Hour",
    "CantonCode": "Location",
    "AccidentSeverityCategory": "Severity",
    "AccidentInvolvingMotorcycle": "Motorcycle_Involved",
}
COUNTRY_CODES = ["CH", "DE"]

# --- FIXED VALUES: twilight reference points -----------------------------------

# (latitude, longitude) of each German state's centre; all Swiss cantons share
# one national centre. Local zones: Europe/Berlin (DE), Europe/Zurich (CH).
DE_POINTS = {
    "BW_DE": (48.6616, 9.3501),
    "BY_DE": (48.9384, 11.4283),
    "BE_DE": (52.5200, 13.4050),
    "BB_DE": (52.4126, 12.5316),
    "HB_DE": (53.0793, 8.8017),
    "HH_DE": (53.5753, 10.0153),
    "HE_DE": (50.6521, 9.1624),
    "MV_DE": (53.6127, 12.4296),
    "NI_DE": (52.6367, 9.8451),
    "NW_DE": (51.4332, 7.6616),
    "RP_DE": (50.1183, 7.3089),
    "SL_DE": (49.3964, 7.0229),
    "SN_DE": (51.1045, 13.2017),
    "ST_DE": (51.9503, 11.6923),
    "SH_DE": (54.2194, 9.6961),
    "TH_DE": (50.9051, 11.0238),
}
CH_POINT = (46.8182, 8.2275)
CH_REGION_KEY = "CH"
ZONE_DE = "Europe/Berlin"
ZONE_CH = "Europe/Zurich"
# Civil twilight: sun centre 6 degrees below the horizon (zenith 96 degrees).
CIVIL_TWILIGHT_ZENITH = 96.0
# Representative day of each month used for the twilight lookup.
REFERENCE_DAY = 15
DEFAULT_YEAR = 2024

# --- derived (not fixed) -------------------------------------------------------

MONTH_NUMBER = {label: i + 1 for i, label in enumerate(MONTH_LABELS)}
CH_REGIONS = {code: f"{code}_CH" for code in CH_CANTONS}


def region_points() -> list[tuple[str, float, float, str]]:
    """(region_key, lat, lng, zone) for the 16 German states and the Swiss centre."""
    pts = [(k, lat, lng, ZONE_DE) for k, (lat, lng) in DE_POINTS.items()]
    pts.append((CH_REGION_KEY, CH_POINT[0], CH_POINT[1], ZONE_CH))
    return pts
