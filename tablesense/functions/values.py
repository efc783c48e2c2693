"""Value-level predicates used by the profile (SQL text, JVM-side)."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Patterns and tolerances that must equal the reference's.
# ---------------------------------------------------------------------------
# A string counts as numeric when it matches this pattern.
NUMERIC_STRING_PATTERN = "^-?[0-9]*\\.?[0-9]+$"
# float64 narrows to float32 when every value moves by at most this much.
FLOAT32_TOLERANCE = 5e-4
# end of fixed values

# Forms in which text is read as a date or time. A column is temporal if all its
# values have one form and parse; which of two readings of '03/04/2024' is meant
# is decided by the values of the whole column. The prefix keeps bare years
# ('5800') and time-only text out of Spark's lenient cast.
DATE_PREFIX_PATTERN = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
TIME = "( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
DOT_PATTERN = f"^[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}{TIME}"
YEAR_PATTERN = f"^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}{TIME}"
SLASH_PATTERN = f"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{TIME}"
DASH_PATTERN = f"^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}{TIME}"
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DAY_NAME_PATTERN = f"(?i)^([0-9]{{1,2}})[ -]({MONTHS})[ -]([0-9]{{4}}){TIME}"  # 31 Jan 2024
NAME_DAY_PATTERN = f"(?i)^({MONTHS}) ([0-9]{{1,2}}),? ([0-9]{{4}}){TIME}"     # January 31, 2024
OFFSET_PATTERN = "[0-9](Z|[+-][0-9]{2}:?[0-9]{2})$"

# Bits of a set of forms. The set of a column is the intersection of its values' sets.
FORMS = {"y-m-d": 1, "d.m.y": 2, "y/m/d": 4, "m/d/y": 8, "d/m/y": 16, "m-d-y": 32, "d-m-y": 64, "month name": 128}


def date_kind_sql(s: str) -> str:
    """Number of the pattern that a text has, null if none; texts that begin with
    neither a digit nor a month are spared the patterns."""
    may = (f"(left({s}, 1) BETWEEN '0' AND '9' OR lower(left({s}, 3)) IN "
           "('jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'))")
    patterns = [DATE_PREFIX_PATTERN, DOT_PATTERN, YEAR_PATTERN, SLASH_PATTERN, DASH_PATTERN, DAY_NAME_PATTERN, NAME_DAY_PATTERN]
    return f"CASE WHEN {may} THEN CASE " + " ".join(f"WHEN {s} RLIKE '{p}' THEN {k}" for k, p in enumerate(patterns, 1)) + " END END"


def date_sql(s: str, kind: str) -> str:
    """TIMESTAMP_NTZ of a text of that kind, month first where it may be either.
    A time with an offset is taken to UTC."""
    utc = f"convert_timezone(current_timezone(), 'UTC', CAST(try_cast({s} AS TIMESTAMP) AS TIMESTAMP_NTZ))"
    number = "'([0-9]+)[./-]([0-9]+)[./-]([0-9]+)'"
    part = lambda pattern, i: f"regexp_extract({s}, '{pattern}', {i})"
    month = lambda m: f"CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left({m}, 3))) + 2) DIV 3 AS STRING)"
    named = lambda pattern, d, m: f"concat({part(pattern, 3)}, '-', {month(part(pattern, m))}, '-', {part(pattern, d)}, {part(pattern, 4)})"
    return (f"CASE WHEN {kind} = 1 AND {s} RLIKE 'T|:' AND {s} RLIKE '{OFFSET_PATTERN}' THEN {utc} ELSE try_cast(CASE {kind} WHEN 1 THEN {s} "
            f"WHEN 2 THEN regexp_replace({s}, {number}, '$3-$2-$1') WHEN 3 THEN regexp_replace({s}, {number}, '$1-$2-$3') "
            f"WHEN 4 THEN regexp_replace({s}, {number}, '$3-$1-$2') WHEN 5 THEN regexp_replace({s}, {number}, '$3-$1-$2') "
            f"WHEN 6 THEN {named(DAY_NAME_PATTERN, 1, 2)} WHEN 7 THEN {named(NAME_DAY_PATTERN, 2, 1)} END AS TIMESTAMP_NTZ) END")


def day_first_date_sql(s: str, kind: str) -> str:
    """The other reading of a text that may be either, else null."""
    return f"CASE WHEN {kind} IN (4, 5) THEN try_cast(regexp_replace({s}, '([0-9]+)[./-]([0-9]+)[./-]([0-9]+)', '$3-$2-$1') AS TIMESTAMP_NTZ) END"


def date_forms_sql(s: str, kind: str, a: str, b: str) -> str:
    """Bits of the forms in which a text of that kind, with the readings a and
    b, parses (0: none); null of a null."""
    one = lambda name, reading: f"if({reading} IS NULL, 0, {FORMS[name]})"
    cases = [one("y-m-d", a), one("d.m.y", a), one("y/m/d", a), f"{one('m/d/y', a)} + {one('d/m/y', b)}", f"{one('m-d-y', a)} + {one('d-m-y', b)}",
             one("month name", a), one("month name", a)]
    return f"if({s} IS NULL, NULL, CASE {kind} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases, 1)) + " ELSE 0 END)"


def day_first_sql(forms: str) -> str:
    """Whether a column with these forms is read day first: only if month first is out."""
    return f"({forms} & 24 = 16 OR {forms} & 96 = 64)"
