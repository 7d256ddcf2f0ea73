"""Scalar text functions (Column -> Column).

All of them are built-in Spark expressions and stay inside whole-stage
codegen, except :func:`nfkc`, which has no JVM equivalent and runs as an
Arrow-batched pandas UDF that only receives the non-ASCII rows.

Regular expressions are Java syntax. Python's ``\\d`` and ``\\s`` are Unicode
aware while Java's are ASCII; texts reach these rules after NFKC, so ASCII
digits are used, and whitespace is spelled out as the exact set of characters
Python's ``str.isspace`` accepts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference's rules for the same results):
# whitespace set = Python str.isspace; triangles that mean a minus sign;
# magnitude words; trailing unit characters; stock, date, money patterns.
WS_CLASS = (
    "\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)
TRIANGLES = "▲△▴▵"
MILLION_YEN = "百万円"
THOUSAND_YEN = "千円"
TRAILING_UNITS = "円株個"
STOCK_UNIT_RE = "株式の状況\\(1単元の株式数([0-9]+)株\\)"
DATE_RE = "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日"
BIRTH_DATE_RE = "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日生"
YEN_SEN_RE = "([0-9]+)円([0-9]+)銭"
NOTE_MARKER_RE = "^※[0-9]([0-9]+)"
BRACKET_NUMBER_RE = "〔[0-9]+〕"
HAS_DATE_RE = "[０-９0-9]{4}年[０-９0-9]{1,2}月[０-９0-9]{1,2}日"
HEADING_NUMBER_RE = "^[(（]?[０-９0-9]+[)）]?[ 　]*"
HEADING_BRACKETS_RE = "[【】]"
PLAIN_DECIMAL_RE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
FLOAT_TEXT_RE = (
    "(?i)^[+-]?(([0-9]+(_[0-9]+)*([.]([0-9]+(_[0-9]+)*)?)?|[.][0-9]+(_[0-9]+)*)"
    "(e[+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)$"
)
NO_TRANSLATION_RE = "(?U)^[\\w\\s\\p{P}]*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- C1 ----
@F.pandas_udf(T.StringType())
def _nfkc_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


# Characters that NFKC leaves as they are whatever stands beside them: ASCII, the
# comma and full stop of Japanese, brackets, kana without the voicing marks and
# their own compatibility forms, the triangles, and the unified ideographs.
FOLDED_CLASS = (
    "\\x00-\\x7F\\x{25b2}-\\x{25b5}\\x{3001}-\\x{3003}\\x{3008}-\\x{3011}\\x{3041}-\\x{3096}"
    "\\x{30a1}-\\x{30fe}\\x{4e00}-\\x{9fff}"
)


def nfkc(x) -> Column:
    """Unicode compatibility fold. Only rows with a character that it may
    change are shipped to Python (others travel as Arrow nulls)."""
    from gridwork.session import ship_package
    ship_package()
    x = _c(x)
    return F.coalesce(_nfkc_batch(F.when(x.rlike(f"[^{FOLDED_CLASS}]"), x)), x)


def fold_stored(df, col: str):
    """C1 on a column of a stored table, of which every text is looked at first. Rows with a character that the fold
    may change go through Python by themselves; where there is none, as in most tables, no row does."""
    foreign = F.coalesce(F.col(col).rlike(f"[^{FOLDED_CLASS}]"), F.lit(False))
    odd = df.filter(foreign)
    return df if odd.isEmpty() else df.filter(~foreign).unionByName(odd.withColumn(col, nfkc(F.col(col))))


# ---------------------------------------------------------- C2 .. C6 ----
def drop_space(x) -> Column:
    """Remove every character Python's ``\\s`` matches."""
    return F.regexp_replace(_c(x), f"[{WS_CLASS}]", "")


def drop_comma_triangles(x) -> Column:
    """C3 + C4: delete ``,`` and turn the four triangles into ``-``."""
    return F.translate(_c(x), TRIANGLES + ",", "-" * len(TRIANGLES))


def magnitude_suffix(x) -> Column:
    """``0百万円`` -> ``0``; text ending in 百万円 / 千円 gets every copy replaced."""
    x = _c(x)
    return (
        F.when(x == F.lit("0" + MILLION_YEN), F.lit("0"))
        .when(x.endswith(MILLION_YEN), F.regexp_replace(x, MILLION_YEN, "000000"))
        .when(x.endswith(THOUSAND_YEN), F.regexp_replace(x, THOUSAND_YEN, "000"))
        .otherwise(x)
    )


def rstrip_units(x) -> Column:
    """Strip any trailing run of 円 株 個."""
    x = _c(x)
    ends = x.endswith(TRAILING_UNITS[0]) | x.endswith(TRAILING_UNITS[1]) | x.endswith(TRAILING_UNITS[2])
    return F.when(ends, F.regexp_replace(x, f"[{TRAILING_UNITS}]+$", "")).otherwise(x)


def normalize_text(x, with_nfkc: bool = True) -> Column:
    """C1..C6 in the reference's order (one expression; for long chains on a
    DataFrame prefer :func:`with_steps` with :data:`NORMALIZE_STEPS`)."""
    x = _c(x)
    if with_nfkc:
        x = nfkc(x)
    return rstrip_units(magnitude_suffix(drop_comma_triangles(drop_space(x))))


def with_steps(df, col: str, steps):
    """Apply Column -> Column functions one ``withColumn`` at a time.

    Rules that look at their input several times would otherwise nest into
    an expression tree that grows with the product of the references; as
    separate projections each step reads a plain column."""
    for fn in steps:
        df = df.withColumn(col, fn(F.col(col)))
    return df


# ---------------------------------------------------------- C7 .. C12 ---
def stock_unit(x) -> Column:
    """``株式の状況(1単元の株式数N株)`` anywhere -> the whole text becomes N."""
    x = _c(x)
    return F.when(x.contains("株式の状況"),
                  F.regexp_replace(x, f"(?s)^.*?{STOCK_UNIT_RE}.*$", "$1")).otherwise(x)


def _iso(x: Column, pattern: str, needle: str) -> Column:
    # the groups are read from the (short) first match, not the whole text
    m = F.regexp_extract(x, pattern, 0)
    iso = F.concat(
        F.regexp_extract(m, pattern, 1), F.lit("-"),
        F.lpad(F.regexp_extract(m, pattern, 2), 2, "0"), F.lit("-"),
        F.lpad(F.regexp_extract(m, pattern, 3), 2, "0"),
    )
    return F.when(x.contains(needle) & (m != ""), F.replace(x, m, iso)).otherwise(x)


def date_iso(x) -> Column:
    """The first ``Y年M月D日`` -> ``YYYY-MM-DD``; every copy of that match is replaced."""
    return _iso(_c(x), DATE_RE, "日")


def birth_date(x) -> Column:
    """As C8 for ``Y年M月D日生`` (the 生 is dropped)."""
    return _iso(_c(x), BIRTH_DATE_RE, "日生")


def _two_digits(d: Column) -> Column:
    """``f'{int(d):02}'`` for a digit string of any length."""
    s = F.regexp_replace(d, "^0+", "")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def yen_sen(x) -> Column:
    """``N円M銭`` anywhere -> the whole text becomes ``N.MM``."""
    x = _c(x)
    return F.when(
        x.contains("銭") & x.rlike(YEN_SEN_RE),
        F.concat(F.regexp_extract(x, YEN_SEN_RE, 1), F.lit("."),
                 _two_digits(F.regexp_extract(x, YEN_SEN_RE, 2))),
    ).otherwise(x)


def note_marker(x) -> Column:
    """C11: text starting ``※d`` + digits -> only the later digits."""
    x = _c(x)
    return F.when(x.startswith("※"), F.regexp_replace(x, f"(?s){NOTE_MARKER_RE}.*$", "$1")).otherwise(x)


def bracket_number(x) -> Column:
    """Delete every ``〔digits〕``."""
    x = _c(x)
    return F.when(x.contains("〔"), F.regexp_replace(x, BRACKET_NUMBER_RE, "")).otherwise(x)


# C1..C6 and the post-scaling rules as step lists for :func:`with_steps`.
NORMALIZE_STEPS = [nfkc, drop_space, drop_comma_triangles, magnitude_suffix, rstrip_units]
PRE_SCALE_STEPS = [drop_space, drop_comma_triangles, magnitude_suffix, rstrip_units,
                   note_marker, bracket_number]
POST_SCALE_STEPS = [note_marker, bracket_number, stock_unit, date_iso, birth_date, yen_sen]


# --------------------------------------------------------- C13 .. C19 ---
def is_decimal_text(x) -> Column:
    """C13 test: plain decimal text (sign, digits, optional point)."""
    return _c(x).rlike(PLAIN_DECIMAL_RE)


def is_number(x) -> Column:
    """C14 (older variant): Python ``float()`` would accept the text."""
    return _c(x).rlike(FLOAT_TEXT_RE)


def has_date(x) -> Column:
    """A 4-digit 年 1-2 月 1-2 日 date in half or full width digits."""
    return _c(x).rlike(HAS_DATE_RE)


def strip_ws(x) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(_c(x), f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def clean_heading(x) -> Column:
    """Drop one leading (bracketed) number and spaces, drop 【】, strip."""
    x = F.regexp_replace(_c(x), HEADING_NUMBER_RE, "")
    return strip_ws(F.regexp_replace(x, HEADING_BRACKETS_RE, ""))


def tab_order(x) -> Column:
    """C17: the number after ``-tab`` as an order key, exact at any length: no
    number last, then by the count of digits (without leading zeros), then by them."""
    d = F.regexp_extract(_c(x), "-tab([0-9]+)", 1)
    digits = F.ltrim(d, F.lit("0"))
    return F.struct((d == "").alias("none"), F.length(digits).alias("n"), digits.alias("d"))


def tab_number(x) -> Column:
    """C17: the digits after ``-tab`` as a number of up to 38 digits; NULL if none (or more:
    :func:`tab_order` sorts numbers of any length)."""
    d = F.regexp_extract(_c(x), "-tab([0-9]+)", 1)
    return F.when(d != "", d.try_cast("decimal(38,0)"))


def doc_prefix(x) -> Column:
    """First 8 characters of a table id."""
    return F.substring(_c(x), 1, 8)


def needs_translation(x) -> Column:
    """True unless the whole text is word characters, spaces or punctuation."""
    return ~_c(x).rlike(NO_TRANSLATION_RE)
