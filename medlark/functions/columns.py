"""Column to Column: dates, ages, weights, units, names. All JVM-side."""

from __future__ import annotations

import json
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(c: Column) -> Column:
    """A double, null where the text is anything but a number (a Java suffix such as 5d is none)."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), F.expr("1") * F.trim(text).try_cast("double"))


def filled(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def day(c: Column) -> Column:
    return F.try_to_date(c, "yyyyMMdd")


def quarter_end(quarter: Column) -> Column:
    last = F.when(quarter.endswith("Q1"), "0331").when(quarter.endswith("Q2"), "0630").when(quarter.endswith("Q3"), "0930").otherwise("1231")
    return day(F.concat(F.substring(quarter, 1, 4), last))


def report_date(fda: Column, received: Column, event: Column, quarter: Column) -> Column:
    """The first valid date, else the quarter's last day."""
    return F.coalesce(day(fda), day(received), day(event), quarter_end(quarter))


def age_years(age: Column, unit: Column) -> Column:
    a, u = number(age), F.upper(F.trim(unit))
    by = {"YR": a, "MON": a / 12.0, "WK": a / 52.142857, "DY": a / 365.25, "HR": a / 8766.0, "DEC": a * 10.0}
    return reduce(lambda out, k: out.when(u.isin(*V.AGE_UNITS[k]), by[k]), list(by)[1:], F.when(u.isin(*V.AGE_UNITS["YR"]), by["YR"]))


def sex(c: Column) -> Column:
    s = F.upper(F.trim(c))
    return F.when(s.isin("M", "F"), s).otherwise("UNKNOWN")


def age_group(years: Column) -> Column:
    return F.when(years.isNull(), "UNKNOWN").when(years < 18, "<18").when(years < 41, "18-40").when(years < 65, "41-64").otherwise("65+")


def weight_kg(weight: Column, unit: Column) -> Column:
    """Kilograms, kept between 0.2 and 500."""
    w, u = number(weight), F.upper(F.trim(unit))
    kg = F.when(u.isin("KG", "KGS"), w).when(u.isin("LB", "LBS"), w * 0.45359237).when(u.isin("G", "GMS"), w / 1000.0).when(u == "OZ", w * 0.028349523125)
    return F.when((w > 0) & kg.between(0.2, 500.0), kg)


def clamped(c: Column, scale: float) -> Column:
    return F.least(F.greatest(c / scale, F.lit(0.0)), F.lit(1.0))


#: White space of regular expressions and the full stop.
_BLANKS = " \t\n\x0b\f\r."


def unit_token(c: Column) -> Column:
    """The micro sign becomes U before upper case, which would make a Greek letter of it."""
    u = F.upper(F.translate(F.trim(F.coalesce(c, F.lit(""))), "µμ", "UU"))
    u = F.replace(F.replace(F.replace(u, F.lit("²"), F.lit("2")), F.lit("**"), F.lit("")), F.lit("^"), F.lit(""))
    return F.translate(u, _BLANKS, "")


def _lookup(values: dict, key: Column, kind: str) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key).cast(kind)


def dose_dimension(token: Column) -> Column:
    return _lookup({u: d for d, _, us in V.DOSE_UNITS for u in us}, token, "string")


def dose_factor(token: Column) -> Column:
    return _lookup({u: f for _, f, us in V.DOSE_UNITS for u in us}, token, "double")


def base_unit(dimension: Column) -> Column:
    return _lookup(V.BASE_UNITS, dimension, "string")


def per_day(frequency: Column) -> Column:
    token = F.translate(F.upper(F.trim(F.coalesce(frequency, F.lit("")))), _BLANKS, "")
    return _lookup(V.PER_DAY, token, "double")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def positive_product(a: Column, b: Column) -> Column:
    return F.when((a > 0) & finite(a) & b.isNotNull() & finite(a * b), a * b)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def hash_bin(term: Column, bins: int) -> Column:
    """Reproducible in any engine: the first 32 bits of MD5."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(bins)).cast("int")


def atc_level(code: Column, length: int) -> Column:
    """The prefix of a well-formed code that is long enough."""
    return F.when(code.rlike("^[A-Z][0-9]{2}") & (F.length(code) >= length), F.substring(code, 1, length))


@cache
def _ascii_forms() -> str:
    """The compatibility characters that NFKC makes ASCII, as a JSON map: a table by rule, not by hand."""
    pairs = ((chr(k), unicodedata.normalize("NFKC", chr(k))) for k in range(0x80, 0x110000) if not 0xD800 <= k < 0xE000)
    return json.dumps({a: b for a, b in pairs if a != b and b.isascii()})


@cache
def _composed() -> str:
    """A pattern of ASCII letters with a combining mark that NFKC makes one character."""
    bases = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    marks = {chr(m): "".join(b for b in bases if len(unicodedata.normalize("NFKC", b + chr(m))) == 1) for m in range(0x300, 0x370)}
    return "|".join(f"[{b}]\\x{{{ord(m):x}}}" for m, b in marks.items() if b)


def compatible(c: Column) -> Column:
    """Compatibility forms as ASCII where they have one (full width, ligatures, small forms), letters with a combining mark
    as one character that isn't ASCII. Texts that are ASCII already aren't touched."""
    forms = F.from_json(F.lit(_ascii_forms()), "map<string,string>")
    plain = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(forms, x), x)), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(plain, _composed(), "\u00e9")).otherwise(c)


def drug_name(c: Column) -> Column:
    """A name without dose, form, release and salt. Compatibility forms are unified where there is anything but ASCII."""
    # marks go after the forms, so a trade mark sign has become letters by then
    name = F.regexp_replace(F.upper(F.trim(compatible(F.coalesce(c, F.lit(""))))), V.NAME_MARKS, "")
    name = F.regexp_replace(name, V.NAME_BRACKETS, " ")
    name = F.regexp_replace(name, V.NAME_FORM_TAIL, "")
    name = F.regexp_replace(name, rf"^\s*{V.NAME_DOSE}\s+", "")
    name = F.regexp_replace(name, V.NAME_ORDINAL, "")
    for _ in range(2):
        name = F.regexp_replace(name, rf"(?:\s+|\s*[-,/]\s*){V.NAME_DOSE}(?:\s*/\s*{V.NAME_DOSE})?\s*$", "")
        name = F.regexp_replace(name, V.NAME_RELEASE, "")
    for pattern in (V.NAME_SALTS, V.NAME_FORMS, rf"\b{V.NAME_DOSE}\b", "[^A-Z0-9]+"):
        name = F.regexp_replace(name, pattern, " ")
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def log_ror(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.log(ror(a, b, c, d, "always"))


def ror(a: Column, b: Column, c: Column, d: Column, smoothing: str) -> Column:
    """(a d) / (b c). smoothing: "always" adds a half to each cell, "zero" only where a cell is 0."""
    half = ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))
    if smoothing == "always":
        return half
    return F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), half).otherwise((a * d) / (b * c).cast("double"))
