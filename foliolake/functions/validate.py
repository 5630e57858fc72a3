"""Typed value checks as struct(ok, reason) columns, and canonical value sets.

The reason texts are part of the contract. Nulls are 'empty value'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolake.functions.text import norm

# Fixed values.
DOSE_UNITS = ("mg", "mcg", "g", "ml", "tablet", "tablets", "capsule", "capsules", "drop", "drops", "unit", "units")
CURRENCY = r"(?:[£$€]|GBP|USD|EUR)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = "january february march april may june july august september october november december sept"
FREQUENCY = (
    r"(?i)(?:once|twice|three|four|five|six|\d+)\s*times?\s*(?:a\s*|per\s*)?(?:day|daily|week|weekly)"
    r"|every\s*\d+(?:\s*(?:to|-)\s*\d+)?\s*(?:hours?|hrs?|h)\b"
    r"|\b(?:bd|b\.d\.|tds|t\.d\.s\.|qds|q\.d\.s\.|prn|p\.r\.n\.|nocte|mane|od|qid|tid|bid)\b"
    r"|at\s+bedtime|as\s+(?:required|needed)|in\s+the\s+morning"
)


def _result(ok: Column, reason: Column) -> Column:
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, F.lit("ok")).otherwise(reason).alias("reason"))


def _tokens(v: Column) -> Column:
    return F.filter(F.split(v, r"\s+"), lambda t: t != "")


def sort_code(v: Column) -> Column:
    run = F.regexp_replace(F.regexp_extract(F.trim(v), r"^[0-9 -]*", 0), r"[-\s]", "")
    return _result(run.rlike(r"^\d{6}$"), F.concat(F.lit("6 digits required, got "), F.length(run).cast("string")))


def account(v: Column) -> Column:
    token = F.coalesce(F.try_element_at(F.filter(_tokens(v), lambda t: t.rlike(r"\d")), F.lit(1)), F.lit(""))
    digits = F.regexp_replace(token, r"\D", "")
    n = F.length(digits)
    masked = (n == 4) | v.rlike(r"[*xX#]") | F.lower(v).contains("ending")
    fits = n.between(4, 12)
    reason = F.when(~fits, F.concat(F.lit("4-12 digits required, got "), n.cast("string"))).when(masked, "masked, last 4 digits only").otherwise("ok")
    return F.struct(fits.alias("ok"), reason.alias("reason"))


def calendar_date(v: Column) -> Column:
    """The day a value names, or null: day first with / or -, year first with -, a month's name, or eight digits."""
    s = F.trim(v)
    tok = F.regexp_extract(s, r"^(\S*)", 1)
    part = lambda text, pattern, i: F.regexp_extract(text, pattern, i)
    # The written forms.
    dmy, ymd = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2}|\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    named = r"(?i)^(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?\s*,?\s*(\d{2}|\d{4})$"
    name = F.lower(part(s, named, 2))
    known = F.array_contains(F.array(*[F.lit(m) for m in (*MONTH_NAMES.split(), *MONTHS)]), name)
    month = F.when(known, F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(name, 1, 3)).cast("string"))
    late = (F.substring(tok, 1, 2).try_cast("int") > 31) | (F.substring(tok, 3, 2).try_cast("int") > 12)
    d = F.when(tok.rlike(dmy), part(tok, dmy, 1)).when(tok.rlike(ymd), part(tok, ymd, 3)).when(s.rlike(named), part(s, named, 1))
    m = F.when(tok.rlike(dmy), part(tok, dmy, 2)).when(tok.rlike(ymd), part(tok, ymd, 2)).when(s.rlike(named), month)
    y = F.when(tok.rlike(dmy), part(tok, dmy, 3)).when(tok.rlike(ymd), part(tok, ymd, 1)).when(s.rlike(named), part(s, named, 3))
    packed = tok.rlike(r"^\d{8}$")
    d = F.when(packed, F.when(late, F.substring(tok, 7, 2)).otherwise(F.substring(tok, 1, 2))).otherwise(d)
    m = F.when(packed, F.when(late, F.substring(tok, 5, 2)).otherwise(F.substring(tok, 3, 2))).otherwise(m)
    y = F.when(packed, F.when(late, F.substring(tok, 1, 4)).otherwise(F.substring(tok, 5, 4))).otherwise(y)
    year = y.try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(year.isNotNull() & (year > 0) & m.isNotNull() & d.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def date(v: Column) -> Column:
    return _result(calendar_date(v).isNotNull(), F.lit("not a calendar date"))


def money(v: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(v), rf"(?i)^(?:\s*{CURRENCY}\s*)+", ""), rf"(?i)(?:\s*{CURRENCY}\s*)+$", "")
    form = r"^([+-]?)\s*([\d,]+(?:\.\d+)?)$"
    number = F.regexp_extract(s, form, 2)
    decimals = F.length(F.regexp_extract(number, r"\.(\d+)$", 1))
    whole = F.regexp_extract(number, r"^([\d,]+)", 1)
    bad_group = number.contains(",") & ~whole.rlike(r"^\d{1,3}(?:,\d{3})+$")
    reason = (
        F.when(~s.rlike(form), F.concat(F.lit("not a monetary amount: "), F.trim(v)))
        .when(number.contains(".") & (decimals != 2), F.concat(F.lit("money needs two decimals, got "), decimals.cast("string")))
        .when(bad_group, F.concat(F.lit("bad thousands grouping: "), F.trim(v)))
    )
    return _result(reason.isNull(), reason)


def dosage(v: Column) -> Column:
    form = r"(?s)^.*?(\d+(?:\.\d+)?)\s*([A-Za-z]+)(.*)$"
    unit, rest = F.regexp_extract(v, form, 2), F.regexp_replace(F.regexp_extract(v, form, 3), r"^[ .,;]+|[ .,;]+$", "")
    reason = (
        F.when(~v.rlike(form), F.concat(F.lit("no dosage in value: "), F.trim(v)))
        .when(~F.lower(unit).isin(*DOSE_UNITS), F.concat(F.lit("unknown unit: "), unit))
        .when((rest != "") & ~F.lower(rest).isin(*DOSE_UNITS) & ~rest.rlike(FREQUENCY), F.concat(F.lit("unknown frequency: "), rest))
    )
    return _result(reason.isNull(), reason)


def identifier(v: Column) -> Column:
    tok = F.regexp_extract(F.trim(v), r"^(\S*)", 1)
    bad = F.regexp_extract(tok, r"([^A-Za-z0-9-])", 1)
    n = F.length(tok)
    reason = (
        F.when(bad != "", F.concat(F.lit("invalid character in identifier: "), bad))
        .when(~n.between(4, 20), F.concat(F.lit("identifier must be 4-20 chars, got "), n.cast("string")))
        .when(~tok.rlike("[A-Za-z0-9]"), F.lit("identifier needs a letter or digit"))
    )
    return _result(reason.isNull(), reason)


def general(v: Column) -> Column:
    s = F.trim(v)
    reason = (
        F.when(s == "", "empty value")
        .when(F.length(s) >= 40, F.concat(F.lit("too long: "), F.length(s).cast("string"), F.lit(" chars")))
        .when(~s.rlike("[A-Za-z0-9]"), "no alphanumeric")
    )
    return _result(reason.isNull(), reason)


#: kind -> check; further kinds may be registered here.
VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "sort_code": sort_code, "account": account, "date": date, "money": money,
    "dosage": dosage, "identifier": identifier, "general": general,
}


def validate(kind: str | Column, v: Column) -> Column:
    """struct(ok, reason) under a fixed kind or a kind column; unknown kinds are refused."""
    empty = F.struct(F.lit(False).alias("ok"), F.lit("empty value").alias("reason"))
    if isinstance(kind, str):
        return F.when(v.isNull(), empty).otherwise(VALIDATORS[kind](v))
    out = F.when(v.isNull() & kind.isin(*VALIDATORS), empty)
    for name, check in VALIDATORS.items():
        out = out.when(kind == name, check(v))
    unknown = F.struct(F.lit(False).alias("ok"), F.concat(F.lit("unknown kind: "), F.coalesce(kind, F.lit(""))).alias("reason"))
    return out.otherwise(unknown)


def canonical(kind: str, v: Column) -> Column:
    """Sorted distinct comparable forms of a value; values that can't be read give an empty array.

    Two values agree when their arrays share a form. A day written in two
    orders has two forms; days with a month's name have none.
    """
    s = F.trim(F.coalesce(v, F.lit("")))
    one = lambda c, ok: F.when(ok, F.array(c)).otherwise(F.array().cast("array<string>"))
    if kind == "dosage":
        found = F.regexp_extract_all(s, F.lit(r"\d+(?:\.\d+)?\s*[A-Za-z]+"), F.lit(0))
        number = lambda t: F.regexp_extract(t, r"^([\d.]+)", 1)
        plain = lambda n: F.regexp_replace(F.regexp_replace(F.regexp_replace(n, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        unit = lambda t: F.lower(F.regexp_extract(t, r"([A-Za-z]+)$", 1))
        kept = F.filter(found, lambda t: unit(t).isin(*DOSE_UNITS))
        return F.array_sort(F.array_distinct(F.transform(kept, lambda t: F.concat(plain(number(t)), unit(t)))))
    if kind == "date":
        d = F.regexp_replace(F.regexp_extract(s, r"^(\S*)", 1), r"\D", "")
        d = F.when(F.length(d) == 6, F.concat(F.substring(d, 1, 4), F.lit("20"), F.substring(d, 5, 2))).otherwise(d)
        return one(d, F.length(d) == 8)
    if kind == "money":
        n = F.regexp_replace(s, r"[^\d.\-]", "").try_cast("decimal(18,2)")
        return one(n.cast("string"), n.isNotNull())
    if kind in ("account", "sort_code"):
        d = F.regexp_replace(s, r"\D", "")
        return one(d, d != "")
    return one(norm(s), norm(s) != "")
