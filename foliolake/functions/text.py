"""Text normal forms, repairs and text statistics as Column expressions.

All functions return null for a null text unless they say otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that recognition confuses with digits.
CONFUSED = "OoQDlI|!SsBZzGbT"
CONFUSED_AS = "0000111155822667"

# Keywords of the density classifier, in the order that breaks ties.
DENSITY_KEYWORDS = {
    "medical": ("mg", "tablet", "dose", "patient", "prescription", "capsule"),
    "banking": ("balance", "account", "sort code", "iban", "debit", "credit", "gbp", "atm"),
    "legal": ("agreement", "clause", "tenant", "landlord", "court", "deed", "witnesseth"),
    "general": ("notice", "meeting", "library", "parcel", "recipe", "school"),
}
DENSITY_ORDERS = {"scorer": ("medical", "banking", "legal", "general"), "reader": ("banking", "medical", "legal", "general")}

# Keywords of the hit classifier.
HIT_KEYWORDS = {
    "banking": (
        "account number", "sort code", "balance", "deposit", "withdrawal", "iban", "statement", "bank", "hsbc",
        "barclays", "lloyds", "natwest", "santander", "card ending", "direct debit", "standing order", "mortgage",
        "credit card", "transaction", "payment", "£", "$", "eur", "usd",
    ),
    "medical": (
        "prescription", "rx", "dosage", "mg", "ml", "tablet", "capsule", "patient", "diagnosis", "medication",
        "warning", "take one", "twice daily", "three times", "daily", "pharmacy", "doctor", "nhs", "drug", "dose",
        "treatment", "symptoms", "keep out of reach", "drowsiness",
    ),
    "legal": (
        "contract", "agreement", "clause", "hereby", "witnesseth", "party", "parties", "tenant", "landlord", "lease",
        "liability", "terms and conditions", "binding", "court", "case no", "plaintiff", "defendant", "judgment",
        "warrant", "affidavit", "notarized", "power of attorney", "testament",
    ),
}


def ascii_edges(pattern: str) -> str:
    """The pattern with word boundaries between ASCII word characters and others.

    Java's own boundary knows all letters; the original patterns meant ASCII
    ones. A boundary that opens a pattern, group or alternative looks back,
    any other looks ahead, so each must stand next to a word character.
    """
    opened = re.sub(r"(^(?:\(\?i\))?|[(|]|\?:)\\b", r"\1(?<![0-9A-Za-z_])", pattern)
    return opened.replace(r"\b", "(?![0-9A-Za-z_])")


def norm(text: Column) -> Column:
    """Scoring form: lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark lacks."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def norm_label(text: Column, compose: bool = False) -> Column:
    """Label scoring form: confusable glyphs as digits, upper case, only A-Z 0-9 . / : $ , -.

    With ``compose`` the text is brought to NFKC first (a Python step).
    """
    text = nfkc(text) if compose else text
    return F.regexp_replace(F.upper(F.translate(text, CONFUSED, CONFUSED_AS)), "[^A-Z0-9./:$,-]+", "")


def clean_for_training(text: Column, compose: bool = False) -> Column:
    """Blanks collapsed and trimmed; case and punctuation stay."""
    text = nfkc(text) if compose else text
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_to_charset(text: Column, keep: str = "0-9A-Z ") -> Column:
    """Upper case, characters outside ``keep`` dropped, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), f"[^{keep}]", ""), " +", " "))


def comparison_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))


def lexicon_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9 ]", " "), " +", " "))


def upper_tokens(text: Column) -> Column:
    """Runs of 0-9 A-Z of the upper-case text, in order."""
    return F.regexp_extract_all(F.upper(text), F.lit("[0-9A-Z]+"), F.lit(0))


def words(text: Column) -> Column:
    """Blank-separated words without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def repair_units(text: Column) -> Column:
    """Misread dose units put right; the order of the four rules matters.

    m9 to mg and m1 to ml come first, so the S rule sees the unit; a unit
    said twice is kept once.
    """
    out = F.regexp_replace(text, ascii_edges(r"(?i)m9\b"), "mg")
    out = F.regexp_replace(out, ascii_edges(r"(?i)m1\b"), "ml")
    out = F.regexp_replace(out, ascii_edges(r"\bS(?=\d{2,4}(?:m[gq]|m1|1m|mg|ml)?\b)"), "5")
    return F.regexp_replace(out, ascii_edges(r"(?i)(\d+)\s*(mg|ml)\s+\2\b"), "$1$2")


def exact_edges(pattern: str, word: str = "0-9A-Za-z_") -> str:
    """The pattern with boundaries between the given word characters and others, wherever they stand."""
    return pattern.replace(r"\b", f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))")


def count_all(text: Column, needles: tuple[str, ...]) -> Column:
    """Non-overlapping occurrences of every needle, summed."""
    total = F.lit(0)
    for k in needles:
        total = total + ((F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k)).cast("int")
    return total


def density_scores(text: Column) -> dict[str, Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    return {name: count_all(low, k) for name, k in DENSITY_KEYWORDS.items()}


def density_class(text: Column, tie_order: str = "scorer") -> Column:
    """Category with most keywords; ties go to the first of ``tie_order``, none to general."""
    scores = density_scores(text)
    top = F.greatest(*scores.values())
    out = F.when(top == 0, "general")
    for name in DENSITY_ORDERS[tie_order]:
        out = out.when(scores[name] == top, name)
    return out


def hit_class(text: Column) -> Column:
    """struct(category, confidence, hits): distinct keywords found, first best category wins."""
    low = F.lower(F.coalesce(text, F.lit("")))
    best = F.struct(F.lit("general").alias("category"), F.lit(0.1).alias("confidence"), F.lit(0).alias("hits"))
    for name, keys in HIT_KEYWORDS.items():
        hits = sum((low.contains(k).cast("int") for k in keys), F.lit(0))
        conf = F.least(F.lit(0.95), hits * 0.09 + 0.05)
        here = F.struct(F.lit(name).alias("category"), conf.alias("confidence"), hits.alias("hits"))
        best = F.when((hits > 0) & (conf > best["confidence"]), here).otherwise(best)
    return best


def structure_score(text: Column) -> Column:
    """How many structured tokens a text holds; case references count twice. Null or blank scores 0."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(ascii_edges(p)))
    return (
        count(r"(?i)\d+(?:\.\d+)?\s*mg\b")
        + count(r"\b\d{2}-\d{2}-\d{2}\b")
        + 2 * count(r"\b\d{4}-[A-Z]{2}-\d{3,8}\b")
        + count(r"(?<![\d-])\d{6,8}(?![\d-])")
        + count(r"(?:[£$€]|[A-Z]{3})\s?\d[\d,]*(?:\.\d{2})?")
    )


def is_garbage(text: Column) -> Column:
    """Under 10 characters, over 500 words, or over 60 % of words of one or two characters; null is garbage."""
    t = F.coalesce(text, F.lit(""))
    w = words(t)
    short = F.size(F.filter(w, lambda x: F.length(x) <= 2))
    return (F.length(F.trim(t)) < 10) | (F.size(w) > 500) | (F.size(w) == 0) | (short / F.greatest(F.size(w), F.lit(1)) > 0.6)


def retained(value: Column, source: Column) -> Column:
    """Does the value stand verbatim in the source, blanks and case aside?"""
    bare = lambda c: F.regexp_replace(F.upper(c), r"\s", "")
    return bare(source).contains(bare(value))


def contains_word(text: Column, needle: Column) -> Column:
    """Is the needle in the text, not next to a word character on either side?"""
    quoted = F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), F.replace(needle, F.lit("\\E"), F.lit("")), F.lit("\\E(?![\\p{L}\\p{N}_])"))
    return F.regexp_like(text, quoted)


def punctuation_rate(text: Column, keep: str = "0-9A-Za-z ") -> Column:
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, f"[{keep}]", "")), F.length(text)), F.lit(0.0))


def mask_digits(text: Column) -> Column:
    """Bullets for all but the last four digits; separators stay."""
    return F.regexp_replace(text, r"\d(?=(?:\D*\d){4})", "•")


def is_degenerate(digits: Column) -> Column:
    """Fewer than four digits, all the same, or one straight run up or down."""
    up, down = F.lit("0123456789"), F.lit("9876543210")
    return (F.length(digits) < 4) | digits.rlike(r"^(\d)\1+$") | F.contains(up, digits) | F.contains(down, digits)


def passes_luhn(digits: Column, least: int = 12) -> Column:
    """Checksum of card numbers of at least ``least`` digits."""
    return (F.length(digits) >= least) & digits.rlike(r"^\d+$") & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def is_substantial(value: Column) -> Column:
    """Four letters or digits, and two words of letters, or one of five, or nothing but a number."""
    alpha = F.regexp_extract_all(value, F.lit("[A-Za-z]{2,}"), F.lit(0))
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return (F.length(norm(value)) >= 4) & (
        (F.size(alpha) >= 2) | F.exists(alpha, lambda w: F.length(w) >= 5) | (F.trim(value).rlike(r"^[\d\s:.,/-]+$") & (digits >= 4))
    )


def value_to_right(text: Column, end: Column) -> Column:
    """What follows position ``end``, separators trimmed; a hyphen before a digit is a sign and stays."""
    rest = F.substring(text, end + 1, F.length(text))
    return F.rtrim(F.regexp_replace(rest, r"^(?:[ \t:#=|.,·—]|-(?!\d))+", ""))


def name_recovered(text: Column, name: Column, share: float = 0.7) -> Column:
    """The name's key stands in the text's key, or at least ``share`` of its tokens do."""
    t, n = lexicon_key(text), lexicon_key(name)
    parts = F.filter(F.split(n, " "), lambda w: w != "")
    have = F.split(t, " ")
    hit = F.size(F.filter(parts, lambda w: F.array_contains(have, w)))
    return (F.length(n) > 0) & (t.contains(n) | (hit / F.greatest(F.size(parts), F.lit(1)) >= share))


def error_kind(seen: Column, meant: Column) -> Column:
    """Class of a misread in label form: empty-label, read-nothing, length-differ, whitespace-only or ``n-char: meant->seen``."""
    g, w = norm_label(F.coalesce(seen, F.lit(""))), norm_label(F.coalesce(meant, F.lit("")))
    differ = F.size(F.filter(F.zip_with(F.split(g, ""), F.split(w, ""), lambda a, b: a != b), lambda x: x))
    return (
        F.when(F.length(w) == 0, "empty-label")
        .when(F.length(g) == 0, "read-nothing")
        .when(F.length(g) != F.length(w), "length-differ")
        .when(differ == 0, "whitespace-only")
        .otherwise(F.concat(differ.cast("string"), F.lit("-char: "), w, F.lit("->"), g))
    )


# Weighted evidence of two document types; each pattern counts once.
TYPE_EVIDENCE = {
    "receipt": (
        (r"\b(?:receipt|till\s*(?:no|number|#)?|transaction\s*(?:no|number|id)|ref(?:erence)?\s*no)\b", 3),
        (r"\b(?:sub-?total|total|amount\s+paid|balance\s+due|change\s+due)\b", 3),
        (r"\b(?:vat|gst|tax|cash|card|change|contactless|chip\s*&?\s*pin)\b", 2),
        (r"\b(?:visa|mastercard|master\s*card|amex|american\s+express)\b", 2),
        (r"\b(?:supermarket|market|grocer|shop|store|restaurant|cafe|café|fuel|petrol|garage)\b", 2),
        (r"\b(?:thank\s+you\s+for\s+shopping|please\s+come\s+again|items?|qty)\b", 2),
        (r"\b(?:opening\s+hours|tel|phone)\b", 1),
    ),
    "prescription": (
        (r"\b(?:prescription|prescribed|repeat\s+prescription)\b", 4),
        (r"\brx\b", 4),
        (r"\b(?:tablet|capsule|dose|dosage|sig|take\s+(?:one|two|1|2))\b", 3),
        (r"\b\d+\s*(?:mg|mcg|ml|iu|g)\b", 3),
        (r"\b(?:once|twice|three\s+times|four\s+times)\s+(?:a|per|daily)\b|\bevery\s+\d+\s+hours\b|\b(?:prn|bd|tds|qds|as\s+needed)\b", 3),
        (r"\b(?:patient|prescriber|dispensed|dispense|pharmacy|chemist|repeats?|refills?)\b", 3),
        (r"\b(?:gp|doctor|dr\.?|physician|consultant|surgery|clinic|medical\s+cent(?:re|er))\b", 2),
        (r"\b(?:date\s+of\s+birth|dob|nhs|medicare|quantity)\b", 2),
    ),
}
TYPE_FLOOR = 5


def _edges(pattern: str) -> str:
    """ASCII boundaries; behind a letter that is none, both ways. Every pattern that begins with one begins with a word character."""
    if pattern.isascii():
        return ascii_edges(pattern)
    return "(?<![0-9A-Za-z_])" + exact_edges(pattern[2:]) if pattern.startswith(r"\b") else exact_edges(pattern)


def evidence_score(text: Column, kind: str) -> Column:
    return sum((F.when(F.lower(text).rlike(_edges(p)), w).otherwise(0) for p, w in TYPE_EVIDENCE[kind]), F.lit(0))


def weighted_type(text: Column) -> Column:
    """struct(type, score, confidence): the type with most evidence (receipt wins ties), unrecognised under the floor."""
    t = F.coalesce(text, F.lit(""))
    a, b = evidence_score(t, "receipt"), evidence_score(t, "prescription")
    top, low = F.greatest(a, b), F.least(a, b)
    sure = 0.5 + 0.35 * (top - low) / F.greatest(top, F.lit(1)) + 0.15 * top / F.greatest(a + b, F.lit(1))
    named = top >= TYPE_FLOOR
    kind = F.when(~named, "unrecognised").when(a >= b, "receipt").otherwise("prescription")
    return F.struct(kind.alias("type"), top.alias("score"), F.when(named, sure).otherwise(top / (2 * TYPE_FLOOR)).alias("confidence"))


def reconcile_views(first: Column, first_conf: Column, second: Column) -> Column:
    """struct(category, confidence) of two classifiers: agreement is worth 0.5 at least;
    otherwise the first stands from 0.5 on, else the second at 0.5."""
    agree = first.eqNullSafe(second)
    category = F.when(agree | (first_conf >= 0.5), first).otherwise(second)
    conf = F.when(agree, F.greatest(first_conf, F.lit(0.5))).when(first_conf >= 0.5, first_conf).otherwise(F.lit(0.5))
    return F.struct(category.alias("category"), conf.alias("confidence"))


def known_found(text: Column, known: Column) -> Column:
    """The known values whose scoring form stands in the text's."""
    t = norm(F.coalesce(text, F.lit("")))
    return F.filter(F.coalesce(known, F.array().cast("array<string>")), lambda k: (F.length(norm(k)) > 0) & F.contains(t, norm(k)))


def is_legible(pixels: Column, least_range: int = 28, least_ink: float = 0.01) -> Column:
    """Enough contrast, and enough pixels darker than the midpoint. ``pixels`` is a flat array of signed bytes; empty is not legible."""
    v = F.transform(pixels, lambda x: F.pmod(x.cast("int"), F.lit(256)))
    hi, lo = F.array_max(v), F.array_min(v)
    ink = F.size(F.filter(v, lambda x: x < (hi + lo) / 2)) / F.greatest(F.size(v), F.lit(1))
    return F.coalesce((hi - lo >= least_range) & (ink >= least_ink), F.lit(False))


def fits_density(label: Column, width: Column, px_per_char: int = 12, least: int = 2, most: int = 47) -> Column:
    """Label length within bounds and the crop wide enough for it."""
    n = F.length(label)
    return F.coalesce(n.between(least, most) & (width / F.greatest(n, F.lit(1)) >= px_per_char), F.lit(False))


def parameter_fingerprint(fields: list[Column]) -> Column:
    """Twelve hex digits of a struct's JSON; fields in the given order."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 12)


def ramp(value: Column, low: float, high: float) -> Column:
    """0 below low, 1 above high, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


_DIGITS = "零一二三四五六七八九"


def chinese_number(n: int | None) -> str | None:
    """A whole number in Chinese numerals, grouped by ten thousands."""
    if n is None:
        return None
    if n < 0:
        return "負" + chinese_number(-n)
    if n < 10:
        return _DIGITS[n]
    for size, unit in ((10**8, "億"), (10**4, "萬"), (1000, "千"), (100, "百"), (10, "十")):
        if n >= size:
            head, rest = divmod(n, size)
            lead = "" if size == 10 and head == 1 else chinese_number(head)
            gap = "零" if rest and rest < size // 10 else ""
            return lead + unit + gap + (chinese_number(rest) if rest else "")
    raise AssertionError(n)


@F.pandas_udf(T.StringType())
def chinese_numerals(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda n: None if pd.isna(n) else chinese_number(int(n)))


def wordpieces(words_: list[str], vocabulary: set[str], unknown: str = "[UNK]") -> list[str]:
    """Greedy longest pieces of each word; inner pieces begin with ##; a word that can't be cut is unknown."""
    out: list[str] = []
    for w in words_:
        pieces, at = [], 0
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in vocabulary), None)
            if end is None:
                pieces = [unknown]
                break
            pieces.append(("##" if at else "") + w[at:end])
            at = end
        out += pieces
    return out


def wordpiece_tokens(text: Column, vocabulary: set[str]) -> Column:
    """Lower-case words and single punctuation marks, cut into pieces (vocabulary ships with the function)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: None if p is None else wordpieces(list(p), vocabulary))

    return run(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0)))
