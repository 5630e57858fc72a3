"""Typed values with the evidence that speaks for them: line context, checksums and confidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolake.session import spread

# Context patterns, their weights and labels.
ACCOUNT_CONTEXT = (
    (r"\b(?:account|acct|a/c)\s*(?:number|no\.?|#)?", 0.25, "account"),
    (r"\b(?:card|credit\s+card|debit\s+card)\s*(?:number|no\.?|#)?", 0.25, "card"),
    (r"\b(?:sort\s*code|routing|iban|swift|bic)\b", 0.22, "banking code"),
    (r"\b(?:reference|ref|invoice|statement|customer|client|member|policy|claim|nhs|national\s+insurance|nino|ssn|vat|tax)\s*(?:number|no\.?|#|id)?", 0.2, "reference"),
    (r"\b(?:patient|prescription|rx|casenote|file)\s*(?:number|no\.?|#|id)?", 0.2, "record id"),
    (r"\b(?:your|our)\s+(?:number|no)\b", 0.08, "weak context"),
)
_CONTEXT = [(re.compile(p, re.I | re.A), w, n) for p, w, n in ACCOUNT_CONTEXT]
_RUN = re.compile(r"\b(\d[\d '.\-]{5,48}\d)\b", re.A)
LEAST_DIGITS, MOST_DIGITS = 8, 34


def line_context(text: str, start: int, end: int, before: int, after: int) -> tuple[str, str, str]:
    """(what stands before, what stands after, the whole line): up to so many characters, on the same line only."""
    a = text.rfind("\n", 0, start) + 1
    z = text.find("\n", end)
    z = len(text) if z < 0 else z
    return text[max(a, start - before) : start], text[end : min(z, end + after)], text[a:z]


def luhn(digits: str) -> bool:
    """The checksum of card numbers; fewer than 12 digits never pass."""
    odd = [int(d) for d in digits[-1::-2]]
    even = [int(d) * 2 for d in digits[-2::-2]]
    return len(digits) >= 12 and sum(odd + [d - 9 if d > 9 else d for d in even]) % 10 == 0


def degenerate(digits: str) -> bool:
    """Too short, one digit only, or counting up or down throughout."""
    steps = {ord(b) - ord(a) for a, b in zip(digits, digits[1:])}
    return len(digits) < 4 or steps in ({0}, {1}, {-1})


def account_values(text: str) -> list[tuple]:
    """(start, raw, digits, masked, is_card, luhn, context, confidence, valid) of the account-like numbers, best first."""
    out = []
    for m in _RUN.finditer(text):
        raw = re.sub(r"\s+", " ", m.group()).strip()
        digits = re.sub(r"\D", "", raw)
        if not LEAST_DIGITS <= len(digits) <= MOST_DIGITS or degenerate(digits):
            continue
        before, after, _ = line_context(text, m.start(), m.end(), 45, 20)
        hits = [(w, n) for rx, w, n in _CONTEXT if rx.search(f"{before} {raw} {after}")]
        weight = sum(w for w, _ in hits)
        card = 15 <= len(digits) <= 19
        passes = luhn(digits) if card else None
        sure = 0.35 + weight
        if card:
            sure += 0.35 if passes else -0.1
        elif 9 <= len(digits) <= 18:
            sure += 0.15
        elif len(digits) >= 24:
            sure -= 0.2
        if re.search(r"(\d)\1{4,}", digits):
            sure -= 0.2
        if len(digits) == 8 and not hits:
            sure -= 0.15
        valid = bool(passes) if card else len(digits) <= 22 and weight > 0
        keep = len(digits) - 4
        places = [i for i, c in enumerate(raw) if c.isdigit()]
        hidden = set(places[:keep])
        masked = "".join("•" if i in hidden else c for i, c in enumerate(raw))
        out.append((m.start(), raw, digits, masked, card, passes, [n for _, n in hits], round(min(1.0, max(0.0, sure)), 4), valid))
    return sorted(out, key=lambda r: (-r[7], r[0]))


ACCOUNT_SCHEMA = "start int, raw string, digits string, masked string, is_card boolean, luhn boolean, context array<string>, confidence double, valid boolean"


def extract_accounts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, start, raw, digits, masked, is_card, luhn, context, confidence, valid) per account-like number.

    rank counts from 0, most confident first. Null texts give none; the key becomes a string.
    """
    names = [c.split()[0] for c in ACCOUNT_SCHEMA.split(", ")]
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *v) for k, t in zip(*(c.to_pylist() for c in batch.columns)) if t is not None for i, v in enumerate(account_values(t))]
            cols = list(zip(*rows)) or [()] * (len(names) + 2)
            arrays = [pa.array(cols[0], type=pa.string()), pa.array(cols[1], type=pa.int32())]
            arrays += [pa.array(c, type=t) for c, t in zip(cols[2:], types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "rank", *names])

    slim = df.select(F.col(key).cast("string").alias(key), text)
    return spread(slim).mapInArrow(run, f"{key} string, rank int, {ACCOUNT_SCHEMA}")


def best_on_lines(values: DataFrame, lines: DataFrame, pattern: str, exclude: str | None = None) -> DataFrame:
    """(page_id, line_index, value, confidence): per page the most confident value on a line
    that fits ``pattern`` (any case) and not ``exclude``; the first line, then the lesser value, of equals.

    ``values`` has (page_id, line_index, value, confidence), ``lines`` (page_id, line_index, text).
    """
    fits = F.col("text").rlike(f"(?i){pattern}")
    if exclude:
        fits = fits & ~F.col("text").rlike(f"(?i){exclude}")
    met = values.join(lines.where(fits).select("page_id", "line_index"), ["page_id", "line_index"])
    w = Window.partitionBy("page_id").orderBy(F.desc("confidence"), "line_index", "value")
    return met.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("page_id", "line_index", "value", "confidence")


def in_section_order(fields: DataFrame, order: dict[str, list[str]]) -> DataFrame:
    """(page_id, section, place, field, value): fields under their sections, both in the given order;
    fields of no section come last under 'other', by name."""
    placed = [(s, i * 10_000 + j, f) for i, (s, fs) in enumerate(order.items()) for j, f in enumerate(fs)]
    plan = F.create_map(*[x for s, n, f in placed for x in (F.lit(f), F.struct(F.lit(s).alias("section"), F.lit(n).alias("n")))]) if placed else None
    known = F.try_element_at(plan, F.col("field")) if plan is not None else F.lit(None).cast("struct<section:string,n:int>")
    rows = fields.select("page_id", "field", "value", known.alias("k")).select("page_id", "field", "value", F.coalesce("k.section", F.lit("other")).alias("section"), F.coalesce("k.n", F.lit(2**30)).alias("n"))
    w = Window.partitionBy("page_id").orderBy("n", "field", "value")
    return rows.withColumn("place", F.row_number().over(w)).select("page_id", "section", "place", "field", "value")


def reason_counts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason, n): why values were refused; ``checks`` has (ok, reason)."""
    return checks.where(~F.coalesce("ok", F.lit(False))).groupBy(*keys, F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def fresh(df: DataFrame, stamp: str, expected: str) -> DataFrame:
    """Rows whose provenance stamp is the expected one; null stamps are stale."""
    return df.where(F.coalesce(F.col(stamp) == expected, F.lit(False)))


def content_digests(lines: DataFrame, file: str, order: str, body: str, chars: int = 12) -> DataFrame:
    """(file, digest): the first ``chars`` hex digits of a SHA-256 over each file's line digests in order.

    Lines are digested one by one, so a file's text is never gathered, only 32 characters a line.
    """
    each = lines.where(F.col(file).isNotNull()).select(file, F.col(order).alias("o"), F.md5(F.coalesce(body, F.lit("")).cast("binary")).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x["d"]), "")
    return each.groupBy(file).agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, chars).alias("digest"))
