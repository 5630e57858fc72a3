"""Value checks, field extraction, lexicon and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.functions import decode, text, validate
from foliolake.operators import evidence, fields, lexicon, policy, speech
from foliolake.operators.current import newest
from foliolake.session import parallelism
from foliolake.tables import table


def _values(spark, sf_dir):
    """Distinct expected and found field values of the readings."""
    e = table(spark, sf_dir, "pipeline_raw_engine")
    rows = e.select(F.explode(F.concat(F.coalesce("expected_fields", F.array().cast("array<string>")), F.coalesce("fields", F.array().cast("array<string>")))).alias("value"))
    return rows.where("value is not null").distinct()


def _validated(kind):
    def query(spark, sf_dir):
        v = _values(spark, sf_dir)
        return v.select("value", validate.validate(kind, F.col("value")).alias("r")).select("value", "r.ok", "r.reason")

    query.__name__ = f"validate_{kind}"
    return query


VALIDATIONS = {f"validate_{k}": _validated(k) for k in validate.VALIDATORS}


def canonical_values(spark, sf_dir):
    v = _values(spark, sf_dir)
    return v.select("value", *[F.array_join(validate.canonical(k, F.col("value")), "|").alias(k) for k in ("dosage", "date", "money", "account", "identifier")])


def labels_resolved(spark, sf_dir):
    c = table(spark, sf_dir, "crops").where("labels is not null").select("labels").distinct()
    return c.select("labels", fields.resolve_label(F.col("labels")).alias("r")).select("labels", "r.field", "r.kind")


def amounts(spark, sf_dir):
    v = _values(spark, sf_dir).where(F.col("value").rlike(r"^[A-Z]{3} [0-9.,]+$"))
    return v.select("value", fields.amount_of(F.col("value")).alias("r")).select("value", F.col("r.value").cast("double").alias("amount"), "r.decimal_sep", "r.ambiguous")


def relative_days(spark, sf_dir):
    """Every phrase against the day of each of the first readings' run."""
    phrases = ("today", "tomorrow", "yesterday", "in 3 days", "in 2 weeks", "in 1 month", "5 days ago", "2 weeks ago", "next week", "next month", "last month", "last year", "some day")
    days = table(spark, sf_dir, "pipeline_raw_engine").select(F.to_date("run_at").alias("day")).where("day is not null").distinct()
    rows = days.select("day", F.explode(F.array(*[F.lit(p) for p in phrases])).alias("phrase"))
    return rows.select(F.col("day").cast("string").alias("day"), "phrase", fields.relative_date(F.col("phrase"), F.col("day")).cast("string").alias("resolved"))


def pattern_fields(spark, sf_dir):
    e = newest(table(spark, sf_dir, "pipeline_raw_engine"), [F.col("record_id")], [F.col("loaded_at").desc_nulls_last(), F.col("ocr_text")])
    return fields.pattern_fields(e.withColumn("c", F.col("expected_category")), "record_id", "ocr_text", "c")


def entity_counts(spark, sf_dir):
    found = fields.entities(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("label").agg(F.count("*").alias("n"))


def typed_values(spark, sf_dir):
    return fields.extract_typed(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("kind", "ambiguous").agg(F.count("*").alias("n"), F.count("value").alias("readable"))


def _lines(spark, sf_dir):
    e = newest(table(spark, sf_dir, "pipeline_raw_engine"), [F.col("record_id")], [F.col("loaded_at").desc_nulls_last(), F.col("ocr_text")])
    return e.where("ocr_text is not null").select(F.col("record_id").cast("string").alias("page_id"), F.posexplode(F.split("ocr_text", "\n")).alias("line_index", "text"))


def spotted_labels(spark, sf_dir):
    return fields.spots(_lines(spark, sf_dir))


def proximity_values(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return fields.proximity_values(lines, fields.spots(lines))


def policy_verdicts(spark, sf_dir):
    """Amounts found by the two systems for the same reading, reconciled."""
    def side(name, tag):
        cur = newest(table(spark, sf_dir, name), [F.col("doc"), F.lower(F.trim("profile"))], [F.col("loaded_at").desc_nulls_last(), F.col("record_id").desc()])
        v = cur.select(F.concat_ws("|", "doc", F.lower(F.trim("profile"))).alias("page_id"), F.explode("fields").alias("value"))
        kind = F.when(F.col("value").rlike("^[A-Z]{3} "), "money").when(F.col("value").rlike("(?i)^[0-9.]+ ?(mg|ml|mcg)$"), "dosage").otherwise("identifier")
        return v.select("page_id", "value", kind.alias("kind"), kind.alias("field"), F.lit(tag).alias("source"))

    cands = policy.candidates(side("pipeline_raw_engine", "first").unionByName(side("pipeline_raw_engine_off", "second")))
    return policy.reconcile(cands)


def policy_summary(spark, sf_dir):
    return policy_verdicts(spark, sf_dir).groupBy("field", "verdict", "source").agg(F.count("*").alias("n"))


# --- lexica ----------------------------------------------------------------


def _tokens(spark, sf_dir):
    c = newest(table(spark, sf_dir, "crops"), [F.col("crop_id")], [F.col("loaded_at").desc_nulls_last(), F.col("labels")])
    return c.where("labels is not null").select("crop_id", text.upper_tokens(F.col("labels")).alias("tokens"), "labels")


def _counts(spark, sf_dir):
    return lexicon.word_counts(_tokens(spark, sf_dir))


def word_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


def bigrams_top12(spark, sf_dir):
    return lexicon.top_per_context(lexicon.bigram_counts(_tokens(spark, sf_dir)), 12).select("prev", "next", "n", "rank")


def char_trigrams(spark, sf_dir):
    return lexicon.char_grams(_tokens(spark, sf_dir).select(text.clean_to_charset(F.col("labels")).alias("t")), "t", 3)


def char_lm_logp(spark, sf_dir):
    base = _tokens(spark, sf_dir).select(text.clean_to_charset(F.col("labels")).alias("t"))
    c1, c2, c3 = (lexicon.char_grams(base, "t", k) for k in (1, 2, 3))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring(F.col("word"), i, F.lit(3)))
    g = _counts(spark, sf_dir).where(F.length("word") >= 3).select(F.explode(grams).alias("g")).distinct()
    asked = g.select(F.substring("g", 1, 2).alias("ctx"), F.substring("g", 3, 1).alias("ch"))
    out = lexicon.backoff_logp(asked, c1, c2, c3)
    return out.select("ctx", "ch", F.round("logp", 9).alias("logp"))


def _bigrams(spark, sf_dir):
    return lexicon.bigram_counts(_tokens(spark, sf_dir))


def word_bigram_logp(spark, sf_dir):
    """Pairs of neighbouring words of the expected texts under the labels' model."""
    e = table(spark, sf_dir, "pipeline_raw_engine").where("expected_text is not null").select(text.upper_tokens(F.col("expected_text")).alias("tokens"))
    asked = lexicon.bigram_counts(e).select("prev", "next")
    return lexicon.word_bigram_logp(asked, _bigrams(spark, sf_dir)).select("prev", "next", F.round("logp", 9).alias("logp"))


def top_bigrams(spark, sf_dir):
    return lexicon.top_bigrams(_bigrams(spark, sf_dir)).select("prev", "next", "n")


def combined_lm(spark, sf_dir):
    """Each pair under the word model and, for its second word, the share of the lexicon: summed with weights."""
    pairs = word_bigram_logp(spark, sf_dir)
    counts = _counts(spark, sf_dir)
    known = counts.select(F.col("word").alias("next"), F.log(F.col("n").cast("double")).alias("word_logn"))
    met = pairs.join(known, "next", "left")
    out = lexicon.combined_logp(met.withColumnRenamed("logp", "pair_logp"), {"pair_logp": 1.0, "word_logn": 0.25})
    return out.select("prev", "next", F.round("logp", 6).alias("logp"))


def account_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return evidence.extract_accounts(d, "doc_id", "text").select("doc_id", "rank", "start", "digits", "masked", "is_card", "luhn", F.array_join("context", ",").alias("context"), "confidence", "valid")


def best_account_lines(spark, sf_dir):
    """The most confident account-like number on a line about accounts, per reading."""
    lines = _lines(spark, sf_dir)
    each = lines.select(F.concat_ws("|", "page_id", F.col("line_index").cast("string")).alias("k"), "text")
    found = evidence.extract_accounts(each, "k", "text")
    values = found.select(F.split("k", r"\|")[0].alias("page_id"), F.split("k", r"\|")[1].cast("int").alias("line_index"), F.col("digits").alias("value"), "confidence")
    return evidence.best_on_lines(values, lines, "account", "card")


def sectioned_fields(spark, sf_dir):
    """Pattern fields of each reading in section order."""
    f = pattern_fields(spark, sf_dir).select(F.col("record_id").cast("string").alias("page_id"), F.col("label").alias("field"), "value")
    return evidence.in_section_order(f, {"money": ["Balance", "Amount"], "reference": ["Account Number", "Sort Code", "Case Number"], "time": ["Date", "Time"]})


def refusal_reasons(spark, sf_dir):
    v = _values(spark, sf_dir)
    checks = [v.select(F.lit(k).alias("kind"), validate.validate(k, F.col("value")).alias("r")).select("kind", "r.ok", "r.reason") for k in ("sort_code", "identifier", "general")]
    return evidence.reason_counts(checks[0].unionByName(checks[1]).unionByName(checks[2]), ["kind"])


def content_digests(spark, sf_dir):
    return evidence.content_digests(table(spark, sf_dir, "pipeline_raw_files"), "file_name", "line_no", "body")


def trie_prefix_weights(spark, sf_dir):
    return lexicon.prefix_weights(_counts(spark, sf_dir))


def _lexicon(spark, sf_dir):
    """Words of the expected texts, the lexicon that crops are measured against."""
    e = table(spark, sf_dir, "pipeline_raw_engine").where("expected_text is not null")
    return e.select(F.explode(text.upper_tokens(F.col("expected_text"))).alias("word"))


def lexicon_coverage(spark, sf_dir):
    out = lexicon.coverage(_counts(spark, sf_dir), _lexicon(spark, sf_dir))
    return out.select("types", "tokens", F.round("type_coverage", 9).alias("type_coverage"), F.round("token_coverage", 9).alias("token_coverage"))


def lexicon_union(spark, sf_dir):
    b = _lexicon(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    return lexicon.weighted_union(_counts(spark, sf_dir), b).select("word", F.round("weight", 6).alias("weight"))


def lexicon_overlap(spark, sf_dir):
    return lexicon.overlap_report(_counts(spark, sf_dir), _lexicon(spark, sf_dir))


def mined_lexicon(spark, sf_dir):
    return lexicon.mine_lexicon(_counts(spark, sf_dir), 20, ["TABLET", "DAILY"])


def floored_lexicon(spark, sf_dir):
    return lexicon.floored_counts(_counts(spark, sf_dir), _lexicon(spark, sf_dir).distinct())


def longest_name_match(spark, sf_dir):
    """The longest issuer name on a crop, known issuers coming from documents."""
    names = table(spark, sf_dir, "documents").select(text.lexicon_key(F.col("issuer")).alias("name")).where("name <> ''").distinct().withColumn("seq", F.lit(0))
    crops = _tokens(spark, sf_dir).select("crop_id", text.lexicon_key(F.col("labels")).alias("t"))
    return lexicon.longest_match(crops, "crop_id", "t", names)


def grammar_classes(spark, sf_dir):
    v = _values(spark, sf_dir)
    return v.select("value", F.array_join(lexicon.grammar_classes(F.col("value")), ",").alias("classes"))


def grammar_lexicon(spark, sf_dir):
    """Values of each field class in the expected texts."""
    e = table(spark, sf_dir, "pipeline_raw_engine").select("expected_text").distinct()
    return lexicon.mined_classes(e, "expected_text")


# --- sequences ---------------------------------------------------------------


def charset_round_trip(spark, sf_dir):
    c = _tokens(spark, sf_dir).select("crop_id", text.clean_to_charset(F.col("labels")).alias("t"))
    spaced = F.flatten(F.transform(decode.encode(F.col("t")), lambda i: F.array(i, F.lit(0))))
    return c.select("crop_id", F.col("t"), decode.decode_greedy(spaced).alias("decoded"))


def ctc_greedy(spark, sf_dir):
    """Decoding of label codes without blanks between them: doubled characters collapse."""
    c = _tokens(spark, sf_dir).select("crop_id", text.clean_to_charset(F.col("labels")).alias("t"))
    return c.select("crop_id", decode.decode_greedy(decode.encode(F.col("t"))).alias("decoded"))


def _step_scores(classes):
    """Log scores that favour the given class of each step, the next class second."""
    return F.transform(classes, lambda c: F.transform(F.sequence(F.lit(0), F.lit(37)), lambda k: F.when(k == c, F.lit(-0.2)).when(k == (c + 1) % 38, F.lit(-2.0)).otherwise(F.lit(-9.0))))


def ctc_beam(spark, sf_dir):
    """Beam decoding of whole labels, each distinct text once."""
    c = _tokens(spark, sf_dir).select("crop_id", text.clean_to_charset(F.col("labels")).alias("t"))
    scores = _step_scores(decode.encode(F.col("t"))).alias("scores")
    texts = c.select("t").distinct().repartition(parallelism(spark)).select("t", scores)
    return c.join(decode.beam_rows(texts, "t", "scores", 3), "t", "left").select("crop_id", "decoded")


def embedding_norms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    unit = decode.l2_normalise(F.col("embedding"))
    return e.select("vec_id", F.round(decode.dot(unit, unit), 6).alias("length"), F.round(F.element_at(decode.softmax(F.transform("embedding", lambda x: x.cast("double"))), 1), 6).alias("first"))


def mean_pooled(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


def text_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(speech.chunks(F.col("text"))).alias("i", "chunk")).select("doc_id", "i", F.length("chunk").alias("chars"))


def wrapped_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = d.select("doc_id", F.posexplode(speech.wrapped(F.col("text"))).alias("i", "line"))
    return speech.pack_pages(lines, "doc_id", "i", 12).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


QUERIES = {
    **VALIDATIONS,
    **{
        f.__name__: f
        for f in (
            canonical_values, labels_resolved, amounts, relative_days, pattern_fields, entity_counts, typed_values, spotted_labels,
            proximity_values, policy_verdicts, policy_summary, word_counts, bigrams_top12, char_trigrams, char_lm_logp, word_bigram_logp, top_bigrams, combined_lm, account_values, best_account_lines,
            sectioned_fields, refusal_reasons, content_digests, trie_prefix_weights,
            lexicon_coverage, lexicon_union, lexicon_overlap, mined_lexicon, floored_lexicon, longest_name_match, grammar_classes, grammar_lexicon,
            charset_round_trip, ctc_greedy, ctc_beam, embedding_norms, mean_pooled, text_chunks, wrapped_pages,
        )
    },
}

# --- SQL equivalents -----------------------------------------------------------

_V = "(select distinct unnest(list_concat(coalesce(expected_fields, []), coalesce(fields, []))) as value from pipeline_raw_engine)"
_C = "(select * from (select *, row_number() over (partition by crop_id order by loaded_at desc nulls last, labels) r from crops) where r = 1 and labels is not null)"
_TOK = f"(select crop_id, labels, regexp_extract_all(upper(labels), '[0-9A-Z]+') tokens from {_C})"
_WC = f"(select word, count(*) n from (select unnest(tokens) word from {_TOK}) group by 1)"
_LEX = "(select unnest(regexp_extract_all(upper(expected_text), '[0-9A-Z]+')) word from pipeline_raw_engine where expected_text is not null)"
_CH = f"(select crop_id, trim(regexp_replace(regexp_replace(upper(labels), '[^0-9A-Z ]', '', 'g'), ' +', ' ', 'g')) t from {_C})"


def _grams(k: int) -> str:
    return f"(select gram, count(*) n from (select substring(repeat('^', {k - 1}) || t, i, {k}) gram from (select t, unnest(range(1, length(t) + 1)) i from {_CH} where length(t) > 0)) group by 1)"


def _check(reason: str) -> str:
    return f"select value, r is null as ok, coalesce(r, 'ok') reason from (select value, {reason} r from {_V} where value is not null)"


def _found(label: str, pattern: str, groups: int = 1) -> str:
    if groups == 1:
        return f"regexp_extract_all(t, '{pattern}', 1)"
    return f"list_transform(list_zip(regexp_extract_all(t, '{pattern}', 1), regexp_extract_all(t, '{pattern}', 2)), lambda z: z[1] || ' ' || z[2])"


_PATTERN_SQL = " union all ".join(
    f"select record_id, '{label}' as label, {_found(label, pattern, groups)} v from e where c = '{c}'"
    for c, label, pattern, groups in (
        ("medical", "Medication", r"(?i)(?:Rx\s*:\s*|medication\s*:\s*|prescription\s+for\s+)([A-Z][a-z]+(?:\s\d{1,4}\s?mg)?)", 1),
        ("medical", "Dosage", r"(?i)(\d{1,4}[\dOo]?)\s*(m[gq]|m1|1m|mL|mI|tab1ets?|tablets?|capsul[ce]s?)", 2),
        ("medical", "Frequency", r"(?i)(every\s*\d+\s*(?:hours?|hrs)|\d+\s*times?\s*(?:a\s*)?day|once daily|twice daily|three times daily|at bedtime)", 1),
        ("medical", "Warning", r"(?i)((?:WARNING|Caution|Do not|Avoid|May cause|Consult|Keep out)[^.\n]+)", 1),
        ("medical", "Patient", r"(?:[Pp]atient|[Nn]ame|[Aa]ccount [Hh]older)\s*[:#]?\s*([A-Z][a-z]+\s+[A-Z][a-z]+)", 1),
        ("banking", "Account Number", r"(?i)account\s*(?:no|number)?\s*[:#]?\s*(\d{6,12})", 1),
        ("banking", "Sort Code", r"(?i)sort\s*code\s*[:#]?\s*(\d{2}[-\s]?\d{2}[-\s]?\d{2})", 1),
        ("banking", "IBAN", r"(?i)(GB\d{2}\s?[A-Z]{4}\s?[\dA-Z]{4}\s?\d{4}[\dA-Z]?\s?\d{4})", 1),
        ("banking", "Balance", r"(?i)(?:balance|available)\s*[:#]?\s*(?:£|\$|€)?\s*([\d,]+\.\d{2})", 1),
        ("banking", "Card Ending", r"(?i)(?:card\s+)?ending\s*(?:in\s*)?(\d{4})", 1),
        ("banking", "Amount", r"(£|\$|€)\s*([\d,]+\.\d{2})", 2),
        ("legal", "Case Number", r"(?i)(?:case|matter)\s*(?:no|number|reference|ref)?\s*[:#.]?\s*([\w-]+-\d+)", 1),
        ("legal", "Date", r"(?i)(\d{1,2}(?:st|nd|rd|th)?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}|\d{1,2}/\d{1,2}/\d{2,4})", 1),
        ("legal", "Clause", r"(?i)(?:clause|section)\s+(\d+(?:\.\d+)?)", 1),
        ("legal", "Parties", r"(?i)between\s+([A-Z][\w\s]{2,40}?)\s+and\s+([A-Z][\w\s]{2,40})", 2),
        ("general", "Date", r"(\d{1,2}/\d{1,2}/\d{2,4})", 1),
        ("general", "Phone", r"(\+?\d{3,4}[\s-]?\d{3,4}[\s-]?\d{3,4})", 1),
        ("general", "Email", r"([\w.+-]+@[\w-]+\.[\w.-]+)", 1),
        ("general", "Time", r"(?i)(\d{1,2}:\d{2}\s*(?:am|pm)?)", 1),
    )
)

_GRAMMAR_SQL = (
    ("money", (r"[£$€]\s?-?\s?\d[\d,]*(?:\.\d{2})?", r"\b(?:GBP|USD|EUR)\s?-?\s?\d[\d,]*(?:\.\d{2})?", r"\b\d[\d,]*\.\d{2}\b", r"-\s?[£$€]?\s?\d[\d,]*(?:\.\d{2})?")),
    ("date", (
        r"\b(?:0?[1-9]|[12]\d|3[01])/(?:0?[1-9]|1[0-2])/(?:\d{2}|\d{4})\b", r"\b(?:0?[1-9]|[12]\d|3[01])-(?:0?[1-9]|1[0-2])-(?:\d{2}|\d{4})\b",
        r"\b(?:0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b",
        r"\b\d{4}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12]\d|3[01])\b")),
    ("dosage", (r"\b\d{1,4}(?:\.\d+)?\s?(?:MG|MCG|ML|G|TABLETS?|CAPSULES?)\b",)),
    ("frequency", (r"\bEVERY\s+\d+\s*(?:HOURS?|HRS?)\b", r"\b\d+\s*TIMES?\s*(?:A\s*)?DAY\b", r"\bONCE DAILY\b|\bTWICE DAILY\b|\bTHREE TIMES DAILY\b|\bAT BEDTIME\b")),
    ("account_masked", (r"\bENDING\s*(?:IN\s*)?\d{4}\b", r"\b[*X]{2,}\s*\d{4}\b")),
    ("sort_code", (r"\b\d{2}-\d{2}-\d{2}\b", r"\b\d{2}\s\d{2}\s\d{2}\b")),
    ("case_ref", (r"\b\d{4}-[A-Z]{2}-\d{3,8}\b",)),
    ("iban", (r"\bGB\d{2}\s?[A-Z]{4}\s?[\dA-Z]{4}\s?\d{4}[\dA-Z]?\s?\d{4}\b",)),
)

#: A label's field and kind, first match first; the SQL's own list.
_LABEL_SQL = """(values (1, 'sort code', 'sort_code', 'sort_code'), (2, 'account number', 'account_number', 'account'), (3, 'account no', 'account_number', 'account'),
 (4, 'card ending', 'card_ending', 'account'), (5, 'ending in', 'card_ending', 'account'), (6, 'ending', 'card_ending', 'account'), (7, 'account holder', 'account_holder', 'general'),
 (8, 'opening balance', 'opening_balance', 'money'), (9, 'closing balance', 'closing_balance', 'money'), (10, 'available funds', 'available_funds', 'money'),
 (11, 'balance', 'balance', 'money'), (12, 'amount', 'amount', 'money'), (13, 'date of birth', 'date_of_birth', 'date'), (14, 'dob', 'date_of_birth', 'date'), (15, 'date', 'date', 'date'),
 (16, 'case reference', 'case_number', 'identifier'), (17, 'case number', 'case_number', 'identifier'), (18, 'case ref', 'case_number', 'identifier'), (19, 'case no', 'case_number', 'identifier'),
 (20, 'matter', 'case_number', 'identifier'), (21, 'iban', 'iban', 'general'), (22, 'dosage', 'dosage', 'dosage'), (23, 'dose', 'dosage', 'dosage'), (24, 'prescription for', 'medication', 'general'),
 (25, 'medication', 'medication', 'general'), (26, 'rx', 'medication', 'general'), (27, 'frequency', 'frequency', 'general'), (28, 'patient', 'patient', 'general'), (29, 'name', 'patient', 'general'),
 (30, 'warning', 'warning', 'general'), (31, 'caution', 'warning', 'general'), (32, 'clause', 'clause', 'general'), (33, 'section', 'clause', 'general'), (34, 'phone', 'phone', 'general'),
 (35, 'email', 'email', 'general'), (36, 'time', 'time', 'general'), (37, 'period', 'period', 'general'), (38, 'property', 'property', 'general'), (39, 'term', 'term', 'general')) l(k, needle, field, kind)"""

_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
_MONTH_NAMES = "['january','february','march','april','may','june','july','august','september','october','november','december']"

_MONEY_BODY = r"regexp_replace(regexp_replace(trim(value), '(?i)^(?:\s*(?:[£$€]|GBP|USD|EUR)\s*)+', ''), '(?i)(?:\s*(?:[£$€]|GBP|USD|EUR)\s*)+$', '')"
ORACLES = {
    "validate_sort_code": _check(
        r"case when regexp_full_match(regexp_replace(regexp_extract(trim(value), '^[0-9 -]*'), '[-\s]', '', 'g'), '\d{6}') then null else '6 digits required, got ' || length(regexp_replace(regexp_extract(trim(value), '^[0-9 -]*'), '[-\s]', '', 'g')) end"
    ),
    "validate_account": r"""select value, n between 4 and 12 as ok, case when n not between 4 and 12 then '4-12 digits required, got ' || n when n = 4 or regexp_matches(value, '[*xX#]') or contains(lower(value), 'ending') then 'masked, last 4 digits only' else 'ok' end reason
from (select value, length(regexp_replace(coalesce(list_filter(string_split_regex(value, '\s+'), lambda t: regexp_matches(t, '\d'))[1], ''), '\D', '', 'g')) n from """
    + _V
    + " where value is not null)",
    "validate_identifier": _check(
        r"case when regexp_matches(regexp_extract(trim(value), '^\S*'), '[^A-Za-z0-9-]') then 'invalid character in identifier: ' || regexp_extract(regexp_extract(trim(value), '^\S*'), '[^A-Za-z0-9-]') when length(regexp_extract(trim(value), '^\S*')) not between 4 and 20 then 'identifier must be 4-20 chars, got ' || length(regexp_extract(trim(value), '^\S*')) when not regexp_matches(value, '[A-Za-z0-9]') then 'identifier needs a letter or digit' end"
    ),
    "validate_general": _check(
        "case when trim(value) = '' then 'empty value' when length(trim(value)) >= 40 then 'too long: ' || length(trim(value)) || ' chars' when not regexp_matches(value, '[A-Za-z0-9]') then 'no alphanumeric' end"
    ),
    "validate_money": rf"""select value, r is null as ok, coalesce(r, 'ok') reason from (select value, case when not regexp_full_match(s, '[+-]?\s*[\d,]+(?:\.\d+)?') then 'not a monetary amount: ' || trim(value)
 when contains(s, '.') and length(regexp_extract(s, '\.(\d+)$', 1)) <> 2 then 'money needs two decimals, got ' || length(regexp_extract(s, '\.(\d+)$', 1))
 when contains(s, ',') and not regexp_full_match(regexp_extract(s, '[\d,]+'), '\d{{1,3}}(?:,\d{{3}})+') then 'bad thousands grouping: ' || trim(value) end r
 from (select value, {_MONEY_BODY} s from {_V} where value is not null))""",
    "validate_dosage": r"""select value, r is null as ok, coalesce(r, 'ok') reason from (select value, case when u = '' then 'no dosage in value: ' || trim(value)
 when lower(u) not in ('mg','mcg','g','ml','tablet','tablets','capsule','capsules','drop','drops','unit','units') then 'unknown unit: ' || u
 when rest <> '' and lower(rest) not in ('mg','mcg','g','ml','tablet','tablets','capsule','capsules','drop','drops','unit','units') then 'unknown frequency: ' || rest end r
 from (select value, regexp_extract(value, '(\d+(?:\.\d+)?)\s*([A-Za-z]+)', 2) u, regexp_replace(regexp_extract(value, '(?s)\d+(?:\.\d+)?\s*[A-Za-z]+(.*)$', 1), '^[ .,;]+|[ .,;]+$', '', 'g') rest from """
    + _V
    + " where value is not null))",
    "word_counts": f"select * from {_WC}",
    "bigrams_top12": f"""select prev, "next", n, rank from (select *, row_number() over (partition by prev order by n desc, "next" desc) rank from (
 select tokens[i] prev, tokens[i + 1] as "next", count(*) n from (select tokens, unnest(range(1, len(tokens))) i from {_TOK}) group by 1, 2)) where rank <= 12""",
    "char_trigrams": f"select * from {_grams(3)}",
    "char_lm_logp": f"""with c1 as {_grams(1)}, c2 as {_grams(2)}, c3 as {_grams(3)},
q as (select distinct substring(word, i, 2) ctx, substring(word, i + 2, 1) ch from (select word, unnest(range(1, length(word) - 1)) i from {_WC} where length(word) >= 3)),
t3 as (select substring(gram, 1, 2) ctx, sum(n) t from c3 group by 1), t2 as (select substring(gram, 1, 1) c, sum(n) t from c2 group by 1), t1 as (select sum(n) t, count(*) v from c1)
select q.ctx, q.ch, round(ln(case when c3.n is not null then c3.n / t3.t when c2.n is not null then 0.4 * c2.n / t2.t else 0.16 * (coalesce(c1.n, 0) + 1) / (t1.t + t1.v) end), 9) logp
from q left join c3 on c3.gram = q.ctx || q.ch left join t3 on t3.ctx = q.ctx left join c2 on c2.gram = substring(q.ctx, 2, 1) || q.ch left join t2 on t2.c = substring(q.ctx, 2, 1) left join c1 on c1.gram = q.ch cross join t1""",
    "word_bigram_logp": f"""with b as (select tokens[i] prev, tokens[i + 1] as nxt, count(*) n from (select tokens, unnest(range(1, len(tokens))) i from {_TOK}) group by 1, 2),
t as (select prev, sum(n) t from b group by 1), v as (select count(distinct w) v from (select prev w from b union all select nxt from b)),
q as (select distinct tokens[i] prev, tokens[i + 1] as nxt from (select tokens, unnest(range(1, len(tokens))) i from (select regexp_extract_all(upper(expected_text), '[0-9A-Z]+') tokens from pipeline_raw_engine where expected_text is not null)))
select q.prev, q.nxt as "next", round(case when q.prev = q.nxt or t is null then 0 else ln((coalesce(n, 0) + 0.5) / (t + 0.5 * v)) end, 9) logp
from q left join b on b.prev = q.prev and b.nxt = q.nxt left join t on t.prev = q.prev cross join v""",
    "top_bigrams": f"select prev, \"next\", n from (select tokens[i] prev, tokens[i + 1] as \"next\", count(*) n from (select tokens, unnest(range(1, len(tokens))) i from {_TOK}) group by 1, 2) where n >= 3 order by n desc, prev, \"next\" limit 12000",
    "refusal_reasons": None,
    "trie_prefix_weights": f"select prefix, sum(n)::bigint pass_weight, sum(case when prefix = word then n else 0 end)::bigint word_weight from (select word, n, substring(word, 1, i) prefix from (select word, n, unnest(range(1, length(word) + 1)) i from {_WC})) group by 1",
    "lexicon_coverage": f"select count(*) types, sum(n)::bigint tokens, round(avg(k), 9) type_coverage, round(sum(k * n) / sum(n), 9) token_coverage from (select n, (word in (select word from {_LEX}))::int k from {_WC})",
    "lexicon_union": f"""with a as {_WC}, b as (select word, count(*) n from {_LEX} group by 1), s as (select (select sum(n) from a) / (select sum(n) from b) k)
select word, round(sum(w), 6) weight from (select word, n::double w from a union all select word, greatest(1, n * k) from b, s) group by 1""",
    "lexicon_overlap": f"select case when b.word is null then 'only_a' when a.word is null then 'only_b' else 'both' end part, count(*) n from {_WC} a full join (select distinct word from {_LEX}) b on a.word = b.word group by 1",
    "mined_lexicon": f"select * from {_WC} where n >= 20 or word in ('TABLET', 'DAILY')",
    "floored_lexicon": f"select word, max(n)::bigint n from (select word, n from {_WC} union all select distinct word, 1 from {_LEX}) group by 1",
    "longest_name_match": rf"""with names as (select distinct trim(regexp_replace(regexp_replace(upper(issuer), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) nm from documents where issuer is not null),
c as (select crop_id, trim(regexp_replace(regexp_replace(upper(labels), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) t from {_C})
select crop_id, nm as name from (select crop_id, nm, row_number() over (partition by crop_id order by length(nm) desc, nm desc) r from c join names on nm <> '' and contains(' ' || t || ' ', ' ' || nm || ' ')) where r = 1""",
    "charset_round_trip": f"select crop_id, t, t as decoded from {_CH}",
    "amounts": r"select value, replace(regexp_extract(value, '[0-9.,]+'), ',', '')::double amount, case when contains(value, '.') then '.' end decimal_sep, not contains(value, '.') and contains(value, ',') and len(string_split(value, ',')) = 2 ambiguous from "
    + _V
    + r" where regexp_full_match(value, '[A-Z]{3} [0-9.,]+')",
    "pattern_fields": f"""with e as (select record_id, ocr_text t, coalesce(case when expected_category in ('medical', 'banking', 'legal') then expected_category end, 'general') c
  from (select *, row_number() over (partition by record_id order by loaded_at desc nulls last, ocr_text nulls first) r from pipeline_raw_engine) where r = 1 and ocr_text is not null),
f as ({_PATTERN_SQL}),
k as (select record_id, label, list_filter(list_transform(v, lambda x: trim(x, ' ')), lambda x: length(x) > 1)[:6] v from f)
select record_id, label, (generate_subscripts(v, 1) - 1)::int ordinal, unnest(v) as value from k""",
    "entity_counts": r"""with d as (select doc_id, text t from documents where text is not null),
drugs as (select unnest(['Amoxicillin','Metformin','Lisinopril','Atorvastatin','Amlodipine','Ibuprofen','Paracetamol','Aspirin','Omeprazole','Simvastatin','Warfarin','Insulin','Prednisolone',
  'Sertraline','Citalopram','Ramipril','Bisoprolol','Salbutamol','Codeine','Tramadol','Diclofenac','Naproxen']) n),
e as (select doc_id, 'DRUG' as label, n v from d join drugs on regexp_matches(t, '(?i)\b' || n || '\b')
 union all select doc_id, 'DOSAGE', unnest(regexp_extract_all(t, '(?i)(?:^|[^\d])(\d{1,4}\s*(?:mg|ml|mcg|micrograms?|tablets?|capsules?))\b', 1)) from d
 union all select doc_id, 'MONEY', unnest(list_transform(list_zip(regexp_extract_all(t, m, 1), regexp_extract_all(t, m, 2), regexp_extract_all(t, m, 3)), lambda z: concat(z[1], z[2], z[3]))) from d, (select '(?i)(£|\$|€)\s*([\d,]+\.\d{2})|\b([\d,]+\.\d{2})\s*(?:GBP|USD|EUR)' m)
 union all select doc_id, 'DATE', unnest(regexp_extract_all(t, '(?i)\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{1,2}(?:st|nd|rd|th)?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b', 1)) from d
 union all select doc_id, 'ORG', unnest(regexp_extract_all(t, '(?i)\b(HSBC|Barclays|Lloyds|NatWest|Santander|NHS|Halifax|TSB|Monzo|Revolut)\b', 1)) from d
 union all select doc_id, 'PERSON', unnest(regexp_extract_all(t, '(?:patient|name|account holder)\s*[:#]\s*([A-Z][a-z]+\s+[A-Z][a-z]+)', 1)) from d)
select label, count(*) n from (select distinct doc_id, label, trim(v) v from e where length(trim(v)) > 1) group by 1""",
    "grammar_classes": "select value, array_to_string(list_filter(["
    + ", ".join(f"case when {' or '.join(f"regexp_matches(upper(trim(value)), '(?i){p}')" for p in ps)} then '{n}' end" for n, ps in _GRAMMAR_SQL)
    + f"], lambda x: x is not null), ',') classes from {_V} where value is not null",
    "grammar_lexicon": "with t as (select distinct expected_text t from pipeline_raw_engine where expected_text is not null), f as ("
    + " union all ".join(f"select '{n}' as class, unnest(regexp_extract_all(t, '(?i){p}')) v from t" for n, ps in _GRAMMAR_SQL for p in ps)
    + ") select class, upper(trim(v)) as value, count(*) n from f where trim(v) <> '' group by 1, 2",
    "labels_resolved": f"""with c as (select distinct labels, lower(trim(labels)) low from crops where labels is not null),
h as (select labels, field, kind, row_number() over (partition by labels order by k) r from c join {_LABEL_SQL} on regexp_matches(low, '(?:^|[^a-z])' || needle || '(?:[^a-z]|$)')),
s as (select labels, regexp_replace(regexp_replace(low, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') slug from c)
select s.labels, coalesce(h.field, case when slug = '' then 'field' else slug end) field, coalesce(h.kind, 'general') kind from s left join h on h.labels = s.labels and h.r = 1""",
    "validate_date": rf"""with v as (select value, trim(value) s, regexp_extract(trim(value), '^(\S*)', 1) tok from {_V} where value is not null),
p as (select *, lower(regexp_extract(s, '(?i)^(\d{{1,2}})(?:st|nd|rd|th)?\s+([A-Za-z]{{3,9}})\.?\s*,?\s*(\d{{2}}|\d{{4}})$', 2)) nm from v),
q as (select value, case
  when regexp_full_match(tok, '\d{{8}}') then case when substring(tok, 1, 2)::int > 31 or substring(tok, 3, 2)::int > 12 then [substring(tok, 1, 4), substring(tok, 5, 2), substring(tok, 7, 2)] else [substring(tok, 5, 4), substring(tok, 3, 2), substring(tok, 1, 2)] end
  when regexp_full_match(tok, '\d{{1,2}}[/-]\d{{1,2}}[/-](?:\d{{2}}|\d{{4}})') then [regexp_extract(tok, '[/-](\d+)$', 1), regexp_extract(tok, '^\d+[/-](\d+)', 1), regexp_extract(tok, '^(\d+)', 1)]
  when regexp_full_match(tok, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') then string_split(tok, '-')
  when list_contains({_MONTHS}, nm) or list_contains({_MONTH_NAMES}, nm) then [regexp_extract(s, '(\d+)$', 1), list_position({_MONTHS}, nm[1:3])::varchar, regexp_extract(s, '^(\d+)', 1)] end x from p),
d as (select value, try_cast(lpad((case when x[1]::int < 100 then x[1]::int + 2000 else x[1]::int end)::varchar, 4, '0') || '-' || lpad(x[2], 2, '0') || '-' || lpad(x[3], 2, '0') as date) d from q)
select value, d is not null as ok, case when d is not null then 'ok' else 'not a calendar date' end reason from d""",
    "ctc_greedy": f"select crop_id, array_to_string(list_filter(list_transform(range(1, length(t) + 1), lambda i: case when i = 1 or t[i] <> t[i - 1] then t[i] end), lambda x: x is not null), '') decoded from {_CH}",
    "masked_codes": None,
    "embedding_norms": "select vec_id, round(list_sum(list_transform(embedding, lambda x: (x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) ** 2)), 6) as length, round(exp(embedding[1]::double) / list_sum(list_transform(embedding, lambda x: exp(x::double))), 6) as first from embeddings",
    "mean_pooled": "select label, dim, round(avg(v::double), 6) mean from (select label, unnest(embedding) v, unnest(range(0, len(embedding)))::int dim from embeddings) group by 1, 2",
    "relative_days": """select day::varchar as day, phrase, (case phrase when 'today' then day when 'tomorrow' then day + 1 when 'yesterday' then day - 1 when 'in 3 days' then day + 3 when 'in 2 weeks' then day + 14
 when 'in 1 month' then (day + interval 1 month)::date when '5 days ago' then day - 5 when '2 weeks ago' then day - 14 when 'next week' then day + 7 when 'next month' then (day + interval 1 month)::date
 when 'last month' then (day - interval 1 month)::date when 'last year' then (day - interval 12 month)::date end)::varchar resolved
from (select distinct run_at::date as day from pipeline_raw_engine where run_at is not null), (select unnest(['today','tomorrow','yesterday','in 3 days','in 2 weeks','in 1 month','5 days ago','2 weeks ago','next week','next month','last month','last year','some day']) phrase)""",
}
ORACLES["refusal_reasons"] = "select kind, reason, count(*) n from (" + " union all ".join(f"select '{k}' kind, * from ({ORACLES[f'validate_{k}']})" for k in ("sort_code", "identifier", "general")) + ") where not ok group by 1, 2"
ORACLES = {k: v for k, v in ORACLES.items() if v}
