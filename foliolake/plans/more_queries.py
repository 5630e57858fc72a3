"""Further evaluation, gating and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.functions import metrics, text
from foliolake.operators import align, corpus, evaluation as ev, graph
from foliolake.operators.current import newest
from foliolake.plans.corpus_queries import _C, _crops, align_monotone
from foliolake.plans.record_queries import _CUR, _current, _n
from foliolake.tables import table


def _pages(spark, sf_dir):
    return _current(spark, sf_dir).withColumn("page_id", F.concat_ws("|", "doc", F.lower(F.trim("profile"))))


def _said(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode("fields").alias("value"))


def _truth(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode("expected_fields").alias("value"))


def weighted_types(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", text.weighted_type(F.col("text")).alias("w")).select("doc_id", "w.type", "w.score", F.round("w.confidence", 6).alias("confidence"))


def reconciled_categories(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    h = text.hit_class(F.col("text"))
    r = d.select("doc_id", h["category"].alias("a"), h["confidence"].alias("c"), text.density_class(F.col("text")).alias("b"))
    return r.select("doc_id", text.reconcile_views(F.col("a"), F.col("c"), F.col("b")).alias("r")).groupBy("r.category").agg(F.count("*").alias("n"), F.round(F.avg("r.confidence"), 6).alias("confidence"))


def known_values_found(spark, sf_dir):
    p = _pages(spark, sf_dir).where("ocr_text is not null")
    found = text.known_found(F.col("ocr_text"), F.col("expected_fields"))
    return p.groupBy("profile").agg(F.sum(F.size(found)).alias("found"), F.sum(F.coalesce(F.size("expected_fields"), F.lit(0))).alias("asked"))


def legible_crops(spark, sf_dir):
    c = _crops(spark, sf_dir).where("crop is not null")
    return c.select("crop_id", text.is_legible(F.flatten("crop")).alias("legible"), text.fits_density(F.col("labels"), F.size(F.element_at("crop", 1)) * 12).alias("dense"))


def value_hits(spark, sf_dir):
    return ev.value_hits(_said(spark, sf_dir), _truth(spark, sf_dir), "page_id")


def value_precision_recall(spark, sf_dir):
    out = ev.precision_recall(value_hits(spark, sf_dir))
    return out.select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "wrong")


def wrong_values(spark, sf_dir):
    return ev.wrong_values(_said(spark, sf_dir), _truth(spark, sf_dir), "page_id")


def gated_precision(spark, sf_dir):
    p = _current(spark, sf_dir)
    out = ev.gated_precision(p, F.col("ocr_confidence") >= 0.75, F.col("category") == F.col("expected_category"))
    return out.select("scanned", "kept", F.round("scanned_precision", 9).alias("scanned_precision"), F.round("kept_precision", 9).alias("kept_precision"))


def line_metrics(spark, sf_dir):
    return ev.line_metrics(align_monotone(spark, sf_dir)).withColumn("cer", F.round("cer", 9)).withColumn("detection_recall", F.round("detection_recall", 9))


def consensus_lines(spark, sf_dir):
    return align.consensus(align_monotone(spark, sf_dir)).select("page_id", "want_index", "got_index", F.round("cer", 9).alias("cer"))


def confusion_pairs(spark, sf_dir):
    a = align_monotone(spark, sf_dir).where("want is not null and got is not null")
    return ev.confusion_pairs(a.select(F.upper("want").alias("want"), F.upper("got").alias("got")), "want", "got")


def bootstrap_category(spark, sf_dir):
    p = _current(spark, sf_dir).select("profile", F.coalesce((F.col("category") == F.col("expected_category")).cast("int"), F.lit(0)).alias("ok"))
    return ev.bootstrap_ci(p, "profile", "ok").withColumn("mean", F.round("mean", 9))


def elected_readings(spark, sf_dir):
    """Of all readings of a page the one with most structure."""
    p = _current(spark, sf_dir).where("ocr_text is not null").select("doc", "record_id", "ocr_text", "ocr_confidence", text.structure_score(F.col("ocr_text")).alias("structure"))
    return ev.elect_best(p, "doc", "structure", "ocr_confidence", "record_id", "ocr_text").select("doc", "record_id", "structure")


def best_profiles(spark, sf_dir):
    p = _current(spark, sf_dir).where("ocr_text is not null and expected_text is not null")
    ok = (F.col("category") == F.col("expected_category")).cast("int")
    v = p.groupBy("expected_category", F.col("profile").alias("name")).agg(F.sum(F.coalesce(ok, F.lit(0))).alias("exact"), F.round(F.avg("ms"), 6).alias("cer"))
    return ev.best_variant(v, "expected_category")


def frequent_labels(spark, sf_dir):
    return ev.top_k(_crops(spark, sf_dir), "labels", 12)


def category_maps(spark, sf_dir):
    m = ev.count_maps(_current(spark, sf_dir).where("category is not null"), "profile", "category")
    return m.select("profile", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


def length_ratios(spark, sf_dir):
    p = _current(spark, sf_dir).where("ocr_text is not null and length(expected_text) > 0")
    return ev.ratio_profile(p, "profile", F.length("ocr_text") / F.length("expected_text")).withColumn("inside", F.round("inside", 9))


def _own_lines(spark, sf_dir):
    return _pages(spark, sf_dir).where("ocr_text is not null").select("page_id", F.posexplode(F.split("ocr_text", "\n")).alias("line_index", "text"))


def carrier_lines(spark, sf_dir):
    return align.carrier_lines(_truth(spark, sf_dir).distinct(), _own_lines(spark, sf_dir))


def field_confidence(spark, sf_dir):
    words = _pages(spark, sf_dir).where("ocr_text is not null").select("page_id", F.explode(text.words(F.col("ocr_text"))).alias("word"), F.col("ocr_confidence").alias("confidence"))
    fields = _said(spark, sf_dir).withColumn("field", F.col("value")).distinct()
    out = align.local_confidence(fields, words)
    return out.select("page_id", "field", F.round("confidence", 9).alias("confidence"))


def record_panels(spark, sf_dir):
    """The texts of a reading as panel lines, expected text first."""
    e = newest(table(spark, sf_dir, "pipeline_raw_engine"), [F.col("record_id")], [F.col("loaded_at").desc_nulls_last(), F.col("ocr_text")])
    sections = F.create_map(F.lit("truth"), F.col("expected_text"), F.lit("read"), F.col("ocr_text"))
    return align.flatten_panels(e.withColumn("sections", sections), "record_id", "sections", ["truth", "read"])


def capture_fingerprints(spark, sf_dir):
    p = _current(spark, sf_dir).groupBy("profile").agg(F.count("*").alias("n"), F.min("ms").alias("least"))
    return p.select("profile", text.parameter_fingerprint([F.col("n"), F.col("least")]).alias("fingerprint"), F.round(text.ramp(F.col("least").cast("double"), 0.0, 5000.0), 6).alias("weight"))


def spoken_numbers(spark, sf_dir):
    return _current(spark, sf_dir).select("ms").where("ms is not null").distinct().select("ms", text.chinese_numerals("ms").alias("words"))


def ink_components(spark, sf_dir):
    """Dark regions of every crop."""
    c = _crops(spark, sf_dir).where("crop is not null and crop_id is not null")
    return graph.grid_regions(c, "crop_id", "crop")


def lexicon_sets(spark, sf_dir):
    """Set algebra on the token sets of two sources."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    side = lambda s: d.where(F.col("source") == s).select(F.explode(text.upper_tokens(F.regexp_replace("text", r"[^\x00-\x7f]", " "))).alias("word")).distinct()
    a, b = side("receipt_photos"), side("bank_letters")
    tag = lambda df, n: df.select(F.lit(n).alias("part"), "word")
    parts = tag(a.intersect(b), "intersect").unionByName(tag(a.subtract(b), "except")).unionByName(tag(a.union(b).distinct(), "union"))
    return parts.groupBy("part").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        weighted_types, reconciled_categories, known_values_found, legible_crops, value_hits, value_precision_recall, wrong_values, gated_precision,
        line_metrics, consensus_lines, confusion_pairs, bootstrap_category, elected_readings, best_profiles, frequent_labels, category_maps,
        length_ratios, carrier_lines, field_confidence, record_panels, capture_fingerprints, spoken_numbers, ink_components, lexicon_sets,
    )
}

# --- SQL equivalents -----------------------------------------------------------

_PG = f"(select *, doc || '|' || lower(trim(profile)) page_id from {_CUR.format('pipeline_raw_engine')})"
_SAID = f"(select page_id, unnest(fields) v from {_PG})"
_TRUE = f"(select page_id, unnest(expected_fields) v from {_PG})"
_MATCH = f"(length({_n('a')}) > 0 and length({_n('b')}) > 0 and ({_n('a')} = {_n('b')} or (length({_n('a')}) >= 4 and contains({_n('b')}, {_n('a')})) or (length({_n('b')}) >= 4 and contains({_n('a')}, {_n('b')}))))"
_HITS = f"""(select page_id, len(s) spoken, len(t) truths, len(list_filter(s, lambda a: len(list_filter(t, lambda b: {_MATCH})) > 0)) hits,
 len(list_filter(t, lambda b: len(list_filter(s, lambda a: {_MATCH})) > 0)) recovered
 from (select coalesce(x.page_id, y.page_id) page_id, coalesce(s, []) s, coalesce(t, []) t from (select page_id, list(v) s from {_SAID} group by 1) x full join (select page_id, list(v) t from {_TRUE} group by 1) y on x.page_id = y.page_id))"""


def _evidence(*patterns: tuple[str, int]) -> str:
    return " + ".join(f"case when regexp_matches(t, '{p}') then {w} else 0 end" for p, w in patterns)


_RECEIPT = _evidence(
    (r"\b(?:receipt|till\s*(?:no|number|#)?|transaction\s*(?:no|number|id)|ref(?:erence)?\s*no)\b", 3),
    (r"\b(?:sub-?total|total|amount\s+paid|balance\s+due|change\s+due)\b", 3),
    (r"\b(?:vat|gst|tax|cash|card|change|contactless|chip\s*&?\s*pin)\b", 2),
    (r"\b(?:visa|mastercard|master\s*card|amex|american\s+express)\b", 2),
    (r"\b(?:supermarket|market|grocer|shop|store|restaurant|cafe|café|fuel|petrol|garage)\b", 2),
    (r"\b(?:thank\s+you\s+for\s+shopping|please\s+come\s+again|items?|qty)\b", 2),
    (r"\b(?:opening\s+hours|tel|phone)\b", 1),
)
_PRESCRIPTION = _evidence(
    (r"\b(?:prescription|prescribed|repeat\s+prescription)\b", 4),
    (r"\brx\b", 4),
    (r"\b(?:tablet|capsule|dose|dosage|sig|take\s+(?:one|two|1|2))\b", 3),
    (r"\b\d+\s*(?:mg|mcg|ml|iu|g)\b", 3),
    (r"\b(?:once|twice|three\s+times|four\s+times)\s+(?:a|per|daily)\b|\bevery\s+\d+\s+hours\b|\b(?:prn|bd|tds|qds|as\s+needed)\b", 3),
    (r"\b(?:patient|prescriber|dispensed|dispense|pharmacy|chemist|repeats?|refills?)\b", 3),
    (r"\b(?:gp|doctor|dr\.?|physician|consultant|surgery|clinic|medical\s+cent(?:re|er))\b", 2),
    (r"\b(?:date\s+of\s+birth|dob|nhs|medicare|quantity)\b", 2),
)

ORACLES = {
    "weighted_types": f"""select doc_id, case when greatest(a, b) < 5 then 'unrecognised' when a >= b then 'receipt' else 'prescription' end as type, greatest(a, b) score,
 round(case when greatest(a, b) >= 5 then 0.5 + 0.35 * (greatest(a, b) - least(a, b)) / greatest(a, b, 1) + 0.15 * greatest(a, b) / greatest(a + b, 1) else greatest(a, b) / 10 end, 6) confidence
from (select doc_id, {_RECEIPT} a, {_PRESCRIPTION} b from (select doc_id, lower(text) t from documents where text is not null))""",
    "known_values_found": f"select profile, sum(len(list_filter(coalesce(expected_fields, []), lambda k: length({_n('k')}) > 0 and contains({_n('ocr_text')}, {_n('k')}))))::bigint found, sum(coalesce(len(expected_fields), 0))::bigint asked from {_PG} where ocr_text is not null group by 1",
    "legible_crops": f"""select crop_id, coalesce(hi - lo >= 28 and len(list_filter(v, lambda x: x < (hi + lo) / 2)) / greatest(len(v), 1) >= 0.01, false) legible, coalesce(length(labels) between 2 and 47 and w / greatest(length(labels), 1) >= 12, false) dense
from (select *, list_max(v) hi, list_min(v) lo from (select crop_id, labels, list_transform(flatten(crop), lambda x: ((x::int % 256) + 256) % 256) v, len(crop[1]) * 12 w from {_C} where crop is not null))""",
    "value_hits": f"select *, spoken - hits as wrong from {_HITS}",
    "value_precision_recall": f"select round(sum(hits) / sum(spoken), 9) as precision, round(sum(recovered) / sum(truths), 9) recall, sum(spoken - hits)::bigint wrong from {_HITS}",
    "wrong_values": f"select s.page_id, s.v as value from {_SAID} s left join (select page_id, list(v) t from {_TRUE} group by 1) t using (page_id) where t is null or len(list_filter(t, lambda b: {_MATCH.replace(_n('a'), _n('s.v'))})) = 0",
    "gated_precision": f"select count(*) scanned, sum(coalesce(ocr_confidence >= 0.75, false)::int)::bigint kept, round(avg(coalesce(category = expected_category, false)::int), 9) scanned_precision, round(coalesce(avg(coalesce(category = expected_category, false)::int) filter (where ocr_confidence >= 0.75), 0), 9) kept_precision from {_CUR.format('pipeline_raw_engine')}",
    "best_profiles": f"select expected_category, name from (select *, row_number() over (partition by expected_category order by exact desc, ms nulls first, name) r from (select expected_category, profile as name, sum(coalesce(category = expected_category, false)::int) exact, round(avg(ms), 6) ms from {_CUR.format('pipeline_raw_engine')} where ocr_text is not null and expected_text is not null group by 1, 2)) where r = 1",
    "frequent_labels": f"select labels, count(*) n from {_C} where labels is not null group by 1 order by n desc, labels limit 12",
    "category_maps": f"select profile, string_agg(category || ':' || n, ',' order by category) counts from (select profile, category, count(*) n from {_CUR.format('pipeline_raw_engine')} where category is not null group by 1, 2) group by 1",
    "length_ratios": f"select profile, quantile_cont(r, 0.1) p10, quantile_cont(r, 0.5) p50, quantile_cont(r, 0.9) p90, round(avg((r between 0.85 and 1.15)::int), 9) inside from (select profile, length(ocr_text)::double / length(expected_text) r from {_CUR.format('pipeline_raw_engine')} where ocr_text is not null and length(expected_text) > 0) group by 1",
    "carrier_lines": f"select page_id, v as value, min(i) - 1 as line_index from (select distinct page_id, v from {_TRUE}) join (select page_id, unnest(string_split(ocr_text, chr(10))) l, generate_subscripts(string_split(ocr_text, chr(10)), 1)::int i from {_PG} where ocr_text is not null) using (page_id) where length({_n('v')}) > 0 and contains({_n('l')}, {_n('v')}) group by 1, 2",
    "field_confidence": rf"""with w as (select page_id, upper(unnest(list_filter(string_split_regex(ocr_text, '\s+'), lambda x: x <> ''))) w, ocr_confidence c from {_PG} where ocr_text is not null),
b as (select page_id, w, min(coalesce(c, 0)) c from w group by 1, 2), f as (select page_id, v as field, unnest(list_filter(string_split_regex(upper(v), '\s+'), lambda x: x <> '')) w from (select distinct page_id, v from {_SAID}))
select page_id, field, round(coalesce(min(c), 0), 9) confidence from f left join b using (page_id, w) group by 1, 2""",
    "lexicon_sets": r"""with t as (select source, unnest(regexp_extract_all(upper(regexp_replace(text, '[^\x00-\x7f]', ' ', 'g')), '[0-9A-Z]+')) w from documents where text is not null),
a as (select distinct w from t where source = 'receipt_photos'), b as (select distinct w from t where source = 'bank_letters')
select 'intersect' part, count(*) n from (select w from a intersect select w from b) union all select 'except', count(*) from (select w from a except select w from b) union all select 'union', count(*) from (select w from a union select w from b)""",
}
