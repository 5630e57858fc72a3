"""Corpus, alignment, event and relational queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolake.functions import text
from foliolake.functions.pages import PAGE_SQL, SPLIT_SQL, page_id, split_name
from foliolake.operators import align, corpus, history
from foliolake.operators.current import newest
from foliolake.tables import table


def _crops(spark, sf_dir):
    return newest(table(spark, sf_dir, "crops"), [F.col("crop_id")], [F.col("loaded_at").desc_nulls_last(), F.col("labels")])


def scan_lineitem_pruned(spark, sf_dir):
    """Two columns of a wide table behind a pushed-down filter."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 45 and l_returnflag = 'R'")
    return li.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def scan_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), F.coalesce("lang", F.lit("")).alias("lang"))


def dedupe_first(spark, sf_dir):
    c = table(spark, sf_dir, "crops").where("labels is not null")
    first = corpus.first_wins(c, corpus.case_blind_key(F.col("labels")), [F.col("loaded_at"), F.col("crop_id"), F.col("labels")])
    return first.select("crop_id", "labels")


def split_by_position(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return corpus.positional_split(d, "doc_id")


def split_by_document(spark, sf_dir):
    return corpus.hashed_split(table(spark, sf_dir, "documents"), "issuer", 3).select("doc_id", "split")


def split_disjointness(spark, sf_dir):
    """Pages of the crops table whose own split column contradicts itself."""
    c = _crops(spark, sf_dir).select(page_id(F.col("doc")).alias("doc"), split_name(F.col("split")).alias("split")).where("doc is not null and split is not null")
    return corpus.split_leaks(c, "doc")


def stratified_folds(spark, sf_dir):
    f = corpus.stratified_folds(table(spark, sf_dir, "documents"), "lang", "doc_id", 5)
    return f.groupBy("lang", "fold").agg(F.count("*").alias("n"))


def capped_crops(spark, sf_dir):
    c = _crops(spark, sf_dir).where("doc is not null and length(labels) >= 2")
    return corpus.cap_per_group(c, "doc", ["line_index", "crop_id"], 40).select("crop_id")


def strided_crops(spark, sf_dir):
    return corpus.strided_sample(_crops(spark, sf_dir), "profile", ["crop_id"], 50).select("crop_id")


def augmented_labels(spark, sf_dir):
    c = _crops(spark, sf_dir).where("labels is not null").select("crop_id", "labels")
    noise = lambda i: {"labels": F.when(F.pmod(F.col("crop_id"), F.lit(3)) == i, F.translate("labels", "0158", "OISB")).otherwise(F.col("labels"))}
    return corpus.augment(c, 2, noise)


def rejection_funnel(spark, sf_dir):
    c = _crops(spark, sf_dir)
    n, steps = F.length(text.clean_to_charset(F.coalesce("labels", F.lit("")))), F.coalesce(F.size(F.element_at("crop", 1)), F.lit(0)) * 8
    out = corpus.funnel(c.select(corpus.label_plausible(n, steps).alias("reason")), "reason")
    return out.select("reason", "n", F.round("part", 9).alias("part"))


def label_length_histogram(spark, sf_dir):
    return corpus.dense_histogram(_crops(spark, sf_dir).select(F.length("labels").alias("chars")), "chars")


def length_distribution(spark, sf_dir):
    c = _crops(spark, sf_dir).select("profile", F.length("labels").cast("double").alias("chars"))
    return corpus.distribution(c, "profile", "chars").withColumn("mean", F.round("mean", 9))


def iqr_divergence(spark, sf_dir):
    """Each profile's median label length against the clean profile's, in its IQR."""
    per = length_distribution(spark, sf_dir)
    base = per.where("profile = 'studio_clean'").select(F.col("median").alias("b_median"), F.col("iqr").alias("b_iqr"))
    out = corpus.divergence(F.col("median"), F.col("b_median"), F.col("b_iqr"))
    return per.where("profile is not null").join(F.broadcast(base)).select("profile", F.round(out, 9).alias("divergence"))


def profile_brackets(spark, sf_dir):
    per = length_distribution(spark, sf_dir)
    base = per.where("profile = 'studio_clean'").select(F.col("median").alias("b_median"), F.col("mean").alias("b_mean"))
    worst = corpus.worst_ratio([(F.col("median"), F.col("b_median")), (F.col("mean"), F.col("b_mean"))])
    return per.where("profile is not null").join(F.broadcast(base)).select("profile", F.round(worst, 6).alias("worst"))


def severity_monotone(spark, sf_dir):
    """Does mean confidence fall along the ladder of capture conditions?"""
    ladder = F.create_map(*[x for i, p in enumerate(("studio_clean", "handheld_light", "handheld_heavy", "worst_case")) for x in (F.lit(p), F.lit(i))])
    e = table(spark, sf_dir, "pipeline_raw_engine").withColumn("step", ladder[F.col("profile")]).where("step is not null")
    per = e.groupBy("expected_category", "step").agg(F.round(F.avg("ocr_confidence"), 9).alias("conf"))
    return corpus.is_monotone(per, "expected_category", "step", [], ["conf"])


def nearest_profile(spark, sf_dir):
    """Each issuer's texts against the sources by length and words, standardised."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("issuer", "source", F.length("text").cast("double").alias("chars"), F.size(text.words(F.col("text"))).cast("double").alias("words"))
    dims = ["chars", "words"]
    mean = lambda key: d.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(x).alias(x) for x in dims])
    out = corpus.nearest_profile(mean("issuer"), mean("source"), dims, "issuer", "source")
    return out.select("issuer", F.round("distance", 6).alias("distance"))


def otsu_thresholds(spark, sf_dir):
    h = corpus.pixel_histogram(_crops(spark, sf_dir), "profile", "crop")
    return corpus.otsu_threshold(h.where("profile is not null"), "profile")


def ink_runs(spark, sf_dir):
    """Runs of header-like short lines inside each page reading of the crops."""
    c = _crops(spark, sf_dir).where("doc is not null and line_index is not null").groupBy("doc", "line_index").agg(F.max(F.length("labels")).alias("chars"))
    return corpus.runs(c, "doc", "line_index", F.col("chars") < 24, 2)


def line_pitch(spark, sf_dir):
    c = _crops(spark, sf_dir).where("doc is not null and line_index is not null").select("doc", "line_index").distinct()
    return corpus.median_pitch(c, "doc", "line_index")


def width_batches(spark, sf_dir):
    c = _crops(spark, sf_dir).where("labels is not null").select("crop_id", "profile", F.length("labels").alias("width"))
    return corpus.width_buckets(c, "profile", "width", "crop_id", 3, 32).groupBy("profile", "bucket", "batch").agg(F.count("*").alias("n"))


def stable_seeds(spark, sf_dir):
    p = table(spark, sf_dir, "crops").select("profile").where("profile is not null").distinct()
    return p.select("profile", corpus.crc_seed(F.col("profile"), 123).alias("seed"), corpus.pick_by_hash(F.col("profile"), 7).alias("pick"))


# --- alignment -----------------------------------------------------------------


def _capture(profile):
    """A capture profile without blanks, case or tag."""
    return F.split(F.lower(F.trim(profile)), r"\+")[0]


def _placed(spark, sf_dir):
    """Current crops with a page, a capture profile and a place on the page."""
    c = _crops(spark, sf_dir).select("crop_id", page_id(F.col("doc")).alias("page"), _capture(F.col("profile")).alias("capture"), "line_index", F.col("labels").alias("text"))
    return c.where("page is not null and capture <> '' and line_index is not null")


def _page_key():
    return F.concat_ws("|", "page", "capture").alias("page_id")


def _wanted(c):
    """The clean lines of a page, once for every other capture of it."""
    clean = c.where("capture = 'studio_clean'").drop("capture")
    others = c.where("capture <> 'studio_clean'").select("page", "capture").distinct()
    return clean.join(others, "page")


def _sides(spark, sf_dir):
    """Reading against reading of the same page: clean lines wanted, each other capture's got."""
    c = _placed(spark, sf_dir)
    want = _wanted(c).select(_page_key(), F.lit("want").alias("side"), "line_index", "text", "crop_id")
    got = c.where("capture <> 'studio_clean'").select(_page_key(), F.lit("got").alias("side"), "line_index", "text", "crop_id")
    return want.unionByName(got)


def align_monotone(spark, sf_dir):
    return align.align_lines(_sides(spark, sf_dir))


def align_difflib(spark, sf_dir):
    return align.align_lines(_sides(spark, sf_dir), "difflib")


def alignment_recall(spark, sf_dir):
    a = align_monotone(spark, sf_dir)
    return a.groupBy("page_id").agg(
        F.sum(F.when(F.col("want_index").isNotNull() & F.col("got_index").isNotNull(), 1).otherwise(0)).alias("pairs"),
        F.sum(F.when(F.col("got_index").isNull(), 1).otherwise(0)).alias("missed"),
        F.sum(F.when(F.col("want_index").isNull(), 1).otherwise(0)).alias("spurious"),
    )


def order_free_recall(spark, sf_dir):
    s = _sides(spark, sf_dir).where("text is not null").select("page_id", "side", F.explode(text.upper_tokens(F.col("text"))).alias("word"))
    out = align.bag_overlap(s.where("side = 'want'"), s.where("side = 'got'"), "page_id")
    return out.select("page_id", "common", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


def count_matched_lines(spark, sf_dir):
    s = _sides(spark, sf_dir)
    j = align.ordinal_join(s.where("side = 'want'").drop("side"), s.where("side = 'got'").drop("side"), "page_id", ["line_index", "crop_id"], ["line_index", "crop_id"])
    return j.select("page_id", "ordinal", F.col("a.text").alias("want"), F.col("b.text").alias("got"))


def zipped_lines(spark, sf_dir):
    """Lines paired by position, the longer side cut."""
    s = _sides(spark, sf_dir)
    j = align.ordinal_join(s.where("side = 'want'").drop("side"), s.where("side = 'got'").drop("side"), "page_id", ["line_index", "crop_id"], ["line_index", "crop_id"], equal_only=False)
    return j.select("page_id", "ordinal", F.col("a.text").alias("want"), F.col("b.text").alias("got"))


def _boxes(rows, shift):
    """Lines as boxes of 30 at every 40; one box per place."""
    b = rows.groupBy("page", "capture", "line_index").agg(F.min("crop_id").alias("id"))
    return b.select(_page_key(), "id", (F.col("line_index") * 40 + shift).alias("y0"), (F.col("line_index") * 40 + 30 + shift).alias("y1"))


def iou_matches(spark, sf_dir):
    c = _placed(spark, sf_dir)
    m = align.match_boxes(_boxes(_wanted(c), 0), _boxes(c.where("capture <> 'studio_clean'"), 6), 0.5)
    return m.select("page_id", "a_id", "b_id", F.round("iou", 9).alias("iou"))


def next_line_values(spark, sf_dir):
    """The line below each short heading of a page."""
    c = _placed(spark, sf_dir).where("text is not null")
    lines = c.groupBy(_page_key(), "line_index").agg(F.min("text").alias("text"))
    lines = lines.select("page_id", "line_index", "text", F.lit(0).alias("x0"), (F.col("line_index") * 40).alias("y0"), (F.col("line_index") * 40 + 30).alias("y1"))
    return align.nearest_below(lines.where(F.length("text") < 24), lines)


def last_event_before(spark, sf_dir):
    """As-of join: each purchase with the value of the user's last other event."""
    e = table(spark, sf_dir, "events")
    marks = e.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = align.last_at_or_before(points, marks, "user_id", "ts", "ts", "value")
    return out.select("event_id", F.round("value", 6).alias("value"))


def page_texts(spark, sf_dir):
    lines = _placed(spark, sf_dir).where("text is not null").select(_page_key(), "line_index", "text", F.lit(0).alias("x0"), F.col("line_index").alias("y0"))
    return align.reading_order(lines.distinct())


# --- history and events ---------------------------------------------------------


def history_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "pipeline_raw_engine").select("record_id", "doc", "profile", "loaded_at", "ms")
    half = F.expr("percentile_approx(record_id, 0.5)")
    mid = e.agg(half.alias("m")).first()["m"] or 0
    stored = newest(e.where(F.col("record_id") <= mid), [F.col("record_id")], [F.col("loaded_at").desc_nulls_last()])
    return history.upsert_latest(stored, e.where(F.col("record_id") > mid), "record_id", "loaded_at")


def latest_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return newest(e, [F.col("user_id")], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


def event_sessions(spark, sf_dir):
    """Gaps-and-islands sessions of each user: a new one after 30 quiet minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("s", sec)
    new = F.coalesce(F.col("s") - F.lag("s").over(w) > 1_800_000_000, F.lit(True)).cast("int")
    numbered = e.withColumn("n", new).withColumn("session", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))


def hourly_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts")).cast("string").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


def segment_cube(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def top_parts_per_brand(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    p = table(spark, sf_dir, "part").join(li, F.col("p_partkey") == F.col("l_partkey"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("q"), "p_partkey")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("p_brand", "p_partkey", F.round("q", 2).alias("quantity"), "rank")


def revenue_by_flag(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_lineitem_pruned, scan_documents, dedupe_first, split_by_position, split_by_document, split_disjointness, stratified_folds, capped_crops,
        strided_crops, augmented_labels, rejection_funnel, label_length_histogram, length_distribution, iqr_divergence, profile_brackets,
        severity_monotone, nearest_profile, otsu_thresholds, ink_runs, line_pitch, width_batches, stable_seeds, align_monotone, align_difflib,
        alignment_recall, order_free_recall, count_matched_lines, zipped_lines, iou_matches, next_line_values, last_event_before, page_texts,
        history_upsert, latest_wins, event_sessions, hourly_events, event_props, segment_cube, top_parts_per_brand, revenue_by_flag,
    )
}

# --- SQL equivalents -----------------------------------------------------------

_C = "(select * exclude (r) from (select *, row_number() over (partition by crop_id order by loaded_at desc nulls last, labels) r from crops) where r = 1)"
_DIST = f"(select profile, count(chars) n, round(avg(chars), 9) mean, quantile_cont(chars, 0.25) p25, quantile_cont(chars, 0.5) median, quantile_cont(chars, 0.75) p75 from (select profile, length(labels)::double chars from {_C}) group by 1)"
_PLACED = f"(select * from (select crop_id, {PAGE_SQL.format('doc')} page, split_part(lower(trim(profile)), '+', 1) capture, line_index, labels as text from {_C}) where page is not null and capture <> '' and line_index is not null)"
_GOT = f"(select page || '|' || capture page_id, line_index, text, crop_id from {_PLACED} where capture <> 'studio_clean')"
_WANT = f"(select p.page || '|' || o.capture page_id, p.line_index, p.text, p.crop_id from {_PLACED} p join (select distinct page, capture from {_PLACED} where capture <> 'studio_clean') o on o.page = p.page where p.capture = 'studio_clean')"
_PL = f"(select page || '|' || capture page_id, line_index, min(text) as text from {_PLACED} where text is not null group by 1, 2)"


def _zip_sql(equal: str) -> str:
    side = lambda s: f"(select *, row_number() over (partition by page_id order by line_index, crop_id)::int o, count(*) over (partition by page_id) n from {s})"
    return f"select a.page_id, a.o as ordinal, a.text want, b.text got from {side(_WANT)} a join {side(_GOT)} b on a.page_id = b.page_id and a.o = b.o {equal}"


ORACLES = {
    "scan_lineitem_pruned": "select l_linestatus, count(*) n, round(sum(l_quantity), 2) quantity from lineitem where l_quantity >= 45 and l_returnflag = 'R' group by 1",
    "scan_documents": "select doc_id, coalesce(length(text), 0) chars, coalesce(lang, '') lang from documents",
    "dedupe_first": "select crop_id, labels from (select *, row_number() over (partition by lower(trim(labels)) order by loaded_at nulls first, crop_id, labels) r from crops where labels is not null) where r = 1",
    "split_by_position": "select doc_id, case when r <= t then 'train' when r <= t + v then 'val' else 'test' end as split from (select doc_id, row_number() over (order by doc_id) r, greatest(1, round_even(0.7 * count(*) over (), 0)) t, greatest(1, round_even(0.15 * count(*) over (), 0)) v from (select distinct doc_id from documents))",
    "split_disjointness": f"select doc from (select {PAGE_SQL.format('doc')} doc, {SPLIT_SQL.format('split')} s from {_C}) where doc is not null group by doc having min(s) <> max(s)",
    "capped_crops": f"select crop_id from (select crop_id, row_number() over (partition by doc order by line_index nulls first, crop_id) r from {_C} where doc is not null and length(labels) >= 2) where r <= 40",
    "strided_crops": f"select crop_id from (select crop_id, row_number() over (partition by profile order by crop_id) - 1 r, greatest(1, count(*) over (partition by profile) // 50) s from {_C}) where r % s = 0 and r // s < 50",
    "augmented_labels": f"select crop_id, case when c > 0 and crop_id % 3 = c then translate(labels, '0158', 'OISB') else labels end labels, c as copy from {_C}, (select unnest([0, 1, 2])::int c) where labels is not null",
    "rejection_funnel": f"""select reason, count(*) n, round(count(*) / sum(count(*)) over (), 9) part from (select case when n = 0 then 'empty' when n > 48 then 'too-long' when n > s then 'ctc-infeasible' when n < floor(0.15 * greatest(1, s)) then 'collapsed' else 'kept' end reason
 from (select length(trim(regexp_replace(regexp_replace(upper(coalesce(labels, '')), '[^0-9A-Z ]', '', 'g'), ' +', ' ', 'g'))) n, coalesce(len(crop[1]), 0) * 8 s from {_C})) group by 1""",
    "label_length_histogram": f"with h as (select length(labels) v, count(*) n from {_C} where labels is not null group by 1) select v as value, coalesce(n, 0) n from (select unnest(range((select min(v) from h), (select max(v) from h) + 1))::int v) left join h using (v)",
    "length_distribution": f"select *, p75 - p25 iqr from {_DIST}",
    "iqr_divergence": f"select profile, round(case when b.iqr <= 1e-9 then case when abs(median - b.m) > 1e-9 then 'infinity'::double else 0 end else abs(median - b.m) / b.iqr end, 9) divergence from {_DIST}, (select median m, p75 - p25 iqr from {_DIST} where profile = 'studio_clean') b where profile is not null",
    "profile_brackets": f"select profile, round(greatest(median / b.m, b.m / median, mean / b.a, b.a / mean), 6) worst from {_DIST}, (select median m, mean a from {_DIST} where profile = 'studio_clean') b where profile is not null",
    "severity_monotone": """with p as (select expected_category, list_position(['studio_clean','handheld_light','handheld_heavy','worst_case'], profile) step, round(avg(ocr_confidence), 9) conf from pipeline_raw_engine group by 1, 2)
select expected_category, bool_and(ok) monotone from (select expected_category, coalesce(conf <= lag(conf) over (partition by expected_category order by step), true) ok from p where step > 0) group by 1""",
    "nearest_profile": r"""with d as (select issuer, source, length(text)::double c, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::double w from documents where text is not null),
i as (select issuer, avg(c) c, avg(w) w from d where issuer is not null group by 1), s as (select source, avg(c) c, avg(w) w from d where source is not null group by 1), z as (select stddev_pop(c) c, stddev_pop(w) w from s)
select issuer, round(min(sqrt(((i.c - s.c) / z.c) ** 2 + ((i.w - s.w) / z.w) ** 2)), 6) distance from i, s, z group by 1""",
    "otsu_thresholds": f"""with h as (select profile, b, count(*) n from (select profile, ((v::int % 256) + 256) % 256 b from (select profile, unnest(flatten(crop)) v from {_C} where crop is not null and profile is not null) where v is not null) group by 1, 2),
r as (select profile, b, sum(n) over (partition by profile order by b)::double wb, sum(b * n) over (partition by profile order by b)::double sb, sum(n) over (partition by profile)::double t, sum(b * n) over (partition by profile)::double st from h),
v as (select profile, b, case when wb > 0 and wb < t then wb * (t - wb) * (sb / wb - (st - sb) / (t - wb)) ** 2 else 0 end x from r)
select profile, b::int threshold from (select *, row_number() over (partition by profile order by x desc, b) k from v) where k = 1""",
    "ink_runs": f"""with l as (select doc, line_index p from {_C} where doc is not null and line_index is not null group by 1, 2 having max(length(labels)) < 24),
m as (select *, sum(n) over (partition by doc order by p) run from (select *, case when p - lag(p) over (partition by doc order by p) <= 2 then 0 else 1 end n from l))
select doc, run::bigint run, min(p) as start, max(p) as "end", count(*) as length from m group by 1, 2""",
    "line_pitch": f"select doc, median(g) pitch from (select doc, line_index - lag(line_index) over (partition by doc order by line_index) g from (select distinct doc, line_index from {_C} where doc is not null and line_index is not null)) group by 1",
    "width_batches": f"""with c as (select crop_id, profile, length(labels) w from {_C} where labels is not null),
b as (select *, sum(n) over (partition by profile order by w, crop_id)::bigint bucket from (select *, case when w - lag(w) over (partition by profile order by w, crop_id) <= 3 then 0 else 1 end n from c))
select profile, bucket, ((r - 1) // 32)::bigint batch, count(*) n from (select *, row_number() over (partition by profile, bucket order by w, crop_id) r from b) group by 1, 2, 3""",
    "order_free_recall": f"""with a as (select page_id, w, count(*) n from (select page_id, unnest(regexp_extract_all(upper(text), '[0-9A-Z]+')) w from {_WANT} where text is not null) group by 1, 2),
b as (select page_id, w, count(*) n from (select page_id, unnest(regexp_extract_all(upper(text), '[0-9A-Z]+')) w from {_GOT} where text is not null) group by 1, 2),
j as (select coalesce(a.page_id, b.page_id) page_id, coalesce(a.n, 0) x, coalesce(b.n, 0) y from a full join b on a.page_id = b.page_id and a.w = b.w)
select page_id, sum(least(x, y))::bigint common, coalesce(round(sum(least(x, y)) / nullif(sum(x), 0), 9), 0) recall, coalesce(round(sum(least(x, y)) / nullif(sum(y), 0), 9), 0) as precision from j group by 1""",
    "next_line_values": f"""select page_id, line_index as label_index, nxt as value_index from (select *, min(case when trim(text) <> '' then line_index end) over (partition by page_id order by line_index rows between 1 following and unbounded following) nxt from {_PL})
 where length(text) < 24 and nxt is not null""",
    "count_matched_lines": _zip_sql("where a.n = b.n"),
    "zipped_lines": _zip_sql(""),
    "stratified_folds": "select lang, f::int fold, (n - f + 4) // 5 n from (select lang, count(*) n from documents group by 1), (select unnest(range(0, 5)) f) where n > f",
    "last_event_before": """select event_id, round(m.value, 6) as value from (select event_id, user_id, ts from events where event_type = 'purchase') p asof left join (select user_id, ts, max(value) as value from events where event_type <> 'purchase' group by 1, 2) m on p.user_id = m.user_id and p.ts >= m.ts""",
    "page_texts": f"select page_id, string_agg(text, chr(10) order by line_index, text) as text from (select distinct page || '|' || capture page_id, line_index, text from {_PLACED} where text is not null) group by 1",
    "history_upsert": "select record_id, doc, profile, loaded_at, ms from (select *, row_number() over (partition by record_id order by loaded_at desc nulls last) r from pipeline_raw_engine) where r = 1",
    "latest_wins": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc nulls last, event_id desc) r from events) where r = 1",
    "event_sessions": """select user_id, session, count(*) events, round(sum(value), 4) as value from (select *, sum(n) over (partition by user_id order by ts, event_id)::bigint session from
 (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= 1800000000 then 0 else 1 end n from events)) group by 1, 2""",
    "hourly_events": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) n from events group by 1, 2",
    "event_props": "select event_type, count(k) n, sum(k)::bigint total from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) k from events) group by 1",
    "segment_cube": "select c_mktsegment, n_name, count(*) n, round(sum(c_acctbal), 2) balance from customer join nation on c_nationkey = n_nationkey group by cube (c_mktsegment, n_name)",
    "top_parts_per_brand": "select p_brand, p_partkey, round(q, 2) quantity, rank from (select p_brand, p_partkey, q, row_number() over (partition by p_brand order by q desc, p_partkey) rank from part join (select l_partkey, sum(l_quantity) q from lineitem group by 1) on p_partkey = l_partkey) where rank <= 3",
    "revenue_by_flag": "select l_returnflag, l_linestatus, count(*) n, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) discount from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
}
