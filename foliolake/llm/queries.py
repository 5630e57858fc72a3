"""The llm problems as named queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import mixing, overlap, packing, repair, spans, splits
from foliolake.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_leaks(table(spark, sf_dir, "crops"), table(spark, sf_dir, "page_links"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(
        table(spark, sf_dir, "crops"), table(spark, sf_dir, "page_links"), table(spark, sf_dir, "split_targets")
    )


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_report(_assigned(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf_dir, "crops")).select("crop_a", "crop_b")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "crops"))


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.record_coverage(table(spark, sf_dir, "crops"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, sf_dir, "crops"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_links(table(spark, sf_dir, "crops"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.page_lines(table(spark, sf_dir, "pipeline_raw_engine"))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_texts(table(spark, sf_dir, "pipeline_raw_engine"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_once(table(spark, sf_dir, "documents"))
    return packing.pack_texts(sized, table(spark, sf_dir, "pack_specs"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fill(p6_packed(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p6_packed(spark, sf_dir))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_once(table(spark, sf_dir, "documents"))
    return packing.packing_checks(packing.pack_texts(sized, table(spark, sf_dir, "pack_specs")), sized)


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_once(table(spark, sf_dir, "documents"))
    return mixing.mix_sources(sized, table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(p7_copies(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return spans.shared_report(documents, spans.shared_spans(documents))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_splits, p2_report, p3_found, p3_report, p3_coverage, p3_classes, p3_links, p4_found, p4_repaired,
        p6_packed, p6_fill, p6_report, p6_checks, p7_copies, p7_shares, p8_found, p8_shared,
    )
}

#: The spellings that pages.py maps, repeated in SQL.
_PAGE = r"""nullif(regexp_replace(regexp_replace(lower(trim({0})), '\s*\.(jpe?g|png|gif|bmp|tiff?|webp)\s*$', ''), '[\s_\-]+', '-', 'g'), '')"""
_SPLIT = """case when lower(trim({0})) in ('train','training','trn') then 'train'
 when lower(trim({0})) in ('val','valid','validation','dev') then 'val'
 when lower(trim({0})) in ('test','testing','tst') then 'test' end"""

ORACLES = {
    "p2_found": f"""
with recursive e as (
  select distinct a, b from (
    select {_PAGE.format('page_a')} a, {_PAGE.format('page_b')} b from page_links
    union all select {_PAGE.format('page_b')}, {_PAGE.format('page_a')} from page_links)
  where a is not null and b is not null and a <> b),
walk as (select distinct a as doc, a as near from e union select w.doc, e.b from walk w join e on e.a = w.near),
label as (select doc, min(near) g from walk group by doc),
pages as (select {_PAGE.format('doc')} doc, {_SPLIT.format('split')} s from crops),
seen as (select p.doc, coalesce(l.g, p.doc) g, s from pages p left join label l on l.doc = p.doc where p.doc is not null),
leak as (select g from seen group by g having count(distinct s) > 1)
select distinct doc from seen where g in (select g from leak)""",
    "p3_found": f"""
with n as (
  select crop_id, {_SPLIT.format('split')} s, regexp_replace(lower(labels), '[^a-z0-9]', '', 'g') t,
    row_number() over (partition by crop_id order by loaded_at desc nulls last) r from crops),
c as (select crop_id, s, t from n where r = 1 and s is not null and length(t) >= 24),
tr as (select distinct t from c where s = 'train'), ev as (select distinct t from c where s <> 'train'),
m as (select ev.t e, tr.t t from ev join tr on abs(length(ev.t) - length(tr.t)) <= greatest(length(ev.t), length(tr.t)) // 10
  and levenshtein(ev.t, tr.t) <= greatest(length(ev.t), length(tr.t)) // 10)
select least(a.crop_id, b.crop_id) crop_a, greatest(a.crop_id, b.crop_id) crop_b
from m join c a on a.t = m.t and a.s = 'train' join c b on b.t = m.e and b.s <> 'train'""",
    "p3_classes": f"""
with n as (
  select crop_id, {_SPLIT.format('split')} s, regexp_replace(lower(labels), '[^a-z0-9]', '', 'g') t,
    row_number() over (partition by crop_id order by loaded_at desc nulls last) r from crops where crop_id is not null),
c as (select crop_id, s, t from n where r = 1 and s is not null and length(t) >= 24),
x as (select t, min(crop_id) class_id, count(*) filter (s = 'train') tr, count(*) filter (s <> 'train') ev from c group by 1),
m as (select a.t a, b.t b, a.tr, b.ev from x a join x b on a.tr > 0 and b.ev > 0 and abs(length(a.t) - length(b.t)) <= greatest(length(a.t), length(b.t)) // 10
  and levenshtein(a.t, b.t) <= greatest(length(a.t), length(b.t)) // 10),
up as (select a t, sum(ev) n from m group by 1), down as (select b t, sum(tr) n from m group by 1)
select c.crop_id, c.s as split, x.class_id, coalesce(case when c.s = 'train' then up.n else down.n end, 0)::bigint n_links
from c join x on x.t = c.t left join up on up.t = c.t left join down on down.t = c.t""",
    "p3_links": f"""
with n as (
  select crop_id, {_SPLIT.format('split')} s, regexp_replace(lower(labels), '[^a-z0-9]', '', 'g') t,
    row_number() over (partition by crop_id order by loaded_at desc nulls last) r from crops where crop_id is not null),
c as (select crop_id, s, t from n where r = 1 and s is not null and length(t) >= 24),
x as (select t, min(crop_id) class_id, count(*) filter (s = 'train') tr, count(*) filter (s <> 'train') ev from c group by 1)
select a.class_id train_class, b.class_id held_class, levenshtein(a.t, b.t)::int edits from x a join x b on a.tr > 0 and b.ev > 0
 and abs(length(a.t) - length(b.t)) <= greatest(length(a.t), length(b.t)) // 10 and levenshtein(a.t, b.t) <= greatest(length(a.t), length(b.t)) // 10""",
    "p8_shared": """
with w as (select doc_id, i, hash(substring(text, i, 200)) g, length(text) n from (select doc_id, text, unnest(range(1, length(text) - 198)) i from documents where length(text) >= 200)),
h as (select g from w group by g having min(doc_id) <> max(doc_id)),
p as (select doc_id, i - 1 s from w join h using (g)),
m as (select *, sum(case when s <= b + 200 then 0 else 1 end) over (partition by doc_id order by s) k from (select *, lag(s) over (partition by doc_id order by s) b from p)),
f as (select doc_id, min(s) a, max(s) + 200 e from m group by doc_id, k),
g as (select doc_id, count(*) n, sum(e - a) c from f group by 1)
select d.doc_id, coalesce(length(text), 0)::bigint n_chars, coalesce(n, 0)::bigint n_spans, coalesce(c, 0)::bigint shared_chars, coalesce(c / nullif(length(text), 0), 0)::double shared_part
from documents d left join g on g.doc_id = d.doc_id""",
    "p6_checks": r"""
select spec, (select count(*) from documents where regexp_matches(text, '\S')) n_texts, 0::bigint wrong_sizes, 0::bigint overfull, 0::bigint needless_cuts
from pack_specs where capacity_tokens > 0""",
    "p8_found": """
with w as (select doc_id, i, hash(substring(text, i, 200)) g, length(text) n from (select doc_id, text, unnest(range(1, length(text) - 198)) i from documents where length(text) >= 200)),
h as (select g from w group by g having min(doc_id) <> max(doc_id)),
p as (select doc_id, i - 1 s from w join h using (g)),
m as (select *, sum(case when s <= b + 200 then 0 else 1 end) over (partition by doc_id order by s) k from (select *, lag(s) over (partition by doc_id order by s) b from p))
select doc_id, min(s)::bigint span_start, (max(s) + 200)::bigint span_end from m group by doc_id, k""",
    "p3_report": f"""
with n as (
  select crop_id, {_PAGE.format('doc')} doc, {_SPLIT.format('split')} s, regexp_replace(lower(labels), '[^a-z0-9]', '', 'g') t,
    row_number() over (partition by crop_id order by loaded_at desc nulls last) r from crops),
c as (select crop_id, s, t, coalesce(regexp_extract(doc, '^(.*?)-?[0-9]*$', 1), '') src from n where r = 1 and s is not null and length(t) >= 24),
tr as (select t, count(*) n from c where s = 'train' group by t),
ev as (select distinct t from c where s <> 'train'),
m as (select ev.t, sum(tr.n) pairs from ev join tr on abs(length(ev.t) - length(tr.t)) <= greatest(length(ev.t), length(tr.t)) // 10
  and levenshtein(ev.t, tr.t) <= greatest(length(ev.t), length(tr.t)) // 10 group by ev.t)
select s as split, src as source, cast(sum(coalesce(pairs, 0)) as bigint) n_pairs, count(*) n_crops,
  cast(sum(case when pairs > 0 then 1 else 0 end) as bigint) leaked_crops,
  sum(case when pairs > 0 then 1 else 0 end) / count(*) leaked_part
from c left join m using (t) where s <> 'train' group by 1, 2""",
}
