"""Problems 1 and 5 as named queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.operators import copy_diff, schema_drift
from foliolake.tables import table

TYPED = ("pipeline_raw_engine", "pipeline_raw_engine_off", "pipeline_raw_pre_wordlm")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema_drift.changes(table(spark, sf_dir, "pipeline_raw_files"))
    return found.select("file_name", "change_kind", "old_field", "new_field")


def p1_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = schema_drift.file_schemas(table(spark, sf_dir, "pipeline_raw_files"))
    return schemas.select(*schema_drift.FILE, "version", "n_fields")


def p1_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.migration_registry(table(spark, sf_dir, "pipeline_raw_files"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pipeline_raw_files")
    return schema_drift.consistent_records(files, {n: table(spark, sf_dir, n) for n in TYPED})


def p1_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.applied_rules(p1_records(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_diff.diff_copies(
        table(spark, sf_dir, "pipeline_raw_engine"),
        table(spark, sf_dir, "pipeline_raw_engine_off"),
        keys={"doc": F.col("doc"), "profile": F.lower(F.trim(F.col("profile")))},
        fields={
            "fields": copy_diff.canonical_list(F.col("fields")),
            "ocr_text": copy_diff.canonical_text(F.col("ocr_text")),
        },
        order=[F.col("loaded_at"), F.col("record_id")],
        left_name="engine",
        right_name="engine_off",
    )


def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).groupBy("field", "kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_versions, p1_migrations, p1_records, p1_rules, p5_found, p5_summary)}

_CURRENT = r"""
 select * from (select coalesce(doc, '') doc, coalesce(lower(trim(profile)), '') profile,
   list_sort(coalesce(fields, [])) f,
   regexp_replace(replace(coalesce(ocr_text, ''), chr(13) || chr(10), chr(10)), '[ \t]+(\n|$)', '\1', 'g') t,
   row_number() over (partition by coalesce(doc, ''), coalesce(lower(trim(profile)), '') order by loaded_at desc nulls last, record_id desc) r
   from {0}) where r = 1"""
_P5 = f"""
with a as ({_CURRENT.format('pipeline_raw_engine')}), b as ({_CURRENT.format('pipeline_raw_engine_off')}),
j as (select coalesce(a.doc, b.doc) doc, coalesce(a.profile, b.profile) profile, a.doc is null la, b.doc is null lb, a.f fa, b.f fb, a.t ta, b.t tb
  from a full join b on a.doc = b.doc and a.profile = b.profile)
select doc, profile, '' as field, 'missing_in_engine' as kind from j where la
union all select doc, profile, '', 'missing_in_engine_off' from j where lb
union all select doc, profile, 'fields', 'differs' from j where not la and not lb and fa <> fb
union all select doc, profile, 'ocr_text', 'differs' from j where not la and not lb and ta <> tb"""

_SCHEMAS = r"""
with lines as (select arm, bench, run_no, file_name, body from pipeline_raw_files
  where arm is not null and bench is not null and run_no is not null and file_name is not null),
files as (select distinct arm, bench, run_no, file_name from lines),
readable as (select * from lines where json_valid(body) and json_type(body) = 'OBJECT'),
keyed as (select *, unnest(json_keys(body)) field from readable),
valued as (select *, json_extract(body, '$."' || field || '"') val from keyed),
kinded as (select *, case json_type(val) when 'VARCHAR' then 'string' when 'BIGINT' then 'whole' when 'UBIGINT' then 'whole' when 'DOUBLE' then 'decimal'
  when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'list' when 'OBJECT' then 'object' end kind from valued),
found as (select arm, bench, run_no, file_name, field, coalesce(list_sort(list(distinct kind) filter (kind is not null)), []) k from kinded group by all),
schemas as (select * exclude k, case when list_contains(k, 'whole') and list_contains(k, 'decimal') then list_filter(k, lambda x: x <> 'whole') else k end kinds from found)"""

_P1_VERSIONS = _SCHEMAS + """
select f.arm, f.bench, f.run_no, f.file_name,
  md5(coalesce(string_agg(s.field || ':' || array_to_string(s.kinds, ','), ';' order by s.field), '')) as version, count(s.field) as n_fields
from files f left join schemas s using (arm, bench, run_no, file_name) group by all"""

_P1_STEPS = _SCHEMAS + r""",
pairs as (select a.arm, a.bench, a.run_no, a.file_name, b.run_no prev_run, b.file_name prev_file from files a join files b on a.arm = b.arm and a.bench = b.bench and b.run_no < a.run_no
  qualify row_number() over (partition by a.arm, a.bench, a.run_no, a.file_name order by b.run_no desc, b.file_name desc) = 1),
now as (select p.*, s.field, s.kinds from pairs p join schemas s using (arm, bench, run_no, file_name)),
was as (select p.*, s.field, s.kinds from pairs p join schemas s on s.arm = p.arm and s.bench = p.bench and s.run_no = p.prev_run and s.file_name = p.prev_file),
both_sides as (select coalesce(n.arm, w.arm) arm, coalesce(n.bench, w.bench) bench, coalesce(n.run_no, w.run_no) run_no, coalesce(n.file_name, w.file_name) file_name,
   coalesce(n.prev_run, w.prev_run) prev_run, coalesce(n.prev_file, w.prev_file) prev_file, w.field old_field, n.field new_field, w.kinds old_kinds, n.kinds new_kinds
 from now n full join was w on n.arm = w.arm and n.bench = w.bench and n.run_no = w.run_no and n.file_name = w.file_name and n.field = w.field),
tokens as (select arm, bench, run_no, file_name, field, json_extract_string(body, '$.doc') doc, json_extract_string(body, '$.profile') profile, val::varchar val,
   lower(regexp_replace(val::varchar, '^"|"$', '', 'g')) plain from kinded where kind is not null),
marked as (select * exclude (val, plain), case when val in ('true', 'false') then ['?' || val]
   when regexp_matches(plain, '^\s*-?[0-9][0-9,]*(\.[0-9]+)?\s*(ms|s)?\s*$') then
     ['#' || floor(ln(greatest(abs(cast(regexp_replace(plain, '[^0-9.\-]', '', 'g') as double) * case when regexp_matches(plain, '[0-9]\s*s\s*$') then 1000 else 1 end), 1e-9)) / ln(1.05))::bigint]
   else list_distinct(list_filter(string_split_regex(plain, '[^\p{L}\p{N}]+'), lambda x: x <> '')) end tk from tokens where doc is not null and profile is not null),
evidence as (select arm, bench, run_no, file_name, field, doc, profile, max(tk) tk from marked where len(tk) > 0 group by all),
olds as (select b.arm, b.bench, b.run_no, b.file_name, b.old_field, e.doc, e.profile, e.tk from both_sides b join evidence e
   on e.arm = b.arm and e.bench = b.bench and e.run_no = b.prev_run and e.file_name = b.prev_file and e.field = b.old_field where b.new_field is null),
news as (select b.arm, b.bench, b.run_no, b.file_name, b.new_field, e.doc, e.profile, e.tk from both_sides b join evidence e
   on e.arm = b.arm and e.bench = b.bench and e.run_no = b.run_no and e.file_name = b.file_name and e.field = b.new_field where b.old_field is null),
compared as (select o.arm, o.bench, o.run_no, o.file_name, o.old_field, n.new_field, len(o.tk) lo, len(n.tk) ln,
   len(list_intersect(case when starts_with(o.tk[1], '#') then ['#' || (o.tk[1][2:]::bigint - 1), o.tk[1], '#' || (o.tk[1][2:]::bigint + 1)] else o.tk end, n.tk)) c
 from olds o join news n using (arm, bench, run_no, file_name, doc, profile)),
scored as (select arm, bench, run_no, file_name, old_field, new_field, avg(c / least(lo, ln)) part, avg(c / (lo + ln - c)) whole from compared group by all having part >= 0.5),
moved as (select * from scored qualify row_number() over (partition by arm, bench, run_no, file_name, old_field order by whole desc, old_field, new_field) = 1
  and row_number() over (partition by arm, bench, run_no, file_name, new_field order by whole desc, old_field, new_field) = 1),
steps as (
 select arm, bench, run_no, file_name, 'renamed' change_kind, old_field, new_field from moved
 union all select arm, bench, run_no, file_name, 'retyped', old_field, new_field from both_sides where old_field = new_field and len(old_kinds) > 0 and len(new_kinds) > 0 and old_kinds <> new_kinds
 union all select arm, bench, run_no, file_name, 'removed', old_field, '' from both_sides b where new_field is null and not exists (select 1 from moved m
   where (m.arm, m.bench, m.run_no, m.file_name, m.old_field) = (b.arm, b.bench, b.run_no, b.file_name, b.old_field))
 union all select arm, bench, run_no, file_name, 'added', '', new_field from both_sides b where old_field is null and not exists (select 1 from moved m
   where (m.arm, m.bench, m.run_no, m.file_name, m.new_field) = (b.arm, b.bench, b.run_no, b.file_name, b.new_field)))"""

ORACLES = {
    "p1_versions": _P1_VERSIONS,
    "p1_found": _P1_STEPS + " select file_name, change_kind, old_field, new_field from steps",
    "p5_found": _P5,
    "p5_summary": f"select field, kind, count(*) n from ({_P5}) group by 1, 2",
}
