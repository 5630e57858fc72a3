"""Text, scoring and comparison queries over the record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.functions import metrics, text
from foliolake.operators import evaluation as ev
from foliolake.operators.current import newest
from foliolake.tables import table


def _current(spark: SparkSession, sf_dir: str, name: str = "pipeline_raw_engine") -> DataFrame:
    df = table(spark, sf_dir, name)
    return newest(df, [F.col("doc"), F.lower(F.trim("profile"))], [F.col("loaded_at").desc_nulls_last(), F.col("record_id").desc()])


def _scores(spark: SparkSession, sf_dir: str, name: str = "pipeline_raw_engine") -> DataFrame:
    return ev.record_scores(_current(spark, sf_dir, name))


_ROUND = 9


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, _ROUND) for n in names})


def record_scores(spark, sf_dir):
    cols = ["record_id", "doc", "profile", "failed", "n_expected", "n_recovered", "class_ok", "word_acc", "cer"]
    return _rounded(_scores(spark, sf_dir).select(*cols), "word_acc", "cer")


_RATES = ("field_recovery", "classification", "word_accuracy", "cer")


def by_profile(spark, sf_dir):
    return _rounded(ev.by_profile(_scores(spark, sf_dir)), *_RATES)


def by_profile_grouping_sets(spark, sf_dir):
    return _rounded(ev.grouping_set_rates(_scores(spark, sf_dir)), *_RATES)


def category_confusion(spark, sf_dir):
    return ev.confusion_counts(_current(spark, sf_dir), "expected_category", "category")


def category_report(spark, sf_dir):
    return _rounded(ev.class_report(category_confusion(spark, sf_dir)), "precision", "recall", "f1")


def category_macro_f1(spark, sf_dir):
    return _rounded(ev.macro_f1(ev.class_report(category_confusion(spark, sf_dir))), "accuracy", "macro_f1")


def cer_micro_macro(spark, sf_dir):
    """Plain ASCII on both sides: engines count other characters differently in edit distances."""
    r = _current(spark, sf_dir).where("expected_text is not null and ocr_text is not null")
    plain = r.select("profile", *[F.regexp_replace(c, r"[^\x00-\x7f]", "-").alias(c) for c in ("expected_text", "ocr_text")])
    d = metrics.with_distances(plain, "expected_text", "ocr_text")
    rate = lambda f, empty: F.avg(F.when(F.col(f"n_{f}") == 0, empty).otherwise(F.col(f"d_{f}") / F.col(f"n_{f}")))
    out = d.groupBy("profile").agg(
        (F.sum("d_label") / F.sum(F.greatest("n_label", F.lit(1)))).alias("micro"), rate("label", (F.col("m_label") > 0).cast("double")).alias("macro"),
        rate("bench", F.col("m_bench").cast("double")).alias("bench"), rate("receipt", F.lit(None)).alias("receipt"),
        F.avg(F.col("d_raw") / F.greatest("n_raw", F.lit(1))).alias("raw"),
    )
    return _rounded(out, "micro", "macro", "bench", "receipt", "raw")


def exact_rates(spark, sf_dir):
    r = _current(spark, sf_dir).where("expected_text is not null and ocr_text is not null")
    a, b = F.col("expected_text"), F.col("ocr_text")
    n = F.count("*")
    out = r.groupBy("profile").agg(
        n.alias("n"), F.sum(metrics.exact_label(a, b).cast("long")).alias("exact_label"), F.sum(metrics.exact_strict(a, b).cast("long")).alias("exact_strict"),
        F.avg(metrics.set_word_accuracy(a, b)).alias("set_word_accuracy"),
    )
    return _rounded(out, "set_word_accuracy")


def wilson_by_profile(spark, sf_dir):
    per = _scores(spark, sf_dir).groupBy("profile").agg(F.sum("class_ok").alias("k"), F.count("*").alias("n"))
    out = per.withColumn("ci", metrics.wilson(F.col("k"), F.col("n"))).select("profile", "k", "n", F.col("ci.low").alias("low"), F.col("ci.high").alias("high"))
    return _rounded(out, "low", "high")


def _items(spark, sf_dir, name):
    s = _scores(spark, sf_dir, name).withColumn("profile", F.lower(F.trim("profile")))
    return ev.item_outcomes(ev.occurrence_ids(s, ["profile", "doc"], ["record_id"]))


def compare_runs(spark, sf_dir):
    out = ev.compare_runs(_items(spark, sf_dir, "pipeline_raw_engine_off"), _items(spark, sf_dir, "pipeline_raw_engine"))
    cols = ["metric", "n_old", "n_new", "k_old", "k_new", "same_items", "lost", "won", "method", "verdict"]
    return out.select(*cols, F.round("old_rate", _ROUND).alias("old_rate"), F.round("new_rate", _ROUND).alias("new_rate"))


def paired_discordance(spark, sf_dir):
    """Both copies on the readings they share, so the paired test is licensed."""
    key = ["doc", "p"]
    side = lambda n, tag: _scores(spark, sf_dir, n).select("doc", F.lower(F.trim("profile")).alias("p"), (F.col("class_ok") == 1).alias(tag))
    pairs = side("pipeline_raw_engine_off", "a").join(side("pipeline_raw_engine", "b"), key)
    cells = ev.discordance(pairs, "a", "b", ["p"])
    return cells.withColumn("p_value", F.round(metrics.mcnemar_exact("only_a", "only_b"), _ROUND)).withColumnRenamed("p", "profile")


def arm_profile_means(spark, sf_dir):
    arms = [_scores(spark, sf_dir, n).select(F.lit(n).alias("arm"), F.lower(F.trim("profile")).alias("profile"), "word_acc") for n in ("pipeline_raw_engine", "pipeline_raw_engine_off")]
    return ev.arm_means(arms[0].unionByName(arms[1]), ["arm", "profile"], "word_acc")


def arm_headlines(spark, sf_dir):
    return ev.mean_of_means(arm_profile_means(spark, sf_dir), ["arm"])


def second_reader_agreement(spark, sf_dir):
    side = lambda n: _current(spark, sf_dir, n).select("doc", F.lower(F.trim("profile")).alias("profile"), F.coalesce("category", F.lit("")).alias("category"))
    out = ev.second_reader(side("pipeline_raw_engine"), side("pipeline_raw_engine_off"), ["doc", "profile"], "category")
    return out.groupBy("kind").agg(F.count("*").alias("n"))


def char_confusions(spark, sf_dir):
    r = _current(spark, sf_dir).where("expected_text is not null and ocr_text is not null")
    return ev.char_confusions(r, "expected_text", "ocr_text")


def error_kinds(spark, sf_dir):
    r = _current(spark, sf_dir).where("expected_text is not null and ocr_text is not null")
    kind = text.error_kind(F.col("ocr_text"), F.col("expected_text"))
    short = F.when(kind.rlike("^[0-9]+-char"), F.regexp_extract(kind, "^([0-9]+-char)", 1)).otherwise(kind)
    return r.groupBy(short.alias("kind")).agg(F.count("*").alias("n"))


def ms_summary(spark, sf_dir):
    r = table(spark, sf_dir, "pipeline_raw_engine").withColumn("ms", F.col("ms").cast("double"))
    return _rounded(ev.seed_summary(r, "profile", "ms"), "mean", "sd", "least", "most")


def norm_labels(spark, sf_dir):
    c = table(spark, sf_dir, "crops")
    l = F.col("labels")
    return c.select("crop_id", "loaded_at", text.norm(l).alias("norm"), text.norm_label(l).alias("label"), text.comparison_form(l).alias("upper"), text.lexicon_key(l).alias("key"), text.clean_to_charset(l).alias("charset"))


def density_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    t = F.col("text")
    return d.groupBy(text.density_class(t).alias("scorer"), text.density_class(t, "reader").alias("reader")).agg(F.count("*").alias("n"))


def hit_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    h = text.hit_class(F.col("text"))
    return d.select("doc_id", h["category"].alias("category"), F.round(h["confidence"], 6).alias("confidence"), h["hits"].alias("hits"))


def structure_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", text.structure_score(F.col("text")).alias("score"), text.is_garbage(F.col("text")).alias("garbage"))


def repaired_units(spark, sf_dir):
    r = table(spark, sf_dir, "pipeline_raw_pre_wordlm").where("ocr_text is not null")
    fixed = text.repair_units(F.col("ocr_text"))
    return r.select("record_id", "loaded_at", F.md5(fixed).alias("digest"), (fixed != F.col("ocr_text")).alias("changed"))


def retained_fields(spark, sf_dir):
    r = table(spark, sf_dir, "pipeline_raw_engine").where("ocr_text is not null")
    rows = r.select("record_id", "loaded_at", "ocr_text", F.explode("fields").alias("value"))
    return rows.groupBy("record_id").agg(F.count("*").alias("n"), F.sum(text.retained(F.col("value"), F.col("ocr_text")).cast("long")).alias("kept"))


def masked_codes(spark, sf_dir):
    r = table(spark, sf_dir, "pipeline_raw_engine").select(F.explode("expected_fields").alias("value")).distinct()
    d = F.regexp_replace("value", r"\D", "")
    return r.select("value", text.mask_digits(F.col("value")).alias("masked"), text.is_degenerate(d).alias("degenerate"), text.is_substantial(F.col("value")).alias("substantial"))


QUERIES = {
    f.__name__: f
    for f in (
        record_scores, by_profile, by_profile_grouping_sets, category_confusion, category_report, category_macro_f1, cer_micro_macro,
        exact_rates, wilson_by_profile, compare_runs, paired_discordance, arm_profile_means, arm_headlines, second_reader_agreement,
        char_confusions, error_kinds, ms_summary, norm_labels, density_classes, hit_classes, structure_scores, repaired_units,
        retained_fields, masked_codes,
    )
}

# --- SQL equivalents -----------------------------------------------------------

_CUR = """(select * exclude (r) from (select *, row_number() over (partition by doc, lower(trim(profile)) order by loaded_at desc nulls last, record_id desc) r from {0}) where r = 1)"""
_N = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_L = "regexp_replace(upper(translate({0}, 'OoQDlI|!SsBZzGbT', '0000111155822667')), '[^A-Z0-9./:$,-]+', '', 'g')"
_U = r"trim(regexp_replace(upper({0}), '\s+', ' ', 'g'))"
_W = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"


def _n(x):
    return _N.format(x)


_SCORES = f"""
select record_id, doc, profile, expected_category, category, coalesce(error, '') <> '' as failed,
  coalesce(len(expected_fields), 0) n_expected,
  case when coalesce(error, '') <> '' then 0 else len(list_filter(coalesce(expected_fields, []), lambda e:
    len(list_filter(coalesce(fields, []), lambda g: length({_n('e')}) > 0 and length({_n('g')}) > 0 and ({_n('e')} = {_n('g')} or (length({_n('g')}) >= 4 and suffix({_n('e')}, {_n('g')}))))) > 0)) end n_recovered,
  case when coalesce(error, '') = '' and coalesce(category = expected_category, false) then 1 else 0 end class_ok,
  case when coalesce(error, '') <> '' or len(g) = 0 then 0.0 else len(list_filter(g, lambda w: list_contains(h, w))) / len(g) end word_acc,
  case when coalesce(error, '') <> '' then 0.0 when length(a) = 0 then length(b) else levenshtein(a, b) / length(a) end cer
from (select *, {_n("coalesce(expected_text, '')")} a, {_n("coalesce(ocr_text, '')")} b,
  list_transform({_W.format("coalesce(expected_text, '')")}, lambda w: {_n('w')}) g, list_transform({_W.format("coalesce(ocr_text, '')")}, lambda w: {_n('w')}) h
  from {_CUR})"""


def _scored(name: str = "pipeline_raw_engine") -> str:
    return _SCORES.format(name)


_RATE = """count(*) n, sum(failed::int)::bigint errors, round(coalesce(sum(n_recovered) / nullif(sum(n_expected), 0), 0), 9) field_recovery,
 round(avg(class_ok), 9) classification, round(avg(word_acc), 9) word_accuracy, round(avg(cer), 9) cer"""
_TEXTS = f"(select * from {_CUR.format('pipeline_raw_engine')} where expected_text is not null and ocr_text is not null)"
_CONF = f"select expected_category truth, coalesce(category, '(none)') guess, count(*) n from {_CUR.format('pipeline_raw_engine')} where expected_category is not null group by 1, 2"
_CLASS = f"""
with c as ({_CONF}), l as (select truth as label, sum(n) support, sum(case when truth = guess then n else 0 end) hits from c group by 1),
k as (select guess as label, sum(n) claimed from c group by 1),
r as (select label, support, coalesce(hits / nullif(claimed, 0), 0) p, hits / support rec from l left join k using (label))
select label, support::bigint support, p as precision, rec as recall, coalesce(2 * p * rec / nullif(p + rec, 0), 0) f1 from r"""
_WILSON = """greatest(0, (k/n + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n)), least(1, (k/n + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n))"""
_ITEMS = """select 'classification' metric, lower(trim(profile)) || '|' || doc || '#0' item, class_ok = 1 ok from s_{0}
 union all select 'field_recovery', lower(trim(profile)) || '|' || doc || '#0#f' || (j - 1), coalesce(not failed and r, false) from f_{0}"""
_ARMS = " union all ".join(f"select '{n}' arm, lower(trim(profile)) profile, word_acc from ({_scored(n)})" for n in ("pipeline_raw_engine", "pipeline_raw_engine_off"))
_ARM_MEANS = f"select arm, profile, round_even(avg(word_acc), 4) mean, count(word_acc) n from ({_ARMS}) group by 1, 2"


def _density(order: tuple[str, ...]) -> str:
    count = {n: " + ".join(f"(length(t) - length(replace(t, '{k}', ''))) // {len(k)}" for k in ks) for n, ks in text.DENSITY_KEYWORDS.items()}
    top = "greatest(" + ", ".join(count.values()) + ")"
    return f"case when {top} = 0 then 'general' " + " ".join(f"when {count[n]} = {top} then '{n}'" for n in order) + " end"


def _hits() -> str:
    parts = {n: " + ".join(f"contains(t, '{k}')::int" for k in ks) for n, ks in text.HIT_KEYWORDS.items()}
    return ", ".join(f"{v} as h_{n}" for n, v in parts.items())


ORACLES = {
    "record_scores": f"select record_id, doc, profile, failed, n_expected, n_recovered, class_ok, round(word_acc, 9) word_acc, round(cer, 9) cer from ({_scored()})",
    "by_profile": f"""with s as ({_scored()})
select 'all' as scope, null as profile, {_RATE} from s union all select 'profile', profile, {_RATE} from s group by profile
union all select case when profile = 'worst_case' then 'sub_human' else 'headline' end, null, {_RATE} from s group by 1""",
    "by_profile_grouping_sets": f"with s as ({_scored()}) select profile, grouping(profile)::int is_total, {_RATE} from s group by grouping sets ((profile), ())",
    "category_confusion": _CONF,
    "category_report": f"select label, support, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) f1 from ({_CLASS})",
    "category_macro_f1": f"select round(sum(recall * support) / sum(support), 9) accuracy, round(avg(f1), 9) macro_f1 from ({_CLASS})",
    "cer_micro_macro": f"""select profile, round(sum(levenshtein(la, lb)) / sum(greatest(length(la), 1)), 9) micro,
 round(avg(case when length(la) = 0 then (length(lb) > 0)::int else levenshtein(la, lb) / length(la) end), 9) macro,
 round(avg(case when length(na) = 0 then length(nb) else levenshtein(na, nb) / length(na) end), 9) bench,
 round(avg(levenshtein(ua, ub) / nullif(length(ua), 0)), 9) receipt, round(avg(levenshtein(a, b) / greatest(length(a), 1)), 9) raw
from (select profile, {_L.format('expected_text')} la, {_L.format('ocr_text')} lb, {_n('expected_text')} na, {_n('ocr_text')} nb,
 {_U.format('expected_text')} ua, {_U.format('ocr_text')} ub, expected_text a, ocr_text b from (select profile, regexp_replace(expected_text, '[^\\x00-\\x7f]', '-', 'g') expected_text, regexp_replace(ocr_text, '[^\\x00-\\x7f]', '-', 'g') ocr_text from {_TEXTS})) group by profile""",
    "exact_rates": f"""select profile, count(*) n, sum(({_L.format('expected_text')} = {_L.format('ocr_text')})::int)::bigint exact_label,
 sum((upper(trim(expected_text)) = upper(trim(ocr_text)))::int)::bigint exact_strict,
 round(avg(case when len(g) = 0 then 1 else len(list_filter(g, lambda w: list_contains(h, w))) / len(g) end), 9) set_word_accuracy
from (select *, list_distinct({_W.format('expected_text')}) g, {_W.format('ocr_text')} h from {_TEXTS}) group by profile""",
    "wilson_by_profile": f"""with t as (select profile, sum(class_ok)::bigint k, count(*) n from ({_scored()}) group by 1), w as (select *, {metrics.Z} z from t),
 c as (select profile, k, n, unnest([struct_pack(l := {_WILSON.split(', least')[0]}, h := least{_WILSON.split(', least')[1]})], recursive := true) from w)
select profile, k, n, round(l, 9) low, round(h, 9) high from c""",
    "compare_runs": f"""with s_o as ({_scored('pipeline_raw_engine_off')}), s_n as ({_scored()}),
 """ + ", ".join(
        f"""f_{t} as (select s.profile, s.doc, s.failed, unnest(range(1, len(c.expected_fields) + 1)) j, unnest(list_transform(c.expected_fields, lambda e: len(list_filter(coalesce(c.fields, []), lambda g:
 length({_n('e')}) > 0 and length({_n('g')}) > 0 and ({_n('e')} = {_n('g')} or (length({_n('g')}) >= 4 and suffix({_n('e')}, {_n('g')}))))) > 0)) r
 from s_{t} s join {_CUR.format(n)} c using (record_id))"""
        for t, n in (("o", "pipeline_raw_engine_off"), ("n", "pipeline_raw_engine"))
    ) + f""", i_o as ({_ITEMS.format('o')}), i_n as ({_ITEMS.format('n')}),
j as (select coalesce(a.metric, b.metric) metric, a.ok o, b.ok w, a.item is not null io, b.item is not null iw from i_o a full join i_n b on a.metric = b.metric and a.item = b.item),
m as (select metric, sum(io::int)::bigint n_old, sum(iw::int)::bigint n_new, sum(coalesce(o, false)::int)::bigint k_old, sum(coalesce(w, false)::int)::bigint k_new,
 bool_and(io and iw) same_items, sum(coalesce(o and not w, false)::int)::bigint lost, sum(coalesce(not o and w, false)::int)::bigint won from j group by 1),
ci as (select *, {metrics.Z} z from m),
b as (select *, (select greatest(0, (k/n + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n)) from (select k_old k, n_old n)) lo,
 (select least(1, (k/n + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n)) from (select k_old k, n_old n)) ho,
 (select greatest(0, (k/n + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n)) from (select k_new k, n_new n)) ln,
 (select least(1, (k/n + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n)) from (select k_new k, n_new n)) hn from ci)
select metric, n_old, n_new, k_old, k_new, same_items, lost, won, 'wilson' as method,
 case when (lo > hn or ln > ho) then case when k_new/n_new > k_old/n_old then 'IMPROVED' else 'REGRESSED' end else 'INCONCLUSIVE' end verdict,
 round(k_old/n_old, 9) old_rate, round(k_new/n_new, 9) new_rate from b""",
    "paired_discordance": f"""with a as (select doc, lower(trim(profile)) p, class_ok = 1 x from ({_scored('pipeline_raw_engine_off')})), b as (select doc, lower(trim(profile)) p, class_ok = 1 y from ({_scored()})),
c as (select p as profile, sum((x and y)::int)::bigint "both", sum((x and not y)::int)::bigint only_a, sum((not x and y)::int)::bigint only_b, sum((not x and not y)::int)::bigint neither from a join b using (doc, p) group by 1)
select *, round(case when only_a + only_b = 0 then 1 else least(1, 2 * (select sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) from (select unnest(range(0, least(only_a, only_b) + 1)) i))) end, 9) p_value from c""",
    "arm_profile_means": _ARM_MEANS,
    "arm_headlines": f"select arm, round_even(avg(mean), 4) headline, count(*) n_profiles from ({_ARM_MEANS}) where profile is distinct from 'worst_case' group by 1",
    "second_reader_agreement": f"""with a as (select doc, lower(trim(profile)) p, coalesce(category, '') c from {_CUR.format('pipeline_raw_engine')}), b as (select doc, lower(trim(profile)) p, coalesce(category, '') c from {_CUR.format('pipeline_raw_engine_off')})
select case when b.c is null then 'only_first' when a.c is null then 'only_second' when {_n('a.c')} = {_n('b.c')} then 'agree' else 'differ' end kind, count(*) n from a full join b on a.doc = b.doc and a.p = b.p group by 1""",
    "char_confusions": f"""select ch, count(*) n from (select unnest(list_distinct(string_split({_L.format('expected_text')}, ''))) ch from {_TEXTS} where {_L.format('expected_text')} <> {_L.format('ocr_text')}) where ch <> '' group by 1""",
    "error_kinds": f"""select case when length(w) = 0 then 'empty-label' when length(g) = 0 then 'read-nothing' when length(g) <> length(w) then 'length-differ' when d = 0 then 'whitespace-only' else d || '-char' end kind, count(*) n
from (select w, g, hamming(case when length(g) = length(w) then g else w end, w) d from (select {_L.format('expected_text')} w, {_L.format('ocr_text')} g from {_TEXTS})) group by 1""",
    "ms_summary": "select profile, round(avg(ms), 9) mean, round(stddev_pop(ms), 9) sd, min(ms)::double least, max(ms)::double most from pipeline_raw_engine group by 1",
    "norm_labels": f"""select crop_id, loaded_at, {_n('labels')} norm, {_L.format('labels')} as label, {_U.format('labels')} as upper,
 trim(regexp_replace(regexp_replace(upper(labels), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) as key, trim(regexp_replace(regexp_replace(upper(labels), '[^0-9A-Z ]', '', 'g'), ' +', ' ', 'g')) charset from crops""",
    "density_classes": f"select {_density(text.DENSITY_ORDERS['scorer'])} scorer, {_density(text.DENSITY_ORDERS['reader'])} reader, count(*) n from (select lower(text) t from documents where text is not null) group by 1, 2",
    "hit_classes": f"""with h as (select doc_id, {_hits()} from (select doc_id, lower(text) t from documents where text is not null)),
c as (select *, least(0.95, h_banking * 0.09 + 0.05) cb, least(0.95, h_medical * 0.09 + 0.05) cm, least(0.95, h_legal * 0.09 + 0.05) cl from h),
p as (select *, case when cm > greatest(0.1, cb) and cm >= cl then 'medical' when cl > greatest(0.1, cb, cm) then 'legal' when cb > 0.1 then 'banking' else 'general' end category from c)
select doc_id, category, round(case category when 'medical' then cm when 'legal' then cl when 'banking' then cb else 0.1 end::double, 6) confidence, case category when 'medical' then h_medical when 'legal' then h_legal when 'banking' then h_banking else 0 end hits from p""",
    "structure_scores": r"""select doc_id, len(regexp_extract_all(text, '(?i)\d+(?:\.\d+)?\s*mg\b')) + len(regexp_extract_all(text, '\b\d{2}-\d{2}-\d{2}\b'))
 + 2 * len(regexp_extract_all(text, '\b\d{4}-[A-Z]{2}-\d{3,8}\b')) + len(list_filter(regexp_extract_all(text, '[\d-]+'), lambda x: regexp_full_match(x, '\d{6,8}')))
 + len(regexp_extract_all(text, '(?:[£$€]|[A-Z]{3})\s?\d[\d,]*(?:\.\d{2})?')) score,
 length(trim(text)) < 10 or len(w) > 500 or len(w) = 0 or len(list_filter(w, lambda x: length(x) <= 2)) / greatest(len(w), 1) > 0.6 garbage
from (select *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') w from documents where text is not null)""",
    "retained_fields": r"""select record_id, count(*) n, sum(contains(regexp_replace(upper(ocr_text), '\s', '', 'g'), regexp_replace(upper(v), '\s', '', 'g'))::int)::bigint kept
from (select record_id, ocr_text, unnest(fields) v from pipeline_raw_engine where ocr_text is not null) group by 1""",
}
