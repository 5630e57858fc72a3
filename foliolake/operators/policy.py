"""Reconciling two extractions of the same page, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions.validate import VALIDATORS, canonical, validate


def canonical_of(kind: Column, value: Column) -> Column:
    out = None
    for name in VALIDATORS:
        c = canonical(name, value)
        out = F.when(kind == name, c) if out is None else out.when(kind == name, c)
    return out.otherwise(canonical("general", value))


def candidates(df: DataFrame) -> DataFrame:
    """Adds ok, reason and canon to (page_id, field, value, kind, source); null values become empty."""
    v = F.trim(F.coalesce("value", F.lit("")))
    checked = df.withColumn("value", v).withColumn("v", validate(F.col("kind"), F.col("value")))
    return checked.withColumn("ok", F.col("v.ok")).withColumn("reason", F.col("v.reason")).withColumn("canon", canonical_of(F.col("kind"), F.col("value"))).drop("v")


def reconcile(cands: DataFrame) -> DataFrame:
    """(page_id, field, value, verdict, source): one row per page, field and canonical value.

    verdict is invalid, conflict (both sources have readable values for the
    field but share none), agreed (another source has a common canonical form
    on the page) or single. Candidates meet through their canonical forms, an
    equi-join, so a page's candidates are never paired wholesale. Of equal
    values the worst verdict stays.
    """
    forms = cands.select("page_id", "field", "source", F.explode("canon").alias("form")).distinct()
    per_form = forms.groupBy("page_id", "form").agg(F.size(F.collect_set("source")).alias("n"))
    shared = per_form.where("n > 1").groupBy("page_id").agg(F.collect_set("form").alias("page_forms"))
    in_field = forms.groupBy("page_id", "field", "form").agg(F.size(F.collect_set("source")).alias("n"))
    per_field = (
        in_field.groupBy("page_id", "field").agg(F.max("n").alias("most"))
        .join(forms.groupBy("page_id", "field").agg(F.size(F.collect_set("source")).alias("sources")), ["page_id", "field"])
    )
    j = cands.join(shared, "page_id", "left").join(per_field, ["page_id", "field"], "left")
    agreed = F.coalesce(F.arrays_overlap("canon", "page_forms"), F.lit(False))
    conflict = F.coalesce((F.col("sources") > 1) & (F.col("most") == 1), F.lit(False))
    verdict = F.when(~F.col("ok"), "1-invalid").when(conflict, "2-conflict").when(agreed, "4-agreed").otherwise("3-single")
    key = F.coalesce(F.when(F.size("canon") > 0, F.array_join("canon", "|")), F.lower("value"))
    w = Window.partitionBy("page_id", "field", "key").orderBy("verdict", "value", "source")
    out = j.withColumn("verdict", verdict).withColumn("key", key).withColumn("r", F.row_number().over(w)).where("r = 1")
    source = F.when(F.col("verdict") == "4-agreed", "both").otherwise(F.col("source"))
    return out.select("page_id", "field", "value", F.substring("verdict", 3, 20).alias("verdict"), source.alias("source"))
