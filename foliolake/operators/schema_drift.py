"""Reading JSON record files whose top-level fields drift from file to file.

Files of one chain (an arm's benchmark) follow each other by run number. Each
file has a schema version, a fingerprint of its field names and value types.
Between neighbouring versions lie migration steps (added, removed, renamed,
retyped); walking the rename steps back gives every field of every file its
canonical name, after which default and cast rules make one typed table.

All of it is relational: a file is one small row; only neighbours whose
fingerprints differ are compared; values of lost and new fields meet within one
record (file, doc, profile), so records are never paired wholesale; chains of
renames are resolved by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.session import cut

CHAIN = ["arm", "bench"]
FILE = ["arm", "bench", "run_no", "file_name"]

#: Share of a value's tokens that must recur for two fields to hold the same kind of content.
RENAME_SIMILARITY = 0.5
#: Two numbers count as alike when they fall into the same or neighbouring bucket of this ratio.
NUMBER_RATIO = 1.05

#: The consistent table: field -> cast rule.
TARGET = {
    "doc": "text", "profile": "text", "expected_category": "text", "expected_fields": "list",
    "expected_text": "text", "category": "name", "fields": "list", "ocr_text": "text",
    "ocr_confidence": "number", "error": "text", "ms": "millis",
}


def kind_of_variant(value: Column) -> Column:
    """string, whole, decimal, boolean, list, object, or null for a JSON null."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema == "VOID", F.lit(None).cast("string"))
        .when(schema == "STRING", "string")
        .when(schema == "BIGINT", "whole")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "decimal")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "list")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("string")
    )


def explode_records(files: DataFrame) -> DataFrame:
    """One row per top-level field of each readable body.

    Blank, cut or non-object bodies give no rows. Lines delivered twice stay
    twice, which changes neither schemas nor evidence. Columns: file keys,
    further columns of ``files``, doc, profile, field, kind (null for a null
    value), value (JSON text).
    """
    rest = [c for c in files.columns if c not in (*FILE, "body")]
    parsed = files.withColumn("v", F.try_parse_json("body")).where(F.schema_of_variant("v").startswith("OBJECT"))
    parts = parsed.lateralJoin(files.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return parts.select(
        *FILE,
        *rest,
        F.try_variant_get("v", "$.doc", "string").alias("doc"),
        F.try_variant_get("v", "$.profile", "string").alias("profile"),
        F.col("key").alias("field"),
        kind_of_variant(F.col("value")).alias("kind"),
        F.to_json("value").alias("value"),
    )


def file_schemas(files: DataFrame) -> DataFrame:
    """(file keys, fields, version, n_fields): one row per file, of one pass over its bodies.

    ``fields`` are sorted (field, kinds) structs; kinds are the sorted kinds of
    the field's non-null values, where whole and decimal numbers in one file are
    decimal. ``version`` is the fingerprint of the fields. A file without
    readable bodies has no fields; rows without a file name, arm, bench or run
    number belong to no file.
    """
    named = files.select(*FILE, "body").dropna(subset=FILE)
    seen = explode_records(named).select(*FILE, F.struct("field", "kind").alias("s"))
    none = F.lit(None).cast("struct<field:string,kind:string>").alias("s")
    sets = seen.unionByName(named.select(*FILE, none)).groupBy(*FILE).agg(F.collect_set("s").alias("s"))

    def kinds(f: Column) -> Column:
        found = F.array_sort(F.transform(F.filter("s", lambda x: (x["field"] == f) & x["kind"].isNotNull()), lambda x: x["kind"]))
        mixed = F.array_contains(found, "whole") & F.array_contains(found, "decimal")
        return F.when(mixed, F.array_remove(found, "whole")).otherwise(found)

    names = F.array_sort(F.array_distinct(F.transform("s", lambda x: x["field"])))
    fields = sets.select(*FILE, F.transform(names, lambda f: F.struct(f.alias("field"), kinds(f).alias("kinds"))).alias("fields"))
    text = F.array_join(F.transform("fields", lambda x: F.concat(x["field"], F.lit(":"), F.array_join(x["kinds"], ","))), ";")
    return fields.withColumn("version", F.md5(text)).withColumn("n_fields", F.size("fields").cast("long"))


def file_pairs(schemas: DataFrame) -> DataFrame:
    """``schemas`` with ``prior``: run_no, file_name, version and fields of the file
    of the next lower run number of the chain, null for the first.

    Should two files share that run number, the later name counts.
    """
    before = Window.partitionBy(*CHAIN).orderBy("run_no").rangeBetween(Window.unboundedPreceding, -1)
    return schemas.withColumn("prior", F.max(F.struct("run_no", "file_name", "version", "fields")).over(before))


def content_tokens(value: Column) -> Column:
    """Distinct tokens of a JSON value; a number (also one written as text, with
    unit ms or s) becomes one bucket token, a boolean one that only booleans have."""
    plain = F.lower(F.regexp_replace(value, r'^"|"$', ""))
    number = r"^\s*-?[0-9][0-9,]*(\.[0-9]+)?\s*(ms|s)?\s*$"
    unit = F.when(plain.rlike(r"[0-9]\s*s\s*$"), F.lit(1000.0)).otherwise(F.lit(1.0))
    amount = F.expr("0.0D") + F.regexp_replace(plain, r"[^0-9.\-]", "").try_cast("double") * unit
    bucket = F.floor(F.log(F.greatest(F.abs(amount), F.lit(1e-9))) / F.log(F.lit(NUMBER_RATIO)))
    words = F.array_distinct(F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    flag = F.when(value.isin("true", "false"), F.array(F.concat(F.lit("?"), value)))
    return flag.when(plain.rlike(number) & amount.isNotNull(), F.array(F.concat(F.lit("#"), bucket.cast("string")))).otherwise(words)


def _spread(tokens: Column) -> Column:
    """A number's bucket with its two neighbours; words stay."""
    return F.flatten(
        F.transform(
            tokens,
            lambda t: F.when(
                t.startswith("#"),
                F.transform(
                    F.array(F.lit(-1), F.lit(0), F.lit(1)),
                    lambda d: F.concat(F.lit("#"), (F.substring(t, 2, 20).try_cast("bigint") + d).cast("string")),
                ),
            ).otherwise(F.array(t)),
        )
    )


STEP = "array<struct<change_kind:string,old_field:string,new_field:string>>"


def plain_steps(pairs: DataFrame) -> DataFrame:
    """``pairs`` whose fingerprint differs from their predecessor's, with the
    arrays ``gone``, ``came`` and ``retyped`` of field names. Files of an
    unchanged version have no steps and are not looked at again.
    """
    moved = pairs.where(F.col("prior").isNotNull() & (F.col("prior.version") != F.col("version")))
    old, new = F.transform("prior.fields", lambda x: x["field"]), F.transform("fields", lambda x: x["field"])
    other = lambda x: F.exists(
        F.col("prior.fields"), lambda y: (y["field"] == x["field"]) & (F.size(y["kinds"]) > 0) & (F.size(x["kinds"]) > 0) & (y["kinds"] != x["kinds"])
    )
    return moved.select(
        *FILE, "version", F.col("prior.run_no").alias("prev_run"), F.col("prior.file_name").alias("prev_file"), F.col("prior.version").alias("prev_version"),
        F.array_except(old, new).alias("gone"), F.array_except(new, old).alias("came"),
        F.transform(F.filter("fields", other), lambda x: x["field"]).alias("retyped"),
    )


def renames(files: DataFrame, steps: DataFrame) -> DataFrame:
    """(file keys, moved): the (old_field, new_field) pairs of fields that went and came back under another name.

    Only files that both lost and gained fields, and their predecessors, are
    read, and only these fields' values. Values are compared within the
    record of one doc and profile; the mean share of common tokens over all records
    that have both decides, and each name is used once (best mutual match, names
    breaking ties). Fields that are null throughout give no evidence and are
    never renamed.
    """
    target = [*CHAIN, "t_run", "t_file"]
    both = steps.where("size(gone) > 0 and size(came) > 0").select(*CHAIN, F.col("run_no").alias("t_run"), F.col("file_name").alias("t_file"), "prev_run", "prev_file", "gone", "came")
    role = lambda name, run, file, fields: F.struct(F.lit(name).alias("role"), F.col(run).alias("run_no"), F.col(file).alias("file_name"), F.col(fields).alias("asked"))
    roles = F.explode(F.array(role("old", "prev_run", "prev_file", "gone"), role("new", "t_run", "t_file", "came")))
    asked = cut(both.select(*target, roles.alias("r")).select(*target, "r.*"))
    live = explode_records(files.select(*FILE, "body").hint("merge").join(asked, FILE)).where(
        "array_contains(asked, field) and kind is not null and doc is not null and profile is not null"
    )
    here = [*target, "doc", "profile"]
    tokens = live.select(*here, "role", "field", content_tokens(F.col("value")).alias("tokens")).where(F.size("tokens") > 0)
    once = tokens.groupBy(*here, "role", "field").agg(F.max("tokens").alias("tokens"))
    side = lambda name: F.collect_list(F.when(F.col("role") == name, F.struct("field", "tokens")))
    records = once.groupBy(*here).agg(side("old").alias("old"), side("new").alias("new"))

    def met(o: Column, n: Column) -> Column:
        return F.struct(
            o["field"].alias("old_field"), n["field"].alias("new_field"), F.size(F.array_intersect(_spread(o["tokens"]), n["tokens"])).alias("n"),
            F.size(o["tokens"]).alias("n_old"), F.size(n["tokens"]).alias("n_new"),
        )

    pairs = records.select(*target, F.explode(F.flatten(F.transform("old", lambda o: F.transform("new", lambda n: met(o, n))))).alias("m")).select(*target, "m.*")
    scored = (
        pairs.groupBy(*target, "old_field", "new_field")
        .agg(
            F.avg(F.col("n") / F.least("n_old", "n_new")).alias("part"),
            F.avg(F.col("n") / (F.col("n_old") + F.col("n_new") - F.col("n"))).alias("whole"),
        )
        .where(F.col("part") >= RENAME_SIMILARITY)
    )
    rank = [F.col("whole").desc(), F.col("old_field"), F.col("new_field")]
    best_old = F.row_number().over(Window.partitionBy(*target, "old_field").orderBy(*rank))
    best_new = F.row_number().over(Window.partitionBy(*target, "new_field").orderBy(*rank))
    best = scored.withColumn("a", best_old).withColumn("b", best_new).where("a = 1 and b = 1")
    return best.groupBy(*CHAIN, F.col("t_run").alias("run_no"), F.col("t_file").alias("file_name")).agg(F.collect_list(F.struct("old_field", "new_field")).alias("moved"))


def migrations(files: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Every step from a file's predecessor to the file.

    Columns: file keys, prev_file, prev_version, version, change_kind (added,
    removed, renamed, retyped), old_field, new_field. A field without non-null
    values on either side is not retyped.
    """
    schemas = cut(file_schemas(files)) if schemas is None else schemas
    steps = cut(plain_steps(file_pairs(schemas)))
    with_moves = steps.hint("merge").join(renames(files, steps), FILE, "left")
    moved = F.coalesce("moved", F.array().cast("array<struct<old_field:string,new_field:string>>"))
    left = lambda col, side: F.array_except(col, F.transform(moved, lambda m: m[side]))
    step = lambda kind, old, new: F.struct(F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))
    every = F.concat(
        F.transform(left("gone", "old_field"), lambda f: step("removed", f, F.lit(""))),
        F.transform(left("came", "new_field"), lambda f: step("added", F.lit(""), f)),
        F.transform("retyped", lambda f: step("retyped", f, f)),
        F.transform(moved, lambda m: step("renamed", m["old_field"], m["new_field"])),
    )
    return with_moves.select(*FILE, "prev_file", "prev_version", "version", F.inline(every.cast(STEP)))


def changes(files: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Every schema change of a file against its predecessor: file keys, change_kind, old_field, new_field."""
    return migrations(files, schemas).select(*FILE, "change_kind", "old_field", "new_field")


def migration_registry(files: DataFrame) -> DataFrame:
    """(arm, bench, prev_version, version, change_kind, old_field, new_field, n_files): the steps
    between each two versions of a chain, and how many files took them."""
    key = [*CHAIN, "prev_version", "version", "change_kind", "old_field", "new_field"]
    return migrations(files).groupBy(*key).agg(F.count("*").alias("n_files"))


def canonical_names(fields: DataFrame, steps: DataFrame) -> DataFrame:
    """(file keys, field, canonical) of every row (file keys, field) of ``fields``: the name a field had before all its renames.

    Origins of a name in a chain are the files where it was added or renamed
    into place; the newest origin at or before a file counts. Rename origins
    point to the origin of their old name and are resolved by doubling, so a
    chain of n renames takes log2(n) joins.
    """
    chain = [*CHAIN, "field"]
    origin = steps.where("change_kind in ('added', 'renamed')").select(
        *CHAIN, F.col("new_field").alias("field"), "run_no", "file_name",
        F.when(F.col("change_kind") == "renamed", F.col("old_field")).alias("old_field"),
    )
    origin = origin.withColumn("oid", F.md5(F.concat_ws("\x1f", *CHAIN, "file_name", "field")))
    key = F.struct("run_no", "oid")
    marks = origin.select(*chain, "run_no", "oid", F.lit(None).cast("string").alias("ask"), F.lit(None).cast("string").alias("file_name"))

    def latest(asks: DataFrame, strict: bool) -> DataFrame:
        """``ask`` with the oid of the newest origin of its field (before its run if strict)."""
        w = Window.partitionBy(*chain).orderBy("run_no").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
        seen = F.max(F.when(F.col("ask").isNull(), key)).over(w)
        return marks.unionByName(asks, allowMissingColumns=True).withColumn("p", seen).where("ask is not null").withColumn("parent", F.col("p.oid"))

    asks = origin.where("old_field is not null").select(*CHAIN, F.col("old_field").alias("field"), "run_no", F.col("oid").alias("ask"))
    parents = latest(asks, strict=True).select(F.col("ask").alias("oid"), F.col("parent"))
    nodes = origin.join(parents, "oid", "left").select("oid", F.coalesce("old_field", "field").alias("name"), "parent")
    nodes = cut(nodes)
    while nodes.where("parent is not null").limit(1).count():
        up = nodes.select(F.col("oid").alias("parent"), F.col("name").alias("up_name"), F.col("parent").alias("up_parent"))
        nodes = cut(nodes.join(up, "parent", "left").select(
            "oid", F.coalesce("up_name", "name").alias("name"), F.col("up_parent").alias("parent")))
    asks = fields.select(*CHAIN, "field", "run_no", "file_name", F.lit("x").alias("ask"))
    resolved = latest(asks, strict=False).select(*FILE, "field", F.col("parent").alias("oid"))
    return resolved.join(nodes.select("oid", "name"), "oid", "left").select(
        *FILE, "field", F.coalesce("name", "field").alias("canonical")
    )


def text_of(value: Column) -> Column:
    """A JSON string as its content, other JSON as written, null as null."""
    return F.when(value.startswith('"'), F.try_variant_get(F.try_parse_json(value), "$", "string")).when(value != "null", value)


def list_of(value: Column) -> Column:
    """A list from a JSON list, a text holding one, an object, or parts split at ; | or line feed.

    An object gives the list it holds under its only key, else its values in the order written.
    """
    text = text_of(value)
    parts = F.filter(F.transform(F.split(text, r"[;|\n]"), lambda s: F.trim(s)), lambda s: s != "")
    parsed = F.from_json(text, "array<string>")
    values = F.map_values(F.from_json(text, "map<string,string>"))
    held = F.when((F.size(values) == 1) & values[0].startswith("["), F.from_json(values[0], "array<string>")).otherwise(values)
    return F.when(text.startswith("["), parsed).when(text.startswith("{"), held).otherwise(parts)


def millis_of(text: Column) -> Column:
    """Milliseconds from 8354, '8,354', '4791 ms' or '9.429 s'; otherwise null."""
    t = F.lower(F.trim(text))
    number = F.regexp_replace(F.regexp_extract(t, r"^([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:ms|s)?$", 1), ",", "").try_cast("double")
    return F.round(F.when(t.rlike(r"[0-9]\s*s$"), number * 1000).otherwise(number)).cast("int")


def cast_rule(rule: str, value: Column) -> Column:
    if rule == "list":
        return list_of(value)
    if rule == "number":
        return text_of(value).try_cast("double")
    if rule == "millis":
        return millis_of(text_of(value))
    if rule == "name":
        return F.when(value.startswith("{"), F.coalesce(F.get_json_object(value, "$.name"), value)).otherwise(text_of(value))
    return text_of(value)


#: Kinds of JSON values that a rule takes as they are.
_AS_WRITTEN = {"list": "[", "text": '"', "name": '"'}


def _applied(name: str, rule: str, value: Column, read: Column, source: Column) -> Column:
    """What was done to one field of one record: rename, default, cast or unreadable; null for nothing."""
    renamed = F.when(source != name, F.concat(F.lit("rename "), source, F.lit(f" to {name}")))
    given = value.isNotNull() & (value != "null")
    lost = F.when(given & read.isNull(), F.lit(f"unreadable {name}"))
    start = _AS_WRITTEN.get(rule)
    other = ~value.startswith(start) if start else value.startswith('"')
    changed = F.when(given & read.isNotNull() & other, F.lit(f"cast {name}"))
    return F.array(renamed, F.when(value.isNull(), F.lit(f"default {name}")), lost, changed)


def consistent_records(files: DataFrame, typed: dict[str, DataFrame]) -> DataFrame:
    """All raw records and all typed tables as one table with the TARGET fields.

    No value is lost: absent fields default to null; fields outside TARGET, and
    values that a cast rule cannot read (their field becomes null), go to
    ``extras`` as JSON text under the name they had. ``applied`` lists every rule that
    changed the record: "rename a to b", "default f", "cast f", "unreadable f".
    ``origin`` is the file name or the typed table's name, ``version`` the
    fingerprint of the raw file's schema. record_id, run_at and loaded_at are
    those of the typed tables, written_at and received_at those of raw lines;
    of a line delivered twice the later delivery counts.
    """
    schemas = cut(file_schemas(files))
    names = cut(canonical_names(schemas.select(*FILE, F.explode("fields.field").alias("field")), changes(files, schemas)))
    # One small row per file: the file's name of every target field. A field
    # that stands beside the one renamed to its name gives way to it.
    known = F.col("canonical").isin(list(TARGET))
    chosen = names.where(known).groupBy(*FILE, "canonical").agg(F.max(F.struct((F.col("field") != F.col("canonical")).alias("r"), "field")).alias("f"))
    per_file = chosen.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("canonical", "f.field"))).alias("named"))
    per_file = cut(schemas.select(*FILE, "version").join(per_file, FILE, "left"))
    lines = files.select(*FILE, "line_no", "written_at", "received_at", "body").dropna(subset=FILE)
    last = F.max(F.struct("received_at", "body", "written_at")).alias("d")
    once = lines.groupBy(*FILE, "line_no").agg(last).select(*FILE, "line_no", "d.*")
    parsed = once.select(*FILE, "line_no", "written_at", "received_at", F.from_json("body", "map<string,variant>").alias("m")).where("m is not null")
    wide = parsed.withColumn("m", F.transform_values("m", lambda k, v: F.to_json(v))).hint("merge").join(per_file, FILE)
    source = lambda n: F.try_element_at(F.col("named"), F.lit(n))
    raws = {n: F.try_element_at(F.col("m"), source(n)) for n in TARGET}
    reads = {n: cast_rule(rule, raws[n]) for n, rule in TARGET.items()}
    step = wide.select("*", *[reads[n].alias(f"__r_{n}") for n in TARGET])
    applied = F.concat(*[_applied(n, rule, raws[n], F.col(f"__r_{n}"), source(n)) for n, rule in TARGET.items()])
    # A field keeps its text in extras unless a target field has read it.
    taken = F.array(*[F.when(F.col(f"__r_{n}").isNotNull() | F.coalesce(raws[n] == "null", F.lit(True)), source(n)) for n in TARGET])
    raw = step.select(
        F.col("file_name").alias("origin"), "version", "arm", "bench", "run_no", "line_no", "written_at", "received_at",
        *[F.col(f"__r_{n}").alias(n) for n in TARGET],
        F.map_filter("m", lambda k, v: ~F.coalesce(F.array_contains(F.array_compact(taken), k), F.lit(False))).alias("extras"),
        F.array_compact(applied).alias("applied"),
    )
    for name, df in typed.items():
        raw = raw.unionByName(_typed_records(name, df), allowMissingColumns=True)
    return raw


def _typed_records(name: str, df: DataFrame) -> DataFrame:
    types = dict(df.dtypes)
    kept = [c for c in ("record_id", "run_at", "loaded_at") if c in types]
    cols, applied, extras = [], [], []
    for n, rule in TARGET.items():
        kind = {"list": "array<string>", "number": "double", "millis": "int"}.get(rule, "string")
        if n not in types:
            cols.append(F.lit(None).cast(kind).alias(n))
            applied.append(F.lit(f"default {n}"))
            continue
        text = F.to_json(F.struct(F.col(n).alias("x")))
        value = F.when(F.col(n).isNotNull(), text.substr(F.lit(6), F.length(text) - 6))
        read = F.col(n) if types[n] == kind else cast_rule(rule, value)
        cols.append(read.alias(n))
        if types[n] != kind:
            applied += [F.when(F.col(n).isNotNull() & read.isNotNull(), F.lit(f"cast {n}")), F.when(F.col(n).isNotNull() & read.isNull(), F.lit(f"unreadable {n}"))]
            extras.append(F.when(read.isNull() & value.isNotNull(), F.struct(F.lit(n).alias("key"), value.alias("value"))))
    left = F.map_from_entries(F.array_compact(F.array(*extras))) if extras else F.expr("cast(map() as map<string,string>)")
    done = F.array_compact(F.array(*applied)) if applied else F.expr("cast(array() as array<string>)")
    return df.select(F.lit(name).alias("origin"), F.lit(name).alias("arm"), *kept, *cols, left.alias("extras"), done.alias("applied"))


def applied_rules(records: DataFrame) -> DataFrame:
    """(origin, rule, n): how many records of each file or table each rule changed."""
    return records.select("origin", F.explode("applied").alias("rule")).groupBy("origin", "rule").agg(F.count("*").alias("n"))
