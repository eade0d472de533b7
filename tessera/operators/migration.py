"""Records moved from one declared schema to another: fields, rows of collections, references and temporary effects, with warnings by path."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..sources.shared import small, written
from .schema import NUMBER, WHOLE, Field, at, is_object, issues_of

TEXTS = {"text", "notes", "reference"}
CELL, PART, REFERENCE = "struct<json:string,warning:string>", "struct<json:string,warnings:array<string>>", "struct<entity:string,id:string>"

# Warnings. Fixed values.
NO_OPTION = ": old value {} is not valid in the new enum and was reset."
NOT_WHOLE = ": decimal value {} cannot be represented as an integer and was reset."
TYPE_CHANGED = ": field type changed from {} to {}; old value was not converted."
ROW_DROPPED = ": invalid collection row was dropped."
NO_SCHEMA = "Old System Pack schema was unavailable; migration used matching field IDs only."
REMOVED = "Removed field(s) not carried forward: "
REFERENCE_RESET = ": reference {} no longer exists and was reset."
REFERENCES_REMOVED = ": {} obsolete reference(s) were removed."
ITEM_RESET = ": obsolete reference {} was reset."
EFFECTS_REMOVED = "Temporary effect(s) for removed field(s) were discarded: "
REVIEW = "Character needs manual review under the new schema: "


def said(template: str, *values: Column) -> Column:
    """A template with its {} filled in."""
    first, *rest = template.split("{}")
    return F.concat(F.lit(first), *[x for v, text in zip(values, rest) for x in (v, F.lit(text))])


def shown(x: Column) -> Column:
    """A variant as messages show it: a text in quotes, else its JSON with a capital for true, false and null as None."""
    text = F.try_variant_get(x, "$", "string")
    quoted = F.when(text.contains("'") & ~text.contains('"'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
    kind = F.schema_of_variant(x)
    return F.when(kind == "STRING", quoted).when(kind == "BOOLEAN", F.initcap(F.to_json(x))).when(kind == "VOID", "None").otherwise(F.to_json(x))


def default_of(field: Field) -> Column:
    """The JSON of a field that has no value yet, null if it stays away."""
    plain = {"collection": "[]", "multi_reference": "[]", "object": "{}", "boolean": "false"}
    return F.lit(field.default if field.default is not None else plain.get(field.kind)).cast("string")


def entry_of(field: Field, value: Column) -> Column:
    """`"name": value` as JSON, null if there is no value."""
    return F.concat(F.lit(json.dumps(field.name, ensure_ascii=False) + ":"), value)


def cell(value: Column | None = None, warning: Column | None = None) -> Column:
    return F.struct((F.lit(None) if value is None else value).alias("json"), (F.lit(None) if warning is None else warning).alias("warning")).cast(CELL)


def carried(old: Field, new: Field, x: Column, path: Column) -> Column:
    """(json, warning) of one value that is no collection; json is null where the new field's default stands."""
    kind, text = F.schema_of_variant(x), F.to_json(x)
    kept, changed = cell(text), cell(warning=F.concat(path, F.lit(TYPE_CHANGED.format(old.kind, new.kind))))
    if new.kind == "calculated":
        out = cell()
    elif old.kind == new.kind == "enum":
        out = F.when(F.try_variant_get(x, "$", "string").isin(*new.options), kept).otherwise(cell(warning=F.concat(path, said(NO_OPTION, shown(x)))))
    elif old.kind == new.kind:
        out = kept
    elif (old.kind, new.kind) == ("integer", "decimal"):
        out = F.when(kind.rlike(f"^(?:{WHOLE})$"), kept).otherwise(changed)
    elif (old.kind, new.kind) == ("decimal", "integer"):
        number = F.try_variant_get(x, "$", "double")
        whole = F.when(number == F.floor(number), F.try_variant_get(x, "$", "decimal(38,0)").cast("string"))
        out = F.when(~kind.rlike(f"^(?:{NUMBER})$"), changed).when(whole.isNotNull(), cell(whole)).otherwise(cell(warning=F.concat(path, said(NOT_WHOLE, shown(x)))))
    elif {old.kind, new.kind} <= TEXTS:
        out = F.when(kind == "STRING", kept).otherwise(changed)
    else:
        out = changed
    return F.when(x.isNull(), cell()).when(kind == "VOID", cell(None if new.kind == "calculated" else F.lit("null"))).otherwise(out)


def carried_row(old: Field, new: Field, row: Column, path: Column) -> Column:
    """(json, warnings) of one row of a collection: the new items, each from the old item of its name or its default."""
    was = {x.name: x for x in old.items}

    def moved(item: Field) -> Column:
        return bind(at(row, item.name), lambda v: carried(was[item.name], item, v, F.concat(path, F.lit(f".{item.name}"))))

    cells = [moved(x) if x.name in was else cell() for x in new.items]

    def whole(found: Column) -> Column:
        entries = [entry_of(x, F.coalesce(F.get(found, F.lit(i))["json"], default_of(x))) for i, x in enumerate(new.items)]
        warnings = F.filter(F.transform(found, lambda c: c["warning"]), lambda w: w.isNotNull())
        return F.struct(F.concat(F.lit("{"), F.array_join(F.array(*entries).cast("array<string>"), ","), F.lit("}")).alias("json"), warnings.alias("warnings")).cast(PART)

    built = bind(F.array(*cells).cast(f"array<{CELL}>"), whole)
    dropped = F.struct(F.lit(None).alias("json"), F.array(F.concat(path, F.lit(ROW_DROPPED))).alias("warnings")).cast(PART)
    return F.when(F.schema_of_variant(row).startswith("OBJECT<"), built).otherwise(dropped)


def part(old: Field, new: Field, x: Column) -> Column:
    """(json, warnings) of one field of a record."""
    single = lambda c: F.struct(c["json"].alias("json"), F.filter(F.array(c["warning"]), lambda w: w.isNotNull()).alias("warnings")).cast(PART)
    if not old.kind == new.kind == "collection":
        return bind(x, lambda v: bind(carried(old, new, v, F.lit(new.name)), single))
    rows = lambda a: F.transform(a, lambda r, i: carried_row(old, new, r, F.concat(F.lit(f"{new.name}["), i.cast("string"), F.lit("]"))))
    listed = lambda rows: bind(rows, lambda a: F.struct(F.concat(F.lit("["), F.array_join(F.transform(a, lambda r: r["json"]), ","), F.lit("]")).alias("json"), F.flatten(F.transform(a, lambda r: r["warnings"])).alias("warnings")).cast(PART))
    other = F.when(F.schema_of_variant(x) == "VOID", single(cell(F.lit("null")))).otherwise(single(cell()))
    return bind(F.try_variant_get(x, "$", "array<variant>"), lambda a: F.when(a.isNotNull(), listed(rows(a))).otherwise(other))


def joined(entries: list[Column]) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array(*entries).cast("array<string>"), ","), F.lit("}"))


def removed_keys(row: Column, fields: tuple[Field, ...], text: str) -> Column:
    """The warning about keys of an object that no field has, in a list of one or none."""
    keys = F.array_sort(F.array_except(F.coalesce(F.map_keys(F.try_variant_get(row, "$", "map<string,variant>")), F.array().cast("array<string>")), F.array(*[F.lit(f.name) for f in fields]).cast("array<string>")))
    return F.when(F.size(keys) > 0, F.array(F.concat(F.lit(text), F.array_join(keys, ", ")))).otherwise(F.array().cast("array<string>"))


def ids_of(field: Field, x: Column) -> Column:
    """(entity, id) of all that a field of a migrated record refers to."""
    one = lambda f, v: F.struct(F.lit(f.entity).alias("entity"), F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")).alias("id")).cast(REFERENCE)
    listed = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))
    if field.kind == "collection":
        items = [i for i in field.items if i.kind == "reference" and i.entity]
        return F.flatten(F.transform(listed, lambda r: F.array(*[one(i, at(r, i.name)) for i in items])))
    return F.transform(listed, lambda v: one(field, v)) if field.kind == "multi_reference" else F.array(one(field, x))


def refers(field: Field) -> bool:
    return bool(field.entity) and field.kind in ("reference", "multi_reference") or any(i.kind == "reference" and i.entity for i in field.items)


def without(field: Field, x: Column, gone: Column) -> Column:
    """(json, warnings) of a field whose references are checked against the list of those that are gone."""
    lost = lambda f, v: F.array_contains(gone, F.struct(F.lit(f.entity).alias("entity"), F.try_variant_get(v, "$", "string").alias("id")).cast(REFERENCE))
    out = lambda value, warnings: F.struct(value.alias("json"), warnings.alias("warnings")).cast(PART)
    none, same = F.array().cast("array<string>"), F.to_json(x)
    if field.kind == "reference":
        return F.when(lost(field, x), out(F.lit(None), F.array(said(field.name + REFERENCE_RESET, shown(x))))).otherwise(out(same, none))
    listed = F.try_variant_get(x, "$", "array<variant>")
    if field.kind == "multi_reference":
        kept = F.filter(listed, lambda v: (F.schema_of_variant(v) != "VOID") & (F.try_variant_get(v, "$", "string") != "") & ~lost(field, v))
        fewer = F.size(listed) - F.size(kept)
        value = F.concat(F.lit("["), F.array_join(F.transform(kept, lambda v: F.to_json(v)), ","), F.lit("]"))
        return F.when(listed.isNull(), out(same, none)).otherwise(out(value, F.when(fewer > 0, F.array(said(field.name + REFERENCES_REMOVED, fewer.cast("string")))).otherwise(none)))

    def row(r: Column, n: Column) -> Column:
        checked = {i.name for i in field.items if i.kind == "reference" and i.entity}
        value = joined([entry_of(i, F.when(~F.coalesce(lost(i, at(r, i.name)), F.lit(False)), F.to_json(at(r, i.name))) if i.name in checked else F.to_json(at(r, i.name))) for i in field.items])
        notes = [F.when(lost(i, at(r, i.name)), F.concat(F.lit(f"{field.name}["), n.cast("string"), F.lit(f"].{i.name}"), said(ITEM_RESET, shown(at(r, i.name))))) for i in field.items if i.name in checked]
        return out(value, F.filter(F.array(*notes).cast("array<string>"), lambda w: w.isNotNull()))

    rows = F.transform(listed, row)
    checked_rows = bind(rows, lambda a: out(F.concat(F.lit("["), F.array_join(F.transform(a, lambda r: r["json"]), ","), F.lit("]")), F.flatten(F.transform(a, lambda r: r["warnings"]))))
    return F.when(listed.isNull(), out(same, none)).otherwise(checked_rows)


def migrate_declared(records: DataFrame, old: list[Field] | None, new: list[Field], entities: DataFrame | None = None, key: str = "record_id", data: str = "data", effects: str | None = None) -> DataFrame:
    """records(key, data: a JSON object as text, effects: another one by field) on the fields of `new`, and `warnings`, a list of texts.

    A value is carried if its kind stays (an enum value only if it is still an option), between kinds of text, from integer to decimal, and from decimal
    to integer if it is whole; else the default stands. Rows of collections are carried item by item, rows that are no objects are
    dropped. With entities(entity_type, entity_id), references that no longer exist go, in fields, lists and rows. Effects on removed fields
    go. What is left is checked by declared_issues' rules. Without `old`, values are copied by name. Data that is no JSON object stays as it is and is only
    checked; so do effects that are none. Rows with equal or null keys are rows like any other."""
    fields, was = tuple(new), None if old is None else {f.name: f for f in old}
    names = {f.name for f in fields}
    none = F.array().cast("array<string>")
    rows = records.select(F.struct(*records.columns).alias("own"), F.col(key).alias("key"), F.try_parse_json(data).alias("v"), (F.col(effects) if effects else F.lit(None)).cast("string").alias("e"))
    v = F.col("v")
    if was is None:
        parts = [F.struct(F.to_json(at(v, f.name)).alias("json"), none.alias("warnings")).cast(PART) for f in fields]
        last = F.array(F.lit(NO_SCHEMA))
    else:
        parts = [part(was[f.name], f, at(v, f.name)) if f.name in was else F.struct(F.lit(None).alias("json"), none.alias("warnings")).cast(PART) for f in fields]
        last = removed_keys(v, fields, REMOVED)
    rows = rows.withColumn("parts", F.when(is_object(v), F.array(*parts).cast(f"array<{PART}>")))
    found = F.flatten(F.transform("parts", lambda p: p["warnings"]))
    whole = joined([entry_of(f, F.coalesce(F.get("parts", F.lit(i))["json"], default_of(f))) for i, f in enumerate(fields)])
    rows = rows.select("own", "key", "e", F.try_parse_json(F.when(F.col("parts").isNotNull(), whole)).alias("v"), F.when(F.col("parts").isNotNull(), F.concat(found, last)).otherwise(none).alias("w"))
    checked = [f for f in fields if refers(f)]
    if entities is not None and checked:
        rows = written(rows)  # read twice, for what it refers to and for what stays
        asked = rows.select("key", F.explode(F.array_distinct(F.flatten(F.array(*[ids_of(f, at(v, f.name)) for f in checked])))).alias("r")).where("r.id is not null")
        known = small(entities.select(F.col("entity_type").alias("t"), F.col("entity_id").cast("string").alias("i")).where("t is not null and i is not null").distinct())
        gone = asked.join(known, (F.col("r.entity") == F.col("t")) & (F.col("r.id") == F.col("i")), "left_anti").groupBy(F.col("key").alias("k")).agg(F.collect_set("r").cast(f"array<{REFERENCE}>").alias("gone"))
        rows = rows.join(gone, F.col("key").eqNullSafe(F.col("k")), "left").withColumn("gone", F.coalesce("gone", F.array().cast(f"array<{REFERENCE}>")))
        kept = [without(f, at(v, f.name), F.col("gone")) if f in checked else F.struct(F.to_json(at(v, f.name)).alias("json"), none.alias("warnings")).cast(PART) for f in fields]
        rows = rows.withColumn("parts", F.when(v.isNotNull(), F.array(*kept).cast(f"array<{PART}>")))
        whole = joined([entry_of(f, F.get("parts", F.lit(i))["json"]) for i, f in enumerate(fields)])
        rows = rows.select("own", "key", "e", F.try_parse_json(F.when(v.isNotNull(), whole)).alias("v"), F.concat("w", F.coalesce(F.flatten(F.transform("parts", lambda p: p["warnings"])), none)).alias("w"))
    columns = {}
    if effects:
        e = F.try_parse_json("e")
        is_map = is_object(e)
        left = joined([entry_of(f, F.to_json(at(e, f.name))) for f in fields])
        rows = rows.withColumns({"w": F.when(is_map, F.concat("w", removed_keys(e, fields, EFFECTS_REMOVED))).otherwise(F.col("w")), "e": F.when(is_map, left).otherwise(F.col("e"))})
        columns[effects] = F.col("e")
    # A record that was no JSON object has no migrated one; its own text is checked instead.
    errors = lambda v: F.transform(issues_of(v, fields), lambda i: F.concat(F.lit("ERROR: "), F.coalesce(F.concat(i["path"], F.lit(": ")), F.lit("")), i["message"]))
    said_of = lambda e: F.when(F.size(e) > 0, F.array(F.concat(F.lit(REVIEW), F.array_join(e, "; ")))).otherwise(none)
    review = bind(F.coalesce("v", F.try_parse_json(F.col("own")[data])), lambda v: bind(errors(v), said_of))
    columns |= {data: F.coalesce(F.to_json("v"), F.col("own")[data]), "warnings": F.concat("w", review)}
    return rows.select(*[columns.pop(c).alias(c) if c in columns else F.col("own")[c].alias(c) for c in records.columns], *[c.alias(n) for n, c in columns.items()])
