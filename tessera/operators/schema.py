"""Declared fields: records as JSON texts against a list of fields, in one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind

#: Types, as schema_of_variant names them, that a value of each kind may have; a null fits every kind.
TEXT, WHOLE, NUMBER = "STRING", r"BIGINT|DECIMAL\(\d+,0\)", r"BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)"
KINDS = {"text": TEXT, "notes": TEXT, "reference": TEXT, "enum": f"{TEXT}|{NUMBER}|BOOLEAN", "integer": WHOLE, "decimal": NUMBER, "boolean": "BOOLEAN", "multi_reference": "ARRAY<.*>",
         "resource": rf"{NUMBER}|OBJECT<.*>", "object": "OBJECT<.*>", "calculated": ".*", "collection": "ARRAY<.*>"}
ISSUE = "array<struct<path:string,message:string>>"


@dataclass(frozen=True)
class Field:
    """One declared field; `items` are the fields of a collection's rows, which with `custom` need a reference or a filled `custom_name`.

    `entity` is what a reference refers to, `default` a new record's value as JSON."""

    name: str
    kind: str
    required: bool = False
    options: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None
    items: tuple[Field, ...] = ()
    custom: bool = False
    custom_name: str = "custom_name"
    entity: str | None = None
    default: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS or (self.kind == "enum") != bool(self.options) or (self.items and self.kind != "collection") or any(x.kind == "collection" for x in self.items) or {"'", '"'} <= set(self.name):
            raise ValueError(f"field {self.name!r} of kind {self.kind!r} is not declared well")


def at(row: Column, name: str) -> Column:
    """The value of a key as a variant: null where it is absent, a variant of null where it is null."""
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(row, f"$[{quote}{name}{quote}]", "variant")


def is_object(value: Column) -> Column:
    """Whether a variant is an object; unlike schema_of_variant, without looking into its values."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def is_array(value: Column) -> Column:
    """Whether a variant is an array; its elements are not looked into."""
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def message(field: Field, value: Column) -> Column:
    """What is wrong with one value, null if nothing is. The value and its type are worked out once."""
    return bind(value, lambda v: bind(F.schema_of_variant(v), lambda kind: _message(field, v, kind)))


def _message(field: Field, value: Column, kind: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    missing = value.isNull() | (kind == "VOID") | ((kind == "STRING") & (text == ""))
    out = F.when(missing, "Required field is missing.") if field.required else F.when(F.lit(False), "")
    out = out.when(value.isNull() | (kind == "VOID"), F.lit(None)).when(~kind.rlike(f"^(?:VOID|{KINDS[field.kind]})$"), f"Value does not match field type '{field.kind}'.")
    if field.options:
        out = out.when(~text.isin(*field.options), "Value is not one of the allowed enum options.")
    number = F.try_variant_get(value, "$", "double")
    for limit, sign, bad in ((field.minimum, ">=", number < F.lit(field.minimum)), (field.maximum, "<=", number > F.lit(field.maximum))):
        if limit is not None:
            out = out.when(bad, f"Value must be {sign} {limit:g}.")
    return out


def unknown(row: Column, fields: tuple[Field, ...], path: Column, said: str) -> Column:
    keys = F.array_except(F.coalesce(F.json_object_keys(F.to_json(row)), F.array().cast("array<string>")), F.array(*[F.lit(f.name) for f in fields]).cast("array<string>"))
    return F.transform(keys, lambda k: F.struct(F.concat(path, k).alias("path"), F.lit(said).alias("message")))


def row_issues(field: Field, row: Column, i: Column) -> Column:
    """The issues of one row of a collection, with its number."""
    path = F.concat(F.lit(f"{field.name}["), i.cast("string"), F.lit("]"))
    found = [F.struct(F.concat(path, F.lit(f".{x.name}")).alias("path"), message(x, at(row, x.name)).alias("message")) for x in field.items]
    if field.custom:
        filled = F.lit(False)
        for x in field.items:
            if x.kind == "reference":
                filled = filled | F.coalesce(F.try_variant_get(at(row, x.name), "$", "string") != "", F.lit(False))
        named = at(row, field.custom_name)
        filled = filled | F.coalesce((F.schema_of_variant(named) == "STRING") & (F.trim(F.try_variant_get(named, "$", "string")) != ""), F.lit(False))
        found.append(F.struct(path.alias("path"), F.when(~filled, "Collection row requires a compendium selection or custom name.").alias("message")))
    inner = F.concat(F.filter(F.array(*found), lambda x: x["message"].isNotNull()) if found else F.array().cast(ISSUE), unknown(row, field.items, F.concat(path, F.lit(".")), "Unknown collection item field."))
    broken = F.array(F.struct(path.alias("path"), F.lit("Collection row must be a mapping/object.").alias("message")))
    return F.when(F.schema_of_variant(row).startswith("OBJECT<"), inner).otherwise(broken)


def collection_issues(field: Field, value: Column) -> Column:
    return F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda r, i: row_issues(field, r, i)))


def issues_of(v: Column, fields: tuple[Field, ...]) -> Column:
    """All (path, message) of one record, a variant, by the declared fields."""
    singles = F.array(*[F.struct(F.lit(f.name).alias("path"), message(f, at(v, f.name)).alias("message")) for f in fields if f.kind != "collection"])
    parts = [F.filter(singles, lambda x: x["message"].isNotNull()), unknown(v, fields, F.lit(""), "Unknown character field.")]
    for f in fields:
        if f.kind == "collection":
            value = at(v, f.name)
            void = value.isNull() | (F.schema_of_variant(value) == "VOID")
            missing, other = (F.array(F.struct(F.lit(f.name).alias("path"), F.lit(said).alias("message"))) for said in ("Required field is missing.", f"Value does not match field type '{f.kind}'."))
            absent = F.when(void, missing) if f.required else F.when(value.isNull(), F.array().cast(ISSUE))
            parts.append(absent.when(~is_array(value), other).otherwise(collection_issues(f, value)))
    whole = F.when(is_object(v), F.concat(*parts)).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit("Character data must be a mapping/object.").alias("message"))))
    return F.coalesce(whole, F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit("Character data must be a mapping/object.").alias("message"))))


def declared_issues(records: DataFrame, fields: list[Field], key: str = "record_id", data: str = "data") -> DataFrame:
    """(key, path, message) of what is wrong with records(key, data: a JSON object as text) by the declared fields.

    Unknown keys, missing required values, values of a wrong type, outside an enum or a range, in the record and in each row of its collections.
    What is no JSON object is one issue without a path. A null fits every kind but a collection, and counts as missing."""
    rows = records.select(key, F.try_parse_json(data).alias("v"))
    return rows.select(key, F.explode(issues_of(F.col("v"), tuple(fields))).alias("i")).select(key, "i.*")
