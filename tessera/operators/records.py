"""Records with fields, references and collections: functions over their rows, selections, explanations, form values, checks and renderings.

Kinds of fields are text, notes, integer, decimal, boolean, enum, reference, multi_reference, resource and collection; a
collection is an array of structures. A null inside a row counts as a missing key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StringType

from ..functions.text import bind, distinct_fold, fold
from ..sources.shared import small, written
from .rules import behind_any, nulls_for_failures, tested

# ---- functions for rules ---------------------------------------------------------------------------


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def count(df: DataFrame, name: str) -> Column:
    """Length of a list, map or text; 0 for anything else and for null."""
    kind = df.schema[name].dataType
    if isinstance(kind, (ArrayType, MapType)):
        return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))
    return F.coalesce(F.length(name), F.lit(0)) if isinstance(kind, StringType) else F.lit(0)


def _item(df: DataFrame, rows: str, field: str):
    """The type of a field of the rows of a collection; None if there is no such field."""
    kind = df.schema[rows].dataType.elementType if rows in df.columns and isinstance(df.schema[rows].dataType, ArrayType) else None
    return kind[field].dataType if kind is not None and field in getattr(kind, "names", []) else None


def _equals(df: DataFrame, rows: str, field: str, expected):
    if _item(df, rows, field) is None:
        return (lambda r: F.lit(expected is None))
    return lambda r: r[field].eqNullSafe(F.lit(expected))


def rowsum(df: DataFrame, rows: str, field: str) -> Column:
    """Sum of a numeric field over a collection's rows; 0 if it is missing or not numeric."""
    return _rowsum(df, rows, field, F.col(rows))


def rowsum_where(df: DataFrame, rows: str, field: str, match: str, expected) -> Column:
    """rowsum over the rows whose field `match` equals a value."""
    return _rowsum(df, rows, field, F.filter(rows, _equals(df, rows, match, expected)))


def _rowsum(df: DataFrame, rows: str, field: str, kept: Column) -> Column:
    if not isinstance(_item(df, rows, field), NumericType):
        return F.lit(0.0)
    return F.coalesce(F.aggregate(kept, F.lit(0.0), lambda s, r: s + F.coalesce(r[field].cast("double"), F.lit(0.0))), F.lit(0.0))


def _size(kept: Column) -> Column:
    return F.greatest(F.coalesce(F.size(kept), F.lit(0)), F.lit(0))


def rowcount(df: DataFrame, rows: str, field: str, expected) -> Column:
    """Rows whose field equals a value."""
    return _size(F.filter(rows, _equals(df, rows, field, expected)))


def nonempty_count(df: DataFrame, rows: str, field: str) -> Column:
    """Rows whose field is not blank."""
    return _size(F.filter(rows, lambda r: _filled(r[field]))) if _item(df, rows, field) is not None else F.lit(0)


def nonempty_count_where(df: DataFrame, rows: str, field: str, match: str, expected) -> Column:
    """nonempty_count over the rows whose field `match` equals a value."""
    equals = _equals(df, rows, match, expected)
    return _size(F.filter(rows, lambda r: equals(r) & _filled(r[field]))) if _item(df, rows, field) is not None else F.lit(0)


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def resource(current: Column, maximum: Column) -> Column:
    return F.struct(current.cast("double").alias("current"), maximum.cast("double").alias("max"))


def resource_max(c: Column) -> Column:
    return F.coalesce(c["max"].cast("double"), F.lit(0.0))


# ---- selections and what stands on them ------------------------------------------------------------


def selections(records: DataFrame, fields: list[tuple[str, str, str, str | None]], row_columns: dict[str, str] | None = None) -> DataFrame:
    """(record_id, entity_type, entity_id, field, row_no, *row_columns): what records refer to, in one scan.

    fields: (field, reference | multi_reference | collection, entity_type, the collection's reference item or None); a
    collection with several reference items is listed once for each. row_no counts from 0 in lists; it is null for a
    reference. row_columns (name to type) are taken from a collection's rows, null elsewhere. Null and empty ids select nothing."""
    extra = row_columns or {}

    def entry(kind: str, field: str, ident: Column, row_no: Column, row: Column | None, names: list[str]) -> Column:
        taken = [(row[c] if row is not None and c in names else F.lit(None)).cast(t).alias(c) for c, t in extra.items()]
        return F.struct(F.lit(kind).alias("entity_type"), ident.cast("string").alias("entity_id"), F.lit(field).alias("field"), row_no.cast("int").alias("row_no"), *taken)

    def listed(entity: str, field: str) -> Column:
        return F.transform(field, lambda x, i: entry(entity, field, x, i, None, []))

    def in_rows(entity: str, field: str, item: str) -> Column:
        names = records.schema[field].dataType.elementType.names
        return F.transform(field, lambda r, i: entry(entity, field, r[item], i, r, names))

    lists = []
    for field, kind, entity, item in fields:
        if kind == "reference":
            lists.append(F.array(entry(entity, field, F.col(field), F.lit(None), None, [])))
        elif kind == "multi_reference":
            lists.append(listed(entity, field))
        else:
            lists.append(in_rows(entity, field, item))
    some = [F.filter(x, lambda s: F.coalesce(s.entity_id != "", F.lit(False))) for x in lists]
    shape = F.filter(F.array(entry("", "", F.lit(""), F.lit(None), None, [])), lambda s: F.lit(False))
    return records.select("record_id", F.explode(F.concat(*[F.coalesce(x, shape) for x in some])).alias("s")).select("record_id", "s.*")


def selected_ineligible(records: DataFrame, chosen: DataFrame, entities: DataFrame) -> DataFrame:
    """(record_id, field, entity_id, severity, message) of selections whose entity's rule does not hold for the record.

    entities(entity_type, entity_id, name, rule, message); an unknown entity is no issue here, see rules.dangling."""
    texts = [r.rule for r in entities.where("rule is not null").select("rule").distinct().orderBy("rule").collect()]
    known = tested(records, texts).select("record_id", "known")
    picked = chosen.select("record_id", "entity_type", "entity_id", "field").join(small(entities.where("rule is not null")), ["entity_type", "entity_id"])
    bad = picked.join(known, "record_id").where(~F.coalesce(F.try_element_at("known", F.col("rule")), F.lit(False)))
    message = F.concat_ws(" ", F.concat("name", F.lit(" is not eligible.")), F.coalesce(F.nullif("message", F.lit("")), F.lit("Requirements are not met.")))
    return bad.select("record_id", "field", "entity_id", F.lit("error").alias("severity"), message.alias("message"))


def limits_where(records: DataFrame, chosen: DataFrame, entities: DataFrame, limit_id: str, maximum: str, tags: tuple[str, ...] = (), metadata: dict[str, object] | None = None, warn_at: int = 0, require_full: bool = False) -> DataFrame:
    """rules.limits over the selections whose entity(entity_type, entity_id, tags, ...) has all tags and the given values."""
    fits = F.lit(True)
    for t in tags:
        fits = fits & F.coalesce(F.array_contains("tags", t), F.lit(False))
    for k, v in (metadata or {}).items():
        fits = fits & F.col(k).eqNullSafe(F.lit(v))
    from .rules import limits

    return limits(records, chosen.join(small(entities.where(fits).select("entity_type", "entity_id").distinct()), ["entity_type", "entity_id"]), limit_id, maximum, warn_at, require_full)


def explain_terms(records: DataFrame, terms: list[tuple[str, int, int, str, str]], sources: DataFrame | None = None) -> DataFrame:
    """(record_id, rule_id, term_no, label, value, sources): each additive term of each rule, in one scan.

    terms: (rule_id, term_no, sign, SQL over the calculated record, label). sources(record_id, modifier, seq, value, source_name,
    condition), as from rules.modifier_sources, is added where a term is a modifier by itself."""
    with nulls_for_failures(records.sparkSession):
        each = [F.struct(F.lit(r).alias("rule_id"), F.lit(n).alias("term_no"), F.lit(label).alias("label"), (F.lit(float(sign)) * F.expr(e).cast("double")).alias("value"), F.lit(e.strip()).alias("modifier")) for r, n, sign, e, label in terms]
        rows = records.select("record_id", F.explode(F.array(*each)).alias("t")).select("record_id", "t.*")
    if sources is None:
        return rows.drop("modifier").withColumn("sources", F.array().cast("array<struct<source_name:string,value:double>>"))
    asked = sources.where(F.col("modifier").isin(sorted({e.strip() for _, _, _, e, _ in terms})))  # before numbering and shuffles, as modifiers are their keys
    lists = asked.groupBy("record_id", "modifier").agg(F.sort_array(F.collect_list(F.struct("seq", "source_name", F.col("value").cast("double").alias("value")))).alias("l"))
    found = F.coalesce(F.transform("l", lambda x: F.struct(x.source_name.alias("source_name"), x.value.alias("value"))), F.array().cast("array<struct<source_name:string,value:double>>"))
    return rows.join(lists, ["record_id", "modifier"], "left").withColumn("sources", found).drop("modifier", "l")


def explain_inputs(records: DataFrame, inputs: list[tuple[str, int, str]], modifiers: set[str], calculated: set[str], labels: dict[str, str] | None = None) -> DataFrame:
    """(record_id, rule_id, input_no, id, label, kind, value): the names a rule reads, as modifier, calculated or field."""
    kind = lambda n: "modifier" if n in modifiers else "calculated" if n in calculated else "field"
    label = lambda n: (labels or {}).get(n, n.replace("_", " ").title())
    each = [F.struct(F.lit(r).alias("rule_id"), F.lit(i).alias("input_no"), F.lit(n).alias("id"), F.lit(label(n)).alias("label"), F.lit(kind(n)).alias("kind"), F.col(n).cast("string").alias("value")) for r, i, n in inputs]
    return records.select("record_id", F.explode(F.array(*each)).alias("t")).select("record_id", "t.*")


# ---- workflows -------------------------------------------------------------------------------------


def final_changes(records: DataFrame, changes: list[tuple[str, str]], integers: tuple[str, ...] = ()) -> DataFrame:
    """Records after a workflow's closing expressions, each of which sees the ones before it.

    A whole number becomes an integer in a field of that kind; one that is not whole, which such a field cannot hold, becomes null."""
    with nulls_for_failures(records.sparkSession):
        for name, e in changes:
            value = F.expr(e)
            records = records.withColumn(name, F.when(value.cast("double") == F.floor(value.cast("double")), value.cast("long")) if name in integers else value)
    return records


def rules_in_scope(issues: DataFrame, edges: DataFrame, steps: DataFrame, step: int) -> DataFrame:
    """issues(record_id, rule_id, ...) of rules all of whose workflow inputs are filled in at or before a step.

    edges(rule_id, dep) holds what calculated and validation rules read, steps(field, step) where a field is filled in; a field
    of several steps counts at the first, and is an input even if a rule calculates it. Rules without such inputs always show."""
    first = written(steps.groupBy("field").agg(F.min("step").alias("step")))
    inner = edges.join(small(first.select(F.col("field").alias("rule_id"))), "rule_id", "left_anti")
    late = behind_any(inner, first.where(F.col("step") > step).select(F.col("field").alias("name")))
    return issues.join(small(late), "rule_id", "left_anti").select(issues.columns)


def drop_placeholder_rows(df: DataFrame, rows: str, references: tuple[str, ...], defaults: dict[str, object] | None = None, custom_name: str = "custom_name") -> Column:
    """A collection without untouched rows: no reference, no custom name, and nothing but defaults, nulls and empty texts elsewhere.

    A boolean without a default starts as false."""
    kind, known = df.schema[rows].dataType.elementType, defaults or {}

    def kept(r: Column) -> Column:
        out = F.lit(False)
        for name in kind.names:
            value = r[name].cast("string")
            if name in references:
                out = out | F.coalesce(value != "", F.lit(False))
            elif name == custom_name:
                out = out | _filled(r[name])
            else:
                start = known.get(name, False if kind[name].dataType.typeName() == "boolean" else None)
                same = r[name].eqNullSafe(F.lit(start)) if start is not None else F.lit(False)
                out = out | ~(same | F.coalesce(value == "", F.lit(True)))
        return out

    return F.filter(rows, kept)


def coerce(raw: DataFrame, fields: dict[str, str], key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(records, issues) from raw form texts: raw has a text column for each field, null where the form has none.

    text, notes, reference: empty for null. integer, decimal: null for blank; what is no such number is null and an issue. boolean: whether
    the form has the field. enum: as it is. multi_reference: the parts of a comma-separated text that are not empty. resource: from <field>__current and
    <field>__max."""
    columns, checks = [], []

    def number(name: str, kind: str) -> Column:
        text = F.nullif(F.trim(name), F.lit(""))
        value = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")) if kind == "integer" else text.try_cast("double")
        checks.append(F.when(text.isNotNull() & value.isNull(), F.struct(F.lit(name).alias("field"), F.lit(f"not a number of kind {kind}").alias("message"))))
        return value

    for name, kind in fields.items():
        if kind in ("text", "notes", "reference"):
            columns.append(F.coalesce(name, F.lit("")).alias(name))
        elif kind in ("integer", "decimal"):
            columns.append(number(name, kind).alias(name))
        elif kind == "boolean":
            columns.append(F.col(name).isNotNull().alias(name))
        elif kind == "multi_reference":
            columns.append(F.coalesce(F.filter(F.split(name, ","), lambda x: x != ""), F.array().cast("array<string>")).alias(name))
        elif kind == "resource":
            columns.append(F.struct(number(f"{name}__current", "decimal").alias("current"), number(f"{name}__max", "decimal").alias("max")).alias(name))
        else:
            columns.append(F.col(name))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else None
    issues = raw.select(key, F.explode(found).alias("i")).select(key, "i.*") if checks else raw.select(key, F.lit("").alias("field"), F.lit("").alias("message")).where("false")
    return raw.select(key, *columns), issues


# ---- what others read ------------------------------------------------------------------------------


def render(records: DataFrame, fields: list[tuple[str, str, str]], entities: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(record_id, text): a line 'Label: value' for each field that is not blank, in order.

    fields: (field, kind, label). A resource shows as current/max, a list joined by commas, a collection as one indented line for
    each row; a reference shows the name of its entity(entity_id, name) if there is one. `limit` cuts texts of single fields."""
    def line(names: list[str]):
        return lambda r: F.concat(F.lit("\n  - "), F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), r[c].cast("string")) for c in names]))

    rows, lines = records, []
    for i, (field, kind, label) in enumerate(fields):
        value = F.col(field)
        if kind == "reference" and entities is not None:
            names = entities.select(F.col("entity_id").cast("string").alias(f"_k{i}"), F.col("name").alias(f"_n{i}"))
            rows = rows.join(small(names), F.col(field).cast("string") == F.col(f"_k{i}"), "left")
            value = F.coalesce(f"_n{i}", F.col(field).cast("string"))
        elif kind == "resource":
            value = F.concat(value["current"].cast("string"), F.lit("/"), value["max"].cast("string"))
        elif kind == "multi_reference":
            value = F.array_join(value, ", ")
        elif kind == "collection":
            names = records.schema[field].dataType.elementType.names
            value = F.nullif(F.array_join(F.transform(value, line(names)), ""), F.lit(""))
        else:
            value = value.cast("string")
        value = F.substring(value, 1, limit) if limit and kind in ("text", "notes") else value
        lines.append(F.when(_filled(value), F.concat(F.lit(f"{label}: "), value) if kind != "collection" else F.concat(F.lit(f"{label}:"), value)))
    return rows.select("record_id", F.concat_ws("\n", *lines).alias("text"))


def search_hints(chosen: DataFrame, entities: DataFrame, limit: int = 24) -> DataFrame:
    """(record_id, field, n, name): the names of a record's entities, distinct but for case, in the order of its rows, for each field."""
    named = chosen.join(small(entities.select("entity_type", "entity_id", "name")), ["entity_type", "entity_id"])
    once = named.groupBy("record_id", "field", F.lower(F.trim("name")).alias("_l")).agg(F.min(F.struct(F.coalesce("row_no", F.lit(-1)).alias("row_no"), "name")).alias("f"))
    n = F.row_number().over(Window.partitionBy("record_id", "field").orderBy("f.row_no", "f.name"))
    return once.withColumn("n", n).where(F.col("n") <= limit).select("record_id", "field", "n", F.trim("f.name").alias("name"))


def records_for(records: DataFrame, viewers: DataFrame) -> DataFrame:
    """(viewer, own, *record columns): the records that each viewer(viewer, group, sees_all) may see: those they own, and with sees_all all of the group.

    records(owner, group, ...); a record reaches a viewer through its owner or its group, never through a pair of all."""
    own = records.join(viewers.select(F.col("viewer").alias("owner")).distinct(), "owner", "left_semi").withColumns({"viewer": F.col("owner"), "own": F.lit(True)})
    rest = records.join(small(viewers.where("sees_all").select("viewer", "group")), "group").where(~F.col("owner").eqNullSafe(F.col("viewer"))).withColumn("own", F.lit(False))
    return own.select("viewer", "own", *records.columns).unionByName(rest.select("viewer", "own", *records.columns))


def autofill_row(rows: DataFrame, entities: DataFrame, key: str, fills: dict[str, str]) -> DataFrame:
    """rows with blank fields taken from the entity that `key` names: fills maps a row's field to the entity's."""
    known = entities.select(F.col("entity_id").alias("_k"), *[F.col(e).alias(f"_{e}") for e in dict.fromkeys(fills.values())])
    out = rows.join(known, F.col(key) == F.col("_k"), "left")
    return out.withColumns({f: F.when(_filled(F.col(f)), F.col(f)).otherwise(F.col(f"_{e}")) for f, e in fills.items()}).select(rows.columns)


def vocabulary(sources: list[DataFrame], limit: int = 280, width: int = 120) -> DataFrame:
    """(ord, value): the values of frames(ord, value) in turn, white space collapsed, without later ones equal but for case."""
    every = None
    for i, df in enumerate(sources):
        part = df.select(F.lit(i).alias("s"), "ord", F.substring(F.trim(F.regexp_replace("value", r"\s+", " ")), 1, width).alias("value")).where("value <> ''")
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(F.lower("value").alias("_l")).agg(F.min(F.struct("s", "ord", "value")).alias("f"))
    return first.select("f.*").orderBy("s", "ord", "value").limit(limit)


def expand_query_with_record(queries: DataFrame, hints: DataFrame, limit: int = 18) -> DataFrame:
    """queries(query_id, record_id, query) with `expanded`: the query on one line, and below it the record's terms that it calls for.

    hints(record_id, group_no, label, field_id, hint_no, term): all terms of a group are added whose label or field id, also without an s at the
    end, stands anywhere in the question; then every term that itself stands there. In order of groups, distinct but for case, `limit` at most."""
    line = F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"\s+", " "))
    asked = queries.withColumn("expanded", line)
    low = F.lower(line)
    within = lambda w: (w != "") & F.col("_low").contains(w)
    label, field = F.lower(F.trim("label")), F.replace(F.lower(F.trim("field_id")), F.lit("_"), F.lit(" "))
    called = F.lit(False)
    for w in (label, F.rtrim(label, F.lit("s")), field, F.rtrim(field, F.lit("s"))):
        called = called | F.coalesce(within(w), F.lit(False))
    named = F.coalesce(within(F.lower("term")), F.lit(False))
    rows = queries.select("query_id", "record_id", low.alias("_low")).join(hints.where("trim(term) <> ''"), "record_id").withColumn("_group", called).where(F.col("_group") | named)
    lists = rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((~F.col("_group")).alias("later"), "group_no", "hint_no", "term"))), lambda x: x.term).alias("_t"))
    more = bind(F.coalesce("_t", F.array().cast("array<string>")), lambda t: distinct_fold(t, limit, 120))
    out = asked.join(lists, "query_id", "left").withColumn("_t", F.array_join(more, "; "))
    return out.withColumn("expanded", F.when(F.col("_t") == "", F.col("expanded")).otherwise(F.concat("expanded", F.lit("\nRelevant selected character-sheet terms: "), "_t"))).drop("_t")


def retrieval_diagnostics(ranked: DataFrame) -> DataFrame:
    """(query_id, hits, best, mean_passage, lexical_only, semantic_only, both): what found the hits of each query."""
    lexical, semantic = F.col("lexical_rank").isNotNull(), F.col("semantic_rank").isNotNull()
    return ranked.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("evidence_score").alias("best"), F.round(F.avg("passage_score"), 6).alias("mean_passage"),
                                          F.count_if(lexical & ~semantic).alias("lexical_only"), F.count_if(semantic & ~lexical).alias("semantic_only"), F.count_if(lexical & semantic).alias("both"))
