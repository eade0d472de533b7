"""Declarative record rules. Rules are rows whose expressions are Spark SQL; Catalyst analyses and compiles them."""

from __future__ import annotations

import re
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..sources.shared import small, written


def rule_levels(edges: DataFrame) -> DataFrame:
    """(rule_id, level) from edges(rule_id, dep): dependency depth; level -1 marks rules on or behind a cycle.

    A null dep is none; one that no rule defines is an input of level 0. In a round, what a rule depends on is replaced: by a number where
    its level is known, and by what stands behind it where that is one rule. So chains halve and take as many rounds as the logarithm
    of their length; only a depth of rules with several open dependencies each takes a round a level. A path as long as there are rules is a cycle's."""
    pairs = edges.where("rule_id is not null").select(F.col("rule_id").alias("id"), "dep").distinct()
    known = pairs.select(F.col("id").alias("dep"), F.lit(True).alias("inside")).distinct()
    state = pairs.join(known, "dep", "left").withColumns({"open": F.col("inside") & F.col("dep").isNotNull(), "loops": F.coalesce(F.col("dep") == F.col("id"), F.lit(False))})
    deps = F.collect_list(F.when(F.col("open"), F.struct("dep", F.lit(1).cast("long").alias("far"))))
    rows = written(state.groupBy("id").agg(F.max(F.when(F.col("dep").isNotNull() & F.col("inside").isNull(), 1).otherwise(0)).cast("long").alias("least"), deps.alias("deps"), F.max("loops").alias("loops"), F.lit(True).alias("moved")))
    n, parts = rows.count(), []
    while True:
        ready = F.col("loops") | (F.size("deps") == 0)
        parts.append(rows.where(ready).select(F.col("id").alias("rule_id"), F.when(F.col("loops"), -1).otherwise(F.col("least")).cast("int").alias("level")))
        if len(parts) == 32:  # a deep graph must not make a wide plan
            parts = [written(reduce(DataFrame.unionByName, parts))]
        some = rows.agg(F.count_if(~ready).alias("open"), F.count_if(ready | F.col("moved")).alias("news")).first()
        if not some.open or not some.news:  # without news every open rule waits for another one
            return reduce(DataFrame.unionByName, [*parts, rows.where(~ready).select(F.col("id").alias("rule_id"), F.lit(-1).alias("level"))])
        there = reduce(DataFrame.unionByName, parts).select(F.col("rule_id").alias("dep"), F.col("level").cast("long").alias("b_least"), (F.col("level") == -1).alias("b_loops"), F.lit(0).alias("n"))
        behind = rows.where(~ready).select(F.col("id").alias("dep"), F.col("least").alias("b_least"), "loops", F.size("deps").alias("n"), F.get("deps", F.lit(0)).alias("next")).withColumnRenamed("loops", "b_loops").unionByName(there, allowMissingColumns=True)
        arcs = rows.where(~ready).select("id", "least", F.explode("deps").alias("d")).select("id", "least", "d.dep", "d.far").join(behind, "dep")
        short, chain = F.col("n") < 2, F.col("n") == 1
        further = F.when(chain, F.struct(F.col("next.dep").alias("dep"), (F.col("far") + F.col("next.far")).alias("far"))).when(F.col("n") > 1, F.struct("dep", "far"))
        arcs = arcs.select("id", F.when(short, F.greatest("least", F.col("far") + F.col("b_least"))).otherwise(F.col("least")).alias("least"), further.alias("to"), "b_loops", short.alias("short"))
        loops = F.max(F.col("b_loops") | F.coalesce((F.col("to.dep") == F.col("id")) | (F.col("to.far") > n), F.lit(False)))
        met = arcs.groupBy("id").agg(F.max("least").alias("least"), F.collect_set("to").alias("deps"), loops.alias("loops"), F.max("short").alias("moved"))
        last = F.sort_array("deps")
        furthest = F.filter(last, lambda x, i: ~F.coalesce(F.get(last, i + 1).dep == x.dep, F.lit(False)))
        rows = written(met.withColumn("deps", furthest))


def reached(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, rule_id): the rules of edges(rule_id, dep) that depend on a name of sources(source), directly or not.

    Only pairs that the round before has found meet the edges again, and only what the sources reach is ever held. Where every rule has one
    dep, a pair has one path if paths end where they come back to their source, so no pair is looked up among those found before."""
    arcs = written(edges.where("rule_id is not null and dep is not null").select("rule_id", "dep").distinct())
    single = arcs.groupBy("rule_id").count().where("count > 1").isEmpty()
    new = written(sources.select("source").where("source is not null").distinct().join(arcs, F.col("source") == F.col("dep")).select("source", "rule_id"))
    found = [new]
    while not new.isEmpty():
        if single:
            new = written(new.where("source <> rule_id").withColumnRenamed("rule_id", "dep").join(arcs, "dep").select("source", "rule_id"))
        else:
            known = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found)
            new = written(new.withColumnRenamed("rule_id", "dep").join(arcs, "dep").select("source", "rule_id").distinct().join(known, ["source", "rule_id"], "left_anti"))
        found.append(new)
        if len(found) == 32:  # a deep chain must not make a wide plan
            found = [written(reduce(DataFrame.unionByName, found))]
    return reduce(DataFrame.unionByName, found)


def behind_any(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(rule_id): the rules of edges(rule_id, dep) that depend on any of names(name), directly or not; every rule is met once, whatever the number of names."""
    arcs = written(edges.where("rule_id is not null and dep is not null").select("rule_id", "dep").distinct())
    new, left = names.select(F.col("name").alias("dep")).where("dep is not null").distinct(), arcs
    found = []
    while True:
        new = written(left.join(new, "dep", "left_semi").select("rule_id").distinct())
        found.append(new)
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found)
        left = written(left.join(new, "rule_id", "left_anti"))  # rules that are found need not be met again
        if len(found) == 32:
            found = [written(reduce(DataFrame.unionByName, found))]
        new = new.select(F.col("rule_id").alias("dep"))


def names_in(spark: SparkSession, texts: list[str]) -> dict[str, list[str] | None]:
    """The names that each SQL expression reads, as Catalyst's parser finds them, sorted; None where the text is no expression.

    Functions, literals and the variables of lambdas are no names; of a name with fields the first part counts."""
    parser, found = spark._jsparkSession.sessionState().sqlParser(), {}
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]

    def read(node, bound: frozenset[str]) -> set[str]:
        """Inside a lambda every name is a variable to the parser; those that are none of its arguments are names after all."""
        if node.nodeName() == "LambdaFunction":
            bound = bound | {x.nameParts().head() for x in listed(node.arguments())}
            return read(node.function(), bound)
        if node.nodeName() in ("UnresolvedAttribute", "UnresolvedNamedLambdaVariable"):
            return {node.nameParts().head()} - bound
        return set().union(*(read(x, bound) for x in listed(node.children())))

    for text in texts:
        try:
            tree = parser.parseExpression(text)
        except Exception as error:  # py4j hands the parser's own error on
            if not re.search("ParseException|ArithmeticException", f"{type(error).__name__} {error}"):  # the latter for a precision beyond 38
                raise
            found[text] = None
            continue
        leaves = listed(tree.collectLeaves())
        inner = any(x.nodeName() == "UnresolvedNamedLambdaVariable" for x in leaves)
        found[text] = sorted(read(tree, frozenset()) if inner else {x.nameParts().head() for x in leaves if x.nodeName() == "UnresolvedAttribute"})
    return found


#: What shaped() puts for a numbered word. Fixed value.
MARK = "tessera_v"
#: Quoted texts and names of a SQL text, and outside them words that hold a digit and call no function. Fixed values.
QUOTED = r"""'[^']*'|"[^"]*"|`[^`]*`"""
NUMBERED = r"(?<![\p{L}\p{N}_.])[A-Za-z_]+[0-9][A-Za-z0-9_]*+(?![\p{L}\p{N}]|\s*\()"


def shaped(rows: DataFrame) -> DataFrame:
    """rows(expr, ...) with shape and words: words with a digit, like p17, become tessera_v1, tessera_v2 and so on, words lists what they stand for.

    No keyword, type or literal of Spark's SQL is such a word, only names are, and functions' names stay, so texts of one shape parse alike.
    A text with a comment, a backslash, a variable or the mark itself is its own shape. The list is a column first, as lambdas work out what they hold for each element."""
    parts, own = F.lit(f"({QUOTED})|({NUMBERED})"), F.col("expr").rlike(f"--|/\\*|[\\\\$\x01]|{MARK}")
    rows = rows.withColumn("words", F.when(own, F.array().cast("array<string>")).otherwise(F.regexp_extract_all("expr", parts, F.lit(2))))
    put = F.transform("words", lambda w: F.when(w == "", "").otherwise(F.concat(F.lit(MARK), F.array_position("words", w).cast("string"))))
    apart = F.split(F.regexp_replace("expr", parts, F.lit("$1\x01")), "\x01", -1)
    joined = F.array_join(F.zip_with(apart, put, lambda a, w: F.concat(a, F.coalesce(w, F.lit("")))), "")
    return rows.withColumn("shape", F.when(own, F.col("expr")).otherwise(joined))


def expression_edges(rules_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unreadable) of rules(rule_id, expr): edges(rule_id, dep), dep null for a rule that reads nothing; unreadable(rule_id, expr).

    Distinct shapes of texts are parsed on the driver, one of each however many rules differ in numbered names alone; the rules stay a table."""
    spark = rules_.sparkSession
    dealt = rules_.select("rule_id", "expr").repartition(spark.sparkContext.defaultParallelism, "expr")  # a small file is one task otherwise
    rows = written(shaped(dealt))
    shapes = [r.shape for r in rows.where("shape is not null").select("shape").distinct().collect()]
    parsed = written(spark.createDataFrame(list(names_in(spark, shapes).items()), "shape string, found array<string>"))
    stands = lambda x: F.coalesce(F.when(x.startswith(MARK), F.get("words", F.try_subtract(F.substring(x, len(MARK) + 1, 9).try_cast("int"), F.lit(1)))), x)
    read = rows.join(small(parsed), "shape", "left").select("rule_id", "expr", F.transform("found", stands).alias("names"))
    edges = read.where("names is not null").select("rule_id", F.explode_outer("names").alias("dep")).distinct()
    return edges, read.where("names is null").select("rule_id", "expr")


def expression_audit(rules_: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, rule_id, problem, name) of what is wrong with rules(kind, rule_id, expr), whose kind is formula, validation, limit, usage, effect or eligibility.

    bad_syntax: no SQL expression, or none at all; unknown_reference: a name that is neither in known(name) nor a formula;
    duplicate_id: two rules of one kind with one id; name_collision: a formula named like a known field; cycle: a formula on or behind one."""
    keyed = rules_.select(F.struct("kind", F.col("rule_id").alias("id")).alias("rule_id"), "expr")
    edges, unreadable = expression_edges(keyed)
    edges = written(edges.select("rule_id.kind", F.col("rule_id.id").alias("rule_id"), "dep"))
    formulas = rules_.where("kind = 'formula'").select(F.col("rule_id").alias("name")).distinct()
    names = known.select("name").union(formulas).distinct()
    unknown = edges.where("dep is not null").join(small(names), F.col("dep") == F.col("name"), "left_anti").select("kind", "rule_id", F.lit("unknown_reference").alias("problem"), F.col("dep").alias("name"))
    syntax = unreadable.select("rule_id.kind", F.col("rule_id.id").alias("rule_id"), F.lit("bad_syntax").alias("problem"), F.lit(None).cast("string").alias("name"))
    twice = rules_.groupBy("kind", "rule_id").agg(F.count("*").alias("n")).where("n > 1").select("kind", "rule_id", F.lit("duplicate_id").alias("problem"), F.col("rule_id").alias("name"))
    same = formulas.join(known.select("name").distinct(), "name", "left_semi").select(F.lit("formula").alias("kind"), F.col("name").alias("rule_id"), F.lit("name_collision").alias("problem"), "name")
    loops = rule_levels(edges.where("kind = 'formula'").select("rule_id", "dep")).where("level = -1").select(F.lit("formula").alias("kind"), "rule_id", F.lit("cycle").alias("problem"), F.col("rule_id").alias("name"))
    return unknown.unionByName(syntax).unionByName(twice).unionByName(same).unionByName(loops)


def fill_defaults(records: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Defaults for keys that a record lacks. records has `present`, the names of its stored keys, so that a stored null stays."""
    return records.withColumns({k: F.when(F.array_contains("present", k), F.col(k)).otherwise(F.lit(v)) for k, v in defaults.items()})


def issues(records: DataFrame, key: str, checks: list[tuple[str, Column, str, str]]) -> DataFrame:
    """(key, rule_id, severity, message) where a check (rule_id, failing condition, severity, message) fails, in one scan."""
    rows = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(m).alias("message"))) for i, bad, s, m in checks])
    return records.select(key, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("i")).select(key, "i.*")


def dangling(selections: DataFrame, entities: DataFrame) -> DataFrame:
    """selections(record_id, entity_type, entity_id, ...) whose entity does not exist."""
    return selections.join(entities.select("entity_type", "entity_id").distinct(), ["entity_type", "entity_id"], "left_anti")


@contextmanager
def nulls_for_failures(spark: SparkSession):
    """What is analysed inside gives null where it would fail at run time: a division by zero, a cast, a lookup, an overflow."""
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)


def tested(rows: DataFrame, texts: list[str]) -> DataFrame:
    """rows with `known`, a map from each SQL condition to whether it holds; one that is null or fails in any way does not.

    Each text is analysed on its own first, so an unknown name or bad syntax switches off that condition alone."""
    def boolean(t: str) -> bool:
        try:
            return rows.select(F.expr(t)).schema[0].dataType == BooleanType()
        except (AnalysisException, ParseException):
            return False

    with nulls_for_failures(rows.sparkSession):
        parts = [x for t in texts for x in (F.lit(t), F.coalesce(F.expr(t), F.lit(False)) if boolean(t) else F.lit(False))]
        return rows.withColumn("known", F.create_map(*parts) if parts else F.create_map().cast("map<string,boolean>"))


def resolve_modifiers(records: DataFrame, selections: DataFrame, effects: DataFrame, modifiers: list[tuple[str, float, str]]) -> DataFrame:
    """(record_id, one column for each modifier). modifiers: (name, default, sum|max|min); effects(entity_type, entity_id,
    modifier, value, when): `when` is a SQL condition over record and row, where the row's columns come before the record's; one
    that fails or is null switches the effect off. Effects are joined, broadcast only if counted to be few; their distinct
    condition texts, part of the rules and not of the data, are compiled into the plan. Partial sums combine before the shuffle; the
    default takes part in every aggregate."""
    if not modifiers:
        return records.select("record_id")
    own = [c for c in records.columns if c == "record_id" or c not in {*selections.columns, *effects.columns}]
    joined = selections.join(small(effects), ["entity_type", "entity_id"]).join(records.select(own), "record_id")
    texts = [r.when for r in effects.where("when is not null").select("when").distinct().orderBy("when").collect()]
    active = tested(joined, texts).where((F.col("when").isNull() | F.try_element_at("known", F.col("when"))) & F.col("value").isNotNull())
    how = {"sum": F.sum, "max": F.max, "min": F.min}
    aggregated = active.groupBy("record_id").agg(*[how[a](F.when(F.col("modifier") == m, F.col("value"))).alias(m) for m, _, a in modifiers])
    out = records.select("record_id").join(aggregated, "record_id", "left")
    join = {"sum": lambda c, d: F.lit(d) + F.coalesce(c, F.lit(0.0)), "max": lambda c, d: F.greatest(F.lit(d), c), "min": lambda c, d: F.least(F.lit(d), c)}
    return out.select("record_id", *[join[a](F.col(m), d).alias(m) for m, d, a in modifiers])


def modifier_sources(selections: DataFrame, effects: DataFrame, entities: DataFrame) -> DataFrame:
    """(record_id, modifier, seq, value, source_name, condition): where a modifier's value comes from, in row order."""
    rows = selections.join(small(effects), ["entity_type", "entity_id"]).join(small(entities), ["entity_type", "entity_id"])
    seq = F.row_number().over(Window.partitionBy("record_id", "modifier").orderBy("field", "row_no", "entity_id", "value"))
    return rows.select("record_id", "modifier", seq.alias("seq"), "value", F.coalesce("label", "name").alias("source_name"), F.col("when").alias("condition"))


def calculate(records: DataFrame, rules: list[tuple[str, str, int]], effects: dict[str, Column] | None = None) -> DataFrame:
    """records with calculated columns; rules (name, SQL, level) are added a level at a time, so plans stay shallow."""
    for level in sorted({r[2] for r in rules}):
        new = {n: F.expr(e) for n, e, at in rules if at == level}
        records = records.withColumns({n: apply_effects(c, effects[n]) if effects and n in effects else c for n, c in new.items()})
    return records


def effective(records: DataFrame, selections: DataFrame, effects: DataFrame, modifiers: list[tuple[str, float, str]], formulas: list[tuple[str, str, int]], temporary: DataFrame, inputs: list[str]) -> DataFrame:
    """records as temporary(record_id, target, seq, op, value) leaves them: inputs, the modifiers and the formulas (name, SQL, level), and `modified`.

    In stages: effects on inputs come first, in the order of seq; then modifiers are resolved on the changed inputs, so that an effect
    may switch a conditional modifier on or off; then formulas a level at a time, each with its effects before the next level reads it.
    An input that is no number, or null, stays; a target that is neither input nor formula has no effect; `modified` lists the inputs whose value
    is another one than before. A record's effects are gathered once, in one list for each target; its columns of these names are replaced."""
    names = [*inputs, *(n for n, _, _ in formulas)]
    at = "lists"
    while at in {*records.columns, *names, *(m for m, _, _ in modifiers)}:
        at = f"_{at}"
    of = lambda n: F.transform(F.sort_array(F.collect_list(F.when(F.col("target") == n, F.struct("seq", "op", "value")))), lambda x: F.struct(x.op.alias("op"), x.value.alias("value")))
    lists = temporary.where(F.col("target").isin(names)).groupBy("record_id").agg(F.struct(*[of(n).alias(f"{i}") for i, n in enumerate(names)]).alias(at))
    own = {n: F.col(at).getField(f"{i}") for i, n in enumerate(names)}
    numbers = {n: apply_effects(F.col(n), own[n]) for n in inputs if isinstance(records.schema[n].dataType, NumericType)}
    changed = F.array(*[F.when(~F.col(n).cast("double").eqNullSafe(v), F.lit(n)) for n, v in numbers.items()]).cast("array<string>")
    adjusted = records.join(lists, "record_id", "left").withColumns({**numbers, "modified": F.array_compact(changed)})
    resolved = resolve_modifiers(adjusted.drop(at, "modified"), selections, effects, modifiers)
    rows = adjusted.drop(*(m for m, _, _ in modifiers)).join(resolved, "record_id")
    return calculate(rows, formulas, {n: own[n] for n, _, _ in formulas}).drop(at)


def apply_effects(value: Column, rows: Column) -> Column:
    """A number after its effects (op, value) in order: add, subtract, multiply, override; null stays null."""
    def step(v: Column, e: Column) -> Column:
        return F.when(e.op == "add", v + e.value).when(e.op == "subtract", v - e.value).when(e.op == "multiply", v * e.value).when(e.op == "override", e.value).otherwise(v)
    return F.when(value.isNotNull() & rows.isNotNull(), F.aggregate(rows, value.cast("double"), step)).otherwise(value.cast("double"))


def eligibility(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(record_id, entity_id, eligible) from entities(entity_id, rule): a rule that is null or holds opens the entity, one that
    fails does not. Each distinct rule text is evaluated once for a record; the answer is a row for every record and entity, so
    records meet the list of entities as an array, not by a join of pairs."""
    texts = [r.rule for r in entities.where("rule is not null").select("rule").distinct().orderBy("rule").collect()]
    every = entities.agg(F.collect_list(F.struct("entity_id", F.col("rule").cast("string").alias("rule"))).alias("l"))
    rows = tested(records, texts).withColumn("_e", every.scalar()).select("record_id", "known", F.explode("_e").alias("e"))
    return rows.select("record_id", F.col("e.entity_id").alias("entity_id"), F.coalesce(F.when(F.col("e.rule").isNull(), True).otherwise(F.try_element_at("known", F.col("e.rule"))), F.lit(False)).alias("eligible"))


def number(records: DataFrame, text: str) -> tuple[Column, bool]:
    """A SQL text as a number over records, null where it fails in any way, and whether it is a number at all; to be used inside nulls_for_failures."""
    try:
        kind = records.select(F.expr(text)).schema[0].dataType
    except (AnalysisException, ParseException):
        return F.lit(None).cast("double"), True
    return (F.expr(text).cast("double"), True) if isinstance(kind, NumericType) else (F.lit(None).cast("double"), False)


def limits(records: DataFrame, selections: DataFrame | None, limit_id: str, maximum: str, warn_at: int = 0, require_full: bool = False, usage: str | None = None) -> DataFrame:
    """(record_id, limit_id, count, maximum, remaining, over_by, severity, problem): use against a maximum.

    Use is the number of selections, or the whole number that `usage` gives, 0 where it gives none. A maximum that fails, or is no whole number from 0
    on, is null and limits nothing. `problem` says what is wrong: usage_failed, usage_not_whole, maximum_failed, maximum_not_whole, maximum_negative."""
    with nulls_for_failures(records.sparkSession):
        most, most_ok = number(records, maximum)
        used, used_ok = number(records, usage) if usage is not None else (F.lit(None).cast("double"), True)
        rows = records.select("record_id", most.alias("_m"), used.alias("_u"))
    if usage is None:
        counts = selections.groupBy("record_id").agg(F.count("*").alias("_n"))
        rows = rows.join(counts, "record_id", "left")
    else:
        rows = rows.withColumn("_n", F.when((F.col("_u") == F.floor("_u")) & (F.col("_u") >= 0), F.col("_u").cast("long")))
    whole = F.when((F.col("_m") == F.floor("_m")) & (F.col("_m") >= 0), F.col("_m").cast("long"))
    wrong = F.when(F.lit(not used_ok), "usage_not_whole").when(F.lit(usage is not None) & F.col("_u").isNull(), "usage_failed").when(F.lit(usage is not None) & F.col("_n").isNull(), "usage_not_whole")
    wrong = wrong.when(F.lit(not most_ok), "maximum_not_whole").when(F.col("_m").isNull(), "maximum_failed").when(F.col("_m") != F.floor("_m"), "maximum_not_whole").when(F.col("_m") < 0, "maximum_negative")
    rows = rows.select("record_id", F.coalesce("_n", F.lit(0).cast("long")).alias("count"), whole.alias("maximum"), wrong.alias("problem"))
    rows = rows.withColumns({"remaining": F.when(F.col("maximum").isNotNull(), F.greatest(F.col("maximum") - F.col("count"), F.lit(0))), "over_by": F.coalesce(F.greatest(F.col("maximum") - F.col("maximum"), F.col("count") - F.col("maximum")), F.lit(0).cast("long"))})
    warn = (F.col("remaining") > 0) & (F.lit(require_full) | (F.col("remaining") <= warn_at))
    return rows.select("record_id", F.lit(limit_id).alias("limit_id"), "count", "maximum", "remaining", "over_by", F.when(F.col("over_by") > 0, "error").when(warn, "warning").alias("severity"), "problem")


#: Messages of limits that have none of their own. Fixed values.
OVER, LEFT = "{label}: {count} selected, maximum {maximum}.", "{label}: {count} of {maximum} selected; {remaining} remaining."


def limit_messages(found: DataFrame, label: str, message: str = OVER, warning: str = LEFT) -> DataFrame:
    """Rows of limits with their message: the template's {label}, {count}, {maximum}, {remaining} and {over_by} filled in; other names stay as they are."""
    def filled(template: str) -> Column:
        parts = re.split(r"(\{(?:label|count|maximum|remaining|over_by)\})", template)
        return F.concat(F.lit(""), *[F.lit(label) if x == "{label}" else F.col(x[1:-1]).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])
    return found.withColumn("message", F.when(F.col("severity") == "error", filled(message)).when(F.col("severity") == "warning", filled(warning)))


def influence_map(effects: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, field, sources): the fields of effects(record_id, field) that a field depends on by edges(rule_id, dep), itself included."""
    own = written(effects.select("record_id", F.col("field").alias("source")).distinct())
    far = own.join(small(reached(edges, own)), "source").select("record_id", F.col("rule_id").alias("field"), "source")
    return far.unionByName(own.select("record_id", F.col("source").alias("field"), "source")).groupBy("record_id", "field").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def advance(records: DataFrame, available_when: str, changes: list[tuple[str, str]]) -> DataFrame:
    """Records after an action, and `advanced`: changes see the ones before them; records the action is not open to stay as they are.

    A condition that is null or fails in any way does not open it, as in `tested`; a change that fails gives null."""
    kept = [c for c in records.columns if c not in ("known", "advanced")]
    out = tested(records.select(kept), [available_when]).withColumn("advanced", F.try_element_at("known", F.lit(available_when))).drop("known")
    with nulls_for_failures(records.sparkSession):
        for name, e in changes:
            out = out.withColumn(name, F.when(F.col("advanced"), F.expr(e)).otherwise(F.col(name)) if name in out.columns else F.when(F.col("advanced"), F.expr(e)))
        return out


def apply_drafts(records: DataFrame, drafts: DataFrame) -> DataFrame:
    """drafts(record_id, base_updated_at, ...) with outcome: applied if the stored stamp is the draft's base, else conflict."""
    stored = records.select("record_id", F.col("updated_at").alias("_u"), F.lit(True).alias("_there"))
    out = drafts.join(stored, "record_id", "left")
    return out.withColumn("outcome", F.when(F.col("_there").isNull(), "missing").when(F.col("_u").eqNullSafe(F.col("base_updated_at")), "applied").otherwise("conflict")).drop("_u", "_there")


def migrate(records: DataFrame, old: dict[str, str], new: dict[str, tuple[str, object]], enums: dict[str, list[str]] | None = None, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """records on a new schema: equal types and interchangeable texts are copied, integers widen, whole decimals narrow,
    everything else takes the default; `warnings` names fields that were reset or removed, and references that were dropped.

    enums: the options of enum fields, a value that is none of them is reset. references: for reference and multi_reference fields the
    ids (entity_id) that exist; others are dropped, a reference becomes null and a list is filtered."""
    texts = {"text", "notes", "reference"}
    cols, warnings = [], []
    keep = [c for c in records.columns if c not in old]
    for i, (name, ids) in enumerate((references or {}).items()):
        if name not in new or name not in old:
            continue
        known = small(ids.select(F.col("entity_id").alias(f"_id{i}")).where("entity_id is not null").distinct())
        if new[name][0] == "reference":
            records = records.join(known, F.col(name) == F.col(f"_id{i}"), "left").withColumn(f"_gone{i}", F.col(name).isNotNull() & (F.col(name) != "") & F.col(f"_id{i}").isNull()).drop(f"_id{i}")
            records = records.withColumn(name, F.when(~F.col(f"_gone{i}"), F.col(name)))
        else:
            keyed = records.withColumn("_row", F.struct(*records.columns)).withColumn("_k", F.xxhash64("_row"))
            held = keyed.select("_k", F.explode(F.array_distinct(name)).alias("_v")).join(known, F.col("_v") == F.col(f"_id{i}")).groupBy("_k").agg(F.collect_set("_v").alias("_there"))
            joined = keyed.join(held, "_k", "left").withColumn("_there", F.coalesce("_there", F.array().cast(records.schema[name].dataType)))
            left = F.filter(name, lambda x: F.array_contains(F.col("_there"), x))
            records = joined.withColumn(f"_gone{i}", F.coalesce(F.size(left) < F.size(name), F.lit(False))).withColumn(name, left).drop("_row", "_k", "_there")
        warnings.append(F.when(F.col(f"_gone{i}"), F.lit(f"{name}: reference dropped")))
    for name, (kind, default) in new.items():
        was = old.get(name)
        if was is None:
            cols.append(F.lit(default).alias(name))
        elif was == kind == "enum" and enums and name in enums:
            fits = F.col(name).isNull() | F.col(name).isin(enums[name])
            cols.append(F.when(fits, F.col(name)).otherwise(F.lit(default)).alias(name))
            warnings.append(F.when(~fits, F.lit(f"{name}: reset")))
        elif was == kind or {was, kind} <= texts or (was, kind) == ("integer", "decimal"):
            cols.append((F.col(name).cast("double") if kind == "decimal" else F.col(name)).alias(name))
        elif (was, kind) == ("decimal", "integer"):
            whole = F.col(name) == F.floor(name)
            cols.append(F.when(whole, F.col(name).cast("long")).otherwise(F.lit(default)).alias(name))
            warnings.append(F.when(~whole, F.lit(f"{name}: reset")))
        else:
            cols.append(F.lit(default).alias(name))
            warnings.append(F.lit(f"{name}: reset"))
    warnings += [F.lit(f"{name}: removed") for name in old if name not in new]
    noted = F.filter(F.array(*warnings) if warnings else F.array().cast("array<string>"), lambda w: w.isNotNull())
    return records.select(*keep, *cols, noted.alias("warnings"))


def rule_audit(edges: DataFrame, known: DataFrame, effects: DataFrame | None = None, modifiers: DataFrame | None = None, entities: DataFrame | None = None, severities: DataFrame | None = None) -> DataFrame:
    """(rule_id, problem, name) of what is wrong with rules(edges: rule_id, dep) and known(name) fields.

    unknown_reference: a name that no field or rule defines; duplicate_id: a name defined more than once; cycle: a rule on or behind one. With
    effects(entity_type, entity_id, modifier): unknown_modifier against modifiers(name, aggregate), unknown_entity against entities. Modifiers:
    bad_aggregate, and name_collision with a field or rule. severities(rule_id, severity): bad_severity."""
    names = known.select("name").union(edges.select("rule_id")).distinct()
    unknown = edges.where("dep is not null").join(names, edges.dep == names.name, "left_anti").select("rule_id", F.lit("unknown_reference").alias("problem"), F.col("dep").alias("name"))
    twice = known.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("name").alias("rule_id"), F.lit("duplicate_id").alias("problem"), "name")
    cycles = rule_levels(edges).where("level = -1").select("rule_id", F.lit("cycle").alias("problem"), F.col("rule_id").alias("name"))
    out = unknown.distinct().unionByName(twice).unionByName(cycles)
    if effects is not None and modifiers is not None:
        out = out.unionByName(effects.join(modifiers.select(F.col("name").alias("modifier")), "modifier", "left_anti").select(F.col("entity_id").cast("string").alias("rule_id"), F.lit("unknown_modifier").alias("problem"), F.col("modifier").alias("name")).distinct())
    if effects is not None and entities is not None:
        out = out.unionByName(effects.join(entities.select("entity_type", "entity_id").distinct(), ["entity_type", "entity_id"], "left_anti").select(F.col("entity_id").cast("string").alias("rule_id"), F.lit("unknown_entity").alias("problem"), F.col("entity_type").alias("name")).distinct())
    if modifiers is not None:
        bad = modifiers.where(~F.coalesce(F.col("aggregate").isin("sum", "max", "min"), F.lit(False))).select(F.col("name").alias("rule_id"), F.lit("bad_aggregate").alias("problem"), F.col("aggregate").alias("name"))
        same = modifiers.select("name").join(names, "name", "left_semi").distinct().select(F.col("name").alias("rule_id"), F.lit("name_collision").alias("problem"), "name")
        out = out.unionByName(bad).unionByName(same)
    if severities is not None:
        out = out.unionByName(severities.where(~F.coalesce(F.col("severity").isin("error", "warning", "info"), F.lit(False))).select("rule_id", F.lit("bad_severity").alias("problem"), F.col("severity").alias("name")))
    return out
