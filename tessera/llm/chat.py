"""Chat formatting: records of many layouts become canonical turns, and turns one marked text with a loss mask. DataFrame functions only.

A record's fingerprint is the hash of the nested paths of its fields that hold a value, out of the paths that any layout names. It selects
the layout, which says declaratively which paths are whose turn. Unknown fingerprints give no turns and a null layout; their rows stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How a record of one layout is read.

    turns: (role, paths) in order; the paths' texts are joined by a blank line, and a turn without any of them is left out.
    items: (array path, role field, text field) of an array of messages. row: one message in two fields (role, text).
    `optional` paths may be absent or null; `roles` are other names of roles."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None
    row: tuple[str, str] | None = None
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.items:
            at, role, text = self.items
            return [at, f"{at}[].{role}", f"{at}[].{text}"]
        return [*self.row] if self.row else [p for _, paths in self.turns for p in paths]


LAYOUTS = (
    Layout("prompt_completion", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system", "completion")),
    Layout("prompt_response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("instruction_output", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("question_answer", turns=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
    Layout("messages", items=("messages", "role", "content"), optional=("messages[].role", "messages[].content")),
    Layout("conversations", items=("conversations", "from", "value"), optional=("conversations[].from", "conversations[].value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("row", row=("role", "text"), optional=("role", "text")),
)


# ---- layouts --------------------------------------------------------------------------------------

def kind_of(schema: StructType, path: str) -> DataType | None:
    """The type at a nested path such as `data.prompt` or `messages[].role`; None where the schema lacks it."""
    at: DataType = schema
    for name in path.split("."):
        many = name.endswith("[]")
        name = name.removesuffix("[]")
        if not isinstance(at, StructType) or name not in at.names:
            return None
        at = at[name].dataType
        if many:
            if not isinstance(at, ArrayType):
                return None
            at = at.elementType
    return at


def field(path: str, of: Column | None = None) -> Column:
    head, *more = path.split(".")
    return reduce(lambda c, name: c.getField(name), more, F.col(f"`{head}`") if of is None else of.getField(head))


def present(path: str) -> Column:
    """Whether a record has a value at the path; of an array, whether one of its items has."""
    if "[]." not in path:
        return field(path).isNotNull()
    at, inner = path.split("[].", 1)
    return F.coalesce(F.exists(field(at), lambda x: field(inner, x).isNotNull()), F.lit(False))


def fingerprint(schema: StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """XXH64 of the paths with a value, sorted, one to a line; only paths that a layout names count, so other columns do not disturb."""
    known = sorted({p for x in layouts for p in x.paths() if kind_of(schema, p) is not None})
    return F.xxhash64(F.concat_ws("\n", *[F.when(present(p), F.lit(p)) for p in known]))


def fingerprints(layout: Layout) -> list[Column]:
    """The hashes of all forms of a layout: its required paths with any of its optional ones."""
    need, free = [p for p in layout.paths() if p not in layout.optional], layout.optional
    return [F.xxhash64(F.lit("\n".join(sorted([*need, *more])))) for n in range(len(free) + 1) for more in combinations(free, n)]


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def turns_by(layout: Layout, schema: StructType) -> Column:
    """The canonical turns of a record of this layout."""
    there = lambda p: kind_of(schema, p) is not None
    if layout.row:
        return F.array(turn(*[field(p) if there(p) else F.lit(None) for p in layout.row]))
    if layout.items:
        at, role, text = layout.items
        inside = lambda x, name: field(name, x) if there(f"{at}[].{name}") else F.lit(None)

        def one(x: Column) -> Column:
            said = inside(x, role)
            named = reduce(lambda c, pair: c.when(said == pair[0], pair[1]), layout.roles, F.when(F.lit(False), "")).otherwise(said)
            return turn(named, inside(x, text))
        return F.transform(field(at), one)
    made = []
    for role, paths in layout.turns:
        texts = [field(p).cast("string") for p in paths if there(p)]
        if texts:
            made.append(F.when(reduce(lambda a, b: a | b, [t.isNotNull() for t in texts]), turn(F.lit(role), F.concat_ws("\n\n", *texts))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with fingerprint, layout and turns(role, text).

    One row for each row. Null roles and texts of messages are empty; a record whose fingerprint no layout has (empty ones too, unless the
    records have the fields of a row) gets a null layout and null turns. Added names replace input columns."""
    schema = records.schema
    usable = [x for x in layouts if all(kind_of(schema, p) is not None for p in x.paths() if p not in x.optional) and any(kind_of(schema, p) is not None for p in x.paths())]
    marked = records.withColumn("fingerprint", fingerprint(schema, layouts))
    chosen, read = F.when(F.lit(False), ""), F.when(F.lit(False), F.lit(None).cast(TURNS))
    for x in usable:
        chosen = chosen.when(F.col("fingerprint").isin(*fingerprints(x)), x.name)
        read = read.when(F.col("layout") == x.name, turns_by(x, schema))
    return marked.withColumn("layout", chosen).withColumn("turns", read.cast(TURNS))


def gathered(records: DataFrame, key: str, order: str) -> DataFrame:
    """(key, turns) of conversations whose turns lie in several records, by `order`, null first; ties by role and text.

    Records without turns add none. A conversation is one row of the result, as its text is one value."""
    rows = F.sort_array(F.collect_list(F.when(F.col("turns").isNotNull(), F.struct(F.col(order).alias("o"), F.col("turns").alias("turns")))))
    return records.groupBy(key).agg(rows.alias("rows")).select(key, F.flatten(F.transform("rows", lambda r: r["turns"])).alias("turns"))


# ---- template -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Template:
    """A turn is opens, role, parts, text, closes. All control strings are escaped inside roles and texts.

    controls: those of this and other common templates (fixed values). Each starts with one of `heads`, and none has a head again."""

    opens: str = "<|im_start|>"
    parts: str = "<|im_sep|>"
    closes: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")
    heads: str = "<["
    escape: str = "\\"

    def __post_init__(self) -> None:
        for c in (*self.controls, self.opens, self.parts, self.closes):
            if c not in self.controls or c[0] not in self.heads or any(h in c[1:] for h in self.heads + self.escape):
                raise ValueError(f"{c!r} is no control string of this template")

    def pattern(self, escapes: str) -> str:
        """A head, then escapes and the rest of a control string."""
        rest = "|".join(re.escape(c[1:]) for c in sorted(self.controls, key=lambda c: (-len(c), c)))
        return f"([{re.escape(self.heads)}]){escapes}({re.escape(self.escape)}*(?:{rest}))"

    def escaped(self, text: Column) -> Column:
        """Control strings get an escape behind their head, and those that have some get one more: none is left, and `restored` undoes it.

        A match has no head but its first character, so matches never overlap."""
        return F.regexp_replace(text, F.lit(self.pattern("")), F.lit("$1" + re.escape(self.escape) + "$2"))

    def restored(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.pattern(re.escape(self.escape))), F.lit("$1$2"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: what stands in a lambda is worked out again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def running(lengths: Column) -> Column:
    """Sums of the numbers before each one. In blocks of a root of their count, as appending copies an array."""
    zero = F.array(F.lit(0).cast("long"))
    sums = lambda of: F.aggregate(of, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def inside(every: Column) -> Column:
        n = F.size(every)
        wide = F.ceil(F.sqrt(n)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / wide).cast("int")), lambda b: sums(F.slice(every, b * wide + 1, wide)))).otherwise(F.array().cast("array<array<bigint>>"))

    def joined(blocks: Column) -> Column:
        starts = F.slice(sums(F.transform(blocks, lambda b: F.element_at(b, -1))), F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + s)))
    return bind(bind(lengths, inside), joined)


def formatted(chats: DataFrame, template: Template = Template(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:  # noqa: B008
    """chats(turns, ...) with `formatted`, and `spans`, one for each turn: code points [start, end) of its text there, and whether it counts in the loss.

    Null or no turns give an empty text. Added names replace input columns, turns goes."""
    turns = F.coalesce("turns", F.array().cast(TURNS))
    pieces = F.transform(turns, lambda t: F.struct(F.concat(F.lit(template.opens), template.escaped(t["role"]), F.lit(template.parts)).alias("lead"), template.escaped(t["text"]).alias("text"), t["role"].isin(*learn).alias("loss")))
    whole = lambda p: F.char_length(p["lead"]) + F.char_length(p["text"]) + len(template.closes)
    start = lambda p, at: at + F.char_length(p["lead"])
    span = lambda p, at: F.struct(start(p, at).alias("start"), (start(p, at) + F.char_length(p["text"])).alias("end"), p["loss"].alias("loss"))
    out = chats.withColumn("_pieces", pieces).withColumn("_at", running(F.transform("_pieces", lambda p: whole(p).cast("long"))))
    return out.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["lead"], p["text"], F.lit(template.closes))), "")).withColumn("spans", F.zip_with("_pieces", "_at", span)).drop("_pieces", "_at", "turns")


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """chats(formatted, spans, ...) with turns(role, text), and loss_text, the unescaped text under the loss mask, both out of the formatted text.

    The text is cut at its control strings, so reading takes one pass; a span applies to the cut piece of its number."""
    cut = lambda c, mark: F.split(c, re.escape(mark))
    parts = F.transform(F.filter(cut(F.col("formatted"), template.closes), lambda x: x != ""), lambda x: cut(F.substr(x, F.lit(len(template.opens) + 1)), template.parts))
    out = chats.withColumn("_parts", parts)
    turns = F.transform("_parts", lambda p: F.struct(template.restored(F.get(p, 0)).alias("role"), template.restored(F.get(p, 1)).alias("text")))
    under = F.zip_with("_parts", "spans", lambda p, s: F.when(s["loss"], template.restored(F.get(p, 1))))
    return out.withColumn("turns", turns).withColumn("loss_text", F.array_join(under, "")).drop("_parts")
