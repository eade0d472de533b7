"""The registered queries of the training-data operators, and DuckDB SQL where SQL can say the same.

No SQL: op2 (XXH64, components), op4 and op6 (trained models), op10 (XXH64 buckets), op13 (eigenvectors). Tests hold these
against brute force or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, language_id, line_dedup, merkle, mixing, quality, run_index_dedup, simhash, substring_dedup, toxicity, url_filter, whitening
from .common import table
from .repeats import attach


def remainder(by: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, "source")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    net = language_id.train(docs, ~held)
    found = language_id.identify(docs.select("doc_id", held.alias("held_out"), "text"), net, keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring_dedup.kept_texts(docs, project=["n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")])
    none = F.lit(0).cast("long")
    return attach(docs, kept, ["n_words", "n_removed", "kept_sha256"]).select(
        "doc_id", F.coalesce("n_words", none).alias("n_words"), F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("kept_sha256", F.sha2(F.lit(""), 256)).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(3) == 1, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return toxicity.score(rows, table(spark, sf_dir, "labels"), ~F.col("held_out")).select("doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_list", ","), 256).alias("items_sha256"), "contaminated")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_bytes", "n_removed", "n_spans"]
    kept = run_index_dedup.kept_bytes(docs, project=["n_bytes", "n_removed", F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")])
    return attach(docs, kept, [*names, "kept_sha256"]).select(
        "doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names], F.coalesce("kept_sha256", F.sha2(F.lit(""), 256)).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    judged = quality.judge(docs, labels.where("quality = 1").select("doc_id"), drop=("text",))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), remainder(3) == 0)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as rows, and one more conversation as prompt and completion, whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), ok.alias("prompt"), ok.alias("completion"))
    chats = chat.gathered(chat.canonical(rows.unionByName(more, allowMissingColumns=True)), "conv_id", "turn")
    back = chat.read_back(chat.formatted(chats))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_url_filter, op2_simhash, op3_line_dedup, op4_language_id, op5_substring_dedup, op6_toxicity, op7_decontamination, op8_mixing, op9_run_index_dedup, op10_quality,
    op11_merkle_manifest, op12_chat_formatting, op13_whitening)}

_SPACE = r"[\x20\x09-\x0D]+"

#: Rule columns, then the two smoothed trigram models as in url_filter, by joins instead of one array.
_OP1 = r"""
with u as (
  select row_number() over () rid, page_id, url, coalesce(contains(url, '://'), false) ok,
    case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end rest from pages),
h as (select rid, page_id, url, case when ok then translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end host,
    case when ok then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end path from u),
r as (select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from h),
t as (select *, case rule when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow' when 'net/' then 'block' when 'example.com/de/' then 'block' end act,
    host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') target, substr(md5(url), 1, 1) in ('0', '1', '2', '3') held from r),
codes as (select rid, i, case when strpos('^abcdefghijklmnopqrstuvwxyz0-._/~%=&?:+*', ch) > 0 then strpos('^abcdefghijklmnopqrstuvwxyz0-._/~%=&?:+*', ch) - 1 else 39 end c from (
    select rid, i, substr('^^' || translate(target, '^123456789', '*000000000'), i, 1) ch from (select rid, target, unnest(range(1, length(target) + 3)) i from t))),
tri as (select rid, i, lag(c, 2) over w * 1600 + lag(c, 1) over w * 40 + c code from codes window w as (partition by rid order by i) qualify lag(c, 2) over w is not null),
n as (select code, count(*) filter (where act = 'allow') n1, count(*) filter (where act = 'block') n0 from tri join t using (rid) where act is not null and not held group by code),
g as (select range code, range // 1600 a, range // 40 % 40 b, range % 40 c, coalesce(n1, 0) n1, coalesce(n0, 0) n0 from range(64000) left join n on n.code = range),
x as (select *, sum(n1) over ab s21, count(*) filter (where n1 > 0) over ab t21, sum(n1) over bc u1, sum(n1) over b_ s11, (sum(n1) over c_ + 1.0::double) / (sum(n1) over () + 40) p01,
    sum(n0) over ab s20, count(*) filter (where n0 > 0) over ab t20, sum(n0) over bc u0, sum(n0) over b_ s10, (sum(n0) over c_ + 1.0::double) / (sum(n0) over () + 40) p00
    from g window ab as (partition by a, b), bc as (partition by b, c), b_ as (partition by b), c_ as (partition by c)),
y as (select *, count(*) filter (where a = 0 and u1 > 0) over (partition by b) t11, count(*) filter (where a = 0 and u0 > 0) over (partition by b) t10 from x),
z as (select *, case when s11 = 0 then p01 else (u1 + t11 * p01) / (s11 + t11) end q1, case when s10 = 0 then p00 else (u0 + t10 * p00) / (s10 + t10) end q0 from y),
m as (select code, cast(round(1e6 * (ln(case when s21 = 0 then q1 else (n1 + t21 * q1) / (s21 + t21) end) - ln(case when s20 = 0 then q0 else (n0 + t20 * q0) / (s20 + t20) end))) as bigint) w from z),
s as (select rid, sum(w)::double / count(*) / 1e6 score from tri join m using (code) group by rid),
lim as (select (avg(score) filter (where act = 'allow') + avg(score) filter (where act = 'block')) / 2 l from t join s using (rid) where act is not null and held)
select page_id, host, path, rule, coalesce(act, case when score < l then 'block' else 'allow' end) verdict from t left join s using (rid), lim"""

_OP3 = rf"""
with d as (select row_number() over () rid, doc_id, source, text, string_split(text, chr(10)) parts from documents),
l as (select rid, source, unnest(range(1, len(parts) + 1)) i, unnest(parts) line from d),
s as (select *, regexp_replace(line, '^{_SPACE}|{_SPACE}$', '', 'g') bare from l),
n as (select source, bare, count(distinct rid) n from s where bare <> '' group by all),
h as (select source, count(*) total from d group by all),
bad as (select n.source, bare from n join h on n.source is not distinct from h.source where n >= 3 and n > 0.1 * total),
k as (select rid, count(bad.bare) n_dropped, string_agg(line, chr(10) order by i) filter (where bad.bare is null) kept
  from s left join bad on s.source is not distinct from bad.source and s.bare = bad.bare group by rid)
select doc_id, source, case when text is null then null else coalesce(kept, '') end as text, coalesce(n_dropped, 0)::int n_dropped from d left join k using (rid)"""

_OP5 = rf"""
with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') w from documents),
k as (select rid, s, md5(array_to_string(w[s : s + 34], ' ')) h from (select rid, w, unnest(range(1, len(w) - 33)) s from d where len(w) >= 35)),
r as (select rid, s from k where h in (select h from k group by h having count(*) > 1)),
c as (select distinct rid, unnest(range(s, s + 35)) i from r),
e as (select rid, unnest(w) v, unnest(range(1, len(w) + 1)) i from d),
x as (select rid, count(c.i) n, string_agg(v, ' ' order by e.i) filter (where c.i is null) kept from e left join c using (rid, i) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join x using (rid)"""

_OP7 = r"""
with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select cast(item_id as varchar) item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark where item_id is not null),
p as (select distinct item, least(len(w), 10) n, array_to_string(w[s : s + 9], ' ') phrase from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) s from b where len(w) > 0)),
k as (select rid, s, n, array_to_string(w[s : s + n - 1], ' ') phrase from (select rid, w, n, unnest(range(1, len(w) - n + 2)) s from d, (select distinct n from p) where len(w) >= n)),
m as (select rid, s, k.n, item from k join p using (n, phrase)),
hit as (select rid, count(distinct i) n_hit from (select rid, unnest(range(s, s + n)) i from m) group by rid),
it as (select rid, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from m group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (rid) left join it using (rid)"""

_OP8 = """
with n as (select source, count(*) n, power(count(*), 0.5) w from documents group by source),
r as (select source, w / (select round(sum(w), 6) from n) * (select sum(n)::double from n) / n rate from n),
p as (select *, greatest(ceil(rate / 64.0), 1)::int parts from r),
k as (select source, rate, parts, unnest(range(0, (rate / parts + 12 * sqrt(rate / parts) + 40)::int + 1)) k from p),
c as (select source, k, parts, sum(exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1))) over (partition by source order by k) c from k),
d as (select row_number() over () rid, *, coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, ''))) nm from documents),
u as (select rid, d.source, part, (('0x' || substr(md5('42:' || part || ':' || nm), 1, 13))::bigint + 0.5) / 4503599627370496.0 u
  from (select d.*, unnest(range(1, parts + 1)) part from d join p on d.source is not distinct from p.source) d),
x as (select rid, count(c.k) n from u left join c on u.source is not distinct from c.source and c.c < u.u group by rid)
select doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::int copy_no from d join x using (rid) where n > 0"""

_OP9 = """
with d as (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) x from documents),
k as (select rid, s, md5(substr(x, 2 * s + 1, 800)) h from (select rid, x, unnest(range(0, length(x) // 2 - 399)) s from d where length(x) >= 800)),
r as (select rid, s from k where h in (select h from k group by h having count(*) > 1)),
g as (select rid, s, case when s <= lag(s) over (partition by rid order by s) + 400 then 0 else 1 end new from r),
i as (select rid, s, sum(new) over (partition by rid order by s) span from g),
sp as (select rid, span, min(s) a, max(s) + 400 b from i group by all),
gap as (select rid, a, b, lag(b, 1, 0) over (partition by rid order by a) p from sp),
parts as (select rid, sum(b - a) n, count(*) spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' order by a) head, max(b) tail from gap join d using (rid) group by rid)
select doc_id, (length(x) // 2)::bigint n_bytes, coalesce(n, 0)::bigint n_removed, coalesce(spans, 0)::bigint n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) kept_sha256 from d left join parts using (rid)"""



def _op11() -> str:
    """Trees level by level: up to 8^7 documents of a language and 8^3 languages. A node alone in its tree stays as it is."""
    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 by bits: each byte is followed by eight shifts
    crc = "xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295)"
    steps: list[str] = []

    def level(nodes: str, paths: str, k: int) -> None:
        steps.append(f"r{nodes}{k} as (select tree, pos // 8 pos, (any_value(n) + 7) // 8 n, list(h order by pos) hs from {nodes}{k} where n > 1 group by tree, pos // 8)")
        steps.append(f"{nodes}{k + 1} as (select tree, pos, n, sha256(array_to_string(hs, '')) h from r{nodes}{k} union all select * from {nodes}{k} where n = 1)")
        steps.append(f"s{paths}{k} as (select p.*, hs, array_to_string(hs[: p.pos % 8], '') l, array_to_string(hs[p.pos % 8 + 2 :], '') r from {paths}{k} p left join r{nodes}{k} t on p.tree is not distinct from t.tree and p.pos // 8 = t.pos)")
        steps.append(f"{paths}{k + 1} as (select rid, tree, pos // 8 pos, proof || coalesce(l, '') || coalesce(r, '') proof, case when hs is null then cur else sha256(l || cur || r) end cur from s{paths}{k})")

    for k in range(7):
        level("n", "p", k)
    steps.append("sub as (select tree lang, h subroot, row_number() over (order by tree nulls first) - 1 pos, count(*) over () n from n7)")
    steps.append("t0 as (select 0 tree, pos, n, subroot h from sub), q0 as (select rid, 0 tree, sub.pos, proof, cur from p7 join sub on p7.tree is not distinct from sub.lang)")
    for k in range(3):
        level("t", "q", k)
    return f"""with recursive d as (select row_number() over () rid, doc_id, lang, {leaf("text")} h, {leaf(lowered)} low from documents),
x as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 pos, count(*) over (partition by lang) n from d),
n0 as (select lang tree, pos, n, h from x),
p0 as (select rid, lang tree, pos, '' proof, case when {crc} % 3 = 0 then low else h end cur from x),
{", ".join(steps)}
select doc_id, x.h leaf, subroot, t3.h root, sha256(proof) proof_sha256, cur folded_root, cur = t3.h verified
from x join q3 using (rid) join sub on sub.lang is not distinct from x.lang, t3"""


#: A control string is a head, escapes, a rest; formatting adds three marks of 12, 10 and 10 characters and one escape for each control string.
_OP12 = r"""
with a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x as (select *, [c for c in regexp_extract_all(role || chr(0) || text, '[<\[]\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|INST\]|/INST\]|\|begin_of_text\|>|\|start_header_id\|>|\|end_header_id\|>|\|eot_id\|>)')] e from a)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
  sum(length(role) + length(text) + len(e) + 32)::bigint formatted_chars from x group by conv_id"""

ORACLES = {"op1_url_filter": _OP1, "op3_line_dedup": _OP3, "op5_substring_dedup": _OP5, "op7_decontamination": _OP7, "op8_mixing": _OP8, "op9_run_index_dedup": _OP9, "op11_merkle_manifest": _op11(), "op12_chat_formatting": _OP12}
