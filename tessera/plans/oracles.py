"""DuckDB SQL that says what each query of queries.py should return."""

from __future__ import annotations

from ..functions.text import EXPANSIONS, RULE_LABEL, STOPWORDS
from ..operators.evidence import CONTENT_STOP, MEDIUM, OVERLAP, STRONG
from ..operators.inventory import TYPES

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKEN = "[A-Za-z0-9][A-Za-z0-9''_-]*"


def _stem(t: str) -> str:
    return (f"case when length({t}) > 5 and ends_with({t}, 'ied') then substr({t}, 1, length({t}) - 3) || 'y' when length({t}) > 5 and ends_with({t}, 'ing') then substr({t}, 1, length({t}) - 3) "
            f"when length({t}) > 4 and ends_with({t}, 'sed') then substr({t}, 1, length({t}) - 2) || 'e' when length({t}) > 4 and ends_with({t}, 'ed') then substr({t}, 1, length({t}) - 2) "
            f"when length({t}) > 4 and ends_with({t}, 'es') then substr({t}, 1, length({t}) - 2) when length({t}) > 3 and ends_with({t}, 's') then substr({t}, 1, length({t}) - 1) else {t} end")


_COMPACT = "translate(t, '''_-', '')"
_VARIANTS = (f"list_distinct(list_filter(list_concat([t, {_stem('t')}, {_COMPACT}, {_stem(_COMPACT)}], case when regexp_matches(t, '[-_]') then "
             f"flatten(list_transform(regexp_split_to_array(t, '[-_]+'), lambda p: [p, {_stem('p')}])) else [] end), lambda v: v <> ''))")

_PAGES = """pages_ as (select doc_id, 'doc/' || doc_id path, 'doc_' || doc_id display_name, source folder_name, text, case when toxic = 1 then 'gm' else 'players' end visibility,
  case when source in ('src3', 'src7') then 'gm' else 'players' end folder_visibility, doc_id % 50 = 0 shown from documents left join (select doc_id, max(toxic) toxic from labels group by 1) using (doc_id)),
seen as (select * from pages_ where (folder_visibility = 'players' or shown) and visibility = 'players')"""
_CHUNKS = "chunks_ as (select 'c' || lpad(cast(doc_id as varchar), 10, '0') id, 'f/' || (doc_id // 10) path, doc_id ordinal, text from documents)"
_TF = f"""{_CHUNKS}, tf as (select chunk_id, token, count(*) tf from (select chunk_id, unnest({_VARIANTS}) token from (select id chunk_id, lower(unnest(regexp_extract_all(text, '{_TOKEN}'))) t from chunks_)) group by all)"""
_EXPAND = " union all ".join(f"select '{k}' k, '{v}' v" for k, vs in EXPANSIONS.items() for v in vs)
_ASKED = f"""raw_ as (select item_id query_id, text q, lower(unnest(regexp_extract_all(text, '{_TOKEN}'))) t from benchmark),
all_ as (select query_id, unnest({_VARIANTS}) token from raw_), base_ as (select query_id, token from all_ where token not in ({_STOP})),
more_ as (select query_id, v t from base_ join ({_EXPAND}) on k = token),
found_ as (select query_id, token from base_ union select query_id, unnest({_VARIANTS}) from more_),
asked as (select query_id, token from found_ union select query_id, token from all_ where query_id not in (select query_id from found_))"""
_DF = f"{_TF}, {_ASKED}, df as (select token, count(*) df from tf where token in (select token from asked) group by 1)"
_WORDS = f"list_filter(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x)), lambda x: x not in ({_STOP}))"
_PHRASES = f"""w_ as (select item_id query_id, text, {_WORDS} w from benchmark),
quoted as (select query_id, 0 k, i, trim(lower(regexp_replace(q, '\\s+', ' ', 'g'))) phrase from (select query_id, unnest(regexp_extract_all(text, '["“](.+?)["”]', 1)) q, generate_subscripts(regexp_extract_all(text, '["“](.+?)["”]', 1), 1) i from w_)),
grams as (select query_id, 5 - k k, i, array_to_string(w[i : i + k - 1], ' ') phrase from (select query_id, w, k, unnest(range(1, len(w) - k + 2)) i from w_, (values (4), (3), (2)) v(k) where len(w) >= k)),
firsts as (select query_id, phrase, min(k * 100000 + i) o from (select * from quoted where phrase <> '' union all select * from grams) group by all),
phrases as (select query_id, (row_number() over (partition by query_id order by o) - 1)::int pos, phrase from firsts qualify pos < 20)"""
_LEXICAL = f"""{_DF}, {_PHRASES}, n_ as (select count(*) n from chunks_),
idf as (select token, ln((n + 1.0::double) / (df + 1)) + 1 idf, df <= greatest(3, ceil(n * 0.01)) rare from df, n_),
nq as (select query_id, count(*) n_tokens from asked group by 1), nr as (select query_id, count(*) n_rare from asked join idf using (token) where rare group by 1),
pairs as (select query_id, chunk_id, sum((1 + ln(tf)) * idf * idf + case when rare then 8.5 * idf else 0 end) base, count(*) matched, count(*) filter (where rare) matched_rare from tf join asked using (token) join idf using (token) group by all),
folded as (select id chunk_id, regexp_replace(lower(text), '\\s+', ' ', 'g') body from chunks_), fq as (select item_id query_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) fq from benchmark),
ph as (select query_id, chunk_id, count(*) hits from pairs join phrases using (query_id) join folded using (chunk_id) where contains(body, phrase) group by all),
lex as (select query_id, chunk_id, matched / n_tokens coverage, coalesce(matched_rare / n_rare, 0) rare_coverage, coalesce(hits, 0) + case when contains(body, fq) then 2 else 0 end phrase_hits,
  base + case when contains(body, fq) then 15 else 0 end score from pairs join nq using (query_id) join folded using (chunk_id) join fq using (query_id) left join nr using (query_id) left join ph using (query_id, chunk_id)),
top as (select query_id, chunk_id, round(score + 9.0 * phrase_hits + 6.0 * coverage + 12.0 * rare_coverage, 6) lexical_score, round(coverage, 6) coverage, round(rare_coverage, 6) rare_coverage, phrase_hits::double phrase_hits from lex),
ltop as (select *, row_number() over (partition by query_id order by lexical_score desc, chunk_id)::int lexical_rank from top qualify lexical_rank <= 100)"""
_SEMANTIC = """v_ as (select vec_id, 'c' || lpad(cast(vec_id as varchar), 10, '0') chunk_id, cast(embedding as double[]) e from embeddings),
sem as (select q.vec_id // 100 query_id, v.chunk_id, round(list_dot_product(q.e, v.e), 6) semantic_score from v_ q, v_ v where q.vec_id % 100 = 0),
stop as (select *, row_number() over (partition by query_id order by semantic_score desc, chunk_id)::int semantic_rank from sem qualify semantic_rank <= 100)"""
_FILES = """files as (select doc_id, 'doc/' || doc_id path, n_chars size, doc_id % 1000 mtime, doc_id % 13 <> 0 available, (['PDF', 'Text', 'Markdown', 'CBZ', 'Image'])[doc_id % 5 + 1] as type, doc_id % 3 = 0 scanned, doc_id % 4 = 0 ocr_current, 'Name ' || (doc_id % 100) display_name from documents)"""
_BATCHES = """b0 as (select o_custkey question_id, l_linenumber query_ord, 'c' || (l_partkey // 2) chunk_id, round(l_discount * l_quantity, 4) evidence_score, l_orderkey, l_extendedprice from lineitem join orders on l_orderkey = o_orderkey),
batches as (select *, row_number() over (partition by question_id, query_ord order by l_extendedprice desc, l_orderkey, chunk_id)::int rank from b0),
once as (select question_id, query_ord, chunk_id, min(rank) rank, arg_min(evidence_score, rank) evidence_score from batches group by all),
merged as (select question_id, chunk_id, count(*) hits, round(sum(1.0::double / rank), 9) rr, min(rank) best_rank, max(evidence_score) best_score, bool_or(query_ord = 1) original_hit,
  max(rank) filter (where query_ord = 1) original_rank, max(evidence_score) filter (where query_ord = 1) original_score from once group by all)"""
_RANKED = f"""{_BATCHES}, r_ as (select *, floor((best_score + 0.025::double * least(hits - 1, 3) + 0.0125::double * least(rr, 2.0::double) + case when original_hit then 0.025::double else 0.0::double end) * 1e6::double + 0.5::double) / 1e6::double rank_score from merged),
ranked as (select *, row_number() over (partition by question_id order by rank_score desc, best_score desc, original_hit desc, best_rank, chunk_id)::int as position from r_)"""
_CONTENT = ", ".join(f"'{w}'" for w in CONTENT_STOP)
_HAS = lambda words: " + ".join(f"contains(low, '{w}')::int" for w in words)
_LIKE = f"k.path = path and k.w <> [] and w <> [] and len(list_intersect(k.w, w))::double / least(len(k.w), len(w)) >= {OVERLAP}"


def _walk(name: str, rows: str, limit: int) -> str:
    """Greedy selection of rows(question_id, n, chunk_id, path, w) as a recursive table with kept and late ones at each n."""
    same = f"len(list_filter(kept, lambda k: {_LIKE})) > 0"
    this = "{'c': r.chunk_id, 'path': r.path, 'w': r.w}"
    return f"""{name}(question_id, n, kept, late) as (
      select question_id, 0::bigint, [{{'c': '', 'path': '', 'w': ['']}}][1:0], [''][1:0] from (select distinct question_id from {rows})
      union all select question_id, n, case when room and not same then list_append(kept, this) else kept end, case when room and same and len(late) < {limit} then list_append(late, this.c) else late end from (
        select s.question_id, r.n, kept, late, {this} this, r.path, r.w, len(kept) < {limit} room, {same} same from {name} s join {rows} r on r.question_id = s.question_id and r.n = s.n + 1)),
    {name}_end as (select * from {name} qualify row_number() over (partition by question_id order by n desc) = 1)"""


_TURNS = "turns as (select conv_id question_id, 'conv/' || conv_id path, 't' || turn chunk_id, turn, role, text from conversations)"
_RECORDS = """records as (select c_custkey record_id, c_name as name, c_custkey % 12 as level, case when c_custkey % 9 <> 0 then c_mktsegment end archetype, c_acctbal balance, c_nationkey nation, c_custkey % 1000 updated_at, c_custkey % 4 <> 0 has_archetype from customer),
sel as (select o_custkey record_id, l_partkey entity_id, l_orderkey * 10 + l_linenumber row_no, l_quantity quantity, l_returnflag = 'R' equipped from lineitem join orders on l_orderkey = o_orderkey),
ent as (select p_partkey entity_id, p_name as name, p_brand brand, p_size as size from part where p_partkey % 17 <> 0)"""
_MODIFIERS = f"""{_RECORDS}, act as (select record_id, size from sel join ent using (entity_id) join records using (record_id)),
pw as (select record_id, sum(size % 7) p from sel join ent using (entity_id) join records using (record_id) where size % 3 = 2 or (size % 3 = 0 and equipped) or (size % 3 = 1 and level >= 5) group by 1),
be as (select record_id, max(size) b from act group by 1),
mods as (select record_id, 1.0 + coalesce(p, 0)::double as power, greatest(5.0, b)::double as best from records left join pw using (record_id) left join be using (record_id))"""

_ROWS = """chars as (select c_custkey record_id, c_name as name, c_custkey % 12 as level, c_acctbal balance, case when c_custkey % 5 <> 0 then cast(c_nationkey as varchar) end home, c_custkey % 30 hp from customer),
inv as (select o_custkey record_id, row_number() over (partition by o_custkey order by l_orderkey, l_linenumber, l_quantity, l_partkey, l_returnflag = 'R') - 1 row_no, case when l_linenumber < 6 then cast(l_partkey as varchar) end item, l_quantity quantity, l_returnflag = 'R' equipped, case when l_linenumber = 7 then l_linestatus end custom_name, case when l_linenumber % 2 = 0 then ' ' else l_returnflag end notes from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
picks as (select record_id, 'nation' entity_type, home entity_id, 'home' field, null::int row_no, null::double quantity, null::boolean equipped from chars where home is not null
  union all select record_id, 'part', cast(record_id % 190 + 1 as varchar), 'skills', 0, null, null from chars union all select record_id, 'part', cast(record_id * 7 % 190 + 1 as varchar), 'skills', 1, null, null from chars
  union all select record_id, 'part', item, 'inventory', row_no, quantity, equipped from inv where item is not null)"""
_ENTITIES = """ents as (select cast(p_partkey as varchar) entity_id, p_name as name, p_brand brand, p_size as size, string_split(p_type, ' ') tags from part)"""


def _cited(c: str) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({c}, '[A-Za-z0-9][A-Za-z0-9''_.+-]*'), lambda x: lower(x))), lambda x: length(x) >= 2 and x not in ({_STOP}))"


_CASE_TYPES = "case ext " + " ".join(f"when '{k}' then '{v}'" for k, v in TYPES.items()) + " end"

_SPLIT = r"""sq_ as (select chunk_id, i, trim(regexp_replace(p, '\s+', ' ', 'g')) p from (select id chunk_id, unnest(parts) p, generate_subscripts(parts, 1) i from (select id, regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\s*\n+|\n+') parts from chunks_))),
sp_ as (select chunk_id, i, unnest(ss) p, generate_subscripts(ss, 1) j from (select chunk_id, i, case when length(p) <= 700 then [p] else string_split(regexp_replace(p, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) end ss from sq_)),
pt_ as (select chunk_id, p, lead(p) over w p2, lead(p, 2) over w p3 from sp_ where length(p) >= 25 window w as (partition by chunk_id order by i, j)),
w_p as (select chunk_id, p from pt_ union all select chunk_id, p || ' ' || p2 from pt_ where p2 is not null and length(p || ' ' || p2) <= 900 union all select chunk_id, p || ' ' || p2 || ' ' || p3 from pt_ where p3 is not null and length(p || ' ' || p2 || ' ' || p3) <= 1100),
all_p as (select chunk_id, p from w_p union all select id, regexp_replace(text, '^\s+|\s+$', '', 'g') from chunks_ where id not in (select chunk_id from w_p) and trim(text, chr(10) || chr(9) || ' ') <> '')"""
_PIECES = f"""{_SPLIT}, ruled_ as (select id chunk_id, regexp_matches(text, '{RULE_LABEL.replace("'", "''")}') ruled from chunks_),
pieces_ as (select chunk_id, regexp_replace(lower(p), '\\s+', ' ', 'g') f, list_distinct(flatten(list_transform(list_distinct(list_transform(regexp_extract_all(p, '{_TOKEN}'), lambda x: lower(x))), lambda t: {_VARIANTS}))) have, ruled and regexp_matches(p, '{RULE_LABEL.replace("'", "''")}') labelled from all_p join ruled_ using (chunk_id)),
lists_ as (select query_id, toks, coalesce(phs, []) phs from (select query_id, list(token) toks from asked group by 1) left join (select query_id, list(phrase) phs from phrases group by 1) using (query_id))"""


def _texts(name: str, pairs: str) -> str:
    """Passage and rule label scores of pairs(query_id, chunk_id)."""
    return f"""{name}_e as (select query_id, chunk_id, labelled, len(list_intersect(toks, have))::double b, len(toks) nt, len(have) nh, coalesce(list_sum(list_transform(list_filter(phs, lambda x: contains(f, x)), lambda x: least(0.35::double, 0.08::double * len(string_split(x, ' '))))), 0) bonus from {pairs} join pieces_ using (chunk_id) join lists_ using (query_id)),
{name}_s as (select *, case when b > 0 then b / nt * 0.82::double + b / nh * 0.18::double + bonus else 0.0::double end s from {name}_e),
{name} as (select query_id, chunk_id, round(max(s), 6) passage_score, round(case when any_value(ruled) then least(1.0::double, 0.35::double + coalesce(max(s) filter (where labelled), 0)) else 0.0::double end, 6) label from {name}_s join ruled_ using (chunk_id) group by all)"""


_SCORED = f"""{_LEXICAL}, {_SEMANTIC}, {_PIECES},
fused as (select query_id, chunk_id, lexical_score, lexical_rank, semantic_rank, round(coalesce(0.48::double / (60 + lexical_rank), 0) + coalesce(0.52::double / (60 + semantic_rank), 0), 9) hybrid from ltop full join stop using (query_id, chunk_id)),
{_texts("ts", "fused")},
lw as (select query_id, chunk_id, max(len(string_split(phrase, ' '))) lw from fused join phrases using (query_id) join folded using (chunk_id) where contains(body, phrase) group by all),
feats as (select query_id, chunk_id, round(lex.coverage, 6) coverage, round(lex.rare_coverage, 6) rare_coverage, lex.phrase_hits, greatest(coalesce(lw, 0), case when contains(body, fq) then len(string_split(fq, ' ')) else 0 end) lw from fused join lex using (query_id, chunk_id) join folded using (chunk_id) join fq using (query_id) left join lw using (query_id, chunk_id)),
parts_ as (select fused.*, coalesce(ts.passage_score, 0) passage_score, coalesce(label, 0) label, coalesce(coverage, 0) coverage, coalesce(rare_coverage, 0) rare_coverage, coalesce(lexical_score / max(lexical_score) over (partition by fused.query_id), 0) strength,
  case when coalesce(phrase_hits, 0) > 0 then least(1.0::double, 0.35::double + 0.18::double * phrase_hits + 0.08::double * greatest(0, lw - 1)) else 0.0::double end phrase_anchor from fused left join ts using (query_id, chunk_id) left join feats using (query_id, chunk_id)),
scored as (select *, round(hybrid + 0.0045::double * strength + 0.0050::double * coverage + 0.0090::double * phrase_anchor + 0.0060::double * rare_coverage + 0.0100::double * passage_score + 0.0110::double * label, 6) evidence_score from parts_)"""
_FINAL = f"""{_SCORED}, final_ as (select *, row_number() over (partition by query_id order by evidence_score desc, coalesce(semantic_rank, 9999), coalesce(lexical_rank, 9999), chunk_id)::int rank from scored qualify rank <= 8)"""

#: The expressions of queries._expressions and the names that each reads.
_EXPRESSIONS = """x as (select p_partkey k, 'p' || p_partkey rule_id, 'p' || (p_partkey // 2) half, case when p_partkey = 1 then 'formula' else (['formula', 'formula', 'formula', 'limit', 'eligibility'])[p_size % 5 + 1] end kind from part),
e as (select kind, rule_id, unnest(case when k % 7 = 0 then [half, 'missing'] when k % 5 = 0 then ['sizes', half] when k = 1 then ['size'] else ['size', half, 'stats'] end) dep from x where k % 50 <> 0)"""

ORACLES: dict[str, str] = {
    "visible_documents": f"with {_PAGES} select doc_id, path, folder_name, visibility from seen",
    "scoped_documents": f"with {_PAGES} select doc_id, path, folder_name from pages_ where folder_name = 'src1' and doc_id in (select doc_id from labels where quality = 1)",
    "keyword_search": f"""with {_PAGES}, asked as (select item_id query_id, text q, list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x)) terms, lower(trim(text)) phrase from benchmark where len(regexp_extract_all(text, '{_TOKEN}')) > 0), hits as (select query_id, path, display_name, text, q, terms, phrase, lower(text) body from seen, asked where len(list_filter(terms, lambda t: not contains(lower(text), t))) = 0),
        s as (select *, 20 * ((length(body) - length(replace(body, phrase, ''))) // length(phrase)) + list_sum(list_transform(terms, lambda t: 3 * ((length(body) - length(replace(body, t, ''))) // length(t))))
          + case when list_max(list_transform(terms, lambda t: strpos(body, t))) - list_min(list_transform(terms, lambda t: strpos(body, t))) <= 250 then 10 else 0 end score from hits)
        select query_id, path, 1 page, score::bigint score, row_number() over (partition by query_id order by score desc, lower(display_name), path)::int rank from s qualify rank <= 100""",
    "doc_terms_top": f"select t term, count(*) n from (select lower(unnest(regexp_extract_all(text, '{_TOKEN}'))) t from documents) group by 1",
    "stem_frequency": f"select {_stem('t')} stem, count(*) n from (select lower(unnest(regexp_extract_all(text, '{_TOKEN}'))) t from documents) group by 1",
    "token_frequency": f"with {_TF} select token, sum(tf)::bigint tf, count(*) df from tf group by 1",
    "query_phrases": f"with {_PHRASES} select query_id, pos, phrase from phrases",
    "passages": r"""with d as (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') t from documents),
        sq as (select doc_id, i, trim(regexp_replace(p, '\s+', ' ', 'g')) p from (select doc_id, unnest(parts) p, generate_subscripts(parts, 1) i from (select doc_id, regexp_split_to_array(t, '\n\s*\n+|\n+') parts from d))),
        sp as (select doc_id, i, unnest(ss) p, generate_subscripts(ss, 1) j from (select doc_id, i, case when length(p) <= 700 then [p] else string_split(regexp_replace(p, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) end ss from sq)),
        pt as (select doc_id, p, lead(p) over w p2, lead(p, 2) over w p3 from sp where length(p) >= 25 window w as (partition by doc_id order by i, j)),
        w as (select doc_id, p from pt union all select doc_id, p || ' ' || p2 from pt where p2 is not null and length(p || ' ' || p2) <= 900 union all select doc_id, p || ' ' || p2 || ' ' || p3 from pt where p3 is not null and length(p || ' ' || p2 || ' ' || p3) <= 1100),
        a as (select doc_id, p from w union all select doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') from d where doc_id not in (select doc_id from w) and trim(t, chr(10) || chr(9) || ' ') <> '')
        select doc_id, count(*) n, sum(length(p))::bigint chars, max(length(p))::int longest from a group by 1""",
    "revision_signals": r"""select doc_id, regexp_matches(regexp_replace(lower(text), '\s+', ' ', 'g'), '\bnow (?:is|are|uses?|calculated|determined|equals?|requires?)\b|\brevised\b|\bupdated\b|\bchanged\b|\breplaces?\b|\binstead\b|\bnew rule\b|\bno longer\b') revised, 0.0::double rule_label from documents""",
    "corpus_status": f"with {_CHUNKS} select count(distinct path) documents, count(distinct path) pages, sum(length(text))::bigint characters, sum(octet_length(encode(text)))::bigint bytes, count(*) chunks from chunks_",
    "doc_frequency": f"with {_DF} select token, df from df",
    "rare_tokens": f"with {_DF} select token, df from df where df <= greatest(3, ceil((select count(*) from chunks_) * 0.01))",
    "lexical_top100": f"with {_LEXICAL} select * from ltop",
    "semantic_top100": f"with {_SEMANTIC} select * from stop",
    "rrf_fused": f"""with {_LEXICAL}, {_SEMANTIC} select query_id, chunk_id, lexical_rank, semantic_rank, round(coalesce(0.48::double / (60 + lexical_rank), 0) + coalesce(0.52::double / (60 + semantic_rank), 0), 9) hybrid_score from ltop full join stop using (query_id, chunk_id)""",
    "vocabulary": """with e as (select 0 s, p_partkey ord, trim(p_brand) v from part union all select 1, p_partkey, trim(p_type) from part), n as (select *, row_number() over (partition by lower(v) order by s, ord, v) n from e) select s, ord, v as "value" from n where n = 1 order by s, ord limit 280""",
    "expand_queries": r"""with q as (select conv_id * 1000 + turn query_id, conv_id % 25 record_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) q from conversations),
        h as (select n_nationkey record_id, g, i, label, field, case when i = 2 then w else upper(n_name[1]) || lower(n_name[2:]) || ' ' || w end term from nation, (values (0, 'thes', 'x the'), (1, 'and', 'no field'), (2, '', 'of the'), (3, 'ingss', 'z'), (4, 'zz', 'to')) v(g, label, field), (values (0, 'the'), (1, 'la'), (2, 'der')) u(i, w)),
        m as (select query_id, g, i, term, (label <> '' and contains(lower(q), label)) or (rtrim(label, 's') <> '' and contains(lower(q), rtrim(label, 's'))) or contains(lower(q), field) or contains(lower(q), rtrim(field, 's')) called, contains(lower(q), lower(term)) named from q join h using (record_id)),
        f as (select query_id, arg_min(term, o) term, min(o) o from (select query_id, term, (not called)::int * 100 + g * 10 + i o from m where called or named) group by query_id, lower(term)),
        t as (select query_id, string_agg(term, '; ' order by o) t from f group by 1)
        select query_id, q || coalesce(chr(10) || 'Relevant selected character-sheet terms: ' || t, '') expanded from q left join t using (query_id)""",
    "document_records": f"""with f as (select source, lower((['pdf', 'TXT', 'md', 'exe', 'cbz', 'webp'])[doc_id % 6 + 1]) ext, 'file ' || doc_id || '.' || (['pdf', 'TXT', 'md', 'exe', 'cbz', 'webp'])[doc_id % 6 + 1] filename, 'file ' || doc_id display_name from documents), p as (select *, 'lib/' || source || '/' || filename path, {_CASE_TYPES} kind from f)
        select source folder, path, filename, display_name, kind as type, substr(sha256(path), 1, 24) doc_key, case when path = 'lib/src2/file 2.md' then 'players' when source = 'src2' then 'gm' else 'players' end visibility, case when path = 'lib/src2/file 2.md' then 'players' else 'inherit' end visibility_override from p where kind is not null""",
    "dedupe_documents": """with d as (select 'Folder' || (doc_id % 7) folder, 'p' || (doc_id // 3) path, doc_id source_ord from documents), a as (select * from d qualify row_number() over (partition by folder, path order by source_ord desc) = 1)
        select * from a qualify row_number() over (partition by path order by lower(folder), folder) = 1""",
    "snapshot_diff": f"""with {_FILES}, a as (select path, size + case when doc_id % 7 = 0 then 1 else 0 end size, mtime, available from files where doc_id % 10 <> 0), b as (select path, size, mtime from files where doc_id % 11 <> 0)
        select path, case when a.path is not null and not a.available then 'offline' when a.path is null then 'added' when b.path is null then 'removed' when a.size = b.size and a.mtime = b.mtime then 'unchanged' else 'changed' end change from a full join b using (path)""",
    "confirm_removed": """select 'root/' || source || '/' || lang || '/' || doc_id path, source in ('src1', 'src4', 'src8') removed from documents""",
    "extraction_status": f"""with {_FILES} select path, case when type = 'Image' then 'unsupported' when (type = 'CBZ' or (type = 'PDF' and scanned)) and not ocr_current then 'skipped_scanned' when doc_id % 2 = 0 and doc_id % 14 <> 0 then 'cached' else 'extracted' end status from files""",
    "artifact_gc": f"""with {_FILES} select 'a' || doc_id artifact, size bytes, doc_id % 8 <> 0 and doc_id % 19 <> 0 and doc_id % 5 <> 0 and (not available or doc_id % 6 <> 0) keep from files""",
    "prune_text": f"""with {_FILES} select path, case when doc_id % 9 = 0 then 'removed' else 'changed' end change from files where doc_id % 9 = 0 or (available and doc_id % 6 = 0)""",
    "text_status": r"""with w as (select 'conv/' || conv_id path, row_number() over (partition by conv_id order by turn) - 1 spot, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) words from conversations), n as (select path, count(*) n, least(12, count(*)) k from w group by 1),
        s as (select distinct path, round_even(i * (n - 1)::double / greatest(k - 1, 1), 0)::bigint spot from (select path, n, k, unnest(range(0, k)) i from n)), a as (select path, count(*) sampled, count(*) filter (where words >= 5) with_words, sum(words)::bigint total from w join s using (path, spot) group by 1)
        select *, case when case when sampled <= 2 then total >= 25 else with_words >= greatest(2, round_even(sampled * 0.25::double, 0)) and total >= 50 end then 'searchable' else 'scanned' end status from a""",
    "ocr_backlog": f"with {_FILES} select path, type, display_name, ocr_current ready from files where type = 'CBZ' or (type = 'PDF' and scanned)",
    "upload_names": r"""with u as (select page_id % 20 as user_, page_id arrival, regexp_extract(regexp_replace(url, '^[a-z]+://|[0-9]+', '', 'g') || ' é.txt', '([^/]*)/*$', 1) l from pages), k as (select *, regexp_replace(regexp_replace(l, '[^A-Za-z0-9._() \-\[\]]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') c from u), n as (select *, row_number() over (partition by user_, c order by arrival) n from k)
        select user_ as "user", arrival, case when n > 1 then regexp_replace(c, '\.[^.]*$', '') || ' (' || n || ')' || regexp_extract(c, '\.[^.]*$') else c end safe_name, true supported from n""",
    "natural_sort": """select p_partkey, 'Page' || (p_partkey % 120) || 'a' || (p_size % 5) || '.jpg' as name, row_number() over (partition by p_partkey % 10 order by p_partkey % 120, p_size % 5, p_partkey)::int pos from part""",
    "corpus_versions": """select doc_id, source, length(text) n, 1 as version from documents union all select doc_id, source, length(text) + 1, 2 from documents where doc_id % 3 <> 0""",
    "streamed_vectors": """with e as (select 'conv/' || conv_id || '/' || turn chunk_id, list_sum(list_transform(string_split(coalesce(text, '') || case when conv_id % 5 = 0 and conv_id % 35 <> 0 then '!' else '' end, ''), lambda x: ord(x)))::bigint s from conversations where conv_id % 7 <> 0 or conv_id % 35 = 0),
        v as (select *, sqrt(((s % 97 + 1) ** 2 + (s % 89 + 2) ** 2 + (s % 83 + 3) ** 2 + (s % 79 + 4) ** 2)::double) r from e) select chunk_id, round((s % 97 + 1) / r, 6) e0, round((s % 79 + 4) / r, 6) e3 from v""",
    "declared_issues": """with o as (select o_orderkey n, o_custkey k, row_number() over (partition by o_custkey order by o_orderkey) - 1 i, o_orderpriority p from orders), c as (select c_custkey k, * from customer), ok as (select * from c where k % 23 <> 0),
        inv as (select o.* from o join ok using (k) where k % 19 <> 0), r as (select * from inv where n % 15 <> 0)
        select k record_id, null as path, 'Character data must be a mapping/object.' message from c where k % 23 = 0
        union all select k, 'name', 'Required field is missing.' from ok where k % 6 = 0
        union all select k, 'level', case when k % 11 = 0 then 'Value does not match field type ''integer''.' when k % 14 < 1 then 'Value must be >= 1.' else 'Value must be <= 10.' end from ok where k % 11 = 0 or (k % 13 <> 0 and k % 14 not between 1 and 10)
        union all select k, 'archetype', 'Value is not one of the allowed enum options.' from ok where c_mktsegment not in ('BUILDING', 'MACHINERY')
        union all select k, 'active', 'Value does not match field type ''boolean''.' from ok where k % 17 = 0
        union all select k, 'nobody', 'Unknown character field.' from ok where k % 10 = 0
        union all select k, 'inventory', case when k % 19 = 0 then 'Value does not match field type ''collection''.' else 'Required field is missing.' end from ok where k % 19 = 0 or k not in (select k from o)
        union all select k, 'inventory[' || i || ']', 'Collection row must be a mapping/object.' from inv where n % 15 = 0
        union all select k, 'inventory[' || i || '].quantity', case when n % 9 = 0 then 'Required field is missing.' else 'Value must be >= 2.' end from r where n % 9 = 0 or n % 7 < 2
        union all select k, 'inventory[' || i || '].extra', 'Unknown collection item field.' from r where n % 10 = 0
        union all select k, 'inventory[' || i || ']', 'Collection row requires a compendium selection or custom name.' from r where n % 4 = 0 and (n % 8 = 0 or n % 12 <> 0)""",
    "vector_reuse": f"""with {_CHUNKS}, e as (select *, list_sum(list_transform(string_split(text, ''), lambda x: ord(x)))::bigint s from chunks_), v as (select *, sqrt(((s % 97 + 1) ** 2 + (s % 89 + 2) ** 2 + (s % 83 + 3) ** 2 + (s % 79 + 4) ** 2)::double) r from e), ch as (select distinct path from chunks_ where ordinal % 70 = 0)
        select id chunk_id, ordinal % 4 <> 0 and ordinal % 15 <> 0 and path not in (select path from ch) reused, round((s % 97 + 1) / r, 6) e0, round((s % 79 + 4) / r, 6) e3 from v""",
    "kb_state": """with recursive ev as (select user_id, event_type k, row_number() over (partition by user_id order by ts, event_id) n from events),
        f as (select distinct user_id, 0::bigint n, 1 l, 0 t, 0 c, 0 e from events union all
          select f.user_id, ev.n, case when k = 'signup' then l + 1 else l end, case when k = 'view' then l when k = 'error' then 0 else t end, case when k = 'click' and t = l then l when k = 'error' then 0 else c end, case when k = 'purchase' and c = l then l when k = 'error' then 0 else e end
          from f join ev on ev.user_id = f.user_id and ev.n = f.n + 1)
        select user_id library_id, l library_rev, t text_rev, c chunk_rev, e embedding_rev, e <> l needs_update from f qualify row_number() over (partition by user_id order by n desc) = 1""",
    "batch_merge": f"with {_BATCHES} select * from merged",
    "evidence_rank": f"with {_RANKED} select question_id, chunk_id, rank_score, position from ranked",
    "near_duplicates": f"""with {_TURNS}, w as (select question_id, path, chunk_id, list_distinct(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x))) w from turns),
        p as (select a.question_id, a.chunk_id a, b.chunk_id b, round(coalesce(len(list_intersect(a.w, b.w))::double / nullif(least(len(a.w), len(b.w)), 0), 0), 6) as overlap from w a join w b on a.question_id = b.question_id and a.path = b.path and a.chunk_id < b.chunk_id) select * from p where overlap >= 0.5""",
    "decisions": r"""with t as (select conv_id, turn, upper(regexp_replace(regexp_replace((['**Yes**, ', 'no - ', 'Nothing ', ''])[turn % 4 + 1] || text, '[^A-Za-z_ ]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) p from conversations) select conv_id, turn, case when regexp_matches(p, '^YES\b') then 'YES' when regexp_matches(p, '^NO\b') then 'NO' else 'CANNOT_DETERMINE' end decision from t""",
    "answer_claims": r"""with a as (select conv_id * 1000 + turn answer_id, replace(text, '. ', ' [' || (turn % 3 + 1) || '].' || chr(10)) t from conversations where role = 'assistant'), l as (select answer_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 line_no from (select answer_id, string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)) ls from a)),
        c as (select answer_id, line_no, line, trim(regexp_replace(regexp_replace(regexp_replace(line, '\[(\d{1,2})\]', ' ', 'g'), '[*_`#>]+', ' ', 'g'), '\s+', ' ', 'g')) claim from l) select answer_id, line_no::int line_no, unnest(regexp_extract_all(line, '\[(\d{1,2})\]', 1))::int source_no, claim from c where claim <> ''""",
    "numbered_sources": """with n as (select conv_id question_id, turn, row_number() over (partition by conv_id order by turn, 't' || turn) n, role, text b from conversations)
        select question_id, string_agg('[' || n || '] Turn of ' || role || case when turn > 0 then ', page ' || turn else '' end || chr(10) || b, chr(10) || chr(10) order by n) prompt from n group by 1""",
    "record_defaults": f"with {_RECORDS} select record_id, level, case when has_archetype then archetype else 'Adventurer' end archetype from records",
    "record_issues": f"""with {_RECORDS} select record_id, 'level_range' rule_id, 'error' severity, 'level out of range' message from records where level < 1 or level > 10
        union all select record_id, 'archetype_known', 'error', 'unknown archetype' from records where coalesce(archetype not in ('BUILDING', 'MACHINERY', 'AUTOMOBILE'), true) union all select record_id, 'balance_positive', 'warning', 'negative balance' from records where balance < 0""",
    "dangling_references": f"with {_RECORDS} select record_id, count(*) n, min(entity_id) first_id from sel where entity_id not in (select entity_id from ent) group by 1",
    "modifiers": f"with {_MODIFIERS} select * from mods",
    "modifier_provenance": f"""with {_RECORDS}, x as (select record_id, 'power' modifier, row_no, entity_id, case when size % 2 = 0 then 'Size ' || size else name end source_name from sel join ent using (entity_id) union all select record_id, 'best', row_no, entity_id, name from sel join ent using (entity_id))
        select record_id, modifier, count(*) n, count(*)::int as last, arg_min(source_name, row_no * 10000000 + entity_id) first_source from x group by all""",
    "calculated": f"""with {_MODIFIERS}, c as (select record_id, level * 2 + power power_score, level * 2 + power + floor(balance / 1000) rank_score from records join mods using (record_id)) select record_id, round(power_score, 6) power_score, round(rank_score, 6) rank_score, case when rank_score > 100 then 'high' else 'low' end tier from c""",
    "limits": f"""with {_RECORDS}, c as (select record_id, count(*) n from sel group by 1), m as (select record_id, coalesce(n, 0) n, (2 + floor(level / 3))::bigint m from records left join c using (record_id))
        select record_id, 'skills' limit_id, n as count, m maximum, greatest(m - n, 0) remaining, greatest(n - m, 0) over_by, case when n > m then 'error' when m - n between 1 and 1 then 'warning' end severity from m""",
    "limit_usage": f"""with {_RECORDS}, x as (select record_id, level = 7 or 3000 % nullif(level - 2, 0) <> 0 broken, case when level = 7 then 3.5::double else 3000::double / nullif(level - 2, 0) end m, case when nation = 3 then balance else floor(balance) end u from records),
        y as (select *, case when u = floor(u) and u >= 0 then u::bigint end n, case when m = floor(m) and m >= 0 then m::bigint end mx from x), z as (select *, coalesce(n, 0) c from y)
        select record_id, 'account' limit_id, c "count", mx maximum, case when mx is not null then greatest(mx - c, 0) end remaining, coalesce(greatest(c - mx, 0), 0) over_by, case when c > mx then 'error' when mx - c between 1 and 500 then 'warning' end severity,
        case when n is null then 'usage_not_whole' when m is null then 'maximum_failed' when m <> floor(m) then 'maximum_not_whole' when m < 0 then 'maximum_negative' end problem,
        case when c > mx then 'Account: ' || c || ' of ' || mx || ', ' || (c - mx) || ' over {{nothing}}' when mx - c between 1 and 500 then 'Account: ' || c || ' of ' || mx || ' selected; ' || (mx - c) || ' remaining.' end message from z""",
    "expression_levels": f"""with recursive {_EXPRESSIONS}, w as (select rule_id, dep, 1 depth from e union all select w.rule_id, e.dep, depth + 1 from w join e on w.dep = e.rule_id)
        select rule_id, coalesce(max(depth) filter (where dep is not null), 0)::int as level from w group by 1""",
    "expression_audit": f"""with {_EXPRESSIONS}, known as (select unnest(['size', 'sizes', 'stats', 'p4']) as name)
        select kind, rule_id, 'unknown_reference' problem, dep as name from e join x using (kind, rule_id) where dep is not null and dep not in (select name from known) and dep not in (select rule_id from x where kind = 'formula')
        union all select kind, rule_id, 'bad_syntax', null from x where k % 50 = 0
        union all select kind, rule_id, 'name_collision', rule_id from x where kind = 'formula' and rule_id in (select name from known)""",
    "eligibility": f"""with {_RECORDS} select record_id, count(*) filter (where coalesce(case n_regionkey when 0 then level >= 3 and archetype = 'BUILDING' when 1 then balance > 5000 else true end, false)) as open, count(*) all_entities from records, nation group by 1""",
    "temporary_effects": """with recursive r as (select l_orderkey, l_linenumber, (['add', 'subtract', 'multiply', 'override'])[l_linenumber % 4 + 1] op, l_quantity % 5 v, row_number() over (partition by l_orderkey order by l_linenumber, (['add', 'subtract', 'multiply', 'override'])[l_linenumber % 4 + 1], l_quantity % 5) n from lineitem),
        f as (select o_orderkey, 0::bigint n, floor(o_totalprice)::double x from orders union all select o_orderkey, r.n, case op when 'add' then x + v when 'subtract' then x - v when 'multiply' then x * v else v end from f join r on l_orderkey = o_orderkey and r.n = f.n + 1)
        select o_orderkey, round(x, 4) as value from f qualify row_number() over (partition by o_orderkey order by n desc) = 1""",
    "advancement": f"with {_RECORDS} select record_id, case when ok then level + 1 else level end as level, case when ok then round(balance - (level + 1) * 10, 2) else balance end balance, ok advanced from (select *, level < 10 and balance > 0 ok from records)",
    "apply_conflicts": f"with {_RECORDS} select o_orderkey, o_custkey record_id, case when r.record_id is null then 'missing' when updated_at = o_orderkey % 1000 then 'applied' else 'conflict' end outcome from orders left join records r on r.record_id = o_custkey",
    "migrate_records": f"with {_RECORDS} select record_id, name, level::double as level, case when balance = floor(balance) then balance::bigint else 0 end balance, 'migrated' note, case when balance <> floor(balance) then 'balance: reset|' else '' end || 'archetype: removed' warnings from records",
    "rule_audit": """with e as (select 'r' || p_partkey rule_id, 'r' || (p_partkey + p_size * 100) dep from part), k as (select 'f' || (p_partkey % 150) as name from part)
        select distinct rule_id, 'unknown_reference' problem, dep as name from e where dep not in (select rule_id from e) union all select name, 'duplicate_id', name from k group by name having count(*) > 1""",
    "rule_levels": """with recursive e as (select cast(p_partkey as varchar) rule_id, case when p_partkey > 1 then cast(p_partkey // 2 as varchar) end dep from part), w as (select rule_id, dep, 1 depth from e union all select w.rule_id, e.dep, depth + 1 from w join e on w.dep = e.rule_id)
        select rule_id, max(case when dep is null then 0 else depth end)::int as level from w group by 1""",
    "influence_map": """with recursive e as (select cast(p_partkey as varchar) rule_id, cast(p_partkey // 2 as varchar) dep from part where p_partkey >= 2), w as (select rule_id, dep from e union select w.rule_id, e.dep from w join e on w.dep = e.rule_id),
        own as (select distinct user_id record_id, cast(event_id * 7919 % (select count(*) from part) + 1 as varchar) f from events), a as (select record_id, rule_id field, f from own join w on w.dep = f union select record_id, f, f from own) select record_id, field, string_agg(f, ',' order by f) sources from a group by all""",
    "coerced": "with forms as (select c_custkey record_id, case when c_custkey % 3 <> 0 then c_name end as name, case when c_custkey % 4 = 0 then ' ' when c_custkey % 7 = 0 then '7a' else cast(c_custkey % 20 as varchar) end as level, c_custkey % 6 = 0 bad, c_acctbal balance, c_custkey % 2 = 0 active, c_mktsegment || '|' || c_name skills, (c_custkey % 9)::double hp, case when c_custkey % 5 <> 0 then 10.0::double end hp_max from customer) select record_id, coalesce(name, '') as name, try_cast(nullif(trim(level), '') as bigint) as level, case when not bad then balance end balance, active, skills, hp, hp_max from forms",
    "entities_issues": r"""with r as (select 'part' entity_type, case when p_partkey % 40 = 0 then 'Bad ' else 'p' end || (p_partkey % 1500) id, case when p_partkey % 33 <> 0 then p_name end as name, p_partkey ord from part), n as (select *, row_number() over (partition by entity_type, id order by ord) n from r)
        select entity_type, id, ord, case when id like 'Bad %' then 'bad id' when coalesce(trim(name), '') = '' then 'empty name' else 'duplicate id' end problem from n where id like 'Bad %' or coalesce(trim(name), '') = '' or n > 1""",
    "import_records": "select c_mktsegment as owner, cast(c_custkey as varchar) record_id, case when c_custkey % 3 = 0 then 0.0 else c_acctbal end::double balance from customer where c_custkey % 3 = 0 or c_custkey % 2 = 0",
    "records_for": """with n as (select *, n_nationkey = min(n_nationkey) over (partition by n_regionkey) gm from nation) select v.n_nationkey viewer, v.n_nationkey = c_nationkey own, c_custkey from customer join nation o on c_nationkey = o.n_nationkey join n v on v.n_regionkey = o.n_regionkey where gm or v.n_nationkey = c_nationkey""",
    "autofill": "select l_orderkey, l_linenumber, l_partkey, coalesce(case when l_linenumber > 2 then nullif(trim(l_returnflag), '') end, case when p_partkey % 17 <> 0 then p_brand end) note from lineitem left join part on p_partkey = l_partkey",
    "search_hints": f"""with {_ROWS}, {_ENTITIES}, m as (select record_id, field, lower(trim(name)) l, min({{'r': coalesce(row_no, -1), 'n': name}}) f from picks join ents using (entity_id) where entity_type = 'part' group by all)
        select record_id, field, row_number() over (partition by record_id, field order by f.r, f.n)::int n, trim(f.n) as name from m qualify n <= 24""",
    "rendered_records": f"""with {_ROWS}, i as (select record_id, string_agg(chr(10) || '  - ' || concat_ws(', ', 'item: ' || item, 'quantity: ' || quantity, 'equipped: ' || equipped, 'custom_name: ' || custom_name, 'notes: ' || notes), '' order by row_no) t from inv group by 1)
        select record_id, concat_ws(chr(10), 'Name: ' || name, 'Level: ' || level, 'Home: ' || n_name, 'Skills: ' || (record_id % 190 + 1) || ', ' || (record_id * 7 % 190 + 1), 'Hit points: ' || hp::double || '/' || (hp + 2)::double, 'Inventory:' || t) as text from chars left join nation on cast(n_nationkey as varchar) = home left join i using (record_id)""",
    "snippet_search": f"""with {_PAGES}, asked as (select item_id query_id, text q, list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x)) terms, lower(trim(text)) phrase from benchmark where len(regexp_extract_all(text, '{_TOKEN}')) > 0), hits as (select query_id, path, display_name, text, q, terms, phrase, lower(text) body from pages_, asked where len(list_filter(terms, lambda t: not contains(lower(text), t))) = 0),
        s as (select *, 20 * ((length(body) - length(replace(body, phrase, ''))) // length(phrase)) + list_sum(list_transform(terms, lambda t: 3 * ((length(body) - length(replace(body, t, ''))) // length(t))))
          + case when list_max(list_transform(terms, lambda t: strpos(body, t))) - list_min(list_transform(terms, lambda t: strpos(body, t))) <= 250 then 10 else 0 end score from hits),
        at_ as (select *, row_number() over (partition by query_id order by score desc, lower(display_name), path)::int rank, case when strpos(body, phrase) > 0 then strpos(body, phrase) - 1 else coalesce(list_min(list_filter(list_transform(terms, lambda t: strpos(body, t)), lambda i: i > 0)) - 1, 0) end at_ from s),
        ab as (select *, greatest(0, at_ - 180) a, least(length(text), at_ + length(trim(q)) + 180) b from at_ where rank <= 10)
        select query_id, path, rank, case when a > 0 then '…' else '' end || trim(regexp_replace(substr(text, a + 1, b - a), '\\s+', ' ', 'g')) || case when b < length(text) then '…' else '' end snippet from ab""",
    "evidence_select": f"""with recursive {_RANKED}, t as (select 'c' || doc_id chunk_id, concat_ws('/', source, lang) path, list_distinct(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x))) w from documents),
        rw as (select ranked.*, path, coalesce(w, []) w from ranked left join t using (chunk_id)), own as (select *, row_number() over (partition by question_id order by original_score desc, original_rank, chunk_id) n from rw where original_hit),
        {_walk("g1", "own", 3)}, kept1 as (select question_id, unnest(kept).c chunk_id from g1_end),
        o as (select own.question_id, own.chunk_id, n, k.chunk_id is not null kept from own left join kept1 k on k.question_id = own.question_id and k.chunk_id = own.chunk_id),
        p as (select *, case when kept then 0 when count(*) filter (where kept) over q < 3 or n < max(n) filter (where kept) over q then 1 else 2 end part from o window q as (partition by question_id)),
        rows_ as (select rw.question_id, rw.chunk_id, rw.path, rw.w, row_number() over (partition by rw.question_id order by coalesce(part, 2), case when coalesce(part, 2) < 2 then p.n end, position) n from rw left join p on p.question_id = rw.question_id and p.chunk_id = rw.chunk_id),
        {_walk("g2", "rows_", 12)}, chosen as (select question_id, unnest(list_concat(list_transform(kept, lambda k: k.c), late[1 : 12 - len(kept)])) chunk_id from g2_end)
        select question_id, chunk_id, rank_score from ranked join chosen using (question_id, chunk_id)""",
    "query_aware_rank": f"""with c as (select conv_id question_id, 'conv/' || conv_id || '/t' || turn chunk_id, turn, role, round(length(text) / 10000.0::double, 6) best_score, length(text) % 10 / 10.0::double passage, list_filter(list_distinct(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x))), lambda x: length(x) >= 3 and x not in ({_CONTENT})) w from conversations),
        q as (select question_id, w q from c where role = 'user'), s as (select c.question_id, c.chunk_id, max(coalesce(len(list_intersect(q, w))::double / nullif(len(q), 0), 0)) share from c join q using (question_id) group by all),
        p as (select question_id, chunk_id, turn, best_score, round(best_score + 0.030::double * share + 0.010::double * passage, 6) pipeline_score from c join s using (question_id, chunk_id))
        select question_id, chunk_id, pipeline_score, row_number() over (partition by question_id order by pipeline_score desc, best_score desc, turn, chunk_id)::int as position from p""",
    "procedural_anchor": f"""with c as (select source || '/' || (doc_id % 50) question_id, lpad(cast(doc_id as varchar), 10, '0') chunk_id, n_chars score, regexp_replace(lower(coalesce(text, '') || (['', ' You can buy it.', ' A player may  pay the cost.', ' This must not exceed the maximum', ' Unless required, it is allowed.', '', ''])[doc_id % 7 + 1]), '\\s+', ' ', 'g') low from documents),
        h as (select *, {_HAS(STRONG)} strong, {_HAS(MEDIUM)} medium from c) select question_id, chunk_id, (strong * 4 + medium)::int total, strong::int strong, medium::int medium from h where strong + medium > 0
        qualify row_number() over (partition by question_id order by strong * 4 + medium desc, strong desc, medium desc, score desc, chunk_id) = 1""",
    "citation_excerpts": f"""with raw as (select conv_id * 1000 + turn answer_id, text, role, turn from conversations), a as (select answer_id, replace(text, '. ', ' [' || (turn % 3 + 1) || '].' || chr(10)) t from raw where role = 'assistant'),
        l as (select answer_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 line_no from (select answer_id, string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)) ls from a)),
        c as (select answer_id, line_no, unnest(regexp_extract_all(line, '\\[(\\d{{1,2}})\\]', 1))::int source_no, trim(regexp_replace(regexp_replace(regexp_replace(line, '\\[(\\d{{1,2}})\\]', ' ', 'g'), '[*_`#>]+', ' ', 'g'), '\\s+', ' ', 'g')) claim from l),
        ct as (select answer_id, line_no, source_no, {_cited('claim')} c from c where claim <> ''), src as (select answer_id, unnest([1, 2, 3]) source_no, text from raw),
        ps as (select answer_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+|' || chr(1)), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: length(p) >= 20) ps from raw where answer_id in (select answer_id from ct)),
        pw as (select answer_id, i, k, array_to_string(ps[i : i + k], ' ') p from (select answer_id, ps, unnest(range(1, len(ps) + 1)) i from ps), (values (0), (1), (2)) v(k) where i + k <= len(ps)),
        pt as (select answer_id, i, k, p, {_cited('p')} t from pw where length(p) <= 700),
        sc as (select ct.answer_id, source_no, line_no, i, k, p, len(list_intersect(c, t))::double b, len(c) nc, len(t) nt, list_filter(c, lambda x: length(x) >= 5 or regexp_matches(x, '\\d')) sp, t from ct join pt on ct.answer_id = pt.answer_id),
        s2 as (select *, round(b / nc * 0.82 + b / nt * 0.18 + coalesce(0.25 * len(list_intersect(sp, t)) / nullif(len(sp), 0), 0), 6) score from sc where b > 0),
        best as (select answer_id, source_no, score, p from s2 where score > 0 qualify row_number() over (partition by answer_id, source_no order by score desc, line_no, i, k) = 1)
        select src.answer_id, src.source_no, coalesce(score, 0.0)::double score, case when score >= 0.2 then substr(p, 1, 700) else substr(trim(text), 1, 520) end citation_excerpt from src left join best on best.answer_id = src.answer_id and best.source_no = src.source_no""",
    "html_pages": r"""with a as (select page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->', ' ', 'g') t from pages), b as (select page_id, regexp_replace(regexp_replace(t, '(?i)</(p|div|li|tr|h[1-6]|ul|nav|table)>|<br\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g') t from a),
        c as (select page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') t from b)
        select page_id, trim(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) as text from c""",
    "coerce_issues": "with forms as (select c_custkey record_id, case when c_custkey % 3 <> 0 then c_name end as name, case when c_custkey % 4 = 0 then ' ' when c_custkey % 7 = 0 then '7a' else cast(c_custkey % 20 as varchar) end as level, c_custkey % 6 = 0 bad, c_acctbal balance, c_custkey % 2 = 0 active, c_mktsegment || '|' || c_name skills, (c_custkey % 9)::double hp, case when c_custkey % 5 <> 0 then 10.0::double end hp_max from customer) select record_id, 'level' field, 'not a number of kind integer' message from forms where level = '7a' union all select record_id, 'balance', 'not a number of kind decimal' from forms where bad",
    "selections": f"with {_ROWS} select record_id, entity_type, entity_id, field, row_no::int row_no, quantity, equipped from picks",
    "record_functions": f"""with {_ROWS}, s as (select record_id, round(sum(quantity), 4) quantity, round(sum(quantity) filter (where equipped), 4) worn, count(*) filter (where equipped) n_worn, count(*) filter (where trim(notes) <> '') noted, count(*) filter (where equipped and trim(notes) <> '') worn_noted from inv group by 1)
        select record_id, round_even(level / 2.0::double, 0)::bigint half, 2 skills, length(name)::int letters, 0 "none", coalesce(quantity, 0.0)::double quantity, 0.0::double no_number, coalesce(worn, 0.0)::double worn, coalesce(n_worn, 0)::int n_worn, coalesce(noted, 0)::int noted, coalesce(worn_noted, 0)::int worn_noted, (hp + 2)::double "most" from chars left join s using (record_id)""",
    "explanations": f"""with {_MODIFIERS}, q as (select record_id, round(sum(quantity), 4) load from sel group by 1), x as (select record_id, level, power, coalesce(load, 0) load, level * 2 + power - coalesce(load, 0) ps from records join mods using (record_id) left join q using (record_id)),
        src as (select record_id, count(*) n, arg_min(case when size % 2 = 0 then 'Size ' || size else name end, row_no * 10000000 + entity_id) f from sel join ent using (entity_id) group by 1)
        select record_id, 'power_score' rule_id, 0 term_no, 'Level * 2' as label, (level * 2)::double as "value", 0 n_sources, null::varchar first_source from x union all select record_id, 'power_score', 1, 'Power', power, coalesce(n, 0)::int, f from x left join src using (record_id)
        union all select record_id, 'power_score', 2, 'Load', -load::double, 0, null from x union all select record_id, 'rank', 0, 'Power Score / Level', round(ps / nullif(level, 0), 6)::double, 0, null from x""",
    "explanation_inputs": f"""with {_MODIFIERS}, x as (select record_id, level, power, (level * 2 + power)::bigint ps from records join mods using (record_id))
        select record_id, 'power_score' rule_id, 0 input_no, 'level' id, 'Level' as label, 'field' kind, level::double as "value" from x union all select record_id, 'power_score', 1, 'power', 'Power', 'modifier', power from x union all select record_id, 'rank', 0, 'power_score', 'Power Score', 'calculated', ps::double from x""",
    "selected_ineligible": f"""with {_ROWS}, {_ENTITIES}, x as (select p.record_id, field, entity_id, e.name, size, level from picks p join ents e using (entity_id) join chars c on c.record_id = p.record_id where entity_type = 'part' and field = 'skills' and size % 4 <> 3)
        select record_id, field, entity_id, 'error' severity, name || ' is not eligible. ' || case when size % 3 = 0 then 'Too early.' else 'Requirements are not met.' end message from x where not coalesce(case size % 4 when 0 then level >= 6 when 1 then 100.0::double / nullif(level, 0) > 20 else false end, false)""",
    "limits_where": f"""with {_ROWS}, {_ENTITIES}, c as (select record_id, count(*) n from picks join ents using (entity_id) where field = 'inventory' and list_contains(tags, 'BRASS') and brand = 'Brand#11' group by 1), m as (select record_id, coalesce(n, 0) n, (1 + floor(level / 4))::bigint m from chars left join c using (record_id))
        select record_id, 'brass' limit_id, n as count, m maximum, greatest(m - n, 0) remaining, greatest(n - m, 0) over_by, case when n > m then 'error' when m - n between 1 and 1 then 'warning' end severity from m""",
    "final_changes": f"with {_RECORDS}, a as (select record_id, balance, case when level % 2 = 0 then level // 2 + 1 end as level from records) select record_id, level, round(balance + level, 2) balance from a",
    "rules_in_scope": """with recursive e as (select p_partkey k, case when p_partkey > 1 then p_partkey // 2 end dep from part), st as (select p_partkey k, p_size % 6 step from part where p_size % 3 = 0), c as (select * from e where dep is not null and k not in (select k from st)),
        w as (select k, dep from c union select w.k, c.dep from w join c on w.dep = c.k), n as (select w.k, max(step) s from w join st on st.k = w.dep group by 1)
        select p_partkey % 10 record_id, cast(p_partkey as varchar) rule_id, p_name message from part left join n on n.k = p_partkey where coalesce(s, 2) <= 2""",
    "placeholder_rows": f"""with {_ROWS}, l as (select record_id, count(*) n, count(*) filter (where coalesce(item, '') <> '' or coalesce(trim(custom_name), '') <> '' or not coalesce(quantity = 1, true) or coalesce(equipped, false) or coalesce(notes, '') <> '') k from inv group by 1) select record_id, coalesce(k, -1)::int "left", coalesce(n, -1)::int all_rows from chars left join l using (record_id)""",
    "effective_values": """with recursive o as (select o_custkey r, (['add', 'multiply', 'subtract'])[o_orderkey % 3 + 1] op, (o_orderkey % 4)::double v, row_number() over (partition by o_custkey order by o_orderkey) n from orders),
        f as (select c_custkey r, 0::bigint n, (c_custkey % 12 * 2)::double x from customer union all select f.r, o.n, case op when 'add' then x + v when 'subtract' then x - v else x * v end from f join o on o.r = f.r and o.n = f.n + 1)
        select r record_id, x base, x + 10 total from f qualify row_number() over (partition by r order by n desc) = 1""",
    "staged_effects": f"""with {_RECORDS}, t as (select o_custkey record_id, sum(case o_orderkey % 5 when 0 then o_orderkey % 3 when 1 then -(o_orderkey % 3) end) dl, count(*) filter (o_orderkey % 5 = 2) nb, sum(o_orderkey % 3) filter (o_orderkey % 5 = 3) ds from orders group by 1),
        adj as (select c_custkey record_id, c_custkey % 12 old, (c_custkey % 12 + coalesce(dl, 0))::double lv, c_acctbal was, c_acctbal * power(2, coalesce(nb, 0)) bal, coalesce(ds, 0)::double ds from customer left join t on c_custkey = record_id),
        pw as (select record_id, sum(size % 7) p from sel join ent using (entity_id) join adj using (record_id) where size % 3 = 2 or (size % 3 = 0 and equipped) or (size % 3 = 1 and lv >= 5) group by 1)
        select record_id, lv as level, bal balance, 1.0 + coalesce(p, 0)::double as power, lv * 2 + 1.0 + coalesce(p, 0) + ds power_score, lv * 2 + 1.0 + coalesce(p, 0) + ds + 10 tier, concat_ws(',', case when lv <> old then 'level' end, case when bal <> was then 'balance' end) modified from adj left join pw using (record_id)""",
    "migrate_nested": """with p as (select cast(p_partkey as varchar) id from part where p_size % 5 <> 0), h as (select cast(n_nationkey as varchar) id from nation where n_regionkey <> 1),
        c as (select c_custkey k, c_name nm, c_nationkey nk, c_mktsegment seg, cast(c_custkey % 190 + 1 as varchar) a, cast(c_custkey * 7 % 230 + 1 as varchar) b from customer),
        o as (select o_orderkey n, o_custkey k, o_orderpriority l, cast(o_orderkey % 230 as varchar) item, row_number() over (partition by o_custkey order by o_orderkey) - 1 i, count(*) filter (o_orderkey % 15 <> 0) over (partition by o_custkey order by o_orderkey) - 1 j from orders),
        r as (select *, item in (select id from p) ok from o),
        g as (select k, string_agg('{' || case when ok then '"item":"' || item || '",' else '' end || '"label":"' || l || '","own":false' || case when n % 4 <> 0 then ',"quantity":' || (n % 7) else '' end || '}', ',' order by n) filter (n % 15 <> 0) inv,
            string_agg('|inventory[' || i || ']' || case when n % 15 = 0 then ': invalid collection row was dropped.' else '.quantity: decimal value ' || (n % 7) || '.5 cannot be represented as an integer and was reset.' end, '' order by n) filter (n % 15 = 0 or n % 4 = 0) w1,
            string_agg('|inventory[' || j || '].item: obsolete reference ''' || item || ''' was reset.', '' order by n) filter (n % 15 <> 0 and not ok) w2,
            string_agg('; ERROR: inventory[' || j || '].quantity: Value must be >= 2.', '' order by n) filter (n % 15 <> 0 and n % 4 <> 0 and n % 7 < 2) w3 from r group by k),
        x as (select c.*, inv, w1, w2, w3, c.a in (select id from p) as ha, c.b in (select id from p) as hb, cast(nk as varchar) in (select id from h) as hn from c left join g using (k)),
        y as (select *, (not ha)::int + (not hb)::int lost, case when k % 14 > 10 then '; ERROR: level: Value must be <= 10.' else '' end || coalesce(w3, '') bad from x)
        select k record_id, case when k % 23 <> 0 then '{"active":false,"balance":' || case when k % 2 = 1 then 0 else nk end || case when hn then ',"home":"' || nk || '"' else '' end || ',"inventory":[' || coalesce(inv, '') || '],"level":' || (k % 14) || ',"name":"' || nm || '","segment":"' || case when seg = 'MACHINERY' then seg else 'BUILDING' end || '","skills":[' || concat_ws(',', case when ha then '"' || a || '"' end, case when hb then '"' || b || '"' end) || ']}' end as data,
            case when k % 3 = 0 then '{"level":[{"op":"add","value":' || (k % 5) || '}]}' end effects,
            case when k % 23 = 0 then '' else substr(case when k % 2 = 1 then '|balance: decimal value ' || nk || '.5 cannot be represented as an integer and was reset.' else '' end || case when seg not in ('BUILDING', 'MACHINERY') then '|segment: old value ''' || seg || ''' is not valid in the new enum and was reset.' else '' end || coalesce(w1, '') || '|Removed field(s) not carried forward: archetype'
                || case when hn then '' else '|home: reference ''' || nk || ''' no longer exists and was reset.' end || case when lost > 0 then '|skills: ' || lost || ' obsolete reference(s) were removed.' else '' end || coalesce(w2, ''), 2) end
            || case when k % 3 <> 0 then '' when k % 23 = 0 then 'Temporary effect(s) for removed field(s) were discarded: archetype|' else '|Temporary effect(s) for removed field(s) were discarded: archetype' end
            || case when k % 23 = 0 then 'Character needs manual review under the new schema: ERROR: Character data must be a mapping/object.' when bad <> '' then '|Character needs manual review under the new schema: ' || substr(bad, 3) else '' end warnings from y""",
    "migrate_references": """with c as (select c_custkey k, cast(c_custkey % 190 + 1 as varchar) a, cast(c_custkey * 7 % 230 + 1 as varchar) b, cast(c_nationkey as varchar) home, c_mktsegment seg from customer), p as (select cast(p_partkey as varchar) id from part where p_size % 5 <> 0), n as (select cast(n_nationkey as varchar) id from nation where n_regionkey <> 1),
        x as (select *, list_filter([case when a in (select id from p) then a end, case when b in (select id from p) then b end], lambda v: v is not null) l, home in (select id from n) ok from c)
        select k record_id, array_to_string(l, ',') skills, case when ok then home end home, case when seg in ('BUILDING', 'MACHINERY') then seg else 'OTHER' end archetype,
          array_to_string(list_filter([case when len(l) < 2 then 'skills: reference dropped' end, case when not ok then 'home: reference dropped' end, case when seg not in ('BUILDING', 'MACHINERY') then 'archetype: reset' end], lambda v: v is not null), '|') warnings from x""",
    "audit_effects": """with e as (select p_partkey * 2 id, 'm' || (p_size % 9) m from part) select 'loop' || i rule_id, 'cycle' problem, 'loop' || i as name from range(4) t(i) union all select distinct cast(id as varchar), 'unknown_modifier', m from e where m in ('m7', 'm8')
        union all select distinct cast(id as varchar), 'unknown_entity', 'part' from e where id not in (select p_partkey from part) union all select m, 'bad_aggregate', 'mean' from (values ('m2'), ('m5')) v(m) union all select distinct p_name, 'bad_severity', 'fatal' from part where p_size % 10 = 0""",
    "corpus_totals": f"""with {_CHUNKS}, v as (select 'c' || lpad(cast(vec_id as varchar), 10, '0') id, len(embedding) n from embeddings where label < 5)
        select count(distinct path) documents, count(distinct path) pages, sum(length(text))::bigint characters, sum(octet_length(encode(text)))::bigint bytes, count(*) chunks, (select count(*) from v) vectors, (select min(n)::int from v) least_dimensions, (select max(n)::int from v) most_dimensions,
          not exists (select 1 from chunks_ where id not in (select id from v)) and not exists (select 1 from v where id not in (select id from chunks_)) "current" from chunks_""",
    "envelope_checks": """select c_custkey record_id, case when c_custkey % 11 = 0 then 'unknown format' when c_custkey % 7 = 0 then 'unsupported version' else 'missing ' || concat_ws(', ', case when c_custkey % 5 = 0 then 'owner' end, case when c_custkey % 3 = 0 then 'system_id' end) end problem
        from customer where c_custkey % 11 = 0 or c_custkey % 7 = 0 or c_custkey % 5 = 0 or c_custkey % 3 = 0""",
    "evidence_ranked": f"with {_FINAL} select query_id, chunk_id, evidence_score, passage_score, phrase_anchor, rank from final_",
    "retrieval_report": f"""with {_FINAL} select query_id, count(*) hits, max(evidence_score) best, round(avg(passage_score), 6) mean_passage, count(*) filter (where lexical_rank is not null and semantic_rank is null) lexical_only,
        count(*) filter (where lexical_rank is null and semantic_rank is not null) semantic_only, count(*) filter (where lexical_rank is not null and semantic_rank is not null) "both" from final_ group by 1""",
    "neighbor_rescue": f"""with {_SCORED}, pos as (select id chunk_id, path, row_number() over (partition by path order by ordinal) pos from chunks_),
        par as (select query_id, chunk_id, evidence_score parent from scored qualify row_number() over (partition by query_id order by evidence_score desc, chunk_id) <= 40),
        near as (select query_id, b.chunk_id, max(parent * 0.55::double * case when abs(b.pos - a.pos) = 1 then 1.0::double else 0.72::double end) base from par join pos a using (chunk_id) join pos b on a.path = b.path and b.pos between a.pos - 2 and a.pos + 2 and a.pos <> b.pos group by all),
        {_texts("tn", "near")}, res as (select query_id, chunk_id, round(base + 0.0120::double * passage_score + 0.0140::double * label, 6) rescue from near join tn using (query_id, chunk_id) where passage_score > 0 or label > 0)
        select query_id, chunk_id, greatest(evidence_score, rescue) evidence_score, rescue is not null neighbor_rescued from scored full join res using (query_id, chunk_id)""",
}
