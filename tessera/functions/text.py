"""Text primitives as Column functions: terms, stems, tokens, phrases, passages, scores, snippets. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9][A-Za-z0-9'_-]*"
# Words without search value.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have",
    "he", "her", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "my", "of", "on", "or", "our", "she", "should", "so",
    "some", "that", "the", "their", "them", "then", "there", "they", "this", "to", "was", "we", "were", "what", "when", "where", "which", "who",
    "why", "will", "with", "would", "you", "your",
]
# Terms that a query term also searches for.
EXPANSIONS = {
    "skill": ["ability", "abilities"], "skills": ["ability", "abilities"], "try": ["attempt", "roll", "check"], "tries": ["attempt", "roll", "check"],
    "trying": ["attempt", "roll", "check"], "purchase": ["purchased", "buy", "bought", "rank"], "purchased": ["purchase", "buy", "bought", "rank"],
    "unpurchased": ["untrained", "unrestricted", "restricted", "rank"], "never": ["without", "zero", "none"], "hitpoint": ["hp", "hitpoints"],
    "hitpoints": ["hp", "hitpoint"], "tedious": ["slow", "long", "tough"], "dangerous": ["threat", "challenge", "combat"], "marching": ["position", "positioning", "order"],
}
# Patterns of rule labels at a line's start and of wording that announces a revision.
RULE_LABEL = r"(?im)^\s*(?:too\s+tough\s+rule|too\s+weak\s+rule|design\s+note|gm(?:'s)?\s+note|game\s+master(?:'s)?\s+note|optional\s+rule|special\s+rule|important\s+rule|rule)\s*[:.-]"
REVISION = r"\bnow (?:is|are|uses?|calculated|determined|equals?|requires?)\b|\brevised\b|\bupdated\b|\bchanged\b|\breplaces?\b|\binstead\b|\bnew rule\b|\bno longer\b"


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def fold(c: Column) -> Column:
    """Lower case, white space collapsed; single spaces, most of it, are not replaced by themselves."""
    return F.regexp_replace(F.lower(c), r"[\t\n\x0B\f\r]\s*| \s+", " ")


def terms(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)


def stem(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (F.when((n > 5) & t.endswith("ied"), F.concat(cut(3), F.lit("y"))).when((n > 5) & t.endswith("ing"), cut(3))
            .when((n > 4) & t.endswith("sed"), F.concat(cut(2), F.lit("e"))).when((n > 4) & t.endswith("ed"), cut(2))
            .when((n > 4) & t.endswith("es"), cut(2)).when((n > 3) & t.endswith("s"), cut(1)).otherwise(t))


def variants(t: Column) -> Column:
    """The set of forms under which one raw token is found: itself, compact, parts, and the stems of these."""
    compact = F.translate(t, "'_-", "")
    parts = F.flatten(F.transform(F.split(t, "[-_]+"), lambda p: F.array(p, stem(p))))
    every = F.concat(F.array(t, stem(t), compact, stem(compact)), F.when(t.rlike("[-_]"), parts).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda v: v != ""))


def tokens(c: Column) -> Column:
    return F.flatten(F.transform(terms(c), variants))


def query_tokens(c: Column, stop=STOPWORDS, expansions=EXPANSIONS) -> Column:
    """Distinct query tokens: without stopwords, with expansions; all tokens if nothing else is left."""
    table = F.create_map(*[x for k, v in expansions.items() for x in (F.lit(k), words_array(v))])
    def expand(base: Column) -> Column:
        more = F.flatten(F.transform(base, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
        return F.concat(base, F.flatten(F.transform(more, variants)))
    every = tokens(c)
    found = bind(F.filter(every, lambda t: ~t.isin(*stop)), expand)
    return F.array_distinct(F.when(F.size(found) > 0, found).otherwise(every))


def query_phrases(c: Column, stop=STOPWORDS) -> Column:
    """Quoted spans, then 4-, 3- and 2-grams of the words that are no stopwords; distinct, 20 at most."""
    quoted = F.filter(F.transform(F.regexp_extract_all(c, F.lit('["“](.+?)["”]'), F.lit(1)), lambda q: F.trim(fold(q))), lambda q: q != "")
    def grams(w: Column) -> Column:
        of = lambda k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(of(4), of(3), of(2))
    every = F.concat(quoted, bind(F.filter(terms(c), lambda t: ~t.isin(*stop)), grams))
    return F.slice(F.array_distinct(every), 1, 20)


def passages(c: Column, limit: int = 700, least: int = 25, two: int = 900, three: int = 1100) -> Column:
    """Paragraphs, or sentences of long ones, alone and joined with the next one or two; the whole text if none is long enough."""
    plain = F.regexp_replace(c, r"\r\n?", "\n")
    squeezed = F.transform(F.split(plain, r"\n\s*\n+|\n+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    parts = F.flatten(F.transform(squeezed, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(F.split(p, r"(?<=[.!?])\s+(?=[A-Z0-9])"))))
    def windows(a: Column) -> Column:
        def at(p: Column, i: Column) -> Column:
            b, d = F.concat_ws(" ", p, F.get(a, i + 1)), F.concat_ws(" ", p, F.get(a, i + 1), F.get(a, i + 2))
            return F.array(p, F.when(F.get(a, i + 1).isNotNull() & (F.length(b) <= two), b), F.when(F.get(a, i + 2).isNotNull() & (F.length(d) <= three), d))
        return F.filter(F.flatten(F.transform(a, at)), lambda x: x.isNotNull())
    found = bind(F.filter(parts, lambda p: F.length(p) >= least), windows)
    whole = F.regexp_replace(plain, r"^\s+|\s+$", "")
    return bind(found, lambda x: F.when(F.size(x) > 0, x).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>")))


def passage_score(q_tokens: Column, q_phrases: Column, passage: Column) -> Column:
    """Coverage of the query by the passage and of the passage by the query, and a bonus for contained phrases."""
    def scored(p: Column) -> Column:
        both = F.size(F.array_intersect(q_tokens, p)).cast("double")
        phrases = F.aggregate(F.filter(q_phrases, lambda x: fold(passage).contains(x)), F.lit(0.0), lambda s, x: s + F.least(F.lit(0.35), 0.08 * F.size(F.split(x, " "))))
        return F.when(both > 0, both / F.size(q_tokens) * 0.82 + both / F.size(p) * 0.18 + phrases).otherwise(0.0)
    return bind(F.array_distinct(tokens(passage)), scored)


def best_passage_score(q_tokens: Column, q_phrases: Column, c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(passages(c), lambda p: passage_score(q_tokens, q_phrases, p))), F.lit(0.0))


def rule_label_score(q_tokens: Column, q_phrases: Column, c: Column) -> Column:
    labelled = F.transform(F.filter(passages(c), lambda p: p.rlike(RULE_LABEL)), lambda p: passage_score(q_tokens, q_phrases, p))
    return F.when(c.rlike(RULE_LABEL), F.least(F.lit(1.0), 0.35 + F.coalesce(F.array_max(labelled), F.lit(0.0)))).otherwise(0.0)


def revision_signal(c: Column) -> Column:
    return fold(c).rlike(REVISION)


def count_of(c: Column, part: Column) -> Column:
    """Occurrences of part in c that do not overlap."""
    return F.when(F.length(part) > 0, (F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.length(part)).otherwise(0).cast("long")


def snippet(c: Column, query: Column, q_terms: Column, around: int = 180) -> Column:
    """Text around the phrase, else the earliest term, else the start, on one line, with ellipses where it was cut."""
    low, phrase = F.lower(c), F.lower(F.trim(query))
    spots = F.filter(F.transform(q_terms, lambda t: F.position(t, low)), lambda i: i > 0)
    at = F.when((F.length(phrase) > 0) & (F.position(phrase, low) > 0), F.position(phrase, low) - 1).otherwise(F.coalesce(F.array_min(spots) - 1, F.lit(0)))
    def cutout(i: Column) -> Column:
        a, b = F.greatest(F.lit(0), i - around), F.least(F.length(c), i + F.length(F.trim(query)) + around)
        body = F.trim(F.regexp_replace(F.substring(c, a + 1, b - a), r"\s+", " "))
        return F.concat(F.when(a > 0, F.lit("…")).otherwise(""), body, F.when(b < F.length(c), F.lit("…")).otherwise(""))
    return bind(at, cutout)


def distinct_fold(values: Column, limit: int, width: int) -> Column:
    """Values with white space collapsed and cut to a width, without later ones equal but for case, the first `limit`."""
    clean = F.filter(F.transform(values, lambda v: F.substring(F.trim(F.regexp_replace(v, r"\s+", " ")), 1, width)), lambda v: v != "")
    return bind(clean, lambda a: F.slice(F.filter(a, lambda v, i: F.array_position(F.transform(a, F.lower), F.lower(v)) == i + 1), 1, limit))


def parse_model_json(c: Column) -> Column:
    """The JSON object that c is, or that it has from the first to the last brace; null without one."""
    return F.coalesce(F.try_parse_json(F.when(F.trim(c).startswith("{"), c)), F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))))


def natural_key(c: Column) -> Column:
    """Sort key: texts without case and numbers in turn, beginning with a (maybe empty) text; numbers of any length by their value."""
    texts, digits = F.split(F.lower(c), r"\d+"), F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    plain = F.transform(digits, lambda d: F.regexp_replace(d, "^0+(?=.)", ""))
    return F.zip_with(texts, plain, lambda t, d: F.struct(t.alias("text"), F.length(d).alias("width"), d.alias("digits")))
