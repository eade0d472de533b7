"""Facts of the operators on small inputs, and brute-force twins of the folds that SQL cannot express."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import chunking, text
from tessera.operators import evidence, incremental, inventory, migration, records, retrieval, rules, schema
from tessera.sources import corpus
from tessera.streaming import corpus as follow_corpus
from tessera.streaming.state import after, kb_state_stream


def one(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v")).alias("r")).collect()


def test_stems_and_tokens(spark):
    got = [r.r for r in one(spark, text.stem, "carried", "rules", "testing", "based", "boxes", "is", "ed")]
    assert got == ["carry", "rul", "test", "base", "box", "is", "ed"]
    assert set(one(spark, text.tokens, "Two-handed")[0].r) == {"two-handed", "two-hand", "twohanded", "twohand", "two", "handed", "hand"}


def test_query_tokens_expand_and_fall_back(spark):
    assert "ability" in one(spark, text.query_tokens, "which skill")[0].r
    assert one(spark, text.query_tokens, "the")[0].r == ["the"]


def test_phrases(spark):
    assert one(spark, text.query_phrases, 'find "Exact  Words" of big red cats')[0].r[:2] == ["exact words", "find exact words big"]


def split_loop(block):
    """The chunking rule restated as a plain loop."""
    pieces, at = [], 0
    if len(block) <= 1800:
        return [block]
    while at < len(block):
        end = min(at + 1800, len(block))
        if end < len(block):
            spots = [m.start() for m in re.finditer(r"[.!?] |\n", block[at:end]) if m.start() > 900]
            end = at + spots[-1] + 1 if spots else end
        piece = block[at:end].strip()
        pieces += [piece] if piece else []
        if end >= len(block):
            break
        at = max(end - 250, at + 1)
    return pieces


def test_split_block_matches_loop(spark):
    texts = ["word " * 700, ("Some sentence here. " * 300).strip(), "x" * 1801, "y" * 1800, "a\n" * 2500, "Über. ß! " * 900]
    assert [r.r for r in one(spark, chunking.split_block, *texts)] == [split_loop(t) for t in texts]


def test_chunk_text_packs_and_drops(spark):
    para = "p" * 600
    got = one(spark, chunking.chunk_text, "  ", "short", "\n\n".join([para] * 4), "\n\n".join(["q" * 1790, "tiny"]))
    assert got[0].r == [] and got[1].r == ["short"]
    assert [len(x) for x in got[2].r] == [1202, 1202]
    assert [len(x) for x in got[3].r] == [1796]


def test_snapshot_diff_and_removal(spark):
    a = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("o", 1, 1)], "path string, size long, mtime long")
    b = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, size long, mtime long")
    got = dict(inventory.snapshot_diff(a, b, a.where("path = 'o'")).collect())
    assert got == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added", "o": "offline"}
    missing = spark.createDataFrame([("/r/x",), ("/s/x",), ("/r",)], "path string")
    sources = spark.createDataFrame([("/r", True), ("/s", False)], "path string, available boolean")
    assert dict(inventory.confirm_removed(missing, sources).collect()) == {"/r/x": True, "/s/x": False, "/r": False}


def test_incremental_equals_rebuild(spark):
    pages = spark.createDataFrame([("a", 1, "Alpha rules text " * 20), ("b", 1, "Beta rules text " * 20)], "path string, page int, text string")
    old = chunking.chunk_documents(pages)
    new = pages.withColumn("text", F.when(F.col("path") == "a", F.repeat(F.lit("Alpha CHANGED rules text "), 20)).otherwise(F.col("text")))
    chunks, gone, fresh = incremental.update_chunks(old, new, pages.where("path = 'a'").select("path"), pages.where("false").select("path"))
    assert sorted(chunks.select("id").collect()) == sorted(chunking.chunk_documents(new).select("id").collect())
    vectors = old.select(F.col("id").alias("chunk_id"), incremental.char_sum_vector(F.col("text")).alias("embedding"))
    out = incremental.update_vectors(chunks, vectors, pages.where("path = 'a'").select("path"), gone, lambda r: r.select(F.col("id").alias("chunk_id"), incremental.char_sum_vector(F.col("text")).alias("embedding")))
    assert out.where("reused").count() == 1 and fresh.count() == 1


def test_kb_state_batch_and_stream(spark, tmp_path):
    kinds = ["chunks_current", "library_changed", "text_current", "embeddings_current", "chunks_current", "embeddings_current"]
    rows = [(7, i, i, k) for i, k in enumerate(kinds)]
    events = spark.createDataFrame(rows, "library_id long, ts long, seq long, type string")
    state = (1, 0, 0, 0)
    for k in kinds:
        state = after(state, k)
    assert tuple(incremental.kb_state(events).first())[1:5] == state == (2, 2, 2, 2)
    events.write.parquet(str(tmp_path / "in"))
    q = kb_state_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("kb_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("kb_out").collect()[-1])[1:5] == state


def test_greedy_selection_matches_loop(spark):
    import random

    rng, rows = random.Random(3), []
    for q in range(6):
        for o in range(30):
            rows.append((q, o, f"c{o}", rng.choice("pq"), sorted({rng.choice("abcdefgh") for _ in range(5)})))
    got = evidence.greedy(spark.createDataFrame(rows, "question_id int, position int, chunk_id string, path string, words array<string>"), 6)
    expected = set()
    for q in range(6):
        kept, late = [], []
        for r in [r for r in rows if r[0] == q]:
            if len(kept) >= 6:
                break
            twin = any(k[3] == r[3] and len(set(k[4]) & set(r[4])) / min(len(k[4]), len(r[4])) >= 0.82 for k in kept)
            (late if twin else kept).append(r)
        expected |= {(q, r[2]) for r in (kept + late)[:6]}
    assert {(r.question_id, r.chunk_id) for r in got.collect()} == expected


def test_greedy_selection_goes_beyond_a_block_of_copies(spark):
    rows = [(1, o, f"c{o}", "p", ["same", "old", "text"]) for o in range(1, 601)] + [(1, 600 + o, f"d{o}", "p", [f"new{o}"]) for o in (1, 2)] + [(2, 1, "e1", "p", ["one"]), (3, 900, "f1", "p", ["far"])]
    got = evidence.greedy(spark.createDataFrame(rows, "question_id int, position int, chunk_id string, path string, words array<string>"), 4)
    assert {(r.question_id, r.chunk_id) for r in got.collect()} == {(1, "c1"), (1, "d1"), (1, "d2"), (1, "c2"), (2, "e1"), (3, "f1")}


def _retrieval_case(spark):
    body = ["Nothing of note is said on this page about the weather.", "The silver dragon guards the old bridge at night. It sleeps by day.", "Rule: a silver dragon may be bribed with carried gold.", "Farmers talk of rain and of little else in these parts."]
    chunks = spark.createDataFrame([(f"c{i}", "p", i, 0, t) for i, t in enumerate(body)], "id string, path string, page int, ordinal int, text string")
    return chunks, spark.createDataFrame([(1, "silver dragon bridge"), (2, "bribed dragon")], "query_id int, query string")


def test_split_passages_score_like_the_text_function(spark):
    chunks, queries = _retrieval_case(spark)
    asked = retrieval.prepared(queries)
    pairs = spark.createDataFrame([(q, f"c{i}") for q in (1, 2) for i in range(4)], "query_id int, chunk_id string")
    got = {(r.query_id, r.chunk_id): (r.passage_score, r.rule_label_score) for r in retrieval._scored_text(pairs, chunks, asked).collect()}
    each = pairs.join(asked, "query_id").join(chunks, F.col("id") == F.col("chunk_id")).select("query_id", "id", F.round(text.best_passage_score(F.col("tokens"), F.col("phrases"), F.col("text")), 6).alias("s"), F.round(text.rule_label_score(F.col("tokens"), F.col("phrases"), F.col("text")), 6).alias("l"))
    assert got == {(r.query_id, r.id): (r.s, r.l) for r in each.collect()} and got[2, "c2"][1] > 0.35


def test_effects_limits_and_modifiers(spark):
    value = lambda start, *ops: F.get(F.transform(F.array(F.lit(start)), lambda v: rules.apply_effects(v, F.array(*[F.struct(F.lit(o).alias("op"), F.lit(float(x)).alias("value")) for o, x in ops]))), F.lit(0))
    assert tuple(spark.range(1).select(value(4, ("multiply", 2)), value(10, ("add", 2), ("subtract", 1)), value(5, ("override", 12))).first()) == (8.0, 11.0, 12.0)
    records = spark.createDataFrame([(1, 2), (2, 5)], "record_id int, level int")
    chosen = spark.createDataFrame([(1, "skill", "athletics"), (1, "skill", "stealth"), (2, "skill", "lore")], "record_id int, entity_type string, entity_id string")
    effects = spark.createDataFrame([("skill", "athletics", "power", 1.0, None), ("skill", "stealth", "power", 3.0, None), ("skill", "lore", "power", 2.0, None), ("skill", "lore", "power", 2.0, "level >= 5"), ("skill", "lore", "power", 9.0, "level >= 6")], "entity_type string, entity_id string, modifier string, value double, when string")
    got = dict(rules.resolve_modifiers(records, chosen, effects, [("power", 0.0, "sum")]).collect())
    assert got == {1: 4.0, 2: 4.0}
    over = {r.record_id: (r.maximum, r.over_by, r.severity) for r in rules.limits(records, chosen, "skills", "1 + floor(level / 5)").collect()}
    assert over == {1: (1, 1, "error"), 2: (2, 0, None)}


def test_effects_on_inputs_reach_modifiers_and_formulas(spark):
    """An effect on an input switches a conditional modifier on; levels read what effects left; other kinds of values stay."""
    records = spark.createDataFrame([(1, 2, "a", True, 7), (2, 2, None, None, 7), (3, None, "c", False, 7)], "record_id int, level int, name string, ready boolean, lists int")
    chosen = spark.createDataFrame([(i, "skill", "lore") for i in (1, 2, 3)], "record_id int, entity_type string, entity_id string")
    effects = spark.createDataFrame([("skill", "lore", "power", 4.0, "level >= 5"), ("skill", "lore", "power", 1.0, None)], "entity_type string, entity_id string, modifier string, value double, when string")
    rows = [(1, "level", 2, "multiply", 2.0), (1, "level", 1, "add", 1.0), (1, "base", 1, "subtract", 1.0), (1, "name", 1, "override", 9.0), (1, "ready", 1, "override", 9.0), (1, "nothing", 1, "add", 5.0), (2, "level", 1, "add", 0.0), (3, "level", 1, "override", 9.0)]
    temporary = spark.createDataFrame(rows, "record_id int, target string, seq int, op string, value double")
    out = rules.effective(records, chosen, effects, [("power", 0.0, "sum")], [("base", "level + power", 0), ("total", "base * 10", 1)], temporary, ["level", "name", "ready"])
    got = {r.record_id: (r.level, r.name, r.ready, r.lists, r.power, r.base, r.total, r.modified) for r in out.collect()}
    assert got == {1: (6.0, "a", True, 7, 5.0, 10.0, 100.0, ["level"]), 2: (2.0, None, None, 7, 1.0, 3.0, 30.0, []), 3: (None, "c", False, 7, 1.0, None, None, [])}
    assert rules.effective(records, chosen, effects, [], [], temporary.where("false"), ["level"]).count() == 3
    assert rules.effective(records.where("false"), chosen, effects, [("power", 0.0, "sum")], [("base", "level", 0)], temporary, ["level"]).count() == 0


def test_cycle_is_reported(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "rule_id string, dep string")
    assert {r.rule_id: r.level for r in rules.rule_levels(edges).collect()} == {"a": -1, "b": -1, "c": 0}


def test_reserved_turns_go_on_to_distinct_hits(spark):
    """Of four original hits the first two are alike: the third distinct one still gets its reserved turn."""
    rows = [(1, f"o{i}", i, True, 1.0 - i / 10, i) for i in (1, 2, 3, 4)] + [(1, "n1", 0, False, None, None)]
    ranked = spark.createDataFrame([(q, c, p + 1, h, s, r) for q, c, p, h, s, r in rows], "question_id int, chunk_id string, position int, original_hit boolean, original_score double, original_rank int")
    texts = spark.createDataFrame([("o1", "p", "red dragon"), ("o2", "p", "red dragon"), ("o3", "p", "blue bird"), ("o4", "p", "old oak"), ("n1", "p", "new nest")], "chunk_id string, path string, text string")
    pick = lambda n: {r.chunk_id for r in evidence.select_evidence(ranked, texts, n).collect()}
    assert pick(3) == {"o1", "o3", "o4"} and pick(4) == {"o1", "o3", "o4", "n1"} and pick(5) == {"o1", "o2", "o3", "o4", "n1"}


def test_guarded_selection_and_rescue(spark):
    texts = spark.createDataFrame([(f"c{i}", "p", f"word{i} only{i}") for i in range(6)], "chunk_id string, path string, text string")
    ranked = spark.createDataFrame([(1, f"c{i}", i + 1) for i in range(6)], "question_id int, chunk_id string, position int")
    batches = spark.createDataFrame([(1, 1, 1, "c5"), (1, 2, 1, "c4"), (1, 2, 2, "c0")], "question_id int, query_ord int, rank int, chunk_id string")
    chosen = spark.createDataFrame([(1, "c3", 0)], "question_id int, chunk_id string, ord int")
    got = evidence.guarded_select(ranked, batches, chosen, texts, limit=4).orderBy("turn").collect()
    assert [r.chunk_id for r in got] == ["c5", "c4", "c3", "c0"]
    rescue = spark.createDataFrame([(1, "c2", 1), (1, "c0", 2), (1, "c1", 9)], "question_id int, chunk_id string, position int")
    verdict = spark.createDataFrame([(1, "CANNOT_DETERMINE"), (2, "YES")], "question_id int, decision string")
    got = evidence.rescue_merge(ranked.where("position > 3"), rescue, verdict, texts, limit=4).orderBy("turn").collect()
    assert [r.chunk_id for r in got] == ["c2", "c0", "c3", "c4"]


def test_conditions_that_fail_switch_off(spark):
    """A division by zero, an unknown name, bad syntax and a text that is no condition hold for nobody; others are not touched."""
    records_ = spark.createDataFrame([(1, 0), (2, 4)], "record_id int, level int")
    chosen = spark.createDataFrame([(1, "s", "a", 9), (2, "s", "a", 9)], "record_id int, entity_type string, entity_id string, level int")
    effects = spark.createDataFrame([("s", "a", "power", 1.0, "10 / record_id > 5"), ("s", "a", "power", 2.0, "10 / (record_id - 1) > 2"), ("s", "a", "power", 4.0, "nobody > 1"), ("s", "a", "power", 8.0, "level >"), ("s", "a", "power", 16.0, "level"), ("s", "a", "power", 32.0, "level = 9")], "entity_type string, entity_id string, modifier string, value double, when string")
    got = dict(rules.resolve_modifiers(records_, chosen, effects, [("power", 0.0, "sum")]).collect())
    assert got == {1: 33.0, 2: 34.0}
    entities = spark.createDataFrame([("x", "10 / level > 2"), ("y", None), ("z", "nobody = 1"), ("w", "cast('a' as int) = 1")], "entity_id string, rule string")
    assert {(r.record_id, r.entity_id) for r in rules.eligibility(records_, entities).where("eligible").collect()} == {(1, "y"), (2, "x"), (2, "y")}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_copies_of_imported_records_stay_apart(spark):
    stored = spark.createDataFrame([("a", "1", 1)], "owner string, record_id string, v int")
    once = spark.createDataFrame(corpus.import_records(stored, stored).collect(), stored.schema)
    twice = corpus.import_records(stored, once).collect()
    assert len(twice) == 3 and len({(r.owner, r.record_id) for r in twice}) == 3


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one\ntwo ")
    (tmp_path / "in" / "deep" / "b.txt").write_text("three")
    files = {(r.source.rpartition("/")[2], r.path.rpartition("/")[2], r.size) for r in corpus.list_files(spark, str(tmp_path / "in")).collect()}
    assert files == {("in", "a.txt", 8), ("deep", "b.txt", 5)}
    pages = corpus.read_text_documents(spark, [str(tmp_path / "in" / "a.txt"), str(tmp_path / "in" / "deep")])
    assert {(r.page, r.text) for r in pages.collect()} == {(1, "one\ntwo "), (1, "three")}
    corpus.write_corpus(pages.select("page", "text"), str(tmp_path / "c"), 3)
    assert corpus.read_corpus(spark, str(tmp_path / "c"), 3).count() == 2 and corpus.read_corpus(spark, str(tmp_path / "c"), 2).count() == 0
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text('{"owner": "a", "level": 2}')
    (tmp_path / "r" / "2.json").write_text("{broken")
    got = corpus.read_records(spark, str(tmp_path / "r"), "owner string, level int", "a").collect()
    assert [(r.owner, r.level, r.file.rpartition("/")[2]) for r in got] == [("a", 2, "1.json")]


def test_small_text_functions(spark):
    row = spark.createDataFrame([(["  Red  fox", "red fox", "", "blue", "green"], 'said {"a": 1} so', '{"a": 2}', "none")], "v array<string>, x string, y string, z string").select(
        text.distinct_fold(F.col("v"), 2, 40).alias("v"), *[F.to_json(text.parse_model_json(F.col(n))).alias(n) for n in "xyz"]).first()
    assert row.v == ["Red fox", "blue"] and row.x == '{"a":1}' and row.y == '{"a":2}' and row.z is None


def test_encoding_in_batches(spark):
    rows = spark.createDataFrame([(f"c{i}", "x" * i) for i in range(1, 40)], "id string, text string")
    got = {r.chunk_id: list(r.embedding) for r in incremental.encode(rows, lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts], 7).collect()}
    assert len(got) == 39 and all(abs(v[0] - 0.6) < 1e-6 and abs(v[1] - 0.8) < 1e-6 for v in got.values())


def test_lexical_candidates_are_the_best_of_all_pairs(spark):
    """Bounds rule pairs out and lose none of the k best, ties at the end included; pairs are looked up as they are in the whole."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(3, 80))) for _ in range(400)]
    texts += texts[:30] + ["Rare Term stands, alone here", "  padded   rare\tterm\n", "brarex term", "", "w1"]
    chunks = spark.createDataFrame([(f"c{i:04d}", f"p{i // 5}", 1, i, t) for i, t in enumerate(texts)], "id string, path string, page int, ordinal int, text string")
    queries = spark.createDataFrame([(0, "w1 w2 w3 w40"), (1, 'rare term "stands, alone"'), (2, " ".join(words)), (3, "w0"), (4, "the"), (5, '"are te" w55'), (6, texts[3])], "query_id int, query string")
    index = retrieval.lexical_index(queries, chunks, 8)
    every = {(r.query_id, r.chunk_id): r for r in retrieval.lexical_features(index).collect()}
    got = retrieval.lexical_topk(index, 10).collect()
    for q in range(7):
        best = sorted((-r.lexical_score, c) for (x, c), r in every.items() if x == q and r.lexical_score > 0)[:10]
        assert [(-r.lexical_score, r.chunk_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.lexical_rank)] == best
    assert 2 * retrieval.lexical_candidates(index, 10).count() < len(every)  # single common words, whose chunks all score alike, are among the queries
    some = spark.createDataFrame([(0, "c0003"), (2, "c0007"), (1, "c0001")], "query_id int, chunk_id string")
    looked = {(r.query_id, r.chunk_id): r for r in retrieval.lexical_features(index, some).collect()}
    assert looked == {k: v for k, v in every.items() if k in {(0, "c0003"), (2, "c0007"), (1, "c0001")}}


def test_phrases_lie_where_contains_finds_them(spark):
    """Words cut at the ends, inner ones whole, single words inside others, punctuation, white space at the ends, repeated phrases, no text."""
    texts = ["The  Quick brown\tfox", "unquick brown foxes", "quick brownish fox", " quick brown", "aaa aa a", "a", "", None, "x-y z, quick", "brown fox quick brown fox jumps"]
    phrases = ["quick brown", "quick brown fox", "brown fox", "a", "aa a", "x-y z", "z, q", "the quick brown fox", "rown fo", "zz", "fox quick brown fox j", "quick", ""]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "id string, text string")
    got = [(r.phrase, r.chunk_id) for r in retrieval.phrase_chunks(spark.createDataFrame([(p,) for p in phrases * 2], "phrase string"), chunks).collect()]
    fold = lambda t: re.sub(r"\s+", " ", t.lower())
    assert sorted(got) == sorted((p, f"c{i}") for p in phrases if p for i, t in enumerate(texts) if t is not None and p in fold(t))


@pytest.mark.parametrize(("vectors", "queries"), [(4096, 4096), (20, 3)])
def test_vectors_match_all_scores(spark, monkeypatch, vectors, queries):
    """Clusters of which far ones are skipped, ties, copies, nulls, fewer vectors than asked for; with parts of buckets and groups of queries."""
    monkeypatch.setattr(retrieval, "VECTORS", vectors)
    monkeypatch.setattr(retrieval, "QUERIES", queries)
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((6, 12)) * 3
    x = np.repeat(middles, 60, axis=0) + rng.standard_normal((360, 12)) * 0.1
    x[50:90] = x[7]
    held = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i * 13].tolist()) for i in range(20)] + [(99, None)], "query_id int, embedding array<double>")
    got = sorted((r.query_id, r.semantic_rank, r.chunk_id, r.semantic_score) for r in retrieval.semantic_topk(asked, held, 10).collect())
    want = []
    for i in range(20):
        scores = np.round(x @ x[i * 13], 6)
        want += [(i, n + 1, f"c{j:03d}", scores[j]) for n, j in enumerate(sorted(range(360), key=lambda j: (-scores[j], j))[:10])]
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want] and np.abs([a[3] - b[3] for a, b in zip(got, want, strict=True)]).max() < 2e-6
    index = retrieval.vector_index(held)
    floors = asked.where("query_id < 20").withColumn("floor", F.lit(20.0))
    assert retrieval.asked_buckets(floors, index, 20, True).count() < 20 * len(index.numbers) / 2
    assert retrieval.semantic_topk(asked, held.limit(0), 10).count() == 0 and retrieval.semantic_topk(asked.where("query_id = 3"), held.where("chunk_id < 'c005'"), 10).count() == 5


def test_upload_names_are_free_ones(spark):
    """Numbers that names already have, existing files, paths, names without a letter, unknown types; as a plain loop names them."""
    def looped(existing, uploads):
        taken, out = set(existing), []
        for name in uploads:
            clean = re.sub(r"[^A-Za-z0-9._() \-\[\]]+", "_", name.rstrip("/").rpartition("/")[2]).strip(" .") or "upload"
            stem, dot, ext = clean.rpartition(".")
            stem, ext = (stem, dot + ext) if dot else (clean, "")
            free, n = clean, 2
            while free in taken:
                free, n = f"{stem} ({n}){ext}", n + 1
            taken.add(free)
            out.append(free)
        return out

    rng = random.Random(2)
    names = ["a.txt", "a.txt", "a (2).txt", "...", "dir/x.exe", "...", "", "a (2).txt", "b", "b (2)", "b", "a (2) (2).txt", "a (02).txt", "é.md"] + [rng.choice(["c.pdf", "c (2).pdf", "c (3).pdf", "c (2) (2).pdf", "c (7).pdf"]) for _ in range(60)]
    uploads = spark.createDataFrame([(u, n, i, "clash") for u in (1, 2) for i, n in enumerate(names)], "user int, name string, arrival long, safe_name string").repartition(3)
    existing = spark.createDataFrame([(1, "a.txt"), (1, "c (3).pdf"), (3, "b")], "user int, name string")
    got = inventory.upload_names(uploads, existing).orderBy("user", "arrival").collect()
    assert [r.safe_name for r in got if r.user == 1] == looped(["a.txt", "c (3).pdf"], names) and [r.safe_name for r in got if r.user == 2] == looped([], names)
    assert {r.name: r.supported for r in got if r.name in ("dir/x.exe", "a.txt", "b")} == {"dir/x.exe": False, "a.txt": True, "b": False}


def test_natural_keys_compare_like_numbers(spark):
    names = ["p1234567890123456780", "p1234567890123456789", "p2", "p10", "P010a", "p10b", "10", "2", "002", "a", "", "a1b2", "a1b10", "é5"]
    key = lambda v: [(1, int(x)) if x.isdigit() else (0, x.lower()) for x in re.split(r"([0-9]+)", v)]
    got = [r.v for r in spark.createDataFrame([(v,) for v in names], "v string").orderBy(text.natural_key(F.col("v")), "v").collect()]
    assert got == sorted(names, key=lambda v: (key(v), v.encode()))


def test_questions_call_for_groups_and_named_terms(spark):
    hints = spark.createDataFrame([(1, 0, "Weapons", "gear", 0, "Silver Sword"), (1, 0, "Weapons", "gear", 1, "Axe"), (1, 1, "Skills", "known_tricks", 0, "Juggling"), (1, 1, "Skills", "known_tricks", 1, "axe"), (1, 2, None, None, 0, " ")], "record_id int, group_no int, label string, field_id string, hint_no int, term string")
    ask = {1: "How does the  Silver Sword work?", 2: "which weapon is best", 3: "my KNOWN TRICK and the axe", 4: "nothing", 5: None}
    queries = spark.createDataFrame([(i, 1, q) for i, q in ask.items()] + [(6, 2, "weapons")], "query_id int, record_id int, query string")
    got = {r.query_id: r.expanded for r in records.expand_query_with_record(queries, hints).collect()}
    tail = "\nRelevant selected character-sheet terms: "
    assert got == {1: "How does the Silver Sword work?" + tail + "Silver Sword", 2: "which weapon is best" + tail + "Silver Sword; Axe", 3: "my KNOWN TRICK and the axe" + tail + "Juggling; axe", 4: "nothing", 5: "", 6: "weapons"}


def test_conditions_and_limits_that_fail(spark):
    """Division by zero and unknown names close an action and void a maximum; use may be an expression."""
    rows = spark.createDataFrame([(1, 0, "x"), (2, 3, "x"), (3, 20, "x")], "record_id int, level int, advanced string")
    assert [(r.level, r.advanced) for r in rules.advance(rows, "10 / level > 2", [("level", "level + 1")]).orderBy("record_id").collect()] == [(0, False), (4, True), (20, False)]
    assert [r.advanced for r in rules.advance(rows, "nobody = 1", [("level", "1 / 0")]).collect()] == [False] * 3
    chosen = spark.createDataFrame([(1,), (1,), (2,)], "record_id int")
    for maximum, want in {"12 div level": ("maximum_failed", None, None), "nobody": ("maximum_failed",) * 3, "level / 3": (None, None, "maximum_not_whole"), "-level": (None, "maximum_negative", "maximum_negative"), "'x'": ("maximum_not_whole",) * 3}.items():
        got = rules.limits(rows, chosen, "l", maximum).orderBy("record_id").collect()
        assert tuple(r.problem for r in got) == want and all((r.maximum is None) == (r.problem is not None) and r["count"] == n for r, n in zip(got, (2, 1, 0), strict=True))
    got = rules.limit_messages(rules.limits(rows, None, "l", "4", usage="level"), "Load", "{label} {count}/{maximum}: {over_by} over, {odd}", "{remaining} left").orderBy("record_id").collect()
    assert [(r["count"], r.message) for r in got] == [(0, None), (3, None), (20, "Load 20/4: 16 over, {odd}")]
    assert [(r["count"], r.problem) for r in rules.limits(rows, None, "l", "4", usage="6 / level").orderBy("record_id").collect()] == [(0, "usage_failed"), (2, None), (0, "usage_not_whole")]
    assert [r.severity for r in rules.limits(rows, chosen, "l", "3", 1).orderBy("record_id").collect()] == ["warning", None, None]


def test_names_are_read_by_the_parser(spark):
    texts = ["a + f(b.c, 'd') * `e f`", "aggregate(xs, 0, (s, x) -> s + x + y)", "1 + 2", "a +", "case when level >= 2 then a end", "interval 1 day + d"]
    assert rules.names_in(spark, texts) == {texts[0]: ["a", "b", "e f"], texts[1]: ["xs", "y"], texts[2]: [], texts[3]: None, texts[4]: ["a", "level"], texts[5]: ["d"]}
    found = rules.expression_audit(spark.createDataFrame([("formula", "a", "b + 1"), ("formula", "b", "a"), ("formula", "level", "1"), ("limit", "m", "2 + nobody"), ("usage", "u", None), ("effect", "e", "level)"), ("eligibility", "g", "a > 1"), ("validation", "v", "1"), ("validation", "v", "2")], "kind string, rule_id string, expr string"), spark.createDataFrame([("level",)], "name string"))
    assert sorted((r.kind, r.rule_id, r.problem, r.name or "") for r in found.collect()) == sorted([("formula", "a", "cycle", "a"), ("formula", "b", "cycle", "b"), ("formula", "level", "name_collision", "level"), ("limit", "m", "unknown_reference", "nobody"), ("usage", "u", "bad_syntax", ""), ("effect", "e", "bad_syntax", ""), ("validation", "v", "duplicate_id", "v")])


def test_reach_of_deep_and_wide_graphs(spark):
    """A chain of 40, a star of 3,000, a cycle, and a source that nothing depends on; only what the sources reach is held."""
    edges = [(f"c{i + 1}", f"c{i}") for i in range(40)] + [(f"s{i}", "hub") for i in range(3000)] + [("x", "y"), ("y", "x"), ("z", None)]
    sources = spark.createDataFrame([("c30",), ("hub",), ("x",), ("lone",), (None,)], "source string")
    got = {(r.source, r.rule_id) for r in rules.reached(spark.createDataFrame(edges, "rule_id string, dep string"), sources).collect()}
    assert got == {("c30", f"c{i}") for i in range(31, 41)} | {("hub", f"s{i}") for i in range(3000)} | {("x", "y"), ("x", "x")}


def test_versions_are_seen_whole(spark, tmp_path):
    """A write that fails leaves the version as it was, a repeated one replaces it, and vacuuming keeps what is committed."""
    path = str(tmp_path / "corpus")
    rows = spark.range(6).withColumn("x", F.lit("a"))
    with pytest.raises(FileNotFoundError):
        corpus.read_corpus(spark, path, 1)
    corpus.write_corpus(rows, path, 1)
    corpus.write_corpus(rows, path, 1)
    before = corpus.read_corpus(spark, path, 1)
    with pytest.raises(Exception, match="stop"):
        corpus.write_corpus(rows.withColumn("x", F.when(F.col("id") == 5, F.raise_error(F.lit("stop"))).otherwise(F.lit("b"))), path, 1)
    assert [r.x for r in corpus.read_corpus(spark, path, 1).collect()] == ["a"] * 6 and corpus.read_corpus(spark, path, 7).count() == 0
    corpus.write_corpus(rows.limit(2), path, 1)
    assert corpus.read_corpus(spark, path, 1).count() == 2 and before.count() == 6
    assert corpus.vacuum_corpus(spark, path) == 3 and corpus.vacuum_corpus(spark, path) == 0 and corpus.read_corpus(spark, path, 1).count() == 2 and set(corpus.commits(spark, path)) == {1}


def test_a_stream_of_pages_equals_the_batch(spark, tmp_path):
    """Pages come, change twice in one batch, go and come back; a batch that is run again changes nothing, nor does starting again."""
    page = lambda n, word: f"{word} rules text. " * n
    drops = [[("a", 0, False, 1, page(20, "Alpha")), ("a", 0, False, 2, page(9, "Two")), ("b", 0, False, 1, page(400, "Beta"))],
             [("a", 1, False, 1, page(20, "Old")), ("a", 2, False, 1, page(21, "CHANGED")), ("c", 1, False, 1, page(30, "Gamma"))],
             [("b", 3, True, None, None), ("c", 2, True, None, None), ("c", 3, False, 1, page(31, "Back"))]]
    kind = "path string, seq int, removed boolean, page int, text string"
    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    encoder = lambda rows: rows.select(F.col("id").alias("chunk_id"), incremental.char_sum_vector(F.col("text")).alias("embedding"))

    def follow():
        changes = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        follow_corpus.follow(changes, store, str(tmp_path / "progress"), encoder).awaitTermination()
        return sorted((r.chunk_id, tuple(r.embedding)) for r in follow_corpus.current(spark, store).collect())

    seen = []
    for rows in drops:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        seen.append(follow())
    final = spark.createDataFrame([("a", 1, page(21, "CHANGED")), ("c", 1, page(31, "Back"))], "path string, page int, text string")
    batch = encoder(chunking.chunk_documents(final).select("id", "text"))
    assert seen[-1] == sorted((r.chunk_id, tuple(r.embedding)) for r in batch.collect()) == follow()
    assert len(seen[0]) == chunking.chunk_documents(spark.createDataFrame([(p, n, t) for p, _, _, n, t in drops[0]], "path string, page int, text string")).count()
    reused = {r.reused for r in corpus.read_corpus(spark, f"{store}/vectors", 1).join(corpus.read_corpus(spark, f"{store}/chunks", 1).where("path = 'b'"), F.col("chunk_id") == F.col("id")).collect()}
    assert reused == {True}
    follow_corpus.apply_changes(spark.createDataFrame(drops[2], kind), store, 2, encoder)
    assert follow() == seen[-1] and corpus.read_corpus(spark, f"{store}/vectors", 0).count() == len(seen[0])
    with pytest.raises(FileNotFoundError):
        follow_corpus.apply_changes(spark.createDataFrame(drops[2], kind), store, 9, encoder)


def test_declared_fields_find_every_issue(spark):
    fields = [schema.Field("name", "text", required=True), schema.Field("level", "integer", minimum=1, maximum=100), schema.Field("share", "decimal"), schema.Field("kind", "enum", options=("a", "2")), schema.Field("it's", "boolean"), schema.Field("skills", "multi_reference"),
              schema.Field("points", "resource"), schema.Field("inventory", "collection", items=(schema.Field("item", "reference"), schema.Field("quantity", "integer", minimum=1)), custom=True)]
    cases = {
        '{"name": "x", "level": 5, "share": 1, "kind": 2, "it\'s": true, "skills": [], "points": {"current": 1}, "inventory": [{"item": "rope", "quantity": 1}, {"custom_name": "own"}]}': {("inventory[1].custom_name", "Unknown collection item field.")},
        '{"name": "", "level": 999, "share": "1", "kind": "b", "it\'s": 0, "skills": "s", "points": true}': {("name", "Required field is missing."), ("level", "Value must be <= 100."), ("share", "Value does not match field type 'decimal'."), ("kind", "Value is not one of the allowed enum options."),
                                                                                                    ("it's", "Value does not match field type 'boolean'."), ("skills", "Value does not match field type 'multi_reference'."), ("points", "Value does not match field type 'resource'.")},
        '{"name": null, "level": 1.5, "x.y": 1, "inventory": null}': {("name", "Required field is missing."), ("level", "Value does not match field type 'integer'."), ("x.y", "Unknown character field."), ("inventory", "Value does not match field type 'collection'.")},
        '{"name": "x", "level": null, "inventory": [5, {}, {"item": "", "quantity": 0}, null]}': {("inventory[0]", "Collection row must be a mapping/object."), ("inventory[1]", "Collection row requires a compendium selection or custom name."), ("inventory[2]", "Collection row requires a compendium selection or custom name."), ("inventory[2].quantity", "Value must be >= 1."), ("inventory[3]", "Collection row must be a mapping/object.")},
        "[1]": {(None, "Character data must be a mapping/object.")}, "{": {(None, "Character data must be a mapping/object.")}, None: {(None, "Character data must be a mapping/object.")},
    }
    got = schema.declared_issues(spark.createDataFrame(list(enumerate(cases)), "record_id int, data string"), fields).collect()
    for i, want in enumerate(cases.values()):
        found = [(r.path, r.message) for r in got if r.record_id == i]
        assert set(found) == want and len(found) == len(want)
    with pytest.raises(ValueError):
        schema.Field("x", "enum")


def test_records_move_to_a_new_schema(spark):
    item = schema.Field("item", "reference", entity="item")
    old = [schema.Field("name", "text"), schema.Field("age", "integer"), schema.Field("rank", "decimal"), schema.Field("kind", "enum", options=("a", "b")), schema.Field("home", "reference", entity="place"), schema.Field("skills", "multi_reference", entity="skill"), schema.Field("old", "text"),
           schema.Field("bag", "collection", items=(item, schema.Field("n", "decimal"), schema.Field("mark", "boolean")))]
    new = [schema.Field("name", "notes", required=True), schema.Field("age", "decimal"), schema.Field("rank", "integer", default="1"), schema.Field("kind", "enum", options=("b",)), schema.Field("home", "reference", entity="place"), schema.Field("skills", "multi_reference", entity="skill"), schema.Field("sum", "calculated"),
           schema.Field("bag", "collection", items=(item, schema.Field("n", "integer", minimum=1, default="1"), schema.Field("mark", "text"), schema.Field("own", "boolean")))]
    entities = spark.createDataFrame([("place", "p"), ("skill", "s"), ("item", "rope"), ("place", "x"), (None, "q")], "entity_type string, entity_id string")
    review = "Character needs manual review under the new schema: ERROR: "
    cases = [
        (1, '{"name": "n", "age": 3, "rank": 2.0, "kind": "b", "home": "p", "skills": ["s", "t", null], "sum": 9, "bag": [{"item": "rope", "n": 2.0}, 7, {"item": "axe", "n": 0.5, "mark": true}]}', '{"age": [1], "old": [2], "a": []}',
         {"name": "n", "age": 3, "rank": 2, "kind": "b", "home": "p", "skills": ["s"], "bag": [{"item": "rope", "n": 2, "own": False}, {"n": 1, "own": False}]}, '{"age":[1]}',
         ["bag[1]: invalid collection row was dropped.", "bag[2].n: decimal value 0.5 cannot be represented as an integer and was reset.", "bag[2].mark: field type changed from boolean to text; old value was not converted.", "skills: 2 obsolete reference(s) were removed.",
          "bag[1].item: obsolete reference 'axe' was reset.", "Temporary effect(s) for removed field(s) were discarded: a, old"]),
        (2, '{"name": "", "age": "3", "rank": 2.5, "kind": "a", "home": "it\'s", "skills": null, "old": 1, "more": 2, "bag": {}}', "[1]", {"name": "", "rank": 1, "skills": None, "bag": []}, "[1]",
         ["age: field type changed from integer to decimal; old value was not converted.", "rank: decimal value 2.5 cannot be represented as an integer and was reset.", "kind: old value 'a' is not valid in the new enum and was reset.", "Removed field(s) not carried forward: more, old",
          'home: reference "it\'s" no longer exists and was reset.', f"{review}name: Required field is missing."]),
        (2, '{"home": "", "name": null, "kind": null, "bag": [{"item": "x"}, {"item": ""}]}', None, {"home": "", "name": None, "kind": None, "rank": 1, "skills": [], "bag": [{"n": 1, "own": False}, {"item": "", "n": 1, "own": False}]}, None,
         ["bag[0].item: obsolete reference 'x' was reset.", f"{review}name: Required field is missing."]),
        (None, '{"name": "z", "home": "q"}', None, {"name": "z", "rank": 1, "skills": [], "bag": []}, None, ["home: reference 'q' no longer exists and was reset."]),
        (4, "{", "{", "{", "{", [f"{review}Character data must be a mapping/object."]),
        (5, None, None, None, None, [f"{review}Character data must be a mapping/object."]),
    ]
    rows = spark.createDataFrame([(k, t, e, str(i)) for i, (k, t, e, *_) in enumerate(cases)], "record_id int, data string, effects string, v string")
    out = migration.migrate_declared(rows, old, new, entities, effects="effects")
    assert out.columns == ["record_id", "data", "effects", "v", "warnings"]
    got = {int(r.v): r for r in out.collect()}
    assert len(got) == len(cases)
    for i, (k, _, _, data, effects, warnings) in enumerate(cases):
        r = got[i]
        assert (json.loads(r.data) if isinstance(data, dict) else r.data) == data and (r.record_id, r.effects) == (k, effects)
        assert r.warnings == warnings
    copied = migration.migrate_declared(rows.where("v = '2'"), None, [schema.Field("home", "text"), schema.Field("flag", "boolean")]).first()
    assert json.loads(copied.data) == {"home": "", "flag": False} and copied.warnings == ["Old System Pack schema was unavailable; migration used matching field IDs only."]
    assert migration.migrate_declared(rows.limit(0), old, new, entities).count() == 0


def test_rule_levels_of_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = rules.written
    monkeypatch.setattr(rules, "written", lambda df: rounds.append(1) or real(df))
    n = 300
    chain = [(f"r{i}", f"r{i + 1}" if i + 1 < n else "input") for i in range(n)] + [("top", "r0"), ("top", "r7"), ("top", None), ("alone", None)]
    chain += [(f"o{i}", f"o{(i + 1) % 7}") for i in range(7)] + [("behind", "o3"), ("behind", "r5"), ("self", "self"), ("x", "y"), ("x", "z"), ("y", "x"), ("y", "z"), ("z", "x"), ("z", "y"), ("on", "x")]
    got = {r.rule_id: r.level for r in rules.rule_levels(spark.createDataFrame(chain, "rule_id string, dep string")).collect()}
    want = {f"r{i}": n - i for i in range(n)} | {"top": n + 1, "alone": 0} | {f"o{i}": -1 for i in range(7)} | {k: -1 for k in ("behind", "self", "x", "y", "z", "on")}
    assert got == want and len(rounds) < 20


def test_rule_levels_match_a_loop(spark):
    import random

    rnd = random.Random(5)
    edges = [(f"n{i}", f"n{rnd.randrange(i + 1, 90)}") for i in range(89) for _ in range(rnd.choice((1, 1, 1, 2, 3)))] + [("n89", None), ("n40", "n12"), ("n3", "field")]
    deps = {}
    for r, d in edges:
        deps.setdefault(r, set()).update({d} - {None})
    level = {}
    while True:
        new = {r: max((level.get(x, 0) + 1 for x in ds), default=0) for r, ds in deps.items() if r not in level and all(x in level or x not in deps for x in ds)}
        if not new:
            break
        level |= new
    got = {r.rule_id: r.level for r in rules.rule_levels(spark.createDataFrame(edges, "rule_id string, dep string")).collect()}
    assert got == {r: level.get(r, -1) for r in deps} and -1 in got.values()


def test_names_of_texts_that_differ_in_numbers_are_read_from_one_shape(spark, monkeypatch):
    asked = []
    real = rules.names_in
    monkeypatch.setattr(rules, "names_in", lambda s, texts: asked.extend(texts) or real(s, texts))
    texts = [f"p{i} + log2(p{i + 1}) + len('p{i % 2}') * 1e5" for i in range(200)] + [f"aggregate(xs, 0, (a1, b2) -> a1 + b2 + r{i})" for i in range(50)]
    texts += ["p1 + -- p2\n p3", "`p 7` + p8.f9 + s.p4", "'p1' || p2 || '", "p5 +", "'it''s p1' = p6", "'\\' p1' = p7", "tessera_v1 + p2", "cast(p1 as decimal(50, 1))", "p1 'x'", "x'1F' + p9", "nope", "1.5e3", "zähler1 + p3", None, "p1 (2)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "rule_id int, expr string")
    edges, unreadable = rules.expression_edges(rows)
    got = {}
    for r in edges.collect():
        got.setdefault(r.rule_id, set()).update({r.dep} - {None})
    plain = real(spark, [t for t in texts if t is not None])
    assert got == {i: set(plain[t]) for i, t in enumerate(texts) if t is not None and plain[t] is not None}
    assert {r.rule_id for r in unreadable.collect()} == {i for i, t in enumerate(texts) if t is None or plain[t] is None}
    assert len(asked) < 20


def test_paths_of_single_deps_look_nothing_up_and_end_on_cycles(spark, monkeypatch):
    edges = [(f"n{i}", f"n{i // 2}") for i in range(2, 64)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("s", "s")]
    deps = dict(edges)
    def names(r):
        seen = []
        while r in deps and deps[r] not in seen:
            r = deps[r]
            seen.append(r)
        return seen
    frame = spark.createDataFrame(edges, "rule_id string, dep string")
    wanted = ["n1", "n3", "n40", "a", "c", "s", None]
    want = sorted((s, r) for r in deps for s in names(r) if s in wanted)
    plans = []
    real = rules.written
    monkeypatch.setattr(rules, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    got = rules.reached(frame, spark.createDataFrame([(s,) for s in wanted], "source string"))
    assert sorted((r.source, r.rule_id) for r in got.collect()) == want
    assert not any("LeftAnti" in p for p in plans)
    any_ = rules.behind_any(frame, spark.createDataFrame([(s,) for s in wanted], "name string"))
    assert sorted(r.rule_id for r in any_.collect()) == sorted({r for _, r in want})


def test_sources_of_modifiers_that_are_no_terms_are_dropped_before_shuffles(spark):
    from tessera.operators import records

    rows = spark.createDataFrame([(1, 2.0), (2, 3.0)], "record_id int, power double")
    picks = spark.createDataFrame([(1, "t", "a", "f", 0), (1, "t", "b", "f", 1), (2, "t", "b", "f", 0)], "record_id int, entity_type string, entity_id string, field string, row_no int")
    effects = spark.createDataFrame([("t", "a", "power", 1.0, None), ("t", "b", "power", 2.0, None), ("t", "b", "best", 3.0, None)], "entity_type string, entity_id string, modifier string, value double, `when` string")
    entities = spark.createDataFrame([("t", "a", "A", None), ("t", "b", "B", None)], "entity_type string, entity_id string, name string, label string")
    out = records.explain_terms(rows, [("r", 0, 1, " power", "P"), ("r", 1, 1, "power * 2", "Q")], rules.modifier_sources(picks, effects, entities))
    assert sorted((r.record_id, r.term_no, [(s.source_name, s.value) for s in r.sources]) for r in out.collect()) == [(1, 0, [("A", 1.0), ("B", 2.0)]), (1, 1, []), (2, 0, [("B", 2.0)]), (2, 1, [])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (power,power * 2)" in plan[plan.index("Window"):]


def test_words_are_fetched_for_unfilled_groups_alone(spark, monkeypatch):
    texts = [(f"c{i}", "p", f"alpha{i} beta{i} gamma{i}" if i % 3 else "same words again") for i in range(60)]
    rows = [(q, i + 1, f"c{(q * 7 + i * (3 if q == 2 else 1)) % 60 if q else i * 3 % 60}") for q in range(4) for i in range(20)]
    words = {c: set(t.split()) for c, _, t in texts}
    frame = spark.createDataFrame(rows, "question_id int, position int, chunk_id string")
    held = spark.createDataFrame(texts, "chunk_id string, path string, text string")
    fetched = []
    real = evidence._worded
    monkeypatch.setattr(evidence, "_worded", lambda part, texts: fetched.append(part.count()) or real(part, texts))
    got = {}
    for r in evidence.greedy(frame, 4, texts=held).collect():
        got.setdefault(r.question_id, set()).add(r.chunk_id)
    want = {}
    for q in range(4):
        kept, late = [], []
        for c in (c for g, _, c in sorted(rows) if g == q):
            same = any(len(words[c] & words[k]) / 3 >= 0.82 for k in kept)
            if len(kept) < 4:
                (late if same else kept).append(c)
        want[q] = set(kept + late[:4 - len(kept)])
    assert got == want
    assert fetched[0] == 4 * 7 and sum(fetched) < len(rows)


def folds_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")


def test_procedural_anchor_folds_a_text_once(spark):
    rows = spark.createDataFrame([("q", "a", 1, "It  MUST\n not, a player\t may"), ("q", "b", 2, "must"), ("q", "c", 3, "nothing"), ("q", "d", 4, None)], "question_id string, chunk_id string, score int, text string")
    found = evidence.procedural_anchor(rows)
    assert [tuple(r) for r in found.select("chunk_id", "total", "strong", "medium").collect()] == [("a", 8, 2, 0)]
    assert folds_of(found) == 1


def test_fold_collapses_every_run_of_white_space(spark):
    texts = ["a b", "a  b", " a\tb ", "\n\na \x0b\f\r\n b", "a\t", "  ", "", "A  B"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in found] == [re.sub(r"[ \t\n\x0b\f\r]+", " ", r.t.lower()) for r in found]


ODD = ["Two-handed two-handed  TESTING's\ttests a", "", None, "-x' carried_on--based 9's buses s' ed ied", "the The THE thing's\x1cboxes\x85 Kelvin K", "_a a_ 'b' b'' c-'-c", "Éd rules. (Rules) rules-rules"]


def counts_of(spark, chunks):
    """(chunk, token): occurrences of raw terms with that form, by the Column functions."""
    rows = chunks.select("id", F.explode(F.regexp_extract_all("text", F.lit(text.TOKEN), F.lit(0))).alias("r")).select("id", F.explode(text.variants(F.lower("r"))).alias("token"))
    return {(r.id, r.token): r["count"] for r in rows.groupBy("id", "token").count().collect()}


@pytest.mark.parametrize("twice", [False, True])
def test_tokens_are_counted_where_texts_are_read(spark, twice):
    chunks = spark.createDataFrame([(f"c{i % 5 if twice else i}" if i != 1 else None, t) for i, t in enumerate(ODD)], "id string, text string")
    every = counts_of(spark, chunks)
    assert {(r.chunk_id, r.token): r.tf for r in retrieval.chunk_tokens(chunks).collect()} == every
    totals = {r.token: (r.tf, r.df) for r in retrieval.token_totals(chunks).collect()}
    assert totals == {t: (sum(n for (_, x), n in every.items() if x == t), sum(x == t for _, x in every)) for t in {t for _, t in every}}
    wanted = spark.createDataFrame([("test",), ("rul",), ("none",), (None,)], "token string")
    assert {(r.chunk_id, r.token) for r in retrieval.chunk_tokens(chunks, wanted).collect()} == {k for k in every if k[1] in ("test", "rul")}


def test_token_totals_shuffle_no_chunks(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"same words {i % 3}") for i in range(400)], "id string, text string").coalesce(2)
    plan = retrieval.token_totals(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" in plan and "hashpartitioning(chunk_id" not in plan
    assert {(r.token, r.tf, r.df) for r in retrieval.token_totals(chunks).where("token = 'same'").collect()} == {("same", 400, 400)}


def test_lexical_candidates_in_steps_and_groups(spark, monkeypatch):
    """The k best stay, whatever is scored at once; a query without a match or with a null id asks nothing."""
    monkeypatch.setattr(retrieval, "CELLS", 7)
    monkeypatch.setattr(retrieval, "ASKED", 2)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    chunks = spark.createDataFrame([(f"c{i:03d}", " ".join(rng.choices(words[: rng.randint(1, 30)], k=rng.randint(0, 25)))) for i in range(120)], "id string, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(9)] + [(9, "nowhere"), (None, "w1")], "query_id int, query string")
    index = retrieval.lexical_index(queries, chunks, 16)
    every = retrieval.lexical_features(index).collect()
    got = {q: [] for q in range(10)}
    for r in sorted(retrieval.lexical_topk(index, 5).collect(), key=lambda r: r.lexical_rank):
        got[r.query_id].append(r.chunk_id)
    assert got == {q: [c for _, c in sorted((-r.lexical_score, r.chunk_id) for r in every if r.query_id == q)[:5]] for q in range(10)}


def test_migration_reads_records_once(spark):
    rows = spark.createDataFrame([(1, '{"home":"a","gone":1}'), (2, '{"home":"b"}'), (3, "[1]"), (4, None)], "record_id int, data string")
    entities = spark.createDataFrame([("place", "a")], "entity_type string, entity_id string")
    fields = [schema.Field("home", "reference", entity="place")]
    out = migration.migrate_declared(rows, fields, fields, entities)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1  # the entities
    got = {r.record_id: (r.data, r.warnings) for r in out.collect()}
    assert got[1] == ('{"home":"a"}', ["Removed field(s) not carried forward: gone"])
    assert got[2] == ("{}", ["home: reference 'b' no longer exists and was reset."])
    assert got[3][0] == "[1]" and got[4][0] is None


def test_selection_moves_words_once_for_a_part_and_not_for_rows(spark):
    """Many questions share a few texts; two texts of one chunk, one that is missing and an empty one are told apart as a loop does."""
    rng = random.Random(5)
    texts = [(f"c{i}", rng.choice("pq"), " ".join(sorted({rng.choice("abcdefgh") for _ in range(4)})) if i % 9 else "") for i in range(40)] + [("c3", "p", "z y"), ("c5", "q", "a b c d"), ("c5", "q", "a b c d")]
    rows = [(q, o + 1, f"c{c}") for q in range(300) for o, c in enumerate(rng.sample(range(43), 14))]
    want = set()
    for q in range(300):
        kept, late = [], []
        every = [(o, c, *t) for g, o, c in rows if g == q for t in sorted((p, sorted(x.split(), key=x.split().index)) for k, p, x in texts if k == c) or [(None, [])]]
        for r in every:
            same = any(k[2] == r[2] and len(set(k[3]) & set(r[3])) / min(len(k[3]), len(r[3])) >= evidence.OVERLAP for k in kept if k[3] and r[3])
            if len(kept) < 5:
                (late if same else kept).append(r)
        want |= {(q, r[0], r[1]) for r in kept + late[:5 - len(kept)]}
    frame = spark.createDataFrame(rows, "question_id int, position int, chunk_id string")
    held = spark.createDataFrame(texts, "chunk_id string, path string, text string")
    out = evidence.greedy(frame, 5, texts=held)
    assert {tuple(r) for r in out.select("question_id", "position", "chunk_id").collect()} == want
    single = held.where("chunk_id not in ('c3', 'c5')")
    assert "regexp_extract_all" not in evidence._worded(frame, evidence._named(single))._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_question_are_dealt_out_once(spark):
    from tessera.sources.shared import bucketed

    rows = bucketed(spark.createDataFrame([(i % 7, i) for i in range(50)] + [(None, 1)], "question_id int, n int"), "question_id")
    plan = rows.groupBy("question_id").agg(F.sum("n").alias("n"))
    assert "Exchange" not in plan._jdf.queryExecution().sparkPlan().toString() + plan._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in plan.collect()} == {(None, 1)} | {(k, sum(i for i in range(50) if i % 7 == k)) for k in range(7)}


LONG = "Rule: the two-handed sword's swing is slow. It is carried by\tBASED knights, as \"red dragon eggs\" are. " * 9 + "\n\nDesign note: red dragon eggs, no more.\r\nGM note - rules' rule\n \nÉd said: tests testing the Kelvin K, carried_on--based 9's."


@pytest.mark.parametrize("group", [1, 1024])
def test_passages_score_like_the_columns(spark, monkeypatch, group):
    """Each passage, and the best of each text, of odd texts, ids that repeat, missing ones and queries without words; queries that nobody asked give no row and no work."""
    monkeypatch.setattr(retrieval, "ASKED", group)
    texts = [(f"c{i}", t) for i, t in enumerate([*ODD, LONG, "gm's note: eggs", LONG.upper()])] + [("c7", "Rule: red eggs"), (None, "red")]
    chunks = spark.createDataFrame(texts, "id string, text string")
    asked = retrieval.prepared(spark.createDataFrame([(1, 'which "red dragon eggs" are rules'), (2, "tests carried_on two-handed sword's"), (3, ""), (4, None), (5, "the"), (1, "kelvin")], "query_id int, query string"))
    pairs = spark.createDataFrame([(q, c, 7) for q in (1, 2, 3, 4, 5, 6, None) for c in [*(f"c{i}" for i in range(12)), None]], "query_id int, chunk_id string, d int")
    rows = pairs.join(asked, "query_id").join(chunks, F.col("id") == F.col("chunk_id"))
    score = lambda p: F.round(text.passage_score(F.col("tokens"), F.col("phrases"), p), 6)
    every = rows.select("query_id", "chunk_id", "d", "tokens", "phrases", F.posexplode(text.passages(F.col("text"))).alias("i", "p")).select("query_id", "chunk_id", "d", "i", "p", score(F.col("p")))
    held, real = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df: held.append(df.count()) or real(df))
    found = retrieval.scored_passages(pairs, chunks, asked, False).select("query_id", "chunk_id", "d", "i", "passage", F.round("s", 6))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect())) and held == [5 * 13]
    best = rows.select("query_id", "chunk_id", F.round(text.best_passage_score(F.col("tokens"), F.col("phrases"), F.col("text")), 6).alias("s"), F.round(text.rule_label_score(F.col("tokens"), F.col("phrases"), F.col("text")), 6).alias("l"))
    want = {(r.query_id, r.chunk_id): (r.s or 0.0, r.l or 0.0) for r in best.groupBy("query_id", "chunk_id").agg(F.max("s").alias("s"), F.max("l").alias("l")).collect()}
    got = {(r.query_id, r.chunk_id): (r.passage_score, r.rule_label_score) for r in retrieval._scored_text(pairs, chunks, asked).collect()}
    assert got == {(r.query_id, r.chunk_id): want.get((r.query_id, r.chunk_id), (0.0, 0.0)) for r in pairs.collect()} and max(s for s, _ in got.values()) > 0.5


def test_far_buckets_give_what_reaches_the_floor(spark):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(f"c{i:03d}", [float(x) for x in rng.normal(size=4)]) for i in range(300)], "chunk_id string, embedding array<double>")
    index = retrieval.vector_index(vectors)
    asked = vectors.limit(9).select(F.expr("int(substring(chunk_id, 2))").alias("query_id"), "embedding", F.when(F.col("chunk_id") != "c003", 2.5).alias("floor"))
    found = retrieval.scored_buckets(retrieval.asked_buckets(asked, index, 4, True), index, 1, 300).collect()
    assert all(r.semantic_score >= 2.5 - 1e-5 for r in found if r.query_id != 3) and any(r.semantic_score < 0 for r in found if r.query_id == 3)


def test_a_null_id_takes_no_turn_before_the_hits(spark):
    rows = [(1, None, 1, True, 0.9, 1), (1, "a", 2, True, 0.8, 2), (1, "b", 3, False, None, None), (None, "a", 1, True, 0.9, 1)]
    ranked = spark.createDataFrame(rows, "question_id int, chunk_id string, position int, original_hit boolean, original_score double, original_rank int")
    texts = spark.createDataFrame([("a", "p", "red dragon"), ("b", "p", "old oak")], "chunk_id string, path string, text string")
    assert [(r.question_id, r.chunk_id) for r in evidence.select_evidence(ranked, texts, 1).collect()] == [(1, "a")]


@pytest.mark.parametrize("most", [1, 1_000_000])
def test_phrases_are_sought_by_segments_beyond_a_small_set(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "NAMES", most)
    seen, real = [], retrieval.segments
    monkeypatch.setattr(retrieval, "segments", lambda chunks, wanted=None: seen.append(wanted) or real(chunks, wanted))
    chunks = spark.createDataFrame([("a", "the red dragon, it sleeps"), ("b", "a red  dragon"), ("c", "blue bird sings"), ("d", None)], "id string, text string")
    phrases = spark.createDataFrame([("red dragon",), ("blue bird",), ("bird sings",)], "phrase string")
    assert {tuple(r) for r in retrieval.phrase_chunks(phrases, chunks).select("phrase", "chunk_id").collect()} == {("red dragon", "a"), ("red dragon", "b"), ("blue bird", "c"), ("bird sings", "c")}
    assert seen == [None] if most == 1 else len(seen[0]) >= 3
