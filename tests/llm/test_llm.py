"""Training-data operators against brute force, planted cases, held-out labels and hard inputs."""

import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam, language_id, line_dedup, mixing, near_copies, quality, repeats, run_index_dedup, simhash, substring_dedup, toxicity, url_filter
from tessera.llm.common import Scratch, table
from tessera.llm.queries import remainder

D = "/root/testdata/sf0.001"
HARD = [None, "", " \n\t ", "one", "a b c", "ß é\n😀 x", "same words again " * 60, "same words again " * 60, "x" * 50_000, "-", "\n\n", "1 2 3 4 5 6 7 8 9 10 11 12"]


def hard(spark):
    rows = [(i, t, "s" if i % 2 else None, "clash") for i, t in enumerate(HARD)] + [(None, "no id", None, "c"), (3, "one", "s", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")


def brute(texts, words, size):
    units = [((t or "").encode().split() if words else (t or "").encode()) for t in texts]
    seen = collections.Counter(tuple(u[i : i + size]) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        mask = [False] * len(u)
        for i in range(len(u) - size + 1):
            if seen[tuple(u[i : i + size])] > 1:
                mask[i : i + size] = [True] * size
        out.append([x for x, m in zip(u, mask, strict=True) if not m])
    return out


@pytest.mark.parametrize(("crowd", "segment"), [(1000, 1 << 17), (1, 64)])
def test_repeats_match_brute_force(spark, monkeypatch, crowd, segment):
    """Passages, whole copies, near copies that differ everywhere, texts of one letter; also as crowds and in segments."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rng = random.Random(5)
    shared = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(3)]
    texts = [" ".join(rng.choice("ijkl") * rng.randint(1, 4) for _ in range(rng.randint(0, 90))) + " " + rng.choice([*shared, "", shared[0][:130]]) for _ in range(40)] + ["ab " * 80, "a" * 200, "", "zz", None, shared[1], shared[1]]
    base = [rng.choice("mnopq") * rng.randint(1, 3) for _ in range(60)]
    texts += [" ".join([*base[:i], f"{i}x", *base[i + 1 :]]) for i in range(0, 60, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r.text for r in substring_dedup.remove_repeats(docs, window=7).orderBy("doc_id").collect()]
    assert [(g or "").encode().split() for g in got] == brute(texts, True, 7)
    got = [list(bytes(r.text or b"")) for r in run_index_dedup.remove_long_repeats(docs, window=30).orderBy("doc_id").collect()]
    assert got == brute(texts, False, 30)


def test_matching_statistics():
    rng = random.Random(3)
    long = bytes(rng.choice(b"ab") for _ in range(120))
    for pieces in ([b"banana", b"bandana", b"nab"], [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaa"], [long, long[5:90] + b"c", b"c" + long[:70], long[::-1]]):
        _statistics_match(pieces)


def _statistics_match(pieces):
    stats, at, whole = run_index_dedup.RunIndex(pieces).matching_statistics(), 0, pieces
    for p in pieces:
        for i in range(len(p)):
            best = max(len(_prefix(p[i:], q[j:])) for q in whole for j in range(len(q) + 1) if (q is not p or i != j))
            assert stats[at + i] == best
        at += len(p) + 1


def _prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def test_simhash_matches_brute_force(spark):
    docs = table(spark, D, "documents").select("doc_id", "text")
    rows = docs.collect()

    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {r.doc_id: fp(r.text) for r in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("fp"), "component_id").collect()
    assert {tuple(r) for r in got} == {(i, f"{prints[i]:016x}", find(i)) for i in ids}


def test_multi_index_finds_every_link(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for p in prints for _ in range(3)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert got == expected


@pytest.mark.parametrize("crowd", [16, 2])
def test_pipeline_near_dedup_keeps_one_of_each_jaccard_group(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rng = random.Random(11)
    made = []
    passage = " ".join(f"p{i}" for i in range(40))
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 9) if g else 40):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = f"E{rng.randrange(10**6)}"
            made.append(" ".join(w) + (" " + passage if g % 3 == 0 else ""))
    texts = [*(r.text for r in table(spark, D, "documents").select("text").collect()), *made, *(passage + f" tail{i} " * 3 for i in range(20)), *(t for t in HARD if t != "")]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])) > 0:
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, D).collect()} == {i for i in range(len(sets)) if find(i) == i}


def test_nodes_around_one_meet_by_what_differs(spark):
    """Edited copies around several nodes: every similar pair is linked to the middle one, or meets; few others do."""
    rng = random.Random(23)
    sets, base = {}, list(range(200))
    for i in range(240):
        words = list(base[: rng.choice((200, 190, 170))])
        for _ in range(rng.choice((0, 1, 3, 8, 12, 15))):
            words[rng.randrange(len(words))] = rng.randrange(1000, 1400)
        sets[i] = {hash(tuple(words[k : k + 5])) for k in range(len(words) - 4)}
        if i % 6 == 1:
            sets[i] = set(sets[i - 1]) ^ {rng.randrange(10**6) for _ in range(rng.randint(1, 30))}
    sets[500], sets[501] = {1}, {1, 2}
    sets = {i: x for i, x in sets.items() if i == min(j for j in sets if sets[j] == x)}
    assert {0, 7} <= set(sets)
    alike = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    similar = {(i, j) for i in sets for j in sets if i < j and alike(sets[i], sets[j])}
    held = spark.createDataFrame([(i, list(x)) for i, x in sets.items()], "node long, hashes array<long>")
    for known in ({}, {i: 0 for i in sets if i < 240 and alike(sets[i], sets[0])} | {i: 3 for i in (3, 4)}):
        members = spark.createDataFrame([(p, i, 0, known.get(i, i)) for p in (0, 7) for i in sets], "p long, node long, check long, root long")
        with Scratch(spark) as scratch:
            direct, pairs = (sorted(map(tuple, x.collect())) for x in near_copies.differing(members, lambda wanted: held.join(wanted.distinct(), "node"), scratch))
        assert set(direct) == {(p, i) for p in (0, 7) for i in sets if i != p and alike(sets[p], sets[i])}
        for p in (0, 7):
            near = {i for i in sets if alike(sets[p], sets[i]) or known.get(i, i) == p}
            missing = {(i, j) for i, j in similar if not {i, j} <= near and known.get(i, i) != known.get(j, j) and p not in (i, j)} - set(pairs)
            assert not missing
        assert len(set(pairs) - similar) < len(sets) ** 2 / 20


def test_nodes_that_met_around_one_are_not_paired_again(spark, monkeypatch):
    """Unlike copies of one text share many small places; two around the same node are compared only if what differs from it says so."""
    monkeypatch.setattr(near_copies, "CROWD", 4)
    rng, texts = random.Random(5), []
    base = [f"w{rng.randrange(3000)}" for _ in range(100)]
    for _ in range(250):
        w = list(base)
        for k in rng.sample(range(100), rng.choice((2, 3, 4))):
            w[k] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    around, meeting, compared = collections.defaultdict(set), set(), []
    differing, verified = near_copies.differing, near_copies.verified

    def met(members, *rest):
        direct, pairs = differing(members, *rest)
        for r in members.collect():
            around[r.node].add(r.p)
        meeting.update(tuple(sorted(r)) for r in pairs.collect())
        return direct, pairs

    def counted(pairs, *rest):
        compared.append({tuple(sorted(r)) for r in pairs.collect()})
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "differing", met)
    monkeypatch.setattr(near_copies, "verified", counted)
    near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id").collect()
    assert len(around) > 200
    assert not {(a, b) for a, b in compared[-1] - meeting if around[a] & around[b]}


def test_near_copies_recall(spark):
    """Of all pairs of sf0.01 at similarity 0.8 or more, by brute force, nine in ten at least end in one group; nothing else does."""
    rows = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    sets, where = {}, collections.defaultdict(list)
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in sets[r.doc_id]:
            where[x].append(r.doc_id)
    common = collections.Counter(p for ids in where.values() for i, a in enumerate(ids) for p in ((a, b) for b in ids[:i]))
    similar = {p for p, n in common.items() if 9 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]))}
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    of = {r.doc_id: r.component_id for r in near_copies.groups(docs, "doc_id").collect()}
    near = [p for p in similar if sets[p[0]] != sets[p[1]]]
    assert len(near) >= 10 and np.mean([of[a] == of[b] for a, b in near]) >= 0.9
    assert all(of[a] == of[b] for a, b in similar if sets[a] == sets[b])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in similar:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    empty = min(i for i in sets if not sets[i]) if any(not s for s in sets.values()) else None
    assert all(find(i) == find(c) or (not sets[i] and c == empty) for i, c in of.items())


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://A.Example.NET/en/x?q#f", "http://example.net/de/", "http://x.example.com/de/1", "https://h.org/fr/", "https://h.org/en/", "http://notnet/"]
    docs = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(docs).collect()}
    assert got[0][:3] == got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4] == ("example.net", "/de/", "net/", "block")
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow") and got[7][2] is None and got[8][2] is None
    assert url_filter.filter_urls(docs.where("false")).count() == 0


def test_quality_counts(spark):
    def count(t):
        w = (t or "").split()
        runs = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)

    docs = table(spark, D, "documents").select("doc_id", "text").unionByName(hard(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = quality.judge(docs, table(spark, D, "labels").where("quality = 1").select("doc_id")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == count(r.text)
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in table(spark, D, "labels").collect()}
    good = [r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(good) > 0.97


def test_decontamination_and_lines_on_hard_inputs(spark):
    items = spark.createDataFrame([(1, "1 2 3 4 5 6 7 8 9 10"), (2, "b c"), (None, "one"), (3, None), (2, "b c")], "item_id long, text string")
    got = {r.text: r for r in decontam.contamination(hard(spark), items).collect()}
    assert got["1 2 3 4 5 6 7 8 9 10 11 12"].n_hit == 10 and got["a b c"].item_list == ["2"] and got["a b c"].n_hit == 2
    assert not got[None].contaminated and not got["one"].contaminated
    assert decontam.proximity_matches(spark.createDataFrame([("x c y b",)], "text string"), items.where("item_id = 2"), 2).count() == 1
    docs = spark.createDataFrame([(i, "s", f"menu\nbody {i}\n menu ") for i in range(5)] + [(9, None, "menu"), (10, "t", None)], "doc_id int, source string, text string")
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(docs).collect()}
    assert out[0] == ("body 0", 2) and out[9] == ("menu", 0) and out[10] == (None, 0)


def test_mixing_draws_poisson(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 5000, "big").when(F.col("id") < 5900, "mid").alias("source"))
    got = {r.source: r.n for r in mixing.mix(docs, weights={"big": 1.0, "mid": 1.0, "\0": 2.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["big"] - 1500) < 150 and abs(got["mid"] - 1500) < 150 and abs(got[None] - 3000) < 200
    again = mixing.mix(docs).select("doc_id", "copy_no")
    assert again.exceptAll(mixing.mix(docs).select("doc_id", "copy_no")).count() == 0


def test_network_gradient():
    net = language_id.Network(["a", "b"], hidden=3)
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, mask = rng.integers(97, 101, (5, 4)), np.array([0, 1, 1, 0]), np.ones((5, 4))
    value, grad = net.loss(x, y, mask)
    for k, at in (("fu", (1, 4)), ("bx", (98, 2)), ("bu", (0, 7)), ("out", (4, 1)), ("fx", (99, 8))):
        net.p[k][at] += 1e-4
        up = net.loss(x, y, mask)[0]
        net.p[k][at] -= 1e-4
        assert abs((up - value) / 1e-4 - grad[k][at]) < 2e-3


def test_language_and_toxicity_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held = remainder(4) == 2
    net = language_id.train(docs, ~held)
    got = language_id.identify(docs.where(held), net).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    odd = {r.text: (r.lang_pred, r.score) for r in language_id.identify(hard(spark), net).collect()}
    assert odd[None] == odd[""] == odd["-"] == ("und", 0.0) and odd["one"][0] != "und"
    net = None
    assert {r.lang_pred for r in language_id.identify(hard(spark), net).collect()} == {"und"}


def _auc(good, bad):
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_held_out(spark, sf):
    """Scores of documents that taught nothing rank toxic ones first, and clean ones are left alone."""
    d = f"/root/testdata/{sf}"
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    got = toxicity.score(docs, labels, remainder(3) != 1).join(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where(remainder(3) == 1).collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert _auc(toxic, clean) > 0.85 and np.mean([x >= 0.7 for x in clean]) < 0.02
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def _plain_model(texts):
    """Both classes' probabilities of a gram's last byte, by dictionaries."""
    def padded(t):
        line = " ".join("".join(chr(b) if chr(b).isalnum() and b < 128 or b > 127 else " " for b in t.lower().encode()).split(" "))
        while "  " in line:
            line = line.replace("  ", " ")
        return line.lstrip(" ") if not line.startswith(" ") else line[1:]

    level = {k: collections.Counter() for k in (0, 1)}
    for t, k in texts:
        line = " " * 5 + padded(t)
        level[k].update(line[i : i + 6] for i in range(len(line) - 5))
    tables = {}
    for n in range(6, 2, -1):
        least = min(sum(level[k].values()) for k in (0, 1))
        for k in (0, 1):
            d, all_, cut = toxicity.DISCOUNT * sum(level[k].values()) / least, collections.Counter(), collections.Counter()
            for g, c in level[k].items():
                all_[g[:-1]] += c
                cut[g[:-1]] += min(c, d)
            tables[n, k] = {g: max(c - d, 0) / all_[g[:-1]] for g, c in level[k].items()}, {x: cut[x] / all_[x] for x in all_}
        level = {k: collections.Counter({g[1:] for g in level[k]} and [g[1:] for g in level[k]]) for k in (0, 1)}
    pairs = collections.Counter()
    for k in (0, 1):
        pairs.update(level[k])
    grid = np.zeros((256, 256))
    for g, c in pairs.items():
        grid[ord(g[0]), ord(g[1])] = c
    shared = toxicity._pairs(grid).reshape(256, 256)

    def evidence(t):
        line, out = " " * 5 + padded(t), []
        for i in range(len(line) - 5):
            g = line[i : i + 6]
            p = []
            for k in (0, 1):
                q = shared[ord(g[4]), ord(g[5])]
                for n in range(3, 7):
                    own, back = tables[n, k]
                    q = own.get(g[-n:], 0.0) + back.get(g[-n:-1], 1.0) * q
                p.append(q)
            out.append(np.log(1 - toxicity.MIX + toxicity.MIX * p[1] / p[0]))
        return np.mean(out) if out else 0.0

    return evidence


@pytest.mark.parametrize("entries", [8_000_000, 40])
def test_toxicity_models_match_dictionaries(spark, monkeypatch, entries):
    monkeypatch.setattr(toxicity, "ENTRIES", entries)
    rng = random.Random(4)
    words = ["such", "suchlike", "oaf", "oafish", "a", "and", "the", "tree", "trees", "9"]
    texts = [(" ".join(rng.choice(words[:4] if k and rng.random() < 0.5 else words[4:] + ["oaf"]) for _ in range(30)) + ".", k) for k in (0, 1, 0, 0, 1, 0, 0, 0)]
    plain = _plain_model(texts)
    asked = [t for t, _ in texts] + ["", "new words, oafs", "the tree and such"]
    with Scratch(spark) as scratch:
        models = toxicity.Models(toxicity.gram_counts(spark.createDataFrame([(t, k, i % 2) for i, (t, k) in enumerate(texts)], "text string, toxic int, half int")), scratch)
        assert (models.parts(toxicity.ALL) > 1) == (entries == 40)
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "row int, text string")
        got = {r.row: r.x for r in toxicity.evidence(rows, models, toxicity.ALL, scratch).collect()}
    assert [got[i] for i in range(len(asked))] == pytest.approx([plain(t) for t in asked], abs=1e-6)


def test_toxicity_on_hard_inputs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    scored = toxicity.score(docs.select("doc_id", "text").unionByName(hard(spark).select((-F.col("doc_id") - 1).alias("doc_id"), "text")), table(spark, "/root/testdata/sf0.01", "labels"), remainder(3) != 1).collect()
    assert len(scored) == docs.count() + len(HARD) + 2 and all(0 <= r.score <= 1 for r in scored)


CLASH = ["k1", "k2", "row", "rate", "name", "parts", "order", "host", "line", "bad", "kept_", "_key", "_id", "id", "target", "ok", "x", "toxic", "node", "least", "h", "n", "letter", "trusted", "limit", "words", "_"]


def every_operator(labels):
    """Each operator on documents with a page's url, giving one row for each row unless it selects rows."""
    return {
        "url": lambda d: url_filter.filter_urls(d), "simhash": lambda d: simhash.near_duplicates(d), "lines": lambda d: line_dedup.drop_boilerplate(d), "language": lambda d: language_id.identify(d, language_id.train(d, F.lit(True))),
        "words": lambda d: substring_dedup.remove_repeats(d), "toxicity": lambda d: toxicity.score(d, labels, F.lit(True)), "benchmark": lambda d: decontam.contamination(d, labels.select("item_id", "text")),
        "bytes": lambda d: run_index_dedup.remove_long_repeats(d), "quality": lambda d: quality.judge(d, labels.where("quality = 1").select("doc_id"))}


def test_operators_take_hard_and_empty_inputs(spark):
    """Nulls in every column, empty and long texts, repeated rows, an empty table: a row for each row, and the same again."""
    docs = hard(spark).withColumns({"url": F.when(F.col("doc_id") % 3 == 0, "http://A.net/x").when(F.col("doc_id") % 3 == 1, F.col("text")), "lang": F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")})
    labels = spark.createDataFrame([(1, 0, 0, 1, "one two"), (3, 1, 1, 2, None), (None, 1, 1, None, "a b c"), (6, None, None, 3, ""), (6, 1, 1, 4, "same words again")], "doc_id long, quality int, toxic int, item_id long, text string")
    n, empty = docs.count(), docs.where("false")
    for name, f in every_operator(labels).items():
        got = f(docs)
        assert got.count() == n and f(empty).count() == 0, name
        assert {"n_words", "source"} <= set(got.columns) or name == "simhash"
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs, weights={}).count() == mixing.mix(docs, weights={"nobody": 1.0}).count() == 0
    assert simhash.keep_one(docs).count() == len(simhash.near_duplicates(docs).select("component_id").distinct().collect())


def test_no_column_clashes_or_is_lost(spark):
    """Input columns named like any working column come back as they were."""
    rows = [(i, f"text number {i} of several " * (i % 3 + 1), "s", "http://a.net/" + str(i), "en" if i % 2 else "de", *[f"{c}{i}" for c in CLASH]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, url string, lang string, " + ", ".join(f"`{c}` string" for c in CLASH))
    labels = spark.createDataFrame([(i, i % 2, i % 2, i, f"text number {i}") for i in range(4)], "doc_id long, quality int, toxic int, item_id long, text string")
    expected = {r[0]: tuple(r[5:]) for r in rows}
    for name, f in every_operator(labels).items():
        if name == "simhash":
            continue
        added = {"url": ("host",)}.get(name, ())
        names = [c for c in CLASH if c not in added]
        got = {r.doc_id: tuple(r[c] for c in names) for r in f(docs).collect()}
        assert got == {k: tuple(v for c, v in zip(CLASH, x, strict=True) if c in names) for k, x in expected.items()}, name
    for r in [*mixing.mix(docs).collect(), *simhash.keep_one(docs).collect()]:
        assert tuple(r[c] for c in CLASH) == expected[r.doc_id]


def test_one_very_long_text(spark):
    """A text of 10 MB beside small ones, whole: its repeats are found at both ends."""
    rng = random.Random(8)
    line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    long = line + " " + " ".join(f"{i}x{i * 7919 % 1000003}" for i in range(750_000)) + " " + line
    docs = spark.createDataFrame([(1, long), (2, line[:300]), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[1].n_words == 750_400 and got[1].n_removed == 400 and got[3].n_words == 0
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in run_index_dedup.remove_long_repeats(docs).collect()}
    assert got[1] == (len(long), 2 * len(line) + 1, 2) or got[1] == (len(long), 2 * len(line), 2)
    assert language_id.identify(docs, None).count() == simhash.near_duplicates(docs).count() == 3


def test_pipeline_stages(spark, tmp_path):
    """Each stage on planted rows: what it must drop goes, what is clean stays, and the columns of documents come back."""
    names = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda rows: spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], names)
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 400")
    mixed = docs.unionByName(make([(9001, None, "en", "s"), (9002, "123 456 - 789", "en", "s"), (None, "", None, None)]))
    kept = corpus_pipeline.keep_languages(spark, mixed, D)
    assert kept.columns == docs.columns and not {9001, 9002, None} & {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.count() >= 0.98 * docs.where(F.col("text").rlike(r"\p{L}")).count()
    lines = make([(i, f"own line {i}\nSubscribe now\nmore {i * 7}", "en", "s") for i in range(12)] + [(20, None, None, None), (21, "", "en", "s")])
    got = {r.doc_id: r for r in corpus_pipeline.drop_lines(spark, lines, D).collect()}
    assert len(got) == 14 and all(got[i].text == f"own line {i}\nmore {i * 7}" and got[i].n_chars == len(got[i].text) for i in range(12)) and got[20].text is None
    item = table(spark, "/root/testdata/sf0.01", "benchmark").orderBy("item_id").first().text
    dirty = make([(1, "before it " + item + " after it", "en", "s"), (2, "nothing of the kind is here", "en", "s"), (3, None, "en", "s")])
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, dirty, "/root/testdata/sf0.01").collect()} == {2, 3}
    out = corpus_pipeline.mix_sources(spark, lines, D)
    assert {r.doc_id for r in out.collect()} <= set(got) and set(out.columns) >= set(docs.columns)
    whole = corpus_pipeline.run(spark, D)
    assert 0 < whole.count() < 3 * table(spark, D, "documents").count() and {r.doc_id for r in whole.collect()} <= {r.doc_id for r in table(spark, D, "documents").collect()}
