"""The Merkle manifest, chat formatting and whitening against plain Python, numpy and hard inputs."""

import hashlib
import json
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, merkle, whitening
from tessera.llm.common import Scratch
from tessera.llm.queries import op12_chat_formatting, op13_whitening, remainder

D = "/root/testdata/sf0.001"


# ---- manifest -------------------------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[2], row[3], row[4], text)])


def climbed(nodes):
    """The root of a list of digests, and for each of them the (left, right) siblings up to it."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            ways[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        at = [p // 8 for p in at]
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], ways


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    trees = {k: sorted(v, key=lambda x: x[:3]) for k, v in trees.items()}
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    below = {k: climbed([x[2] for x in trees[k]]) for k in order}
    root, above = climbed([below[k][0] for k in order])
    out = []
    for k, up in zip(order, above, strict=True):
        for (_, _, leaf, r), way in zip(trees[k], below[k][1], strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            cur = leaf_of(r, "".join(c.lower() if c.isascii() else c for c in r[1])) if bad else leaf
            for left, right in way + up:
                cur = h(left, cur, right)
            out.append((r[0], leaf, below[k][0], root, h(*[x for pair in way + up for x in pair]), cur, cur == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_matches_plain_loops(spark, monkeypatch, height):
    """Several tiers of blocks, last runs of one, lone leaves, null and empty languages, null ids and texts, repeated rows, a clashing column."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    langs = ["en"] * 585 + ["fr"] * 73 + ["de"] * 8 + ["es"] * 9 + ["", None, None, "É"] + [f"x{i}" for i in range(7)]
    rows = [(i * 7 % 683, f"Text {i} É" if i % 5 else None, "s" if i % 3 else None, k, None if i % 11 == 0 else i, "clash") for i, k in enumerate(langs)]
    rows += [(None, "", "", None, 0, "c"), (5, "A" * 100_000, "s", "en", 1, "c"), (3, "Same", "s", "en", 1, "c"), (3, "Same", "s", "en", 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, leaf string").repartition(3)
    got = merkle.verified(docs, remainder(3) == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows)


def test_manifest_of_few_rows(spark):
    docs = spark.createDataFrame([(7, "Abc", None, "en", 3)], "doc_id long, text string, source string, lang string, n_chars long")
    r = merkle.verified(docs, F.lit(None).cast("boolean")).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf_of((7, "Abc", None, "en", 3), "Abc") and r.proof_sha256 == h() and r.verified
    assert merkle.verified(docs.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_van_emde_boas_order(levels):
    """Each place is taken once, and both halves of a tree split at half its height lie in one stretch each."""
    at = [merkle.address(d, np.arange(8**d), levels) for d in range(levels)]
    assert sorted(np.concatenate(at).tolist()) == list(range(merkle.places(levels)))
    if levels > 1:
        upper = levels // 2
        assert max(a.max() for a in at[:upper]) == merkle.places(upper) - 1
        first = np.concatenate([at[d][: 8 ** (d - upper)] for d in range(upper, levels)])
        assert sorted(first.tolist()) == list(range(merkle.places(upper), merkle.places(upper) + merkle.places(levels - upper)))


def test_blocks_are_stored_whole(spark):
    """A tree of more than one block has its leaves' blocks and those of their roots, and each stored digest is at its address."""
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(5000)]
    with Scratch(spark) as scratch:
        rows = spark.createDataFrame([("=en", i, 5000, bytearray(x)) for i, x in enumerate(leaves)], "tree string, pos long, n long, digest binary")
        tiers = [t.orderBy("block").collect() for t in merkle.tiers_of(scratch, rows)]
    assert [(len(t), [r.slots for r in t]) for t in tiers] == [(2, [4096, 904]), (1, [2])]
    at = merkle.address(4, np.arange(4096), 5)[100] * 32
    assert tiers[0][0].nodes[at : at + 32] == leaves[100] and tiers[1][0].digest.hex() == climbed([x.hex() for x in leaves])[0]


# ---- chat -----------------------------------------------------------------------------------------

HARD = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_sep|>x", "<<|im_start|>", "[<s>", "\\", "<|im_", "é😀<|im_sep|>\n", "a\nb\r\n", "$1\\2", "</INST]", "x" * 70_000]


@pytest.fixture(scope="module")
def chats(spark):
    turns = [{"role": r, "text": t} for t in HARD for r in ("user", "assistant", t[:40])]
    rows = [(0, turns), (1, []), (2, None), (3, turns[1:2]), (4, turns[:1] * 300)]
    return spark.createDataFrame(rows, f"id long, turns {chat.TURNS}")


def test_chats_are_read_back(chats):
    """Texts and roles with control strings, escapes and none; no turns; many turns. Spans point at the escaped texts."""
    asked = {r.id: [(t.role, t.text) for t in r.turns or []] for r in chats.collect()}
    for r in chat.read_back(chat.formatted(chats)).collect():
        assert [(t.role, t.text) for t in r.turns] == asked[r.id]
        assert r.loss_text == "".join(t for role, t in asked[r.id] if role == "assistant")
        marks = chat.Template()
        assert r.formatted.count(marks.opens) == r.formatted.count(marks.parts) == r.formatted.count(marks.closes) == len(asked[r.id])
        assert not any(c in r.formatted for c in ("</s>", "[INST]", "[/INST]", "<s>"))
        assert [(s.end - s.start, s.loss) for s in r.spans][:2] == [(len(t), role == "assistant") for role, t in asked[r.id]][:2]
        for s, (role, text) in zip(r.spans, asked[r.id], strict=True):
            assert len(r.formatted[s.start : s.end]) >= len(text) and r.formatted[s.end :].startswith(marks.closes) and r.formatted[: s.start].endswith(marks.parts)


@given(st.lists(st.tuples(st.sampled_from(["u", "<s>", "assistant"]), st.text(alphabet="<[\\|ims_endINST/]>tar x")), max_size=4))
def test_any_text_can_be_escaped(turns):
    """The same patterns in Python: no control string stays, and restoring undoes it."""
    import re

    marks = chat.Template()
    for _, text in turns:
        escaped = re.sub(marks.pattern(""), lambda m: m[1] + "\\" + m[2], text)
        assert not any(c in escaped for c in marks.controls)
        assert re.sub(marks.pattern(r"\\"), lambda m: m[1] + m[2], escaped) == text


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(closes="END")


def test_layouts_are_found_by_their_paths(spark):
    """Records of many layouts in one table of JSON lines, with nulls, empty arrays and other fields; unknown ones stay without turns."""
    lines = [
        ({"id": 1, "prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"id": 2, "prompt": "p", "completion": None, "system": "s"}, "prompt_completion", [("system", "s"), ("user", "p")]),
        ({"id": 3, "instruction": "i", "input": "x", "output": "o", "source": "web"}, "instruction_output", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"id": 4, "messages": [{"role": "user", "content": "a"}, {"role": None, "content": None}]}, "messages", [("user", "a"), ("", "")]),
        ({"id": 5, "messages": []}, "messages", []),
        ({"id": 6, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": ""}]}, "conversations", [("user", "a"), ("assistant", "b"), ("tool", "")]),
        ({"id": 7, "question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"id": 8, "prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"id": 9, "prompt": "p", "messages": [{"role": "user", "content": "a"}]}, None, None),
        ({"id": 10, "layout": "clash"}, None, None),
    ]
    records = spark.read.json(spark.sparkContext.parallelize([json.dumps(x) for x, _, _ in lines], 2))
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns] if r.turns else (None if r.turns is None else [])) for r in chat.canonical(records).collect()}
    assert got == {x["id"]: (name, turns) for x, name, turns in lines}


def test_nested_layouts(spark):
    own = chat.Layout("nested", turns=(("user", ("data.ask",)), ("assistant", ("data.reply",))))
    records = spark.createDataFrame([(1, ("a", "b")), (2, None)], "id int, data struct<ask:string,reply:string>")
    assert [(r.layout, r.turns and len(r.turns)) for r in chat.canonical(records, (own,)).orderBy("id").collect()] == [("nested", 2), (None, None)]


def test_conversations_of_hard_rows(spark, tmp_path):
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "a", "x"), (1, None, "system", "<s>", "x"), (1, 1, "assistant", None, "x"), (None, 0, "assistant", "no id", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op12_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {1, None, -1} and got[1].n_turns == 4 and got[1].loss_chars == 0 and got[None].loss_chars == 5
    assert got[1].turns_sha256 == h("system\n<s>\n", "\na\n", "assistant\n\n" * 2) and got[-1].loss_sha256 == h("</s>[INST] ok [/INST]")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op12_chat_formatting(spark, f"{tmp_path}/none").count() == 1


def test_chat_formatting_runs_on_the_jvm(spark):
    plan = op12_chat_formatting(spark, D)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- whitening ------------------------------------------------------------------------------------

def exact(vectors):
    """Components by numpy over the distinct vectors."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    c = (n * fit - total) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    return x, n, total, values[::-1], basis[:, ::-1]


def test_whitening_matches_a_dense_solver(spark):
    got = op13_whitening(spark, D).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{D}/embeddings.parquet").orderBy("vec_id").collect()
    x, n, total, values, basis = exact([r.embedding for r in rows])
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10
    w = got.whitened.to_numpy().reshape(-1, 16)
    expected = ((n * x - total) / n) @ (basis[:, :16] / np.sqrt(values[:16]))
    assert np.abs(np.abs(w) - np.abs(expected)).max() < 1e-9
    assert np.allclose(got.explained.to_numpy()[:16], values[:16] / values.sum(), rtol=1e-10)
    assert got.deviation.to_numpy()[::16].tolist() == ((n * x - total) ** 2).sum(axis=1).tolist()


def test_whitening_of_hard_inputs(spark):
    """Null, not finite, empty and odd vectors go; copies are fitted once and all come back; flat directions give no component."""
    nan, inf = float("nan"), float("inf")
    sound = [[0.1 * i, -0.2 * (i % 3), 0.5] for i in range(9)]
    rows = [(i, v, "clash") for i, v in enumerate(sound)] + [(3, sound[3], "c"), (None, sound[0], "c"), (90, None, "c"), (91, [], "c"), (92, [1.0, None, 2.0], "c"), (93, [nan, 0.0, 0.0], "c"), (94, [inf, 0.0, 0.0], "c"), (95, [1.0], "c")]
    kind = "vec_id long, embedding array<float>, whitened string"
    got = whitening.whitened(spark.createDataFrame(rows, kind)).toPandas()
    assert len(got) == 11 * 2 and set(got.n) == {9} and set(got.component) == {1, 2} and got.vec_id.isna().sum() == 2
    assert got.identity_error.max() < 1e-12 and abs(got.explained[:2].sum() - 1) < 1e-12
    for few in ([], rows[:1], [rows[0]] * 3):
        assert whitening.whitened(spark.createDataFrame(few, kind)).count() == 0


@pytest.mark.parametrize("size", [1, 5, 40, 400])
def test_jacobi_davidson(size):
    """Against a dense solver, also with restarts (400), repeated and zero eigenvalues; no more products than a few for each round."""
    rng = np.random.default_rng(size)
    basis = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = np.sort(np.concatenate([rng.uniform(0.5, 1, size - size // 3), np.zeros(size // 3)]))[::-1].copy()
    if size > 4:
        values[1:3] = values[1]
    v = basis * values @ basis.T
    passes = []
    got, vectors = whitening.jacobi_davidson(lambda z: passes.append(z.shape[1]) or v @ z, size, 16)
    k = min(16, size)
    assert np.abs(got - values[:k]).max() < 1e-12 and np.abs(v @ vectors - vectors * got).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12 and len(passes) < 200


def test_minres_solves():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((12, 12))
    a, b = a + a.T, rng.standard_normal((12, 3))
    assert np.abs(a @ whitening.minres(lambda z: a @ z, b, 12) - b).max() < 1e-6
