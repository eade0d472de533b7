"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, labels every byte position with a distribution over the
languages, and a document's distribution is the mean over all positions of its whole text. It is trained in
numpy by backpropagation through time with Adam, on windows from a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, small_batches, texts_of

#: Texts of each language in the training sample, at most; windows taken from each; bytes in a window.
SAMPLE, WINDOWS, LENGTH = 300, 12, 64
HIDDEN, STEPS, BATCH, RATE = 12, 260, 192, 0.02
#: Windows that a task runs at once.
WIDE = 4096


class Network:
    """Two GRU cells, one for each direction, and a linear layer over both states at each position."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.h = classes, hidden
        one = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(hidden))).astype(np.float32)
        self.p = {"out": one(2 * hidden, len(classes)), "bias": np.zeros(len(classes), np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": one(256, 3 * hidden) * 0.5, f"{d}u": one(hidden, 3 * hidden)}

    def step(self, d: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.h
        a, u = np.take(self.p[f"{d}x"], x, axis=0, mode="clip"), h @ self.p[f"{d}u"]
        g = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
        z, r, un = g[:, :n], g[:, n:], u[:, 2 * n :]
        c = r * un
        c += a[:, 2 * n :]
        c *= 2
        c = _sigmoid(c)
        c *= 2
        c -= 1
        new = h - c
        new *= z
        new += c
        return new, z, r, c, un

    def states(self, d: str, x: np.ndarray, full: bool = False) -> list:
        """States after each position, in text order; full: with what backpropagation needs."""
        h = np.zeros((x.shape[1], self.h), np.float32)
        out = [None] * len(x)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            got = self.step(d, x[t], h)
            out[t] = (h, *got) if full else got[0]
            h = got[0]
        return out

    def loss(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions that mask has, and the gradients. x and mask: (length, batch)."""
        n, kept = self.h, {d: self.states(d, x, True) for d in "fb"}
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        into, total, scale = {"f": [], "b": []}, 0.0, np.float32(1 / mask.sum())
        for t in range(len(x)):
            s = np.concatenate((kept["f"][t][1], kept["b"][t][1]), axis=1)
            p = _softmax(s @ self.p["out"] + self.p["bias"])
            total -= float((np.log(p[np.arange(len(y)), y] + 1e-9) * mask[t]).sum() * scale)
            p[np.arange(len(y)), y] -= 1
            p *= (mask[t] * scale)[:, None]
            grad["out"] += s.T @ p
            grad["bias"] += p.sum(0)
            ds = p @ self.p["out"].T
            into["f"].append(ds[:, :n])
            into["b"].append(ds[:, n:])
        for d in "fb":
            carry = np.zeros_like(into[d][0])
            for t in reversed(range(len(x))) if d == "f" else range(len(x)):
                h, _, z, r, c, un = kept[d][t]
                dh = into[d][t] + carry
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * un * r * (1 - r)
                da = np.concatenate((dz, dr, dc), axis=1)
                du = np.concatenate((dz, dr, dc * r), axis=1)
                np.add.at(grad[f"{d}x"], x[t], da)
                grad[f"{d}u"] += h.T @ du
                carry = dh * z + du @ self.p[f"{d}u"].T
        return total, grad

    def train(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> list[float]:
        rng, losses = np.random.default_rng(seed), []
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        groups = [np.flatnonzero(labels == k) for k in range(len(self.classes))]
        for i in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups if len(g)])
            mask = (np.arange(windows.shape[1])[:, None] < lengths[pick][None, :]).astype(np.float32)
            value, grad = self.loss(windows[pick].T, labels[pick], mask)
            losses.append(value)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * min(1.0, 2.0 / max(norm, 1e-9)) * (0.05 + 0.95 * (1 - i / steps))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return losses

    def window_sums(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sums of the position distributions of each window: (batch, classes)."""
        n, k, x = self.h, len(self.classes), x.astype(np.int64)
        ahead, behind, bias = self.p["out"][:n].T.copy(), self.p["out"][n:].T.copy(), self.p["bias"][:, None]
        h, first = np.zeros((x.shape[1], n), np.float32), []
        for t in range(len(x)):
            h = self.step("f", x[t], h)[0]
            first.append(ahead @ h.T + bias)
        h, out = np.zeros((x.shape[1], n), np.float32), np.zeros((k, x.shape[1]), np.float32)
        for t in reversed(range(len(x))):
            h = self.step("b", x[t], h)[0]
            p = first[t]
            p += behind @ h.T
            p -= p.max(0)
            np.exp(p, out=p)
            p *= mask[t] / p.sum(0)
            out += p
        return out.T

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean distributions of whole texts; zeros for empty ones."""
        size = np.diff(offsets)
        count = -(-size // LENGTH)
        row = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = offsets[row] + nth * LENGTH
        length = np.minimum(LENGTH, offsets[row + 1] - begin)
        sums = np.zeros((len(size), len(self.classes)), np.float64)
        for a in range(0, len(row), WIDE):
            b = min(a + WIDE, len(row))
            at = begin[a:b][None, :] + np.arange(LENGTH)[:, None]
            mask = np.arange(LENGTH)[:, None] < length[a:b][None, :]
            x = np.where(mask, data[np.minimum(at, len(data) - 1)], 0)
            np.add.at(sums, row[a:b], self.window_sums(x, mask.astype(np.float32)))
        return sums / np.maximum(size, 1)[:, None]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    """The logistic function, in place; exponentials are several times faster here than hyperbolic tangents."""
    np.clip(v, -40, 40, out=v)
    np.negative(v, out=v)
    np.exp(v, out=v)
    v += 1
    return np.reciprocal(v, out=v)


def _softmax(v: np.ndarray) -> np.ndarray:
    v = np.exp(v - v.max(1, keepdims=True))
    v /= v.sum(1, keepdims=True)
    return v


def train(docs: DataFrame, trains: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network | None:
    """A network fitted on at most `sample` different texts of each language, chosen by a hash of the text; None without any.

    Only rows with a language, a text and `trains` teach. The bound of what the network learns from is `sample` texts a language, with
    WINDOWS windows of LENGTH bytes spread over each; the driver holds no more than these. Everything else reads whole texts.
    """
    rows = docs.where(trains & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.encode(text, "UTF-8").alias("t"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # Of each language the `sample` different texts with the least hashes; four times as many are looked at, for copies.
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 4 * sample / n))])
    spot = F.pmod(F.xxhash64(F.lit(5), "t"), F.lit(1 << 40))
    near = rows.withColumn("spot", spot).where(F.col("spot") < F.try_element_at(share, F.col("lang")) * float(1 << 40))
    once = near.groupBy("lang", "spot").agg(F.min("t").alias("t"))
    chosen = once.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("spot"))).where(F.col("n") <= sample)
    # Evenly spaced windows of the chosen texts; a text gives WINDOWS of them at most.
    step = F.greatest(F.lit(1), (F.length("t") - LENGTH) / WINDOWS)
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.greatest(F.lit(0), F.least(F.length("t") - LENGTH, F.floor(i * step))).cast("int")))
    parts = chosen.select("lang", F.explode(starts).alias("s"), "t").select("lang", F.substring("t", F.col("s") + 1, LENGTH).alias("w")).collect()
    classes = sorted(counts)
    windows, lengths = np.zeros((len(parts), LENGTH), np.uint8), np.zeros(len(parts), np.int64)
    order = sorted(range(len(parts)), key=lambda i: (parts[i].lang, bytes(parts[i].w)))
    for i, j in enumerate(order):
        raw = bytes(parts[j].w)
        windows[i, : len(raw)], lengths[i] = np.frombuffer(raw, np.uint8), len(raw)
    labels = np.array([classes.index(parts[j].lang) for j in order])
    net = Network(classes)
    if len(parts) and len(classes) > 1:
        net.train(windows, lengths, labels)
    return net


def identify(docs: DataFrame, net: Network | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score (the mean probability of that language); other columns are kept.

    A null text and one without any letter get 'und' and 0.0, as does every text without a network. Input columns
    named lang_pred or score are replaced. Repeated rows each give a row. Without `keep_text` the text is left out.
    """
    row, _ = packed(docs, ("lang_pred", "score", text))
    names = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text)]
    back = lambda: [F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in names]
    rows = docs.select(row, F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    if net is None:
        return rows.select(*back(), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(net))

    def work(batches):
        n = Network.__new__(Network)
        n.__dict__ |= shared.value
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            size = np.where(letter, np.diff(offsets), 0)
            part = n.documents(data, offsets) if letter.all() else n.documents(data[np.repeat(letter, np.diff(offsets))], np.concatenate(([0], np.cumsum(size))))
            best = part.argmax(1)
            found = [n.classes[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            value = np.where(letter, np.clip(part[np.arange(len(best)), best], 0, 1), 0.0)
            given = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(value)], names=["row", "lang_pred", "score"])
            yield given.append_column("text", batch.column(1)) if keep_text else given

    shape = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), *(["text"] if keep_text else []))
    return rows.mapInArrow(work, shape.schema).select(*back(), "lang_pred", "score")
