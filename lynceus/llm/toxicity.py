"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input joins the hashed embedding of the word with the mean hashed embeddings of its character trigrams and of its
beginnings. Two recurrences
read a window of words in both directions, attention pools their states, a logistic unit gives the window's score. A
document's score is its worst window's, over all overlapping windows of the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lynceus.llm.base import ready, text_slices

WINDOW, STRIDE = 32, 16
WORDS, CHARS, HEADS = 1 << 14, 1 << 12, 1 << 14
WORD_DIM, CHAR_DIM, HEAD_DIM, HIDDEN, ATTENTION = 10, 6, 10, 12, 8
#: Lengths in bytes of the beginnings of a word that are inputs.
HEAD_SIZES = range(2, 11)
#: Windows advanced together, and distinct words whose inputs a worker keeps.
LANES, KEPT_WORDS = 4096, 250_000
#: Documents and words a feature must be met in to be learned.
LEAST = 4
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def word_features(words: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By embedding table: hashed features of all words in one run, and how many each word has (at least one)."""
    raw = [w.encode("utf-8", "replace") for w in words]
    sizes = np.array([len(w) for w in raw], np.int64)
    data = np.frombuffer(b"<" + b"><".join(raw) + b">", np.uint8).astype(np.int64)
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    grams = ((data[:-2] * 257 + data[1:-1]) * 257 + data[2:]) * 0x9E3779B1 >> 12
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    rolled, heads, owners = np.zeros(len(words), np.int64), [], []
    for k in range(1, HEAD_SIZES.stop):  # the hash of a beginning extends that of the one before
        on = np.flatnonzero((sizes >= k) if k > 1 else (sizes >= 0))
        rolled[on] = (rolled[on] * 257 + data[starts[on] + k]) & 0x7FFFFFFFFFFF
        if k == 1:
            on = np.flatnonzero(sizes < HEAD_SIZES.start)
        heads.append((rolled[on] * 0x9E3779B1 >> 11) % HEADS)
        owners.append(on)
    owner = np.concatenate(owners)
    return {
        "ew": (np.array([zlib.crc32(w) % WORDS for w in raw], np.int64), np.ones(len(words), np.int64)),
        "ec": (grams[at] % CHARS, sizes),
        "eh": (np.concatenate(heads)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))),
    }


def window_starts(n: int) -> range:
    """Starts of the overlapping windows of ``n`` words."""
    return range(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(np.clip(-x, -30, 30)))


def summed(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Table of ``rows`` rows with ``values`` added at rows ``at``."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    keys, first = np.unique(at[order], return_index=True)
    if len(keys):
        out[keys] = np.add.reduceat(values[order], first, axis=0)
    return out


class Network:
    """Parameters, forward and backward pass. Word ids index a list of distinct words; -1 pads.

    Embeddings begin at zero, so features never learned say nothing.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def init(*shape: int, scale: float | None = None) -> np.ndarray:
            return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

        d, h = WORD_DIM + CHAR_DIM + HEAD_DIM, HIDDEN
        self.p = {k: np.zeros((n, w), np.float32) for k, n, w in (("ew", WORDS, WORD_DIM), ("ec", CHARS, CHAR_DIM), ("eh", HEADS, HEAD_DIM))}
        for s in "fb":
            self.p |= {f"w{s}": init(d, 3 * h), f"u{s}": init(h, 3 * h), f"c{s}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": init(2 * h, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "v": init(ATTENTION), "o": init(2 * h), "ob": np.zeros(1, np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, dict]:
        feats = word_features(words)
        parts = [np.add.reduceat(self.p[k][f], np.cumsum(n) - n, axis=0) / n[:, None] for k, (f, n) in feats.items()]
        return np.concatenate(parts, axis=1).astype(np.float32), feats

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: x @ self.p[f"w{s}"] + self.p[f"c{s}"] for s in "fb"}

    def forward(self, proj: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        """Scores before the logistic function of windows ``ids`` (n, WINDOW)."""
        p, h, n = self.p, HIDDEN, len(ids)
        mask = (ids >= 0)
        full = bool(mask.all())
        states = np.zeros((WINDOW, n, 2 * h), np.float32)
        tape: dict = {}
        for s, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            cur, u, side = np.zeros((n, h), np.float32), p[f"u{s}"], slice(0, h) if s == "f" else slice(h, 2 * h)
            for t in order:
                g, hu = proj[s][ids[:, t]], cur @ u
                zr = sigmoid(g[:, : 2 * h] + hu[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(g[:, 2 * h :] + r * hu[:, 2 * h :])
                nxt = new + z * (cur - new)
                if not full:
                    nxt = np.where(mask[:, t, None], nxt, cur)
                if keep:
                    tape[s, t] = (cur, z, r, new, hu[:, 2 * h :])
                cur = nxt
                states[t, :, side] = cur
        act = np.tanh(states @ p["a"] + p["ab"])
        e = np.where(mask.T, act @ p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        out = pooled @ p["o"] + p["ob"]
        return (out, (tape, states, act, weight, pooled, mask)) if keep else out

    def gradients(self, proj, x, feats, ids, saved, dout) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        tape, states, act, weight, pooled, mask = saved
        g = {"o": pooled.T @ dout, "ob": np.array([dout.sum()], np.float32)}
        dpool = dout[:, None] * p["o"]
        dstates = weight[:, :, None] * dpool
        dw = np.einsum("tnh,nh->tn", states, dpool)
        de = weight * (dw - (weight * dw).sum(axis=0)) * mask.T
        g["v"] = np.einsum("tn,tna->a", de, act)
        dact = de[:, :, None] * p["v"] * (1 - act**2)
        g["a"], g["ab"] = np.einsum("tnh,tna->ha", states, dact), dact.sum(axis=(0, 1))
        dstates += dact @ p["a"].T
        dx = np.zeros_like(x)
        for s, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            side, u = slice(0, h) if s == "f" else slice(h, 2 * h), p[f"u{s}"]
            du, carry = np.zeros_like(u), np.zeros((len(ids), h), np.float32)
            dgates = np.zeros((WINDOW, len(ids), 3 * h), np.float32)
            for t in order:
                cur, z, r, new, hn = tape[s, t]
                on = mask[:, t, None]
                dh = carry + dstates[t, :, side]
                dnew = dh * (1 - z) * (1 - new**2) * on
                dz = dh * (cur - new) * z * (1 - z) * on
                dr = dnew * hn * r * (1 - r)
                dhu = np.concatenate((dz, dr, dnew * r), axis=1)
                du += cur.T @ dhu
                carry = np.where(on, dh * z, dh) + dhu @ u.T
                dgates[t] = np.concatenate((dz, dr, dnew), axis=1)
            live = mask.T.ravel()
            dproj = summed(len(x), ids.T.ravel()[live], dgates.reshape(-1, 3 * h)[live])
            g[f"u{s}"], g[f"w{s}"], g[f"c{s}"] = du, x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ p[f"w{s}"].T
        low = 0
        for k, (f, n) in feats.items():
            width = p[k].shape[1]
            g[k] = summed(len(p[k]), f, np.repeat(dx[:, low : low + width] / n[:, None], n, axis=0))
            low += width
        return g


class Reader:
    """Scores texts with a network, keeping the inputs of words already met."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.proj = {s: np.zeros((0, 3 * HIDDEN), np.float32) for s in "fb"}

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all windows (n, WINDOW) and the text each belongs to."""
        new = list(dict.fromkeys(w for t in texts for w in t if w not in self.at))
        if new:
            if len(self.at) + len(new) > KEPT_WORDS:
                self.forget()
                new = list(dict.fromkeys(w for t in texts for w in t))
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            add = self.net.projected(self.net.inputs(new)[0])
            self.proj = {s: np.concatenate((self.proj[s], add[s])) for s in "fb"}
        sizes = np.array([len(t) for t in texts])
        flat = np.array([self.at[w] for t in texts for w in t], np.int64)
        count = np.where(sizes > 0, np.maximum(-(-(sizes - (WINDOW - STRIDE)) // STRIDE), 1), 0)
        owner = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        place = (nth * STRIDE)[:, None] + np.arange(WINDOW)
        inside = place < sizes[owner][:, None]
        base = (np.cumsum(sizes) - sizes)[owner][:, None]
        return np.where(inside, flat[np.where(inside, base + place, 0)] if len(flat) else -1, -1), owner

    def window_scores(self, ids: np.ndarray) -> np.ndarray:
        parts = [self.net.forward(self.proj, ids[i : i + LANES]) for i in range(0, len(ids), LANES)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of each text's worst window; 0 for texts without words."""
        ids, owner = self.windows([tokens(t) for t in texts])
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, self.window_scores(ids))
        return np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(worst, -50, 50))), 0.0)


def train(texts: list[str], labels: list[int], epochs: int = 8, rate: float = 0.01, seed: int = 7) -> Network:
    """Learns from whole texts with one label each: a positive text teaches with its worst window, a negative one with its
    worst and a random window. The first windows are those with the most telling words."""
    net, rng = Network(seed), np.random.default_rng(seed)
    docs, y = [tokens(t) for t in texts], np.asarray(labels)
    known = [i for i, d in enumerate(docs) if d]
    docs, y = [docs[i] for i in known], y[known]
    if not len(docs):
        return net
    odds = log_odds(docs, y)
    spread = Counter(w for d in docs for w in set(d))
    often = np.array(list(spread.values()))
    common = {
        k: np.bincount(f, np.repeat(often, n), minlength=len(net.p[k]))[:, None] >= LEAST
        for k, (f, n) in word_features(list(spread)).items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, worst = 0, np.zeros(len(docs), np.int64)
    for epoch in range(epochs):
        if epoch in (0, 1, 2) or epoch % 2 == 0:
            worst = worst_windows(net if epoch else None, docs, odds, rng)
        chosen: list[tuple[list[str], int]] = []
        for d, start, label in zip(docs, worst, y):
            chosen.append((d[start : start + WINDOW], int(label)))
            if not label:
                start = int(rng.choice(window_starts(len(d))))
                chosen.append((d[start : start + WINDOW], 0))
        order = rng.permutation(len(chosen))
        batch = min(256, max(32, len(chosen) // 24))
        for lo in range(0, len(order), batch):
            rows = [chosen[i] for i in order[lo : lo + batch]]
            words = list(dict.fromkeys(w for d, _ in rows for w in d))
            at = {w: i for i, w in enumerate(words)}
            ids = np.full((len(rows), WINDOW), -1)
            for i, (d, _) in enumerate(rows):
                ids[i, : len(d)] = [at[w] for w in d]
            x, feats = net.inputs(words)
            proj = net.projected(x)
            out, saved = net.forward(proj, ids, keep=True)
            target = np.array([t for _, t in rows], np.float32)
            grads = net.gradients(proj, x, feats, ids, saved, ((sigmoid(out) - target) / len(rows)).astype(np.float32))
            step += 1
            lr = rate * min(1.0, step / 20) * (0.5 if epoch >= epochs * 0.6 else 1.0)
            for k, g in grads.items():
                if k in common:
                    g = g * common[k]
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def worst_windows(net: Network | None, docs: list[list[str]], odds: dict[str, float], rng) -> np.ndarray:
    """Start of each document's worst window by the network, or by its most telling word."""
    reader, out = Reader(net or Network()), []
    for lo in range(0, len(docs), 512):
        part = docs[lo : lo + 512]
        ids, owner = reader.windows(part)
        if net is None:
            telling = np.array([max(odds.get(f, 0.0) for f in marks(w)) for w in reader.at])
            worth = np.where(ids >= 0, telling[ids], 0.0).max(axis=1)
        else:
            worth = reader.window_scores(ids)
        order = np.lexsort((rng.random(len(ids)), worth, owner))
        last = np.concatenate((owner[order][1:] != owner[order][:-1], [True]))
        out.append((order[last] - np.searchsorted(owner, np.arange(len(part)))) * STRIDE)
    return np.concatenate(out)


def marks(word: str) -> list[str]:
    return [word + ">", *(word[:k] for k in range(3, 9) if k <= len(word))]


def log_odds(docs: list[list[str]], y: np.ndarray) -> dict[str, float]:
    """How much a word (ending in >) or a beginning of words tells about the label."""
    seen: dict[str, list[int]] = {}
    for d, label in zip(docs, y):
        for f in {f for w in set(d) for f in marks(w)}:
            seen.setdefault(f, [0, 0])[int(label)] += 1
    n = np.bincount(y, minlength=2) + 2
    return {f: float(np.log((c[1] + 1) / n[1]) - np.log((c[0] + 1) / n[0])) for f, c in seen.items() if sum(c) > 2}


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, train_rows: int = 2000, threshold: float = 0.3,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``; predicted is 1 where score >= ``threshold``.

    ``labels`` (id, label 0/1) names the documents the network may learn from: at most ``train_rows`` of each label, those
    with the smallest hashes of their ids, so the sample does not depend on row order. Their whole texts are used; they
    fit the driver. An id labelled both ways counts as 1; null ids, labels and texts are not learned from. Without
    examples of both labels every score is 0. Null, empty and wordless texts score 0. Ids may be null or repeated; other
    columns are not read; an empty table gives an empty result. Scoring is a map without a shuffle over all windows of
    whole texts.
    """
    spark = ready(docs.sparkSession)
    pool = labels.toDF("__of", "__label").where("__of is not null and __label in (0, 1)").groupBy("__of").agg(F.max("__label").alias("__label"))
    order = [F.xxhash64("__of"), "__of"]
    chosen = [pool.where(F.col("__label") == y).orderBy(*order).limit(train_rows) for y in (0, 1)]
    taught = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col(id_col) == F.col("__of")).where(F.col(text_col).isNotNull())
    rows = [(r[0], r[1]) for r in taught.select(text_col, "__label", "__of").orderBy(*order, text_col).drop("__of").collect()]
    net = train([t for t, _ in rows], [y for _, y in rows]) if {y for _, y in rows} == {0, 1} else None
    shared = spark.sparkContext.broadcast(net.p if net else None)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        reader = None
        if shared.value is not None:
            own = Network.__new__(Network)
            own.p = shared.value
            reader = Reader(own)
        for batch in batches:
            parts = [reader.scores(t) if reader else np.zeros(len(t)) for _, t in text_slices([batch], 1 << 20)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score.astype(np.float64))], ["id", "held_out", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    out = out.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
