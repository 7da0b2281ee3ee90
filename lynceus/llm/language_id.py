"""Language identification with hyperdimensional profiles.

Letters have random bipolar vectors; a trigram is the product of its letters' vectors, each rotated by its place; a text
is the sum (bundle) of its trigrams, a language prototype the sum over the language's training texts. A text gets the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lynceus.llm.base import ready, stored, text_slices

#: Symbols: 0 is any run of non-letters, 1-26 are a-z, all other letters share the rest by their code.
SYMBOLS, N = 64, 3
DIM, SEED = 512, 20_240_601
GRAMS = SYMBOLS**N
#: Cells of one dense count matrix inside a task, and languages whose counts a task holds at once.
CELLS, HELD = 1 << 22, 32
#: Sharpens cosines into a score.
SHARPNESS = 20.0


@lru_cache(1)
def symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            table[cp] = cp - 96 if 97 <= cp <= 122 else 27 + (cp * 0x9E3779B1 & 0xFFFFFFFF) % (SYMBOLS - 27)
    return table


@lru_cache(4)
def letters(dim: int = DIM) -> np.ndarray:
    """Letter vectors, rotated for each of the N places."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
    return np.stack([np.roll(base, N - 1 - place, axis=1) for place in range(N)])


def gram_vectors(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors of packed trigrams, one row each."""
    v = letters(dim)
    return v[0][grams // SYMBOLS**2] * v[1][grams // SYMBOLS % SYMBOLS] * v[2][grams % SYMBOLS]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, packed trigram) of every trigram, and whether each document has a letter."""
    padded = ["\n" + t.lower() + "\n" for t in texts]
    lengths = np.array([len(t) for t in padded])
    raw = "".join(padded)
    data = raw.encode("utf-32-le", "replace")
    cps = np.frombuffer(data, np.uint32)
    s = symbol_table()[cps]
    d = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (d[1:] != d[:-1])
    has = np.zeros(len(texts), bool)
    has[d[s > 0]] = True
    s, d = s[keep].astype(np.int32), d[keep]
    g = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    same = d[:-2] == d[2:]
    return d[:-2][same], g[same], has


def language_counts(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, gram, n) over whole texts; each task adds up its own counts first. At most 262,144 rows per language."""
    ready(docs.sparkSession)

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "gram", "n"])
            held.clear()

        for langs, texts in text_slices(batches):
            d, g, _ = trigrams(texts)
            names, code = np.unique(np.array(langs, dtype=str), return_inverse=True)
            of = code[d]
            for i, name in enumerate(names):
                if name not in held:
                    if len(held) == HELD:
                        yield from out()
                    held[name] = np.zeros(GRAMS, np.int64)
                held[name] += np.bincount(g[of == i], minlength=GRAMS)
        yield from out()

    rows = docs.where(lang.isNotNull() & text.isNotNull()).select(lang.cast("string").alias("lang"), text.alias("text"))
    return rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(counts: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes; a language's counts (a bounded group) are bundled in one task each."""

    def bundle(t: pa.Table) -> pa.Table:
        grams, n = t["gram"].to_numpy(), t["n"].to_numpy().astype(np.float64)
        total = np.zeros(dim)
        for i in range(0, len(grams), 4096):
            total += n[i : i + 4096] @ gram_vectors(grams[i : i + 4096], dim)
        return pa.table({"lang": [t["lang"][0].as_py()], "v": [list(total / max(np.linalg.norm(total), 1e-300))]})

    rows = counts.groupBy("lang").applyInArrow(bundle, "lang string, v array<double>").orderBy("lang").collect()
    return [r.lang for r in rows], np.array([r.v for r in rows]).reshape(len(rows), dim)


def identify(docs: DataFrame, langs: list[str], protos: np.ndarray, id_col: str, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """Adds lang_pred and score to the id and the ``keep`` columns, in one pass without a shuffle."""
    ready(docs.sparkSession)
    dim = protos.shape[1]
    names, weights, fields = [*langs, "und"], protos.T.astype(np.float32), [id_col, *keep, "lang_pred", "score"]

    def run(batches):
        for batch in batches:
            pred, score = [], []
            for _, texts in text_slices([batch]):
                d, g, has = trigrams(texts)
                best, conf = np.full(len(texts), len(langs)), np.zeros(len(texts))
                grams, column = np.unique(g, return_inverse=True)
                if len(langs) and len(grams):
                    v = gram_vectors(grams, dim).astype(np.float32)
                    step = max(1, CELLS // len(grams))
                    for lo in range(0, len(texts), step):
                        hi = min(lo + step, len(texts))
                        a, b = np.searchsorted(d, (lo, hi))
                        m = np.bincount((d[a:b] - lo) * np.int64(len(grams)) + column[a:b], minlength=(hi - lo) * len(grams))
                        x = m.reshape(hi - lo, len(grams)).astype(np.float32) @ v
                        cos = (x @ weights).astype(np.float64) / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                        soft = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
                        best[lo:hi], conf[lo:hi] = cos.argmax(axis=1), 1 / soft.sum(axis=1)
                pred.append(np.where(has, best, len(langs)))
                score.append(np.where(has & (best < len(langs)), conf, 0.0))
            p = np.concatenate(pred) if pred else np.zeros(0, int)
            s = np.concatenate(score) if score else np.zeros(0)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *rest, pa.array([names[i] for i in p], pa.string()), pa.array(s)], fields)

    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"), *[c.alias(k) for k, c in keep.items()])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", lang_pred string, score double"
    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, train: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Prototypes are learned from all rows where ``train`` holds and text and language are not null. Null texts and texts
    without a letter get ``und`` with score 0, and so does every text if there is nothing to learn from; ties go to the
    first language in order. Ids may be null or repeated; other columns are not read; an empty table gives an empty result.
    """
    counts = stored(language_counts(docs.where(train), F.col(text_col), F.col(lang_col)), "profiles")
    langs, protos = prototypes(counts)
    return identify(docs, langs, protos, id_col, text_col, {"held_out": held_out})
