"""Quality, mixing, toxicity, languages and the pipeline against brute force or held-out labels."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lynceus.llm import kneser_ney as kn, toxicity as tx
from lynceus.llm.base import fold_of, stored
from lynceus.llm.language_id import language_id
from lynceus.llm.mixing import mix_documents

SF = "/root/testdata/sf0.01"


# ---- quality -------------------------------------------------------------------------------------


def plain_model(texts):
    """Interpolated modified Kneser-Ney written term by term; p(context, symbol)."""
    n = kn.ORDER
    top = Counter()
    for t in texts:
        s = bytes([kn.START]) * (n - 1) + t.encode() + bytes([kn.END])
        top.update(s[i : i + n] for i in range(len(s) - n + 1))
    level = {n: top}
    for k in range(n - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    cut, ctx = {}, {}
    for k in level:
        coc = Counter(level[k].values())
        cut[k] = kn.discounts(*[float(coc[i]) for i in (1, 2, 3, 4)])
        ctx[k] = defaultdict(list)
        for g, c in level[k].items():
            ctx[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 257
        below, counts = p(g[1:]), ctx[k].get(g[:-1])
        if not counts:
            return below
        d = lambda c: cut[k][min(c, 3) - 1]
        c = level[k].get(g, 0)
        return (c - d(c) if c else 0) / sum(counts) + sum(map(d, counts)) / sum(counts) * below

    return p


def test_perplexity_by_brute_force(spark, docs_of):
    rnd = random.Random(0)
    texts = [" ".join(rnd.choice(["the", "cat", "sät", "on", "mat", "dog"]) for _ in range(rnd.randint(1, 30))) for _ in range(40)]
    asked = texts[:5] + ["zebra!! 世", "", "THE CAT", "the " * 3000]
    model = kn.KneserNey.fit(stored(kn.gram_counts(docs_of(enumerate(texts)).select("doc_id", "text")), "counts"))
    got = {r.id: (r.n_symbols, r.bits) for r in kn.bits_per_symbol(stored(docs_of(enumerate(asked)), "docs"), model, "doc_id", "text", "lang").collect()}
    p = plain_model(texts)
    for i, t in enumerate(asked):
        s = bytes([kn.START]) * (kn.ORDER - 1) + t.encode() + bytes([kn.END])
        bits = -sum(math.log2(p(s[j : j + kn.ORDER])) for j in range(len(s) - kn.ORDER + 1))
        assert got[i][0] == len(t.encode()) + 1 and got[i][1] == pytest.approx(bits, rel=1e-9)
    total = sum(p(b"the"[:3] + bytes([c])) for c in range(256))
    assert total == pytest.approx(1, abs=0.01)


def test_quality_edges(spark, docs_of):
    good = [(i, f"the cat sat on the mat and dog {i % 7} ran", "en", "s") for i in range(80)]
    rows = [*good, (200, "#### %%%% @@@@ !!!! ####", "en", "s"), (201, None, None, "s"), (202, "", "xx", "s"), (None, "the cat sat on the mat and dog 3 ran", "en", "s"), (203, "the cat", "zz", None), (203, "the cat", "zz", None)]
    docs = stored(docs_of(rows), "docs")
    got = kn.quality_scores(docs, spark.createDataFrame([(i,) for i in range(80)] + [(None,), (999,)], "x long")).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[200] and kept[201] and kept[202] and kept[203] and kept[None] and all(kept[i] for i in range(80))
    none = kn.quality_scores(docs, spark.createDataFrame([], "x long")).collect()
    assert len(none) == len(rows) and all(r.kept and r.threshold is None for r in none)
    assert kn.quality_scores(stored(docs_of([]), "docs"), spark.createDataFrame([(1,)], "x long")).collect() == []


def test_rows_that_share_an_id_keep_their_own_language(spark, docs_of):
    """Equal sizes, one id, two languages: fluent text in one and junk in the other are judged each by its own."""
    good = [(i, f"the cat sat on the mat and dog {i % 7} ran far away", lang, "s") for i in range(80) for lang in [("zz", "aa")[i % 2]]]
    fluent, junk = "the cat sat on the mat and dog 3 ran far away", "q#x@z!w%v^k&j*p~b|y{f}u[m]n;t:c,l<e>o?i$QZXJK"
    assert len(fluent) == len(junk)
    rows = [*good, (900, fluent, "zz", "s"), (900, junk, "aa", "s"), (None, junk, "zz", "s"), (None, fluent, None, "s")]
    got = kn.quality_scores(stored(docs_of(rows), "docs"), spark.createDataFrame([(i,) for i in range(80)], "x long")).where("doc_id = 900 or doc_id is null").collect()
    by = {(r.doc_id, r.lang): r for r in got}
    assert set(by) == {(900, "zz"), (900, "aa"), (None, "zz"), (None, "und")}
    assert by[900, "zz"].kept and not by[900, "aa"].kept and by[900, "zz"].bits_per_symbol < 2 < by[900, "aa"].bits_per_symbol
    assert not by[None, "zz"].kept and by[None, "und"].kept


# ---- mixing --------------------------------------------------------------------------------------


def test_raking_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mix_documents(docs, F.when(F.length("text") < 1500, "short").otherwise("long"), alpha=0.5, topic_targets={"short": 0.3, "long": 0.7, "none": 9.0}).toPandas()
    got["topic"] = np.where(got.text.str.len() < 1500, "short", "long")
    assert (got.mix_tokens == got.text.str.split().str.len()).all()
    cube = got.pivot_table(index="source", columns=["lang", "topic"], values="mix_tokens", aggfunc="sum", fill_value=0)
    x = np.array([[[cube.loc[s].get((a, t), 0) for t in ("long", "short")] for a in sorted(set(got.lang))] for s in cube.index], float)
    x /= x.sum()
    want = [x.sum((1, 2)) ** 0.5, x.sum((0, 2)) ** 0.5, np.array([0.7, 0.3])]
    want = [w / w.sum() for w in want]
    y = x.copy()
    for _ in range(500):
        for axis, w in enumerate(want):
            m = y.sum(tuple(i for i in range(3) if i != axis))
            y *= (w / m).reshape([-1 if i == axis else 1 for i in range(3)])
    factor = np.divide(y, x, out=np.zeros_like(x), where=x > 0)
    si, li = {s: i for i, s in enumerate(cube.index)}, {a: i for i, a in enumerate(sorted(set(got.lang)))}
    mine = np.array([factor[si[s], li[a], int(t == "short")] for s, a, t in zip(got.source, got.lang, got.topic)])
    assert np.allclose(got.mix_factor, mine, rtol=1e-5)
    assert np.allclose(got.mix_probability, mine / mine.max(), rtol=1e-5)
    share = (got.mix_tokens * got.mix_probability).groupby(got.topic).sum()
    assert share["short"] / share.sum() == pytest.approx(0.3, abs=1e-6)
    drawn = got[got.mix_sampled]
    assert len(drawn) == pytest.approx(got.mix_probability.sum(), abs=4 * math.sqrt((got.mix_probability * (1 - got.mix_probability)).sum()))


def test_mixing_edges(docs_of):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c", None, None), (2, None, "en", "s"), (3, "", "de", "only")]
    got = mix_documents(docs_of(rows), F.lit(None).cast("string")).collect()
    assert len(got) == 5 and len({r.mix_sampled for r in got if r.doc_id == 1}) == 1
    assert {r.doc_id: r.mix_probability for r in got}[3] == 0.0
    assert mix_documents(docs_of([]), F.lit("t")).collect() == []


# ---- toxicity ------------------------------------------------------------------------------------


def test_gradients():
    net = tx.Network(1)
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) + (rng.standard_normal(v.shape) * 0.3 if k[0] == "e" else 0) for k, v in net.p.items()}
    words = ["idiot", "hello", "wörld", "a"]
    ids = -np.sort(-rng.integers(-1, 4, (5, tx.WINDOW)), axis=1)
    ids[:, 0] = 1
    y = np.array([0, 1, 0, 1, 1.0])

    def loss():
        p = tx.sigmoid(net.forward(net.projected(net.inputs(words)[0]), ids))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    x, feats = net.inputs(words)
    proj = net.projected(x)
    out, saved = net.forward(proj, ids, keep=True)
    grads = net.gradients(proj, x, feats, ids, saved, (tx.sigmoid(out) - y) / 5)
    for k, v in net.p.items():
        flat, at = v.reshape(-1), int(np.abs(grads[k]).argmax())
        was = flat[at]
        flat[at] = was + 1e-3
        up = loss()
        flat[at] = was - 1e-3
        down = loss()
        flat[at] = was
        assert (up - down) / 2e-3 == pytest.approx(grads[k].ravel()[at], rel=2e-2, abs=1e-5)


def test_windows_cover_whole_texts():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        reader = tx.Reader(tx.Network())
        ids, owner = reader.windows([[f"w{i}" for i in range(n)], ["x"]])
        seen = set(ids[owner == 0].ravel().tolist()) - {-1}
        assert len(seen) == n and (owner == 1).sum() == 1
        assert (owner == 0).sum() == (len(tx.window_starts(n)) if n else 0)


def test_toxicity_held_out(spark, docs_of):
    """Insults at any place of a text, far beyond the first window, learned from rows outside the held-out fold."""
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfgklmn" for b in ("ana", "olo", "eri", "utu", "isi")]
    rows, labels = [], []
    for i in range(900):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 300))]
        bad = rnd.random() < 0.35
        if bad:
            text[rnd.randrange(len(text))] = rnd.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, int(bad)))
    rows += [(None, "scum", None, None), (2000, None, "en", "s"), (2001, "", "en", "s"), (2002, "!!", "en", "s")]
    held = fold_of(F.col("doc_id")) == 2
    lab = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(docs_of(rows), lab.where(~held), held).collect()}
    assert len(got) == len(rows)
    apart = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in apart)
    assert sum(got[i].predicted == y for i, y in apart) >= 0.95 * len(apart)
    assert got[2000].score == got[2001].score == got[2002].score == 0.0 and got[None].predicted == 1
    assert tx.toxicity(docs_of([]), lab, held).collect() == []
    assert {r.score for r in tx.toxicity(docs_of(rows[:3]), lab.limit(0), held).collect()} == {0.0}


# ---- languages -----------------------------------------------------------------------------------


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = fold_of(F.col("doc_id")) == 2
    hidden = docs.withColumn("lang", F.when(~held, F.col("lang")))
    got = {r.doc_id: r for r in language_id(hidden, ~held, held).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    apart = [i for i, r in got.items() if r.held_out]
    assert len(got) == len(truth) and {r.doc_id for r in docs.where(held).select("doc_id").collect()} == set(apart)
    assert sum(got[i].lang_pred == truth[i] for i in apart) >= 0.98 * len(apart)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(docs_of):
    rows = [(1, "the quick brown fox", "en"), (2, "der schnelle braune fuchs", "de"), (2, "der schnelle braune fuchs", "de"), (3, None, "en"), (4, "123 !!", "en"), (5, "", None), (None, "the fox " * 20000, None)]
    rows = [(*r, "s") for r in rows]
    got = language_id(docs_of(rows), F.lit(True), F.lit(False)).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == 7 and by == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en"}
    assert {r.lang_pred for r in language_id(docs_of(rows), F.lit(False), F.lit(True)).collect()} == {"und"}
    assert language_id(docs_of([]), F.lit(True), F.lit(False)).collect() == []


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "ngram_join", "mixing", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, SF), name)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        sizes.append(len(ids))
        assert set(ids) <= before and len(ids) == len(set(ids))
        if name != "pieces":
            assert docs.columns == columns
        if name == "quality":
            assert len(good - set(ids)) <= 0.01 * len(good) and len(bad & set(ids)) <= 0.25 * len(bad)
        if name == "line_dedup":
            assert set(ids) == before
    assert sizes[0] < 1000 and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    assert docs.where("not round_trip or not coalesce(parity, true)").count() == 0
