"""Exact, line and near deduplication against brute force."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.llm import near_vectors as nv, ngram_join as nj, signature_tree as st
from lynceus.llm.base import components
from lynceus.llm.exact_dedup import exact_dedup
from lynceus.llm.line_dedup import line_dedup
from lynceus.llm.shingles import shingle_sets


def closed(n, pairs):
    """Smallest index reachable, by union."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return [root(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- exact ---------------------------------------------------------------------------------------

ROWS = [(1, "same"), (5, "same"), (3, "Same"), (2, None), (9, ""), (4, "x" * 200_000), (6, "x" * 200_000), (7, "tie"), (7, "tie"), (None, "lone")]


def keepers(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, docs_of, tmp_path, weak):
    """With a weak digest, unequal texts hit one state row and the byte check must part them."""
    docs_of(ROWS).repartition(4).write.parquet(path := str(tmp_path / "docs"))
    digest = (lambda t: F.length(t).cast("string")) if weak else None
    got = exact_dedup(spark, path, files_per_batch=1, **({"digest": digest} if weak else {})).collect()
    want = keepers(ROWS)
    assert len(got) == len(ROWS)
    texts = {}
    for i, t in ROWS:
        texts.setdefault(i, t or "")
    for r in got:
        assert (r.keep_id, r.group_size) == want[texts[r.doc_id]] and r.kept == (r.doc_id == r.keep_id)


def test_exact_state_continues(spark, docs_of, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    docs_of([(1, "a"), (2, "b")]).write.parquet(path)
    assert len(exact_dedup(spark, path, state_dir=state).collect()) == 2
    docs_of([(3, "a")]).write.mode("append").parquet(path)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(spark, path, state_dir=state).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_exact_empty(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(path := str(tmp_path / "docs"))
    assert exact_dedup(spark, path).collect() == []


# ---- lines ---------------------------------------------------------------------------------------


def test_lines_by_brute_force(docs_of):
    rnd = random.Random(4)
    shared = ["nav home", "cookies", "rare", "four sites"]
    rows = [(1, None, "en", "s0"), (2, "", "en", "s1"), (None, "nav home\nown", "en", "s2"), (3, "nav home\n\n nav home \nkeep", "en", None), (3, "cookies\nother", "en", "s9")]
    for i in range(10, 60):
        site = f"s{i % 9}"
        lines = [f"line {i} {k}" for k in range(3)] + [s for k, s in enumerate(shared) if rnd.random() < (0.9, 0.5, 0.05, 0.4)[k] and (s != "four sites" or i % 9 < 4)]
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", site))
    rows.append(rows[-1])
    got = line_dedup(docs_of(rows), min_sites=5).collect()
    sites, first = {}, {}
    for i, t, _, s in rows:
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            line = line.strip(" \t\r")
            if line:
                sites.setdefault(line, set()).update({s} - {None})
                at = (i is not None, i or 0, pos)
                first[line] = min(first.get(line, at), at)
    bad = {x for x, s in sites.items() if len(s) >= 5}
    assert bad and "four sites" not in bad

    def clean(i, t):
        if t is None:
            return None
        keep = [x for pos, x in enumerate(t.split("\n")) if x.strip(" \t\r") not in bad or first[x.strip(" \t\r")] == (i is not None, i or 0, pos)]
        return "\n".join(keep)

    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((i, clean(i, t)) for i, t, _, _ in rows), key=key)
    assert all("pos" in r.asDict() and r.n_removed <= r.n_lines for r in got)
    assert line_dedup(docs_of([]), 5).collect() == []


# ---- shingles, trees, join -----------------------------------------------------------------------


def reference_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed, families=60):
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for _ in range(families):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([0, 1, 4, 5, 6, 30, 80, 150]))]
        if rnd.random() < 0.3:
            base += passage
        for _ in range(rnd.choice([1, 1, 2, 6])):
            b = list(base)
            for _ in range(rnd.randint(0, 4)):
                if b:
                    b[rnd.randrange(len(b))] = f"z{rnd.randint(0, 5)}"
            out.append((" ".join(b)).upper() if rnd.random() < 0.3 else "\n".join(b))
    return out


def linked(sets):
    out = []
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if shared and 100 * shared >= 80 * (len(x) + len(sets[j]) - shared):
                out.append((j, i))
    return out


def test_tree_prunes_no_link():
    texts = corpus(1, 150)
    tokens, n = shingle_sets(texts)
    sets = [reference_set(t) for t in texts]
    assert list(n) == [len(s) for s in sets]
    ends = np.cumsum(n)
    at = np.flatnonzero(n)
    maps = [st.bitmap(tokens[ends[i] - n[i] : ends[i]]) for i in at]
    left, right = st.pairs_between(st.forest(maps, n[at], at))
    pairs = {(min(p), max(p)) for p in zip(left.tolist(), right.tolist())}
    assert len(pairs) == len(left) and set(linked(sets)) <= pairs and len(pairs) < 0.05 * len(at) ** 2


@pytest.mark.parametrize("small", [False, True])
def test_join_by_brute_force(docs_of, monkeypatch, small):
    """Small limits force frequent shingles, several buckets, spread shingles and block pairs."""
    if small:
        for name, value in (("BLOCK", 3), ("FEW", 2), ("BUCKET", 50), ("SPREAD", 2), ("AT_LEAST", 3), ("LOCAL", 2), ("WINDOW_SHINGLES", 500)):
            monkeypatch.setattr(nj, name, value)
    texts = corpus(7) + [None, "", " \n", "one two"] + ["one two"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_join(docs_of(list(enumerate(texts)))).collect()}
    sets = [reference_set(t) for t in texts]
    comp = closed(len(texts), linked(sets))
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(texts))}


def test_join_of_star_whose_head_is_an_outlier(docs_of):
    """Members that link with each other but not with the smallest id are found by the trees."""
    words = [f"w{i}" for i in range(100)]
    head = words[:60] + [f"h{i}" for i in range(40)]
    texts = [" ".join(head), " ".join(words), " ".join(words[:-1] + ["x"]), " ".join(words[:-2] + ["y", "z"])]
    got = {r.doc_id: r.component_id for r in nj.jaccard_join(docs_of(list(enumerate(texts)))).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("block", [512, 3])
def test_join_counts_every_link(docs_of, monkeypatch, block):
    """Chains, whose ends do not link, families and copies, against brute force."""
    monkeypatch.setattr(nj, "BLOCK", block)
    chain = [" ".join(f"w{i}" for i in range(s, s + 100)) for s in (0, 8, 16)]
    texts = corpus(9, 30) + chain + chain[:1] + [None, ""]
    sets = [reference_set(t) for t in texts]
    n = [0] * len(texts)
    for a, b in linked(sets):
        n[a] += 1
        n[b] += 1
    got = {r.doc_id: r.n_links for r in nj.jaccard_join(docs_of(list(enumerate(texts))), count_links=True).collect()}
    assert got == dict(enumerate(n)) and n[-6:] == [2, 3, 1, 2, 0, 0]


def test_join_null_and_repeated_ids(docs_of):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_join(docs_of(rows)).collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (None, 2, None), (2, 2, 2), (2, 2, 2)], key=str)
    assert nj.jaccard_join(docs_of([])).collect() == []


# ---- vectors -------------------------------------------------------------------------------------


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nv, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows, label = [], []
    for c in range(25):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9)) if c else 40):
            rows.append((centre + rng.standard_normal(16) * 0.05).astype(np.float32).tolist())
            label.append(int(c % 3))
    rows += [rows[0], [2 * x for x in rows[0]], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0], [1.0], [], rows[0]]
    label += [label[0], label[0], 0, 0, 0, 0, 0, 0, 0, None]
    df = spark.createDataFrame([(i, v, x, "c") for i, (v, x) in enumerate(zip(rows, label))], "vec_id long, embedding array<float>, label int, rid string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nv.near_vectors(df).collect()}
    ok = [v is not None and x is not None and len(v) > 0 and all(y is not None and np.isfinite(y) for y in v) and any(v) for v, x in zip(rows, label)]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and label[i] == label[j] and len(rows[i]) == len(rows[j]):
                a, b = np.array(rows[i]), np.array(rows[j])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    pairs.append((j, i))
    comp, n = closed(len(rows), pairs), [0] * len(rows)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in range(len(rows))}
    assert nv.near_vectors(df.limit(0)).collect() == []


def test_vectors_of_a_table(spark):
    """Recall against all rows of a given table."""
    rows = nv.near_vectors(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect()
    assert len(rows) == 500 and rows[0].recall >= 0.999


@pytest.mark.parametrize("audit", [512, 8])
def test_small_groups_beside_a_hot_one(spark, monkeypatch, audit):
    """Pairs that the graph never meets are missed by no audit that a hot group of copies would fill; a small one needs all pairs."""
    rng = np.random.default_rng(5)
    vectors = [rng.standard_normal(16).tolist()] * 300
    for _ in range(20):
        v = rng.standard_normal(16)
        vectors += [v.tolist(), (v + rng.standard_normal(16) * 0.01).tolist()]
    real = nv.ordered_neighbours
    hot = lambda rows, *rest: real(rows, *rest).join(rows.where("id < 300").select("rid"), "rid", "left_semi")
    monkeypatch.setattr(nv, "ordered_neighbours", hot)
    monkeypatch.setattr(nv, "AUDIT", audit)
    monkeypatch.setattr(nv, "BLOCK", 100)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.recall >= 0.999) for r in nv.near_vectors(df).collect()}
    assert got == {i: (299, 0, True) if i < 300 else (1, i - i % 2, True) for i in range(340)}


def test_package_travels_to_workers(tmp_path):
    """A Python worker finds the package though the session starts elsewhere, without PYTHONPATH."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("rows", e.queries()["op8_language_id"](s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
