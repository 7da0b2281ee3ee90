"""Importance resampling, the prefix trie and the secret scan against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.llm import prefix_trie, secret_scan
from lynceus.llm.importance import _scan, compose, importance_sample, run_features, word_payloads

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def test_payloads_compose_into_the_crc_of_runs():
    r = random.Random(1)
    texts = ["".join(r.choice("abAZ09 é世.,\n--") for _ in range(r.randint(0, 300))) for _ in range(120)]
    texts += ["x" * 500 + " a " + "y" * 129 + " b", "", "z" * 5000, " . "]
    crc, size, counts = word_payloads(texts, 1000)  # small windows: dictionaries change inside texts
    feature, owner = run_features(crc, size, counts, 3)
    want = []
    for i, t in enumerate(texts):
        ws = words_of(t)
        want += [(i, zlib.crc32(b" ".join(ws[j : j + n]))) for n in (1, 2, 3) for j in range(len(ws) - n + 1)]
    assert sorted(zip(owner.tolist(), feature.tolist())) == sorted(want)
    assert len(_scan(b"   ")[0]) == 0
    pair = compose(np.array([zlib.crc32(b"left")], np.uint32), np.array([zlib.crc32(b"r" * 300)], np.uint32), np.array([300]))
    assert pair[0] == zlib.crc32(b"left" + b"r" * 300)


def drawn(docs, target, buckets, max_run, percent, min_words, seed):
    def features(text):
        ws = words_of(text)
        return [zlib.crc32(b" ".join(ws[j : j + n])) % buckets for n in range(1, max_run + 1) for j in range(len(ws) - n + 1)]

    s, t = Counter(x for _, d in docs for x in features(d)), Counter(x for d in target for x in features(d))
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, d in docs:
        f = features(d)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(d))])
    may = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("max_run", [1, 2])
def test_importance_equals_brute_force(spark, docs_of, max_run):
    r = random.Random(2)
    vocab = ["alpha", "Beta", "γάμμα", "x1", "the", "of", "zeta" * 40]
    docs = [(r.choice([i, None, 5]), r.choice([None, ""]) if i % 17 == 0 else " ".join(r.choices(vocab, k=r.randint(0, 60)))) for i in range(300)]
    docs.append((900, "word " * 30000))
    # rows that repeat an id only differ in rank by their text: keep such texts equal
    docs = [(i, "five " * 30 if i in (None, 5) else t) for i, t in docs]
    target = ["alpha beta x1", None, "the alpha " * 9]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_sample(docs_of(docs), aim, buckets=97, max_run=max_run, percent=30, min_words=5)
    assert [c for c, t in got.dtypes[1:] if t != "bigint"] == []
    assert sorted((tuple(x) for x in got.collect()), key=str) == drawn(docs, target, 97, max_run, 30, 5, 2024)


def test_importance_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert importance_sample(docs_of([]), none).collect() == []
    rows = importance_sample(docs_of([(1, "a b"), (2, None)]), none).collect()
    assert {x.doc_id: (x.n_features, x["rank"]) for x in rows} == {1: (2, None), 2: (0, None)}


def trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    path = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :]) for c, v in own.items()}
    members = defaultdict(list)
    for c, v in path.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        value = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += value
            leaves[k[:d]] += kids[k] == 0
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(path[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items()), key=str)


def found_trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("c", "p", "d", "k", "n", "w", "low", "d1", "words", "depth")])
    got = prefix_trie.prefix_trie(df)
    assert [t for c, t in got.dtypes if c != "ends_sha256" and t != "bigint"] == []
    return sorted((tuple(x) for x in got.collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(3)
    rows = [(c, t if r.random() > 0.05 else None, r.choice(["u", None]), r.choice(["a b", "c", None, ""])) for c in [*range(-30, 60), None] for t in range(r.randint(1, 13))]
    seen = set()
    return [x for x in rows if x[:2] not in seen and not seen.add(x[:2])]


@pytest.mark.parametrize("stretch, chunk", [(1024, 4096), (8, 4)])
def test_trie_equals_brute_force(spark, talks, monkeypatch, stretch, chunk):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    assert found_trie(spark, talks) == trie(talks)


def test_trie_of_one_long_path_with_branches(spark):
    r = random.Random(4)
    rows = [(c, t, "u", r.choice("ab") if t > 20 else "same words") for c in range(100, 140) for t in range(r.randint(20, 40))]
    rows += [(200, t, None, "w " * 20000 if t == 3 else str(t)) for t in range(50)]
    assert found_trie(spark, rows) == trie(rows)


def test_trie_edges(spark):
    assert found_trie(spark, []) == []
    one = [(1, 0, None, None)]  # takes nothing from the missing conversation 0 and loses its only turn, or keeps it
    assert found_trie(spark, one) == trie(one)
    same = [(40, 0, "u", "a"), (40, 0, "u", "a"), (40, 0, "u", "a"), (60, 0, "u", "a")]  # repeated rows are turns
    assert found_trie(spark, same) == trie(same)


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def is_key(v):
    return bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 8)


def candidates(t):
    out = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(ASSIGN, t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    for m in re.finditer(ASSIGN + "|([A-Za-z0-9_-]{20,})", t, re.I | re.A):
        v = m[3]
        if v and all(re.search(p, v) for p in ("[a-z]", "[A-Z]", "[0-9]")) and is_key(v) and not re.search("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", v):
            out.append((m.start(), 3, m.end(), v))
    return out


def scanned(rows):
    found, owners = [candidates(t or "") for _, t, _ in rows], defaultdict(set)
    for (_, _, source), c in zip(rows, found):
        for x in c:
            owners[x[3]] |= {source.split("/")[0]} if source is not None else set()
    text = lambda spans: ",".join(f"{secret_scan.KINDS[x[1]]}:{x[0]}:{x[2]}" for x in spans)
    out = []
    for (i, _, _), c in zip(rows, found):
        spans = sorted(x for x in c if x[1] < 3 or len(owners[x[3]]) <= 1)
        base = [x for x in spans if x[1] < 3]
        out.append((i, *[sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(text(base).encode()).hexdigest(), text(spans)))
    return sorted(out, key=str)


def found_secrets(df):
    return sorted((tuple(x) for x in secret_scan.span_digests(secret_scan.secret_scan(df)).collect()), key=str)


def test_scan_equals_brute_force(spark, docs_of):
    r = random.Random(5)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef",
             "é", "𝒳", "\n", "secret", "ſecret", "x", "Zk3" * 7, "aB3dE5gH7jK9lM1nP3qR5", "-", "."]
    rows = [(r.choice([None, i, 7]), "".join(r.choices(parts, k=r.randint(0, 40))) if r.random() > 0.05 else None, r.choice([None, "a/x", "a/y", "b", "c"])) for i in range(600)]
    got = found_secrets(docs_of([(i, t, None, s) for i, t, s in rows]))
    assert got == scanned(rows) and any("owned" in x[5] for x in got)


def test_scan_of_long_texts_and_empty_tables(spark, docs_of):
    rows = [(1, "deadbeefdeadbeef x " * 20000 + "password = hunter2hunter2", "a"), (2, "q" * 1_000_000, "b"), (3, "a" * 1_000_000, "b"), (4, "", None)]
    assert found_secrets(docs_of([(i, t, None, s) for i, t, s in rows])) == scanned(rows)
    assert found_secrets(docs_of([])) == []


def test_verdicts_follow_the_owners(spark, docs_of):
    key, copied = "token = q9w8e7r6t5y4u3i2", "token = exampleexample12"
    rows = [(1, key, None, "ann/one"), (2, key, None, "ann/two")] + [(10 + i, copied, None, f"owner{i}/x") for i in range(4)]
    rows += [(20, "secret: sharedshared1234", None, "p/x"), (21, "secret: sharedshared1234", None, "q/x"), (30, "4041894974608795", None, "z")]
    by = {x.doc_id: x.spans[0] for x in secret_scan.secret_scan(docs_of(rows)).collect()}
    assert {i: s.verdict for i, s in by.items()} == {1: "live", 2: "live", **{10 + i: "example" for i in range(4)}, 20: "shared", 21: "shared", 30: "plain"}
    assert (by[1].n_rows, by[1].n_repos, by[1].n_owners) == (2, 2, 1) and by[10].n_owners == 4


def test_scan_runs_no_python(spark, docs_of):
    plan = secret_scan.secret_scan(docs_of([(1, "token = q9w8e7r6t5y4u3i2", None, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
