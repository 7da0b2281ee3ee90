"""One query per corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.llm.base import fold_of, table
from lynceus.llm.exact_dedup import exact_dedup
from lynceus.llm.importance import importance_sample
from lynceus.llm.kneser_ney import quality_scores
from lynceus.llm.language_id import language_id
from lynceus.llm.line_dedup import line_dedup
from lynceus.llm.mixing import mix_documents
from lynceus.llm.near_vectors import near_vectors
from lynceus.llm.ngram_join import jaccard_join
from lynceus.llm.pieces import encode_pieces
from lynceus.llm.prefix_trie import prefix_trie
from lynceus.llm.registry import query
from lynceus.llm.secret_scan import secret_scan, span_digests
from lynceus.llm.settings import form_topic, trusted_ids, vocabulary
from lynceus.llm.token_counts import token_counts
from lynceus.llm.toxicity import toxicity


@query("op1_near_vectors")
def op1(spark, sf):
    return near_vectors(table(spark, sf, "embeddings"), threshold=0.98)


@query("op2_token_counts")
def op2(spark, sf):
    return token_counts(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


@query("op6_exact_dedup", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text""")
def op6(spark, sf):
    return exact_dedup(spark, f"{sf}/documents.parquet")


@query("op8_language_id")
def op8(spark, sf):
    held = fold_of(F.col("doc_id")) == 2
    return language_id(table(spark, sf, "documents"), train=~held, held_out=held)


@query("op4_line_dedup", """
WITH l AS (SELECT doc_id, source, text, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
b AS (SELECT t, min({'d': doc_id, 'p': pos}) AS first FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 8),
m AS (SELECT k.*, b.t IS NOT NULL AND {'d': doc_id, 'p': pos} <> b.first AS gone FROM k LEFT JOIN b ON k.t = b.t)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id""")
def op4(spark, sf):
    return line_dedup(table(spark, sf, "documents"), min_sites=8).select("doc_id", "n_lines", "n_removed", "text")


@query("op5_mixing")
def op5(spark, sf):
    docs = mix_documents(table(spark, sf, "documents"), form_topic())
    return docs.select("doc_id", "source", "lang", "mix_topic", "mix_tokens", "mix_factor", "mix_probability", "mix_sampled")


@query("op10_pieces")
def op10(spark, sf):
    return encode_pieces(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op3_quality")
def op3(spark, sf):
    return quality_scores(table(spark, sf, "documents"), trusted_ids(spark, sf))


@query("op7_toxicity")
def op7(spark, sf):
    held = fold_of(F.col("doc_id")) == 2
    labels = table(spark, sf, "labels").where(~held).select("doc_id", "toxic")
    return toxicity(table(spark, sf, "documents"), labels, held)


JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) l ON r.y = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id"""


@query("op9_ngram_join", JOIN_SQL)
def op9(spark, sf):
    return jaccard_join(table(spark, sf, "documents"))


LINKS_SQL = JOIN_SQL.replace("AS component_id\n", "AS component_id,\n  (SELECT count(*) FROM e WHERE e.a = w.doc_id OR e.b = w.doc_id) AS n_links\n")


@query("op9_link_counts", LINKS_SQL)
def op9_links(spark, sf):
    return jaccard_join(table(spark, sf, "documents"), count_links=True)


#: CRC-32 of every text ``v`` of a relation ``distinct_texts``, one byte of all texts in each round.
CRC_SQL = """
crc_table(i, c, s) AS (SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM crc_table WHERE s < 8),
crc_steps(v, h, p, r) AS (SELECT v, hex(encode(v)), 0, 4294967295::BIGINT FROM distinct_texts
  UNION ALL SELECT v, h, p + 1, xor(r >> 8, t.c) FROM crc_steps JOIN crc_table t ON t.s = 8 AND t.i = xor(r & 255,
    (16 * (strpos('0123456789ABCDEF', substr(h, 2 * p + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * p + 2, 1)) - 1)::BIGINT)
  WHERE 2 * p < length(h)),
crcs AS (SELECT v, xor(r, 4294967295) AS crc FROM crc_steps WHERE 2 * p = length(h))"""


@query("op11_importance", r"""
WITH RECURSIVE dw AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS v FROM documents),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS v FROM benchmark),
distinct_texts AS (SELECT v FROM dw UNION SELECT v FROM bw),""" + CRC_SQL + """,
s AS (SELECT crc % 10000 AS b, count(*) AS s FROM dw JOIN crcs USING (v) GROUP BY 1),
t AS (SELECT crc % 10000 AS b, count(*) AS t FROM bw JOIN crcs USING (v) GROUP BY 1),
tot AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS ss, coalesce((SELECT sum(t) FROM t), 0) AS tt),
g AS (SELECT range AS b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) LEFT JOIN s ON s.b = range LEFT JOIN t ON t.b = range CROSS JOIN tot),
f AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS w FROM dw JOIN crcs USING (v) JOIN g ON g.b = crc % 10000 GROUP BY doc_id),
d AS (SELECT documents.doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
  coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM d WHERE n_features >= 20)
SELECT d.doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM r) // 100 THEN r END AS rank FROM d LEFT JOIN r USING (doc_id)""")
def op11(spark, sf):
    return importance_sample(table(spark, sf, "documents"), table(spark, sf, "benchmark"), buckets=10_000, max_run=1, percent=10, min_words=20, seed=2024)


@query("op12_prefix_trie", """
WITH RECURSIVE own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
distinct_texts AS (SELECT DISTINCT c::VARCHAR AS v FROM own),""" + CRC_SQL + """,
convs AS (SELECT v::BIGINT AS c, crc % 4 AS h, v::BIGINT - v::BIGINT % 20 AS base FROM crcs),
raw AS (SELECT convs.c, 0 AS side, p, role, text FROM convs JOIN own ON own.c = base AND p <= h
  UNION ALL SELECT convs.c, 1, p, role, text FROM convs JOIN own ON own.c = convs.c AND p > h),
lists AS (SELECT convs.c, coalesce(list({'r': role, 't': text} ORDER BY side, p) FILTER (role IS NOT NULL), []) AS l FROM convs LEFT JOIN raw ON raw.c = convs.c GROUP BY convs.c),
paths AS (SELECT c, len(l) AS n, d, sha256(l[:d]::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(l[:d - 1]::VARCHAR) END AS pk,
  CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS w FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM lists)),
nodes AS (SELECT d, k, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM paths GROUP BY d, k),
kids AS (SELECT x.d, x.k, count(y.k) AS n_children FROM nodes x LEFT JOIN nodes y ON y.pk = x.k AND y.d = x.d + 1 GROUP BY ALL),
below AS (SELECT u.d, u.k, count(DISTINCT CASE WHEN n_children = 0 THEN v.k END) AS n_leaves FROM paths u JOIN paths v ON u.c = v.c AND v.d >= u.d
  JOIN kids ON kids.d = v.d AND kids.k = v.k GROUP BY u.d, u.k),
subtree AS (SELECT DISTINCT u.d, u.k, v.d AS vd, v.k AS vk FROM paths u JOIN paths v ON u.c = v.c AND v.d >= u.d),
saved AS (SELECT s.d, s.k, sum((n_convs - 1) * w)::BIGINT AS saved_tokens FROM subtree s JOIN nodes v ON v.d = vd AND v.k = vk GROUP BY s.d, s.k)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN kids USING (d, k) JOIN below USING (d, k) JOIN saved USING (d, k) LEFT JOIN nodes p ON p.k = n.pk AND p.d = n.d - 1""")
def op12(spark, sf):
    return prefix_trie(table(spark, sf, "conversations"), family=20, heads_of=4)


_WORDS = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
_ASSIGN = f"""({_WORDS}|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind_sql(kind: int, pattern: str, group: int) -> str:
    return f"""SELECT doc_id, owner, {kind} AS kind, unnest(range(len(m))) AS pos, unnest(m) AS m, unnest(v) AS v, unnest(gaps[:len(m)]) AS gap FROM (
  SELECT doc_id, owner, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v,
    string_split_regex(text, '{pattern}') AS gaps FROM docs)"""


@query("op13_secrets", f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, split_part(source, '/', 1) AS owner FROM documents),
pieces AS ({_kind_sql(0, _ASSIGN, 2)} UNION ALL {_kind_sql(1, 'AKIA[A-Z0-9]+', 0)} UNION ALL {_kind_sql(2, '[0-9a-f]+', 0)}
  UNION ALL {_kind_sql(3, _ASSIGN + '|([A-Za-z0-9_-]{20,})', 3)}),
sized AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY pos)::BIGINT AS stop FROM pieces),
hits AS (SELECT doc_id, owner, kind, stop - length(m) AS lo, stop, v FROM sized WHERE CASE kind WHEN 0 THEN length(v) >= 12 WHEN 1 THEN length(m) >= 18
  WHEN 2 THEN length(m) >= 16 ELSE regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')
  AND len(list_distinct(string_split(v, ''))) >= 8 AND NOT regexp_matches(v, 'AKIA[A-Z0-9]{{14,}}|[0-9a-f]{{16,}}') END),
owners AS (SELECT v, count(DISTINCT owner) AS n FROM hits GROUP BY v),
spans AS (SELECT doc_id, kind, lo, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || lo || ':' || stop AS span FROM hits JOIN owners USING (v) WHERE kind < 3 OR n <= 1),
lists AS (SELECT doc_id, count_if(kind = 0)::BIGINT AS n_assign, count_if(kind = 1)::BIGINT AS n_access, count_if(kind = 2)::BIGINT AS n_hex,
  string_agg(span, ',' ORDER BY lo, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY lo, kind) AS spans FROM spans GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM docs LEFT JOIN lists USING (doc_id)""".replace("\\\\x", "\\x"))
def op13(spark, sf):
    return span_digests(secret_scan(table(spark, sf, "documents"), repo="source"))
