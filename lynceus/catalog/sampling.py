"""SP1-SP15: splits, samples, identity and leakage guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.catalog import query
from lynceus.operators import sampling as sp
from lynceus.plans.roles import COHORT_SQL, SCORES_SQL, cohort, scores_wide

SEED = 42
#: The hash of (seed, id) in SQL, and the in-class rank by it.
WORD_SQL = "CAST('0x' || substr(md5('{seed}:' || {id}), 1, 8) AS BIGINT)"
H = WORD_SQL.format(seed=SEED, id="id")
RANKED_SQL = f"""{COHORT_SQL},
ranked AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {H}, id) AS r,
                  count(*) OVER (PARTITION BY y) AS n_class, count(*) OVER () AS n_all FROM cohort)"""


def quota_sql(name: str, n: str, source: str = "SELECT DISTINCT y, n_class AS c, n_all AS t FROM ranked") -> str:
    """Largest-remainder quotas per class of a total ``n``."""
    return f"""{name} AS (
  SELECT y, CAST(fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, y) <= total - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS q
  FROM (SELECT y, ({n}) AS total, floor(({n}) * c / t) AS fl, ({n}) * c / t - floor(({n}) * c / t) AS fr FROM ({source})))"""


@query("sp1_stratified_split", f"""
WITH {RANKED_SQL}, {quota_sql('quota', 'ceil(t * 0.2)')}
SELECT id, y, CASE WHEN r <= q THEN 'test' ELSE 'train' END AS split FROM ranked JOIN quota USING (y)""")
def sp1(spark, sf):
    return sp.stratified_split(cohort(spark, sf).select("id", "y"), "id", "y", 0.2, SEED)


FIXED_SQL = f"""{RANKED_SQL}, {quota_sql('big', 'floor(t / 10)')},
{quota_sql('small', 'floor(t * 1.0 / 10)', 'SELECT y, q AS c, sum(q) OVER () AS t FROM big')},
parts AS (SELECT id, y, CASE WHEN r <= small.q THEN 'test_small' WHEN r <= big.q THEN 'test' ELSE 'pool' END AS part
          FROM ranked JOIN big USING (y) JOIN small USING (y))"""


def _fixed(spark, sf):
    c = cohort(spark, sf).select("id", "y")
    n = c.count() // 10
    return sp.fixed_split(c, "id", "y", n, n // 10, SEED)


@query("sp2_fixed_split", f"WITH {FIXED_SQL} SELECT id, y, part FROM parts")
def sp2(spark, sf):
    return _fixed(spark, sf)


NESTED_SQL = f"""{RANKED_SQL},
nest AS (SELECT id, y, n_all, row_number() OVER (ORDER BY (r - 0.5) / n_class, y) AS nr
         FROM (SELECT id, y, CAST(r AS DOUBLE) AS r, CAST(n_class AS DOUBLE) AS n_class, n_all FROM ranked)),
samples AS (SELECT s.size, id, y FROM nest JOIN (
  SELECT DISTINCT CAST(floor(n_all / d) AS INTEGER) AS size FROM nest, (VALUES (10), (4), (2)) t(d)) s ON nr <= s.size)"""


def _nested(spark, sf):
    c = cohort(spark, sf).select("id", "y")
    n = c.count()
    return sp.nested_samples(c, "id", "y", [n // 10, n // 4, n // 2], SEED)


@query("sp3_nested_samples", f"WITH {NESTED_SQL} SELECT size, id, y FROM samples")
def sp3(spark, sf):
    return _nested(spark, sf).select("size", "id", "y")


@query("sp4_verify_nesting", f"""
WITH {NESTED_SQL},
sizes AS (SELECT size, lead(size) OVER (ORDER BY size) AS nxt FROM (SELECT DISTINCT size FROM samples))
SELECT size, count_if(nxt IS NOT NULL AND b.id IS NULL)::BIGINT AS n_outside,
       count_if(nxt IS NOT NULL AND b.id IS NULL) = 0 AS nested
FROM samples a JOIN sizes USING (size) LEFT JOIN (SELECT size AS bsize, id FROM samples) b ON b.bsize = nxt AND b.id = a.id
GROUP BY size""")
def sp4(spark, sf):
    return sp.verify_nesting(_nested(spark, sf), "id")


@query("sp5_overlap_report", f"""
WITH {FIXED_SQL}
SELECT (SELECT count(*) FROM parts WHERE part = 'pool' AND id IN (SELECT id FROM parts WHERE part <> 'pool')) AS n_shared,
       (SELECT count(*) FROM parts WHERE part = 'pool' AND id NOT IN (SELECT id FROM parts WHERE part <> 'pool')) AS n_outside""")
def sp5(spark, sf):
    parts = _fixed(spark, sf)
    return sp.overlap_report(parts.filter("part = 'pool'"), parts.filter("part <> 'pool'"), "id")


@query("sp6_split_id", f"""
WITH {COHORT_SQL}
SELECT count(*) AS n_rows, substr(sha256(count(*) || '|0.2|42|True'), 1, 16) AS split_id FROM cohort""")
def sp6(spark, sf):
    return sp.split_id_of(cohort(spark, sf), 0.2, SEED, True)


@query("sp7_id_fingerprint", f"""
WITH {COHORT_SQL},
p AS (SELECT count(*) AS n, CAST(sum(h) AS VARCHAR) AS s, bit_xor(h) AS x
      FROM (SELECT CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM cohort))
SELECT n AS n_ids, substr(sha256(n || '|' || s || '|' || x), 1, 16) AS fingerprint FROM p""")
def sp7(spark, sf):
    return sp.id_fingerprint(cohort(spark, sf), "id")


@query("sp8_table_digest")
def sp8(spark, sf):
    return sp.table_digest(cohort(spark, sf))


@query("sp9_assign_folds", f"WITH {RANKED_SQL} SELECT id, y, CAST((r - 1) % 5 AS INTEGER) AS fold FROM ranked")
def sp9(spark, sf):
    return sp.assign_folds(cohort(spark, sf).select("id", "y"), "id", "y", 5, SEED)


@query("sp10_repeated_folds", f"""
WITH {COHORT_SQL},
l AS (SELECT id, y, CAST(rep AS INTEGER) AS repeat FROM cohort, unnest([1, 2, 3]) t(rep))
SELECT id, y, repeat, CAST((row_number() OVER (PARTITION BY repeat, y
  ORDER BY CAST('0x' || substr(md5((42 + repeat) || ':' || id), 1, 8) AS BIGINT), id) - 1) % 5 AS INTEGER) AS fold FROM l""")
def sp10(spark, sf):
    return sp.repeated_folds(cohort(spark, sf).select("id", "y"), "id", "y", 5, 3, SEED)


@query("sp11_seeded_draws", f"""
WITH {COHORT_SQL},
l AS (SELECT id, y, CAST(s AS INTEGER) AS seed, count(*) OVER () // 3 AS n_all FROM cohort, unnest([7, 11, 42]) t(s)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, y ORDER BY CAST('0x' || substr(md5(seed || ':' || id), 1, 8) AS BIGINT), id) AS r,
             count(*) OVER (PARTITION BY seed, y) AS nc FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY (CAST(r AS DOUBLE) - 0.5) / CAST(nc AS DOUBLE), y) AS nr FROM r)
SELECT seed, id, y FROM n WHERE nr <= n_all // 5""")
def sp11(spark, sf):
    c = cohort(spark, sf).select("id", "y")
    return sp.seeded_draws(c, "id", "y", c.count() // 5, [7, 11, 42]).select("seed", "id", "y")


@query("sp12_bounded_subsample", f"""
WITH {RANKED_SQL},
t AS (SELECT count(*) AS n, count(*) // 10 AS want, sum(y) AS p FROM cohort),
q AS (SELECT greatest(1, round_even(want * p / n, 0)) AS np, want FROM t)
SELECT id, y FROM ranked, q WHERE (y = 1 AND r <= np) OR (y = 0 AND r <= want - np)""")
def sp12(spark, sf):
    c = cohort(spark, sf).select("id", "y")
    return sp.bounded_subsample(c, "id", "y", c.count() // 10, SEED)


@query("sp13_balanced_draw", f"""
WITH {FIXED_SQL},
free AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {WORD_SQL.format(seed=7, id='id')}, id) AS fr
         FROM parts WHERE part = 'pool')
SELECT id, y FROM free WHERE (y = 1 AND fr <= 100) OR (y = 0 AND fr <= 101)""")
def sp13(spark, sf):
    parts = _fixed(spark, sf)
    return sp.balanced_draw(cohort(spark, sf).select("id", "y"), parts.filter("part <> 'pool'"), "id", "y", 201, 7)


@query("sp14_subsample", f"""
WITH {COHORT_SQL} SELECT id, y FROM cohort ORDER BY {H}, id LIMIT 500""")
def sp14(spark, sf):
    return sp.subsample(cohort(spark, sf).select("id", "y"), "id", 500, SEED)


@query("sp15_shared_values_exact", f"""
WITH {SCORES_SQL}
SELECT s.id, s.a, s.b FROM scores s SEMI JOIN (SELECT a, b FROM scores WHERE stage = 'B') t ON s.a = t.a AND s.b = t.b WHERE s.stage = 'A'""")
def sp15(spark, sf):
    s = scores_wide(spark, sf)
    return sp.shared_values(s.filter("stage = 'A'").select("id", "a", "b"), s.filter("stage = 'B'"), ["a", "b"])


@query("sp15_shared_values_tolerant", f"""
WITH {SCORES_SQL}
SELECT s.id, s.a, s.b FROM scores s
WHERE s.stage = 'A' AND EXISTS (
  SELECT 1 FROM scores t WHERE t.stage = 'B' AND floor(t.a / 0.0001) BETWEEN floor(s.a / 0.0001) - 1 AND floor(s.a / 0.0001) + 1
  AND abs(s.a - t.a) <= 0.0001 AND abs(s.b - t.b) <= 0.0001)""")
def sp15t(spark, sf):
    s = scores_wide(spark, sf)
    return sp.shared_values(
        s.filter("stage = 'A'").select("id", "a", "b"), s.filter("stage = 'B'"), ["a", "b"], tol=0.0001
    )


@query("sp15_shared_values_relative", f"""
WITH {SCORES_SQL}
SELECT DISTINCT s.id, s.a, s.b FROM scores s
WHERE s.stage = 'A' AND EXISTS (
  SELECT 1 FROM scores t WHERE t.stage = 'B' AND floor(t.a / 0.0003) BETWEEN floor(s.a / 0.0003) - 1 AND floor(s.a / 0.0003) + 1
  AND abs(s.a - t.a) <= 0.00001::DOUBLE + 0.0002::DOUBLE * abs(t.a) AND abs(s.b - t.b) <= 0.00001::DOUBLE + 0.0002::DOUBLE * abs(t.b))""")
def sp15r(spark, sf):
    """A tolerance that grows with the value; a is at most 1, so 0.0003 bounds it in the SQL."""
    s = scores_wide(spark, sf)
    return sp.shared_values(s.filter("stage = 'A'").select("id", "a", "b"), s.filter("stage = 'B'"), ["a", "b"], tol=0.00001, rtol=0.0002)
