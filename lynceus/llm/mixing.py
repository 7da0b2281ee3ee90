"""Mixing documents to target shares by iterative proportional fitting (raking).

Token weights of the (source, language, topic) cells are scaled until the token shares by source, by language and by
topic all meet their targets; documents are then drawn with probabilities proportional to their cell's factor.

Sources are open-ended and stay distributed: one row per source with its non-empty (language, topic) cells. Languages and
topics are closed label sets; only their totals, one number per pair, reach the driver in each iteration.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lynceus.llm.base import stored

UNKNOWN = "und"
#: Source rows up to which the factor table is broadcast (about 100 bytes a row); beyond it joins shuffle.
BROADCAST_ROWS = 50_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def tempered(totals: dict[str, float], alpha: float) -> dict[str, float]:
    """Shares proportional to total ** alpha."""
    raised = {k: v**alpha for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


class Raking:
    """Fitted factors: ``source_factors`` (source, a), ``b`` by language, ``c`` by topic, ``scale``: 1 / largest factor."""

    def __init__(self, source_factors: DataFrame, n_sources: int, b: dict[str, float], c: dict[str, float], scale: float, error: float, rounds: int):
        self.source_factors, self.n_sources, self.b, self.c = source_factors, n_sources, b, c
        self.scale, self.error, self.rounds = scale, error, rounds


def rake(cells: DataFrame, alpha: float = 0.85, language_targets: dict[str, float] | None = None, topic_targets: dict[str, float] | None = None,
         tol: float = 1e-9, max_rounds: int = 200) -> Raking:
    """Fits factors to ``cells`` (source, lang, topic, tokens): one row per non-empty cell.

    Targets of sources are their shares tempered by ``alpha``; so are those of languages and topics unless given as
    shares (values that do not occur are left out and the rest scaled up). Stops once every margin is within ``tol`` of
    its target, or after ``max_rounds``; the reached error is in the result.
    """
    cells = stored(cells.where("tokens > 0"), "cells")
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0.0)

    def margin(name: str, given: dict[str, float] | None) -> dict[str, float]:
        totals = {r[0]: float(r[1]) for r in cells.groupBy(name).agg(F.sum("tokens")).orderBy(name).collect()}
        if given is None:
            return tempered(totals, alpha)
        return tempered({k: given.get(k, 0.0) for k in totals}, 1.0)

    langs, topics = margin("lang", language_targets), margin("topic", topic_targets)
    li, ti = {k: i for i, k in enumerate(langs)}, {k: i for i, k in enumerate(topics)}
    pairs = len(li) * len(ti)
    if not pairs:
        return Raking(cells.select("source", F.lit(0.0).alias("a")), 0, {}, {}, 0.0, 0.0, 0)

    def index(column: str, of: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col(column)]

    at = (index("lang", li) * len(ti) + index("topic", ti)).alias("k")
    kept = cells.where(F.col("lang").isin(*li) & F.col("topic").isin(*ti)).select("source", at, (F.col("tokens") / whole).alias("w"))
    by_source = kept.groupBy("source").agg(F.collect_list(F.struct("k", "w")).alias("cells"), F.sum("w").alias("total"))
    raised = by_source.withColumn("target", F.pow("total", F.lit(alpha)))
    norm = raised.agg(F.sum("target")).first()[0]
    sources = stored(raised.select("source", "cells", (F.col("target") / norm).alias("target")), "sources")
    n_sources = sources.count()
    b_target, c_target = np.array(list(langs.values())), np.array(list(topics.values()))
    b, c, error, rounds = np.ones(len(li)), np.ones(len(ti)), np.inf, 0

    def factor() -> Column:
        inner = F.lit([float(x) for x in np.outer(b, c).ravel()])
        reached = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["w"] * inner[x["k"]])
        return F.col("target") / reached

    while error > tol and rounds < max_rounds:
        with_a = sources.select("cells", factor().alias("a"))
        sums = with_a.select("a", F.explode("cells").alias("x")).groupBy("x.k").agg(F.sum(F.col("a") * F.col("x.w"))).collect()
        m = np.zeros(pairs)
        for k, v in sorted(tuple(r) for r in sums):
            m[k] = v
        m = m.reshape(len(li), len(ti))
        now = m * np.outer(b, c)  # sources fit here; the other two margins show how far it is
        error = max(np.abs(now.sum(axis=1) - b_target).max(), np.abs(now.sum(axis=0) - c_target).max())
        if error > tol:
            b = b_target / (m @ c)
            c = c_target / (b @ m)
        rounds += 1
    outer = F.lit([float(x) for x in np.outer(b, c).ravel()])
    final = stored(sources.select("source", factor().alias("a"), F.transform("cells", lambda x: outer[x["k"]]).alias("bc")), "factors")
    largest = final.agg(F.max(F.col("a") * F.array_max("bc"))).first()[0]
    return Raking(final.select("source", "a"), n_sources, dict(zip(li, map(float, b))), dict(zip(ti, map(float, c))), 1 / largest, float(error), rounds)


def mix_documents(docs: DataFrame, topic: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                  alpha: float = 0.85, language_targets: dict[str, float] | None = None, topic_targets: dict[str, float] | None = None,
                  seed: int = 42) -> DataFrame:
    """All rows and columns of ``docs`` plus mix_topic, mix_tokens, mix_factor, mix_probability, mix_sampled.

    A document is sampled where a hash of (seed, id) lies below its probability: its cell's raked factor over the largest
    one, so no probability is cut at 1 and the expected token shares equal the targets. Null sources, languages and
    topics are the value ``und``. Documents without words carry no tokens: factor and probability are those of their
    cell, or 0 where the cell has no tokens at all. Rows with one id share their fate; columns named mix_* are replaced.
    An empty table gives an empty result.
    """
    names = [c for c in docs.columns if not c.startswith("mix_")]
    rows = docs.select(
        *names, F.coalesce(topic, F.lit(UNKNOWN)).alias("mix_topic"), words(F.col(text_col)).alias("mix_tokens"),
        F.coalesce(source_col, F.lit(UNKNOWN)).alias("__source"), F.coalesce(lang_col, F.lit(UNKNOWN)).alias("__lang"))
    cells = rows.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("mix_topic").alias("topic")).agg(
        F.sum("mix_tokens").alias("tokens"))
    fit = rake(cells, alpha, language_targets, topic_targets)
    factors = fit.source_factors.select(F.col("source").alias("__of"), F.col("a").alias("__a"))
    if fit.n_sources <= BROADCAST_ROWS:
        factors = F.broadcast(factors)

    def looked_up(column: str, values: dict[str, float]) -> Column:
        found = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(column)] if values else F.lit(None).cast("double")
        return F.coalesce(found, F.lit(0.0))

    joined = rows.join(factors, F.col("__source") == F.col("__of"), "left")
    whole = F.coalesce("__a", F.lit(0.0)) * looked_up("__lang", fit.b) * looked_up("mix_topic", fit.c)
    uniform = F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    out = joined.withColumn("mix_factor", whole).withColumn("mix_probability", F.least(F.lit(1.0), F.col("mix_factor") * F.lit(fit.scale)))
    return out.withColumn("mix_sampled", uniform < F.col("mix_probability")).drop("__source", "__lang", "__of", "__a")
