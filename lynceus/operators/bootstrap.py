"""Bootstrap intervals in bounded passes over score-ordered blocks.

Identical rows are counted first; a resample draws one Poisson weight per group of identical rows. The weight is the inverse
distribution function at a word that depends on (seed, group, resample) alone, so both models of a pair see the same
resample and results do not depend on partitioning.

No row is multiplied by the resamples. A block is a range of exact scores of one group; a task streams its cells in score
order and carries arrays with one number per resample. The first pass sums positives and negatives of each block, those
sums above a block are its offsets, the second pass adds concordant mass and precision. Memory is a few arrays of
``ROWS`` x resamples, whatever the number of rows, groups or equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lynceus.functions.draws import MARGIN, SPAN, poisson
from lynceus.functions.hashing import hash_word
from lynceus.operators.compare import delong, holm, mcnemar, pair_cells, pair_weight, pair_with_reference, verdict
from lynceus.operators.evaluate import LABEL_METRICS, RANK_METRICS, confusion, label_metrics, label_ratios, metrics_long, ranking_metrics
from lynceus.operators.quality import assert_runs_consistent
from lynceus.operators.ranking import bucket_count, join_groups, with_value_bucket
from lynceus.session import ship_package, stored

METHOD = "poisson_cells"
#: Cells drawn at once: few enough for their draws to stay in a core's cache.
ROWS = 64
#: Partial sums a task holds before it hands them on.
HELD = 64
#: Cells of one score above which their draws are summed by several tasks before the ordered pass.
HOT = 100_000

CELLS = "gid string, bucket int, score double, y int, cnt long, w0 long, w1 long, sums binary"
Sums = tuple[np.ndarray, np.ndarray]


def score_key(score: Column) -> Column:
    """Text of a score that keys its draws: 15 decimals. Closer scores stay apart as scores and share a draw."""
    return F.round(score * 1e15).cast("decimal(38,0)").cast("string")


def _group(keys: list[str], *more: Column) -> Column:
    return F.to_json(F.struct(*keys, *more))


def _back(df: DataFrame, like: DataFrame, keys: list[str], more: str = "") -> DataFrame:
    """The group columns from their text."""
    schema = ", ".join([*(f"`{k}` {like.schema[k].dataType.simpleString()}" for k in keys), *([more] if more else [])])
    rest = [c for c in df.columns if c != "gid"]
    return df.withColumn("_g", F.from_json("gid", schema or "_ int")).select(*([F.col("_g.*")] if schema else []), *rest)


def cell_rows(cells: DataFrame, gid: Column, score: Column, key: list[Column], seed: int) -> DataFrame:
    """Cells with their key words and score block, in the layout of ``CELLS``."""
    parts = [F.lit(seed), *key]
    rows = cells.select(
        gid.alias("gid"), score.cast("double").alias("score"), F.col("y").cast("int").alias("y"), F.col("cnt").cast("long").alias("cnt"),
        hash_word(*parts, word=0).alias("w0"), hash_word(*parts, word=1).alias("w1"))
    rows = with_value_bucket(rows, "score", bucket_count(rows), "bucket")
    return rows.select("gid", F.col("bucket").cast("int").alias("bucket"), "score", "y", "cnt", "w0", "w1", F.lit(None).cast("binary").alias("sums"))


def _weights(batch: dict[str, np.ndarray], rows: slice, resamples: int) -> np.ndarray:
    """Draws of some cells; column 0 holds the counts themselves, so the observed value is one more resample."""
    cnt = batch["cnt"][rows]
    summed = [(i, s) for i, s in enumerate(batch["sums"][rows]) if s is not None]
    # 32 bits where no sum over the cells can pass them
    most = int(cnt.max()) + SPAN * math.isqrt(int(cnt.max())) + SPAN + MARGIN
    dtype = np.int32 if not summed and most * len(cnt) < 2**31 else np.int64
    out = np.empty((len(cnt), resamples + 1), dtype)
    out[:, 0] = cnt
    out[:, 1:] = poisson(cnt, batch["w0"][rows], batch["w1"][rows], resamples, dtype)
    for i, s in summed:
        out[i] = np.frombuffer(s, np.int64)
    return out


def _columns(batch: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {n: np.array(batch.column(i).to_pylist(), object) if n in ("gid", "sums", "p", "n") else batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}


NAMES = [c.split()[0] for c in CELLS.split(", ")]


def _runs(*keys: np.ndarray) -> Iterator[slice]:
    """Slices of rows with equal keys, in the order they come."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    at = [0, *np.flatnonzero(change).tolist(), n]
    yield from (slice(a, b) for a, b in zip(at, at[1:]) if b > a)


def _chunks(run: slice) -> Iterator[slice]:
    yield from (slice(a, min(a + ROWS, run.stop)) for a in range(run.start, run.stop, ROWS))


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _block_sums(resamples: int):
    """Pass one, in any order: (gid, bucket, positives, negatives) summed as far as a task holds them."""
    schema = pa.schema([("gid", pa.string()), ("bucket", pa.int32()), ("p", pa.binary()), ("n", pa.binary())])

    def run(batches):
        held: dict[tuple, Sums] = {}
        for batch in batches:
            cols = _columns(batch, NAMES)
            for part in _runs(cols["gid"], cols["bucket"]):
                key = (cols["gid"][part.start], int(cols["bucket"][part.start]))
                if key not in held and len(held) >= HELD:
                    yield _out([(*k, p.tobytes(), n.tobytes()) for k, (p, n) in held.items()], schema)
                    held = {}
                p, n = held.setdefault(key, (np.zeros(resamples + 1, np.int64), np.zeros(resamples + 1, np.int64)))
                for rows in _chunks(part):
                    w, pos = _weights(cols, rows, resamples), cols["y"][rows] == 1
                    p += np.add.reduce(w[pos], axis=0, dtype=w.dtype)
                    n += np.add.reduce(w[~pos], axis=0, dtype=w.dtype)
        if held:
            yield _out([(*k, p.tobytes(), n.tobytes()) for k, (p, n) in held.items()], schema)

    return run


def _offsets():
    """Sums above each block, from the blocks of a group in descending order; a block's parts come one after the other."""
    schema = pa.schema([("gid", pa.string()), ("bucket", pa.int32()), ("p", pa.binary()), ("n", pa.binary())])

    def run(batches):
        gid = bucket = None
        for batch in batches:
            cols, out = _columns(batch, ["gid", "bucket", "p", "n"]), []
            for g, b, p, n in zip(cols["gid"], cols["bucket"].tolist(), cols["p"], cols["n"]):
                p, n = np.frombuffer(p, np.int64), np.frombuffer(n, np.int64)
                if g != gid:
                    gid, bucket, up, un = g, None, np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
                if b != bucket:
                    bucket = b
                    out.append((g, b, up.tobytes(), un.tobytes()))
                up, un = up + p, un + n
            if out:
                yield _out(out, schema)

    return run


class _Block:
    """Running state of one block: sums above, the last score's sums not yet placed, and what has been added up."""

    def __init__(self, up: bytes, un: bytes):
        # whole numbers below 2^53, so that their products need no conversion
        self.up, self.un = (np.frombuffer(b, np.int64).astype(np.float64) for b in (up, un))
        self.first = self.up, self.un
        self.score, self.open = None, None
        self.area, self.precision = np.zeros(len(self.up)), np.zeros(len(self.up))

    def add(self, score: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Draws of some cells: those of a score's class are summed, all scores but the last are placed together."""
        new, pos = np.concatenate(([True], score[1:] != score[:-1])), y == 1
        starts = np.flatnonzero(new | np.concatenate(([False], pos[1:] != pos[:-1])))
        at, pos = np.cumsum(new)[starts] - 1, pos[starts]
        sums = w if len(starts) == len(w) else np.add.reduceat(w, starts, axis=0, dtype=w.dtype)
        of = lambda rows: [np.add.reduce(sums[rows & c], axis=0, dtype=np.float64) for c in (pos, ~pos)]
        last, begin = at[-1], 0
        if self.open is not None and score[0] == self.score:
            self.open = [a + b for a, b in zip(self.open, of(at == 0))]
            if last == 0:
                return
            begin = 1
        self._place_open()
        rows = (at >= begin) & (at < last)
        if rows.any():
            self._place(*[x for c in (pos, ~pos) for x in (sums[rows & c].astype(np.float64), at[rows & c])])
        self.score, self.open = score[-1], of(at == last)

    def _place_open(self) -> None:
        if self.open is not None:
            one = np.zeros(1, np.int64)
            self._place(self.open[0][None], one, self.open[1][None], one)

    def _place(self, p: np.ndarray, at_p: np.ndarray, n: np.ndarray, at_n: np.ndarray) -> None:
        """Sums of positives and of negatives with the numbers of their scores, the highest first."""
        tp, fp = (np.concatenate((top[None], x)) for top, x in ((self.up, p), (self.un, n)))
        np.cumsum(tp, axis=0, out=tp)
        np.cumsum(fp, axis=0, out=fp)
        if len(n):
            above, with_ties = np.searchsorted(at_p, at_n, "left"), np.searchsorted(at_p, at_n, "right")
            over = tp[above]
            if not np.array_equal(above, with_ties):
                over = (over + tp[with_ties]) * 0.5  # positives above, and half of those at the same score
            over *= n
            self.area += over.sum(0)
        if len(p):
            hits = tp[np.searchsorted(at_p, at_p, "right")]
            named = fp[np.searchsorted(at_n, at_p, "right")]
            named += hits
            np.maximum(named, 1.0, out=named)
            hits /= named
            hits *= p
            self.precision += hits.sum(0)
        self.up, self.un = tp[-1].copy(), fp[-1].copy()

    def close(self) -> tuple[bytes, ...]:
        self._place_open()
        p, n = (np.rint(now - then).astype(np.int64) for now, then in zip((self.up, self.un), self.first))
        return tuple(x.tobytes() for x in (p, n, self.area, self.precision))


TOTALS = "gid string, p binary, n binary, area binary, precision binary"
TOTALS_ARROW = pa.schema([("gid", pa.string()), *[(c, pa.binary()) for c in ("p", "n", "area", "precision")]])


def _ordered(resamples: int):
    """Pass two: a block's offsets come first, then its cells by descending score."""

    def run(batches):
        key = block = None
        for batch in batches:
            cols, out = _columns(batch, [*NAMES, "p", "n"]), []
            for part in _runs(cols["gid"], cols["bucket"]):
                at = (cols["gid"][part.start], int(cols["bucket"][part.start]))
                if at != key:
                    if block is not None:
                        out.append((key[0], *block.close()))
                    key, block = at, _Block(cols["p"][part.start], cols["n"][part.start])
                    part = slice(part.start + 1, part.stop)
                for rows in _chunks(part):
                    block.add(cols["score"][rows], cols["y"][rows], _weights(cols, rows, resamples))
            if out:
                yield _out(out, TOTALS_ARROW)
        if block is not None:
            yield _out([(key[0], *block.close())], TOTALS_ARROW)

    return run


def _totals():
    """Block results of a group added up, in the order they come."""

    def run(batches):
        gid, total = None, None
        for batch in batches:
            out = []
            for g, *parts in zip(*[c.to_pylist() for c in batch.columns[:5]]):
                parts = [np.frombuffer(b, t) for b, t in zip(parts, (np.int64, np.int64, np.float64, np.float64))]
                if g == gid:
                    total = [a + b for a, b in zip(total, parts)]
                    continue
                if gid is not None:
                    out.append((gid, *[x.tobytes() for x in total]))
                gid, total = g, parts
            if out:
                yield _out(out, TOTALS_ARROW)
        if gid is not None:
            yield _out([(gid, *[x.tobytes() for x in total])], TOTALS_ARROW)

    return run


def _per_resample():
    """(gid, r, roc_auc, pr_auc); r = -1 is the observed table. A resample with one class only cannot be ranked and is left out."""
    schema = pa.schema([("gid", pa.string()), ("r", pa.int32()), ("roc_auc", pa.float64()), ("pr_auc", pa.float64())])

    def run(batches):
        for batch in batches:
            for g, p, n, area, precision in zip(*[c.to_pylist() for c in batch.columns]):
                p, n = np.frombuffer(p, np.int64).astype(float), np.frombuffer(n, np.int64).astype(float)
                ok = np.flatnonzero((p > 0) & (n > 0))
                roc, pr = np.frombuffer(area)[ok] / (p[ok] * n[ok]), np.frombuffer(precision)[ok] / p[ok]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(ok), pa.string()), pa.array(ok - 1, pa.int32()), pa.array(roc), pa.array(pr)], schema=schema)

    return run


def _spread_hot(cells: DataFrame, resamples: int) -> DataFrame:
    """Scores that many cells share are summed where the cells lie: the ordered pass then reads one row per task and class."""
    hot = stored(cells.groupBy("gid", "score").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select("gid", "score"))
    if hot.isEmpty():
        return cells
    names = [c for c in NAMES if c != "sums"]
    schema = pa.schema([("gid", pa.string()), ("bucket", pa.int32()), ("score", pa.float64()), ("y", pa.int32()), ("sums", pa.binary())])

    def summed(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            cols = _columns(batch, NAMES)
            for part in _runs(cols["gid"], cols["score"], cols["y"]):
                key = (cols["gid"][part.start], int(cols["bucket"][part.start]), float(cols["score"][part.start]), int(cols["y"][part.start]))
                if key not in held and len(held) >= HELD:
                    yield _out([(*k, v.tobytes()) for k, v in held.items()], schema)
                    held = {}
                total = held.setdefault(key, np.zeros(resamples + 1, np.int64))
                for rows in _chunks(part):
                    total += np.add.reduce(_weights(cols, rows, resamples), axis=0)
        if held:
            yield _out([(*k, v.tobytes()) for k, v in held.items()], schema)

    sums = cells.join(hot, ["gid", "score"], "left_semi").select(*NAMES).mapInArrow(summed, "gid string, bucket int, score double, y int, sums binary")
    sums = sums.select("gid", "bucket", "score", "y", *[F.lit(1).cast("long").alias(c) for c in names[4:]], "sums")
    return stored(cells.join(hot, ["gid", "score"], "left_anti").select(*NAMES).unionByName(sums))


def resampled_ranking(cells: DataFrame, resamples: int) -> DataFrame:
    """(gid, r, roc_auc, pr_auc) of cells in the layout of ``CELLS``; r = -1 is the observed table."""
    spark = cells.sparkSession
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by number of the cell, not of its block: draws of a hot block are spread over all tasks
    cells = _spread_hot(stored(cells.repartition(n, "w0", "w1").sortWithinPartitions("gid", "bucket", "score", "y")), resamples)
    binary = "gid string, bucket int, p binary, n binary"
    sums = cells.mapInArrow(_block_sums(resamples), binary)
    above = sums.repartition(n, "gid").sortWithinPartitions("gid", F.desc("bucket")).mapInArrow(_offsets(), binary)
    above = above.select("gid", "bucket", *[F.lit(None).cast(t).alias(c) for c, t in (("score", "double"), ("y", "int"), ("cnt", "long"), ("w0", "long"), ("w1", "long"), ("sums", "binary"))], "p", "n")
    both = cells.select(*NAMES, *[F.lit(None).cast("binary").alias(c) for c in ("p", "n")]).unionByName(above)
    # the row with offsets has no score and comes first
    both = both.repartition(n, "gid", "bucket").sortWithinPartitions("gid", "bucket", F.col("score").desc_nulls_first(), "y", "w0", "w1").na.fill(0, ["y", "cnt", "w0", "w1"])
    blocks = both.mapInArrow(_ordered(resamples), TOTALS)
    totals = blocks.repartition(n, "gid").sortWithinPartitions("gid", "p", "area").mapInArrow(_totals(), TOTALS)
    return stored(totals.mapInArrow(_per_resample(), "gid string, r int, roc_auc double, pr_auc double"))


def resampled_rank_metrics(scores: DataFrame, keys: list[str], resamples: int, seed: int) -> DataFrame:
    """``(keys, r, roc_auc, pr_auc)``."""
    cells = scores.groupBy(*keys, "y", "proba").agg(F.count(F.lit(1)).alias("cnt"))
    rows = cell_rows(cells, _group(keys), F.col("proba"), [*[F.col(k) for k in keys], F.col("y"), score_key(F.col("proba"))], seed)
    return _back(resampled_ranking(rows, resamples).where("r >= 0"), scores, keys)


def resampled_label_metrics(scores: DataFrame, keys: list[str], resamples: int, seed: int, threshold: float = 0.5) -> DataFrame:
    """``(keys, r, label metrics)`` from the four confusion cells of every group."""
    ship_package(scores.sparkSession)
    names = ("tp", "fp", "tn", "fn")
    conf = confusion(scores, keys, threshold)
    words = [hash_word(F.lit(seed), *[F.col(k) for k in keys], F.lit(n), word=w).alias(f"{n}_{w}") for n in names for w in (0, 1)]
    schema = pa.schema([("gid", pa.string()), ("r", pa.int32()), *[(n, pa.int64()) for n in names]])

    def drawn(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array([row[n] for n in names])
                w = poisson(np.maximum(counts, 1), *[np.array([row[f"{n}_{i}"] for n in names]) for i in (0, 1)], resamples) * (counts > 0)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([row["gid"]] * resamples, pa.string()), pa.array(np.arange(resamples), pa.int32()), *[pa.array(x) for x in w]], schema=schema)

    long = conf.select(_group(keys).alias("gid"), *names, *words).mapInArrow(drawn, "gid string, r int, " + ", ".join(f"{n} long" for n in names))
    tp, fp, tn, fn = (F.col(n) for n in names)
    out = long.filter((tp + fn > 0) & (tn + fp > 0)).select("gid", "r", *[c.alias(m) for m, c in label_ratios(tp, fp, tn, fn).items()])
    return _back(out, scores, keys)


def interval(values: DataFrame, keys: list[str], metrics: list[str], confidence: float = 0.95) -> DataFrame:
    """Percentile interval per metric: ``(keys, metric, ci_low, ci_high, n_resamples)``.

    The exact percentile sees one value per resample.
    """
    alpha = (1 - confidence) / 2
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return values.select(*keys, F.inline(pairs)).groupBy(*keys, "metric").agg(
        F.percentile("value", F.lit(alpha)).alias("ci_low"), F.percentile("value", F.lit(1 - alpha)).alias("ci_high"),
        F.count("value").alias("n_resamples"),
    )


def bootstrap_ci(scores: DataFrame, keys: list[str], metric: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Point estimate and percentile interval of one metric per group."""
    return metric_ci_table(scores, keys, resamples, seed, [metric])


def metric_ci_table(
    scores: DataFrame, keys: list[str], resamples: int = 2000, seed: int = 42,
    metrics: tuple[str, ...] = (*RANK_METRICS, *LABEL_METRICS),
) -> DataFrame:
    """All metrics of all groups with intervals: ``(keys, metric, point, ci_low, ci_high, n_resamples, method)``."""
    parts = []
    rank = [m for m in metrics if m in RANK_METRICS]
    label = [m for m in metrics if m in LABEL_METRICS]
    if rank:
        ci = interval(resampled_rank_metrics(scores, keys, resamples, seed), keys, rank)
        parts.append(join_groups(metrics_long(ranking_metrics(scores, keys), keys, rank), ci, keys, ["metric"]))
    if label:
        ci = interval(resampled_label_metrics(scores, keys, resamples, seed), keys, label)
        parts.append(join_groups(metrics_long(label_metrics(scores, keys), keys, label), ci, keys, ["metric"]))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumnRenamed("value", "point").withColumn("method", F.lit(METHOD))


def paired_draws(pairs: DataFrame, keys: list[str], resamples: int, seed: int) -> DataFrame:
    """``(keys, r, roc_auc, pr_auc)``: metric(a) - metric(b) in every resample; r = -1 is the observed table.

    One weight per ``(y, score a, score b)`` group serves both models.
    """
    cells = pairs.groupBy(*keys, "y", "pa", "pb").agg(F.sum(pair_weight(pairs)).alias("cnt"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(p).cast("double").alias("score")) for s, p in (("a", "pa"), ("b", "pb"))])
    cells = cells.select(*keys, "y", "cnt", score_key(F.col("pa")).alias("ka"), score_key(F.col("pb")).alias("kb"), F.inline(sides))
    rows = cell_rows(cells, _group(keys, F.col("side")), F.col("score"), [*[F.col(k) for k in keys], F.col("y"), F.col("ka"), F.col("kb")], seed)
    ranked = _back(resampled_ranking(rows, resamples), pairs, keys, "side string")
    diff = lambda m: F.sum(F.when(F.col("side") == "a", F.col(m)).otherwise(-F.col(m)))
    return ranked.groupBy(*keys, "r").agg(diff("roc_auc").alias("roc_auc"), diff("pr_auc").alias("pr_auc"))


def paired_bootstrap(pairs: DataFrame, keys: list[str], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Paired interval of metric(a) - metric(b): ``(keys, metric, delta, ci, includes_zero, p_value)``.

    p is twice the share of resamples on the other side of zero, at most 1.
    """
    per_r = paired_draws(pairs, keys, resamples, seed)
    metric = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("d")) for m in ("roc_auc", "pr_auc")])
    long = per_r.select(*keys, "r", F.inline(metric))
    d, drawn_r = F.col("d"), F.col("r") >= 0
    share = lambda cond: F.avg(F.when(drawn_r, cond.cast("double")))
    agg = long.groupBy(*keys, "metric").agg(
        F.max(F.when(~drawn_r, d)).alias("delta"),
        F.percentile(F.when(drawn_r, d), F.lit(0.025)).alias("ci_low"),
        F.percentile(F.when(drawn_r, d), F.lit(0.975)).alias("ci_high"),
        share(d <= 0).alias("_le"), share(d >= 0).alias("_ge"),
        F.count(F.when(drawn_r, d)).alias("n_resamples"),
    )
    p = F.least(F.lit(1.0), F.lit(2.0) * F.when(F.col("delta") >= 0, F.col("_le")).otherwise(F.col("_ge")))
    return agg.withColumn("includes_zero", (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)).withColumn("p_value", p).drop("_le", "_ge")


def compare_all(scores: DataFrame, ref: str, keys: list[str], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Every model against a reference in every group: DeLong, both bootstraps, McNemar, one Holm family.

    Models that do not score the same ids, once each and with equal labels, stop the job: no pair is left out in silence.
    """
    assert_runs_consistent(scores.withColumn("_pair", F.struct(*keys, "id")), run="model", id_col="_pair")
    by = [*keys, "model"]
    # every test works on counts of identical pairs: the pairs are joined and counted once
    pairs = stored(pair_cells(pair_with_reference(scores, ref, keys), by))
    boot = paired_bootstrap(pairs, by, resamples, seed)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = boot.groupBy(*by).agg(
        pick("roc_auc", "delta").alias("boot_delta"), pick("roc_auc", "ci_low").alias("boot_ci_low"),
        pick("roc_auc", "ci_high").alias("boot_ci_high"), pick("roc_auc", "p_value").alias("boot_p"),
        pick("pr_auc", "delta").alias("boot_pr_delta"), pick("pr_auc", "p_value").alias("boot_pr_p"),
    )
    mc = mcnemar(pairs, by).select(*by, F.col("p_value").alias("mcnemar_p"), "n_discordant")
    out = join_groups(join_groups(delong(pairs, by), wide, by), mc, by)
    out = holm(out, "p_value", by, out="p_holm", flag="significant")
    out = holm(out, "boot_p", by, out="boot_p_holm", flag="boot_significant")
    return out.withColumn("verdict", verdict(F.col("p_holm"), F.col("delta")))
