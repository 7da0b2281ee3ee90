"""Near-duplicate vectors by NN-descent.

The neighbour graph begins with neighbours in random-hyperplane orders and is refined by joins of every vector's
neighbours, and theirs to it, with each other. Edges at or above the threshold make components. Lists full of links are
saturated: they are enlarged to the whole component and every link in it is counted, block by block. An audit compares a
fresh sample with all rows; while its recall, a mean over vectors, is too low, the links it found, more orders and longer
lists are added. Labels in which vectors still miss links after ATTEMPTS are compared as a whole, block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lynceus.llm.base import components, ready, stored

BITS, ORDERS, WINDOW = 24, 8, 64
NEIGHBOURS, ROUNDS, ATTEMPTS = 8, 4, 3
#: Members of a component compared in one task, and vectors of an audit (512 bytes each).
BLOCK, AUDIT = 1024, 512
RECALL = 0.999


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vector.isNotNull() & ~bad & (norm > 0)


def unit(column, dtype: str) -> np.ndarray:
    """Unit vectors, in double precision, of packed ones."""
    x = np.frombuffer(b"".join(v.as_py() for v in column), dtype).reshape(len(column), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed_vectors(rows: DataFrame) -> tuple[DataFrame, str]:
    """(rid, id, grp, v) of comparable rows, stored; v holds the components as given. grp: label and dimension."""
    ready(rows.sparkSession)
    dtype = "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches):
        for batch in batches:
            v = batch.column(3)
            width = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            ends = np.cumsum(width)
            body = [flat[e - w : e].tobytes() for e, w in zip(ends, width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(body, pa.binary())], ["rid", "id", "grp", "v"])

    kind = rows.schema["id"].dataType.simpleString()
    grp = F.concat_ws("|", F.col("label").cast("string"), F.size("v").cast("string"))
    numbered = stored(
        rows.where(F.col("label").isNotNull() & valid(F.col("v"))).select(F.monotonically_increasing_id().alias("rid"), "id", grp.alias("grp"), "v"), "numbered")
    return stored(numbered.mapInArrow(run, f"rid long, id {kind}, grp string, v binary"), "vectors"), dtype


def top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct neighbours."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], sims[first]


def ordered_neighbours(vectors: DataFrame, dtype: str, orders: range, k: int, threshold: float) -> DataFrame:
    """(rid, near, sims): best neighbours within overlapping windows of each random-hyperplane order."""

    def code(batches):
        for batch in batches:
            groups = batch.column("grp").to_pylist()
            width = np.array([len(x.as_py()) for x in batch.column("v")])
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                part = batch.take(pa.array(at))
                x = unit(part.column("v"), dtype)
                for o in orders:
                    planes = np.random.default_rng(1000 + o).standard_normal((x.shape[1], BITS))
                    bits = (x @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{o}|{groups[i]}" for i in at]), pa.array(bits), part.column("rid"), part.column("v")], ["line", "code", "rid", "v"])

    def windows(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table, last: bool):
            """Windows of one line; returns how many of its rows are done."""
            n = len(table)
            if n < 2:
                return None, n
            x, rid = unit(table["v"].combine_chunks(), dtype), table["rid"].to_numpy()
            out_r, out_n, out_s = [], [], []
            half = WINDOW // 2
            starts = list(range(0, max(n - half, 1), half))
            for s in starts:
                e = min(s + WINDOW, n)
                g = x[s:e] @ x[s:e].T
                np.fill_diagonal(g, -2)
                m = min(k, e - s - 1)
                best = np.argpartition(-g, m - 1, axis=1)[:, :m]
                for i in range(e - s):
                    near = best[i]
                    nxt = i + 1  # keeps runs of alike vectors in one piece
                    if nxt < e - s and g[i, nxt] >= threshold and nxt not in near:
                        near = np.append(near, nxt)
                    out_r.append(rid[s + i])
                    out_n.append(rid[s + near].tobytes())
                    out_s.append(g[i, near].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(out_r, pa.int64()), pa.array(out_n, pa.binary()), pa.array(out_s, pa.binary())], ["rid", "near", "sims"]), n

        def lines(table: pa.Table):
            line = np.array(table["line"].to_pylist())
            cut = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            return [(a, b) for a, b in zip(cut, np.append(cut[1:], len(line)))]

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            parts = lines(table)
            for a, b in parts[:-1]:
                out, _ = flush(table.slice(a, b - a), True)
                if out is not None:
                    yield out
            a, b = parts[-1]
            tail = table.slice(a, b - a)
            if len(tail) > 4 * WINDOW:  # a long line: what lies well behind its last windows is done
                out, _ = flush(tail, False)
                yield out
                tail = tail.slice(len(tail) - WINDOW // 2)
            held = tail.combine_chunks().to_batches()
        if held:
            out, _ = flush(pa.Table.from_batches(held), True)
            if out is not None:
                yield out

    lines = vectors.select("rid", "grp", "v").mapInArrow(code, "line string, code long, rid long, v binary")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartitionByRange(n, "line", "code", "rid").sortWithinPartitions("line", "code", "rid")
    return lines.mapInArrow(windows, "rid long, near binary, sims binary")


def merged(parts: DataFrame, k: int) -> DataFrame:
    """One list of the ``k`` best neighbours per vector."""

    def run(batches):
        for batch in batches:
            near, sims = [], []
            for ns, ss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = top(np.frombuffer(b"".join(ns), np.int64), np.frombuffer(b"".join(ss), np.float64), k)
                near.append(a.tobytes())
                sims.append(b.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.binary()), pa.array(sims, pa.binary())], ["rid", "near", "sims"])

    lists = parts.groupBy("rid").agg(F.collect_list("near").alias("near"), F.collect_list("sims").alias("sims"))
    return lists.mapInArrow(run, "rid long, near binary, sims binary")


def edges_of(lists: DataFrame, least: float = -2.0, both: bool = False) -> DataFrame:
    """(a, b) of the list entries with cosine >= ``least``."""

    def run(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r, ns, ss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                near = np.frombuffer(ns.as_py(), np.int64)[np.frombuffer(ss.as_py(), np.float64) >= least]
                a.append(np.full(len(near), r))
                b.append(near)
            x, y = np.concatenate(a), np.concatenate(b)
            if both:
                x, y = np.concatenate((x, y)), np.concatenate((y, x))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def refined(lists: DataFrame, vectors: DataFrame, dtype: str, k: int) -> DataFrame:
    """One round: the neighbours of each vector, forward and a hashed choice of as many backward, meet each other."""
    near = edges_of(lists, both=True).distinct()
    spread = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("a", "b").alias("h"), F.col("b")))), 1, 2 * k).alias("m"))
    members = spread.select("a", F.explode("m.b").alias("member")).union(spread.select("a", F.col("a").alias("member")))
    met = members.join(vectors.select(F.col("rid").alias("member"), "v"), "member").groupBy("a").agg(
        F.collect_list("member").alias("ids"), F.collect_list("v").alias("vs"))

    def run(batches):
        for batch in batches:
            rid, near, sims = [], [], []
            for ids, vs in zip(batch.column(1).to_pylist(), batch.column(2)):
                if len(ids) < 2:
                    continue
                x, ids = unit(vs.values, dtype), np.array(ids)
                g = x @ x.T
                np.fill_diagonal(g, -2)
                m = min(k, len(ids) - 1)
                best = np.argpartition(-g, m - 1, axis=1)[:, :m]
                rid += list(ids)
                near += [ids[b].tobytes() for b in best]
                sims += [g[i, b].tobytes() for i, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(near, pa.binary()), pa.array(sims, pa.binary())], ["rid", "near", "sims"])

    found = met.mapInArrow(run, "rid long, near binary, sims binary")
    return merged(found.union(lists), k)


def in_blocks(vectors: DataFrame, label: DataFrame) -> DataFrame:
    """(component, i, j, ids, second, vs): the vectors of every pair of blocks of each component of (node, component)."""
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    rows = label.join(sizes, "component").withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), F.col("node").alias("rid"))
    # small components share tasks: rows of many meet in one batch, told apart by their component
    return rows.join(vectors.select("rid", "v"), "rid").groupBy("component", "i", "j").agg(
        F.collect_list("rid").alias("ids"), F.collect_list("second").alias("second"), F.collect_list("v").alias("vs"))


def link_counts(vectors: DataFrame, dtype: str, label: DataFrame, threshold: float) -> DataFrame:
    """(rid, n_links): links of every vector of a component to all its other members, counted by pairs of blocks."""

    def run(batches):
        for batch in batches:
            out_r, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, ids, second, vs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                x, ids, second = unit(vs.values, dtype), np.array(ids), np.array(second)
                if i == j:
                    hits = (x @ x.T >= threshold)
                    np.fill_diagonal(hits, False)
                    out_r.append(ids)
                    out_n.append(hits.sum(axis=1))
                else:
                    hits = x[~second] @ x[second].T >= threshold
                    out_r += [ids[~second], ids[second]]
                    out_n += [hits.sum(axis=1), hits.sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_r)), pa.array(np.concatenate(out_n))], ["rid", "n"])

    return in_blocks(vectors, label).mapInArrow(run, "rid long, n long").groupBy("rid").agg(F.sum("n").alias("n_links"))


def exact_links(vectors: DataFrame, dtype: str, groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs that join whatever links join within each of the ``groups`` (grp), all pairs compared.

    A task returns at most one pair for each of its vectors: the vector and the smallest that links reach in its blocks.
    """
    label = vectors.join(F.broadcast(groups), "grp", "left_semi").select(F.col("rid").alias("node"), F.col("grp").alias("component"))

    def run(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for ids, vs in zip(batch.column(3), batch.column(5)):
                ids = ids.values.to_numpy()
                order = np.argsort(ids)
                ids, x = ids[order], unit(vs.values, dtype)[order]
                hits, least = x @ x.T >= threshold, np.arange(len(ids))
                np.fill_diagonal(hits, True)
                while True:
                    now = np.where(hits, least, len(ids)).min(axis=1)
                    now = now[now]
                    if (now == least).all():
                        break
                    least = now
                moved = least < np.arange(len(ids))
                a.append(ids[moved])
                b.append(ids[least[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return in_blocks(vectors, label).mapInArrow(run, "a long, b long").distinct()


def compared(vectors: DataFrame, dtype: str, chosen: list, threshold: float, pairs: bool) -> DataFrame:
    """True links of the ``chosen`` rows (rid, grp, v) to all rows: the ``pairs`` (a, b), or (a, b) with b their number in a batch."""
    asked: dict = {}
    for r in chosen:
        asked.setdefault(r.grp, []).append((r.rid, bytes(r.v)))
    shared = vectors.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            groups = np.array(batch.column("grp").to_pylist())
            for g in np.unique(groups):
                if g in shared.value:
                    at = np.flatnonzero(groups == g)
                    part = batch.take(pa.array(at))
                    q = np.array([r for r, _ in shared.value[g]])
                    x = np.frombuffer(b"".join(v for _, v in shared.value[g]), dtype).reshape(len(q), -1).astype(np.float64)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    rid = part.column("rid").to_numpy()
                    hits = (x @ unit(part.column("v"), dtype).T >= threshold) & (q[:, None] != rid)
                    if pairs:
                        i, j = np.nonzero(hits)
                        a.append(q[i])
                        b.append(rid[j])
                    else:
                        a.append(q)
                        b.append(hits.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return vectors.select("rid", "grp", "v").mapInArrow(run, "a long, b long")


def audited(vectors: DataFrame, dtype: str, label: DataFrame, counts: DataFrame, threshold: float, sample: int, salt: int) -> tuple[float, list]:
    """(recall, rows of the sample that miss links). Recall is the mean, over the sampled vectors that have true links, of
    the share of them that was counted.

    Half the sample has links, if so many do: a quarter is one vector of a component each, so that a component counts once
    whatever its size, and the rest any linked vectors. The other half has none. ``salt`` draws another sample.
    """
    light = vectors.join(counts, "rid", "left").select("rid", "grp", F.coalesce("n_links", F.lit(0)).alias("n"), "v")
    one = label.groupBy("component").agg(F.min(F.struct(F.xxhash64(F.lit(salt), "node").alias("h"), F.col("node"))).alias("x"))
    one = one.select(F.col("x.node").alias("rid")).orderBy(F.xxhash64(F.lit(salt + 1), "rid")).limit(sample // 4)
    chosen = {r.rid: r for r in light.join(F.broadcast(one), "rid", "left_semi").collect()}
    for kind, size in (("n > 0", sample // 2 - len(chosen)), ("n = 0", sample // 2)):
        chosen |= {r.rid: r for r in light.where(kind).orderBy(F.xxhash64(F.lit(salt), "rid")).limit(size).collect()}
    true = dict(compared(vectors, dtype, list(chosen.values()), threshold, pairs=False).groupBy("a").agg(F.sum("b")).collect())
    share = {k: chosen[k].n / n for k, n in true.items() if n}
    return (sum(share.values()) / len(share) if share else 1.0), [chosen[k] for k, s in share.items() if s < 1]


def near_vectors(rows: DataFrame, threshold: float = 0.98, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept, recall) of every row.

    Two rows link when their labels are equal and not null, their vectors have one length and cosine >= ``threshold``,
    computed in double precision. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. n_links counts linked rows other than the row itself, component_id is the smallest id links reach, kept says
    that it is the row's own. recall is the last audit's, the same on every row, and at least RECALL. Rows that repeat an id count as rows of their
    own; a null id is never a component's id unless it is alone. Other columns are not read; an empty table gives an
    empty result.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    vectors, dtype = packed_vectors(base)
    parts, begun = None, 0
    extra = None

    def settled(links: DataFrame):
        """Labels, counts, and the audit of a sample of its own."""
        nonlocal audits
        audits += 1
        links = links if extra is None else links.union(extra)
        label = stored(components(links), "labels")
        counts = stored(link_counts(vectors, dtype, label, threshold), "counts")
        return label, counts, *audited(vectors, dtype, label, counts, threshold, AUDIT, 2 * audits)

    def more(found: DataFrame) -> DataFrame:
        return stored(found if extra is None else extra.union(found), "audit")

    audits = 0
    for attempt in range(ATTEMPTS):
        fresh = ordered_neighbours(vectors, dtype, range(begun, begun + ORDERS), k, threshold)
        begun += ORDERS
        lists = stored(merged(fresh if parts is None else fresh.union(parts), k), "lists")
        runs = stored(edges_of(fresh, threshold).distinct(), "runs")
        known = edges_of(lists, threshold).distinct().count()
        for _ in range(ROUNDS):
            lists = stored(refined(lists, vectors, dtype, k), "lists")
            now = edges_of(lists, threshold).distinct().count()
            if now == known:
                break
            known = now
        links = edges_of(lists, threshold).union(runs)
        label, counts, recall, missed = settled(links)
        if recall >= RECALL:
            break
        extra = more(compared(vectors, dtype, missed, threshold, pairs=True).union(runs))
        parts, k = lists, 2 * k
    # whole labels: first those with misses, then all
    every = vectors.select("grp").distinct()
    for last in (False, True):
        if recall >= RECALL:
            break
        groups = every if last else vectors.sparkSession.createDataFrame([(g,) for g in {r.grp for r in missed}], "grp string")
        extra = more(exact_links(vectors, dtype, groups, threshold))
        label, counts, recall, missed = settled(links)
    if recall < RECALL:
        raise RuntimeError(f"recall {recall} after comparing all rows")
    named = label.join(vectors.select("rid", "id"), label.node == vectors.rid).groupBy("component").agg(F.min("id").alias("least"))
    found = label.join(named, "component").join(counts, label.node == counts.rid).select("node", "least", "n_links")
    done = vectors.join(found, vectors.rid == found.node, "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    rest = base.where(F.col("label").isNull() | ~F.coalesce(valid(F.col("v")), F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("recall"))
