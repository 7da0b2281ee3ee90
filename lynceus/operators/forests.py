"""Random forests grown over cells: rows that agree in all bins, wherever they lie, with their number by label.

A tree only sees the bins of a row, and the draws of like rows add up: a sum of n Poisson draws of mean 1 is one Poisson draw of
mean n. So the rows are read once, cells are counted over all tasks, and a level of all trees costs one pass over the cells,
whatever the number of rows; where rows hardly agree, cells are as many as rows. Thresholds, gains, subsets of columns per node
and pruning are those of MLlib's RandomForestClassifier; draws and subsets come from other generators, so a forest with draws
is one of the same distribution and not the same forest. Draws hang on the seed and the cells, not on where the rows lie.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, functions as F

from lynceus.operators.boosting import Node, as_tree, binned
from lynceus.operators.staged import Tree
from lynceus.session import ship_package, stored

#: Cells of a block at most; rows whose cells are counted before they are sent on.
BLOCK, COUNTED = 1 << 16, 1 << 19
#: Tasks that share the cells at most: each sends on the sums of all trees of a pass. Bytes of these sums at most.
TASKS, SUMS = 128, 1 << 26
#: Deepest tree that is grown over cells: the sums of a level follow its nodes.
DEEPEST = 10
CELLS = "bins binary, neg long, pos long"
CELLS_ARROW = pa.schema([("bins", pa.binary()), ("neg", pa.int64()), ("pos", pa.int64())])
BLOCKS = "part int, start int, bins binary, neg binary, pos binary"
BLOCKS_ARROW = pa.schema([("part", pa.int32()), ("start", pa.int32()), *[(c, pa.binary()) for c in ("bins", "neg", "pos")]])


@dataclass
class Vote(Node):
    """A node with (rows of label 0, rows of label 1); it predicts the label with more."""

    @property
    def value(self) -> float:
        return float(self.stats[1] > self.stats[0])

    @property
    def rows(self) -> int:
        return int(self.stats.sum())


def _counted(thresholds: list[np.ndarray]):
    """Rows (label, features) as cells with their number by label, counted over some rows of a task."""
    def cells(held: list) -> pa.RecordBatch:
        bins, y = (np.concatenate(v) for v in zip(*held))
        flat = np.ascontiguousarray(bins)
        found, cell = np.unique(flat.view(np.dtype((np.void, flat.dtype.itemsize * flat.shape[1]))).ravel(), return_inverse=True)
        n, pos = np.bincount(cell, minlength=len(found)), np.bincount(cell[y == 1], minlength=len(found))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in found], pa.binary()), pa.array(n - pos), pa.array(pos)], schema=CELLS_ARROW)

    def run(batches):
        held, waiting = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(binned(batch, thresholds))
            waiting += batch.num_rows
            if waiting >= COUNTED:
                yield cells(held)
                held, waiting = [], 0
        if held:
            yield cells(held)

    return run


def _packed(batches):
    """Cells of a task, in order, as blocks."""
    from pyspark import TaskContext

    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            neg, pos = (some.column(i).to_numpy(zero_copy_only=False).tobytes() for i in (1, 2))
            values = [b"".join(some.column(0).to_pylist()), neg, pos]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], schema=BLOCKS_ARROW)
            start += 1


def cell_blocks(rows: DataFrame, thresholds: list[np.ndarray]) -> RDD:
    """Blocks ``(part, start, bins by column, neg, pos)`` of all cells of rows ``(y double, features array)``, stored once."""
    ship_package(rows.sparkSession)
    kind, d = np.min_scalar_type(max(len(t) + 1 for t in thresholds)), len(thresholds)
    cells = stored(rows.mapInArrow(_counted(thresholds), CELLS).groupBy("bins").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    tasks = max(1, min(TASKS, math.ceil(cells.count() / (BLOCK // 4))))
    blocks = stored(cells.repartition(tasks, "bins").sortWithinPartitions("bins").mapInArrow(_packed, BLOCKS))

    def block(r):
        neg, pos = (np.frombuffer(r[c], np.int64) for c in ("neg", "pos"))
        return r["part"], r["start"], np.frombuffer(r["bins"], kind).reshape(len(neg), d), neg, pos

    return blocks.rdd.map(block)


def level_sums(block: tuple, number: int, tree: Tree, some: list[int], sizes: list[int], seed: int, bootstrap: bool) -> np.ndarray:
    """(label, open node, bins of all columns): rows that one tree draws."""
    part, start, bins, neg, pos = block
    weights = (neg, pos)
    if bootstrap:
        draws = np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFFFFFFFFFF, number, part, start]))
        weights = (draws.poisson(neg), draws.poisson(pos))
    k = len(some)
    place = np.full(len(tree.feature), k)
    place[some] = np.arange(k)
    node = place[tree.leaves(bins)]
    parts = []
    for column, size in zip(bins.T, sizes):
        at = node * size + column
        parts.append(np.stack([np.bincount(at, w, (k + 1) * size).reshape(-1, size)[:k] for w in weights]))
    return np.concatenate(parts, axis=2)


def _gini(s: np.ndarray) -> np.ndarray:
    n = s[0] + s[1]
    safe = np.where(n > 0, n, 1.0)
    return np.where(n > 0, 1.0 - (s[0] / safe) ** 2 - (s[1] / safe) ** 2, 0.0)


def best_split(sums: np.ndarray, sizes: list[int], columns: np.ndarray, min_rows: int, min_gain: float):
    """(sums of the node, (gain, column, bin, sums left, sums right) or None); of equal gains the earlier."""
    total, best = sums[:, :sizes[0]].sum(axis=1), None
    impurity, n, at = float(_gini(total)), total.sum(), 0
    for f, size in enumerate(sizes):
        own = sums[:, at:at + size]
        at += size
        if size < 2 or f not in columns or not n:
            continue
        left = np.cumsum(own, axis=1)[:, :-1]
        right = total[:, None] - left
        nl, nr = left.sum(axis=0), right.sum(axis=0)
        gain = impurity - nl / n * _gini(left) - nr / n * _gini(right)
        gain = np.where((nl < min_rows) | (nr < min_rows) | (gain < min_gain), -np.inf, gain)
        s = int(np.argmax(gain))
        if gain[s] > 0 and (best is None or gain[s] > best[0]):
            best = (float(gain[s]), f, s, left[:, s], right[:, s])
    return total, best


def subset_size(strategy: str, d: int) -> int | None:
    """Columns tried per node, or None where the strategy is another."""
    return {"all": d, "sqrt": math.ceil(math.sqrt(d)), "auto": math.ceil(math.sqrt(d)), "log2": max(1, math.ceil(math.log2(d)))}.get(strategy)


def grow_forest(blocks: RDD, sizes: list[int], trees: int, depth: int, subset: int, seed: int, bootstrap: bool = True,
                min_rows: int = 1, min_gain: float = 0.0) -> list[list[Vote]]:
    """All trees, a level of all of them at a time; a pass takes as many trees as their sums leave room for.

    The sums of a tree meet in one task, which picks its splits: the driver gets one split per open node.
    """
    spark = blocks.context
    grown, opened = [[Vote(np.zeros(2), 0.0)] for _ in range(trees)], [[0] for _ in range(trees)]
    for level in range(depth):
        todo = [t for t in range(trees) if opened[t]]
        room = max(1, SUMS // (16 * sum(sizes) * max((len(opened[t]) for t in todo), default=1)))
        for first in range(0, len(todo), room):
            sent = spark.broadcast({t: (as_tree(grown[t], 1.0, level), opened[t]) for t in todo[first:first + room]})  # as large as the model

            def summed(part, sent=sent):
                total: dict[int, np.ndarray] = {}
                for block in part:
                    for t, (tree, some) in sent.value.items():
                        s = level_sums(block, t, tree, some, sizes, seed, bootstrap)
                        total[t] = total[t] + s if t in total else s
                return total.items()

            def splits(one, sent=sent):
                t, sums = one
                tried = lambda node: np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFFFFFFFFFF, t, node, 1 << 40])).permutation(len(sizes))[:subset]
                return t, [best_split(sums[:, i], sizes, tried(node), min_rows, min_gain) for i, node in enumerate(sent.value[t][1])]

            width = max(1, min(spark.defaultParallelism, len(sent.value)))
            for t, found in blocks.mapPartitions(summed).reduceByKey(np.add, width).map(splits).collect():
                opened[t] = _split(grown[t], opened[t], found, level + 1 < depth)
            sent.unpersist()
    return grown


def _split(nodes: list[Vote], some: list[int], found: list, more: bool) -> list[int]:
    """Splits the open nodes of a tree; returns the nodes that are open then."""
    after = []
    for number, (total, best) in zip(some, found):
        node = nodes[number]
        node.stats, node.impurity = total, float(_gini(total))
        if best is None:
            continue
        node.gain, node.feature, node.bin, left, right = best
        node.left, node.right = len(nodes), len(nodes) + 1
        for stats in (left, right):
            child = Vote(stats, float(_gini(stats)))
            if more and child.impurity > np.finfo(float).eps:
                after.append(len(nodes))
            nodes.append(child)
    return after
