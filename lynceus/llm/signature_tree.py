"""Signature trees: nodes hold the OR of their members' token bitmaps and the range of their set sizes."""

from __future__ import annotations

import numpy as np

LEAF, FAN = 8, 4
NARROW, WIDE = 64, 1 << 16


def width_of(n: int) -> int:
    """Bits of a set's bitmap: the power of two that is at least twice its size, within bounds."""
    return int(min(max(1 << (2 * n - 1).bit_length(), NARROW), WIDE))


def bitmap(tokens: np.ndarray) -> bytes:
    """Bit (hash mod width) of every token; the lower half ORed with the upper is the bitmap of half the width."""
    width = width_of(len(tokens))
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) narrowed to ``words`` words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def can_link(a: np.ndarray, b: np.ndarray, slack_a, slack_b, low_a, high_a, low_b, high_b, num: int, den: int) -> np.ndarray:
    """Whether a set under node a and one under node b can reach Jaccard num/den.

    A set shares at most the bits both nodes have, plus its tokens that fell on taken bits (slack).
    """
    common = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(common + slack_a, common + slack_b), np.minimum(high_a, high_b))
    fits = (high_b * den >= num * low_a) & (high_a * den >= num * low_b)
    return fits & ((num + den) * most >= num * (low_a + low_b))


class Tree:
    """Levels from the members (0) to the root, over members of one bitmap width in order of size and bits."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, names: np.ndarray):
        order = np.lexsort((maps[:, 0], sizes))
        maps, sizes, self.names = maps[order], sizes[order].astype(np.int64), names[order]
        slack = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, slack, sizes, sizes)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            m, s, lo, hi = self.levels[-1]
            at = np.arange(0, len(m), fan)
            self.levels.append((
                np.bitwise_or.reduceat(m, at, axis=0), np.maximum.reduceat(s, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
            fan = FAN

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, child) of all children; a member is its own child."""
        if level == 0:
            return np.arange(len(nodes)), nodes
        fan, below = (LEAF if level == 1 else FAN), len(self.levels[level - 1][0])
        child = nodes[:, None] * fan + np.arange(fan)
        at, k = np.nonzero(child < below)
        return at, child[at, k]


def dual_traversal(a: Tree, b: Tree, num: int = 80, den: int = 100, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Names (of a, of b) of the member pairs that no bound excludes; with a is b every pair once."""
    words = min(a.levels[0][0].shape[1], b.levels[0][0].shape[1])
    la = [(folded(m, words), *rest) for m, *rest in a.levels]
    lb = la if a is b else [(folded(m, words), *rest) for m, *rest in b.levels]
    if words != a.levels[0][0].shape[1]:  # narrower maps have fewer bits, so more slack
        la = [(m, s + (np.bitwise_count(w[0]).sum(axis=1, dtype=np.int64) - np.bitwise_count(m).sum(axis=1, dtype=np.int64)) if k == 0 else s, lo, hi)
              for k, ((m, s, lo, hi), w) in enumerate(zip(la, a.levels))]
        la = _lifted(la)
    if lb is not la and words != b.levels[0][0].shape[1]:
        lb = [(m, s + (np.bitwise_count(w[0]).sum(axis=1, dtype=np.int64) - np.bitwise_count(m).sum(axis=1, dtype=np.int64)) if k == 0 else s, lo, hi)
              for k, ((m, s, lo, hi), w) in enumerate(zip(lb, b.levels))]
        lb = _lifted(lb)
    stack = [(len(la) - 1, len(lb) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    left, right = [], []
    while stack:
        ka, kb, na, nb = stack.pop()
        ok = np.zeros(len(na), bool)
        for i in range(0, len(na), chunk):
            x, y = na[i : i + chunk], nb[i : i + chunk]
            (ma, sa, loa, hia), (mb, sb, lob, hib) = la[ka], lb[kb]
            ok[i : i + chunk] = can_link(ma[x], mb[y], sa[x], sb[y], loa[x], hia[x], lob[y], hib[y], num, den)
        na, nb = na[ok], nb[ok]
        if not len(na):
            continue
        if ka == kb == 0:
            left.append(a.names[na])
            right.append(b.names[nb])
            continue
        for i in range(0, len(na), chunk):
            x, y = na[i : i + chunk], nb[i : i + chunk]
            if ka >= kb:
                at, x = a.children(ka, x)
                y = y[at]
            da = ka - 1 if ka >= kb else ka
            if kb >= ka or a is b:
                at, y = b.children(kb, y)
                x = x[at]
            db = kb - 1 if kb >= ka or a is b else kb
            if a is b:
                keep = (x < y) if da == 0 else (x <= y)
                x, y = x[keep], y[keep]
            stack.append((da, db, x, y))
    empty = np.zeros(0, a.names.dtype)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _lifted(levels: list) -> list:
    """Slack of inner nodes again from the members' slack."""
    out, slack, fan = [levels[0]], levels[0][1], LEAF
    for m, _, lo, hi in levels[1:]:
        slack = np.maximum.reduceat(slack, np.arange(0, len(slack), fan))
        out.append((m, slack, lo, hi))
        fan = FAN
    return out


def forest(maps: list[bytes], sizes: np.ndarray, names: np.ndarray) -> dict[int, Tree]:
    """A tree for each bitmap width, in 64-bit words."""
    width = np.array([len(m) // 8 for m in maps])
    return {
        int(w): Tree(np.frombuffer(b"".join(maps[i] for i in np.flatnonzero(width == w)), np.uint64).reshape(-1, int(w)), sizes[width == w], names[width == w])
        for w in np.unique(width)}


def pairs_between(a: dict[int, Tree], b: dict[int, Tree] | None = None, num: int = 80, den: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs within one forest, or between two; widths further apart than a factor of two cannot link."""
    left, right = [], []
    for w, x in a.items():
        for v in (w // 2, w, 2 * w):
            y = (b or a).get(v)
            if y is None or (b is None and v < w):
                continue
            p, q = dual_traversal(x, y, num, den)
            left.append(p)
            right.append(q)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))
