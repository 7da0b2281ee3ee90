"""Word shingle sets as sorted 64-bit hashes, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: Bytes of text hashed at once.
PORTION = 1 << 19
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _portions(parts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about PORTION bytes: hashing takes some forty bytes of memory for each."""
    at = size = 0
    for i, p in enumerate(parts):
        size += len(p)
        if size >= PORTION:
            yield parts[at : i + 1]
            at, size = i + 1, 0
    if at < len(parts) or not parts:
        yield parts[at:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text); A-Z are lower-cased, words end at space, tab and line breaks."""
    found = [_word_hashes(p) for p in _portions([t.encode("utf-8", "replace") for t in texts])]
    return np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])


def _word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate(([False], inside)).astype(np.int8), append=0)
    begin = np.flatnonzero(edge[:-1] == 1)
    end = np.flatnonzero(edge[:-1] == -1)
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), dtype=np.uint64)
        before = np.where(begin > 0, total[begin - 1], np.uint64(0))
        raw = (total[end - 1] - before) * _powers(_INVERSE, len(data))[begin]
        hashes = mix(raw + (end - begin).astype(np.uint64) * _STEP)
    ends = np.cumsum([len(p) + 1 for p in parts])
    upto = np.searchsorted(begin, ends)
    return hashes, np.diff(np.concatenate(([0], upto)))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, set sizes): the sorted distinct shingles of each text, one text after the other.

    A text of fewer words than a shingle has its whole sequence as the one element, a text without words none.
    """
    words, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        state = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
        for i in range(SHINGLE):
            state = mix(state * _STEP + words[i : i + len(state)])
        owner = np.repeat(np.arange(len(texts)), counts)
        whole = owner[: len(state)] == owner[SHINGLE - 1 :] if len(state) else np.zeros(0, bool)
        tokens, of = [state[whole]], [owner[: len(state)][whole]]
        for k in range(1, SHINGLE):
            short = np.flatnonzero(counts == k)
            s = np.full(len(short), k, np.uint64)
            for i in range(k):
                s = mix(s * _STEP + words[starts[short] + i])
            tokens.append(s)
            of.append(short)
    token, doc = np.concatenate(tokens), np.concatenate(of)
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    return token[new], np.bincount(doc[new], minlength=len(texts))


def digests(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; 0 for an empty one."""
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        out = []
        for salt in (np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5)):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ salt), dtype=np.uint64)))
            out.append(np.where(sizes > 0, mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)), np.uint64(0)))
    return out[0], out[1]
