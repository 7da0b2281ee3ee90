"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary is compiled, on demand, into a deterministic transducer over bytes. A state is what decides all
later merges: the longest suffix read that some token can still extend, with the last token and the relative count at
each of its positions. Every transition is annotated with the change of the token count it brings; the last byte of a
word has transitions of its own, which emit the rest of the word's count and return to the start state.

A run of bytes is cut into chunks that advance side by side, one table lookup per chunk and step. The map of a chunk
that holds a word end does not depend on its entry state, so maps compose by an associative rule (the later reset wins)
and a prefix scan gives every chunk its true entry state; only the bytes before a chunk's first word end run again.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lynceus.llm.base import ready, text_slices

#: Fixed values of the vocabulary format: characters that stand for bytes, the word-end suffix, white space, contractions.
PRINTABLE = (range(33, 127), range(161, 173), range(174, 256))
WORD_END = "</w>"
SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

SPACE, LETTER, NUMBER, OTHER = range(4)
UNSEEN = np.int32(-1)


def byte_of_char() -> dict[str, int]:
    own = {b for r in PRINTABLE for b in r}
    table = {chr(b): b for b in own}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class CountTransducer:
    """Transducer of one byte-level BPE vocabulary with word ends.

    Once its table holds ``cells`` entries it is emptied before the next slice and compiled again from the text that
    follows, as lazy automata do: memory is bounded by ``cells`` and one slice.
    """

    def __init__(self, path: str, cells: int = 1 << 25, chunk: int = 512):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_of_char()
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("not a byte-pair vocabulary with word ends")
        self.specials = [t["content"] for t in spec["added_tokens"]]

        def symbols(token: str) -> str:
            last = token.endswith(WORD_END) and token != WORD_END
            out = "".join(chr(chars[c]) for c in (token[: -len(WORD_END)] if last else token))
            return out[:-1] + chr(256 + ord(out[-1])) if last else out

        special = set(self.specials)
        self.tokens = {symbols(t) for t in model["vocab"] if t not in special}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(merges)}
        self.open = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            group = unicodedata.category(chr(cp))[0]
            if group in "LN":
                self.kinds[cp] = LETTER if group == "L" else NUMBER
        self.kinds[list(SPACES)] = SPACE
        self.cells, self.chunk, self.width = cells, chunk, 64
        self._empty()

    # ---- compilation ------------------------------------------------------------------------------

    def _empty(self) -> None:
        self.column = np.full(256, -1, np.int32)
        self.bytes: list[int] = []
        self.known: dict = {}
        self.states: list = []
        self.fits: dict = {}
        self._allocate(1 << 10)
        self._state(("", ((None, 0),)))

    def _allocate(self, rows: int) -> None:
        old = getattr(self, "target", None) if self.states else None
        target = np.full((rows, 2, self.width), UNSEEN, np.int32)
        emit = np.zeros((rows, 2, self.width), np.int8)
        if old is not None:
            n, w = len(self.states), min(old.shape[2], self.width)
            target[:n, :, :w], emit[:n, :, :w] = old[:n, :, :w], self.emit[:n, :, :w]
        self.target, self.emit = target, emit

    def _state(self, key) -> int:
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.states)
            if at == len(self.target):
                self._allocate(at + at // 2)
            self.states.append(key)
        return at

    def merged(self, text: str) -> list[str]:
        """Plain byte-pair merging, for the short strings that decide whether two tokens can be neighbours."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[best] == 1 << 60:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fit(self, left: str | None, right: str) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            found = self.fits[key] = self.merged((left or "") + right) == ([left, right] if left else [right])
        return found

    def _last_token(self, state, symbol: str) -> tuple[str, str, int]:
        context, profile = state
        read = context + symbol
        for i in range(len(read)):
            token = read[i:]
            if profile[i] is None:  # no token can begin here
                continue
            left, count = profile[i]
            if token in self.tokens and self._fit(None, token) and self._fit(left, token):
                return read, token, count + 1
        raise ValueError("the vocabulary does not cover all bytes")

    def _compile(self, at: int, last: bool, column: int) -> None:
        state, byte = self.states[at], self.bytes[column]
        if last:
            to, count = 0, self._last_token(state, chr(256 + byte))[2]
        else:
            read, token, count = self._last_token(state, chr(byte))
            i = 0
            while i < len(read) and read[i:] not in self.open:
                i += 1
            kept = ((p[0], p[1] - count) if p and read[j:] in self.open else None for j, p in enumerate(state[1][i:], i))
            to = self._state((read[i:], (*kept, (token, 0))))
        self.target[at, int(last), column] = to
        self.emit[at, int(last), column] = count

    def _columns(self, data: np.ndarray) -> None:
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[b] < 0:
                if len(self.bytes) == self.width:
                    self.width = min(256, self.width + 8)
                    self._allocate(len(self.target))
                self.column[b] = len(self.bytes)
                self.bytes.append(int(b))

    # ---- text to words ----------------------------------------------------------------------------

    def _normal(self, text: str) -> tuple[str, int]:
        """Normalised text and the number of special strings in it."""
        found = 0
        if "<|" in text:
            for s in self.specials:
                found += text.count(s)
                text = text.replace(s, " ")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text.encode("utf-8", "replace").decode("utf-8")).replace("Σ", "σ")
        return text.lower(), found

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of all words, a flag on each word's last byte, and the byte's place in the text."""
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        cps = data if len(data) == len(text) else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kinds[cps]
        before = np.concatenate(([SPACE], kind[:-1])).astype(np.uint8)
        start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        quote = np.flatnonzero((cps == ord("'")) & (before != OTHER))
        quote = quote[quote + 1 < len(cps)]
        quote = quote[kind[quote + 1] == LETTER]
        if len(quote):
            first = cps[quote + 1]
            second = np.where(quote + 2 < len(cps), cps[np.minimum(quote + 2, len(cps) - 1)], 0)
            size = 2 * np.isin(first, [ord(c) for c in ONE_LETTER])
            for a, b in TWO_LETTERS:
                size = np.where((first == ord(a)) & (second == ord(b)), 3, size)
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            after = quote + size
            after = after[after < len(cps)]
            start[after] |= kind[after] == LETTER
        filled = kind != SPACE
        last = filled & np.concatenate((start[1:] | ~filled[1:], [True]))
        if cps is not data:
            width = (1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)).astype(np.int64)
            end = np.cumsum(width) - 1
            filled = np.repeat(filled, width)
            flag = np.zeros(len(data), bool)
            flag[end[last]] = True
            last = flag
        place = np.flatnonzero(filled)
        return data[place], last[place], place

    # ---- execution --------------------------------------------------------------------------------

    def _advance(self, state: np.ndarray, columns: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = (state * 2 + last) * self.width + columns
        to = self.target.reshape(-1)[cell]
        if to.min(initial=0) < 0:
            for c in np.unique(cell[to < 0]):
                at, rest = divmod(int(c), 2 * self.width)
                self._compile(at, *divmod(rest, self.width))
            to = self.target.reshape(-1)[cell]
        return to, self.emit.reshape(-1)[cell]

    def emitted(self, data: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Change of the token count at each byte of a run of whole words."""
        n, size = len(data), self.chunk
        if n == 0:
            return np.zeros(0, np.int8)
        if len(self.states) * 2 * self.width > self.cells:
            self._empty()
        self._columns(data)
        k = -(-n // size)
        pad = k * size - n
        columns = np.pad(self.column[data], (0, pad)).reshape(k, size).T.copy()
        flags = np.pad(last, (0, pad)).reshape(k, size).T.astype(np.int64)
        state, out = np.zeros(k, np.int64), np.zeros((size, k), np.int8)
        for t in range(size):  # every chunk as if it began at a word: right from its first word end on
            live = k - (t >= size - pad and pad > 0)
            state[:live], out[t, :live] = self._advance(state[:live], columns[t, :live], flags[t, :live])
        reset = flags.any(axis=0)
        head = np.where(reset, flags.argmax(axis=0) + 1, np.where(np.arange(k) == k - 1, size - pad, size))
        whole = np.concatenate(([True], last[np.arange(1, k) * size - 1]))  # starts a word
        entry = np.concatenate(([0], state[:-1]))
        known = np.concatenate(([True], reset[:-1] | whole[:-1]))
        entry[whole] = 0
        todo = np.flatnonzero(~whole)
        while len(todo):  # one round, unless words are longer than chunks
            now = todo[known[todo]]
            cur = entry[now]
            for t in range(int(head[now].max())):
                on = np.flatnonzero(t < head[now])
                cur[on], out[t, now[on]] = self._advance(cur[on], columns[t, now[on]], flags[t, now[on]])
            through = ~reset[now] & (now + 1 < k)
            entry[now[through] + 1], known[now[through] + 1] = cur[through], True
            todo = todo[~np.isin(todo, now)]
        return out.T.reshape(-1)[:n]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        pairs = [self._normal(t) for t in texts]
        joined = "\n".join(t for t, _ in pairs)
        ends = np.cumsum([len(t.encode("utf-8")) + 1 for t, _ in pairs])
        data, last, place = self._words(joined) if joined else (np.zeros(0, np.uint8), np.zeros(0, bool), np.zeros(0, np.int64))
        total = np.concatenate(([0], np.cumsum(self.emitted(data, last), dtype=np.int64)))
        upto = total[np.searchsorted(place, ends, side="left")]
        return np.diff(np.concatenate(([0], upto))) + np.array([s for _, s in pairs], np.int64)


_machines: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    """One machine per Python worker and vocabulary."""
    if path not in _machines:
        _machines[path] = CountTransducer(path)
    return _machines[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` names a vocabulary file every worker can read. Null and empty texts have 0 bytes and 0 tokens; null and
    repeated ids pass through; other columns are neither read nor returned; an empty table gives an empty result.
    Special strings inside a text count one token each. A map without shuffle: memory is bounded by the slice and the
    transducer's table, whatever the table's size; a text of any length is one run of chunks.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        machine = transducer(path)
        for batch in batches:
            out: list = []
            for _, texts in text_slices([batch]):
                out.append(machine.counts(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
