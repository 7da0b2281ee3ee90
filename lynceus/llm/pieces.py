"""SentencePiece models on the tokenizers library: parse the model file, rebuild its pipeline, encode, decode, verify."""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lynceus.llm.base import ready, text_slices

#: Fixed values of the model format: the space marker, piece types, model types.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(field number, value) of a protobuf message; values are ints, raw 32-bit words or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What a model file says; the defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                spec = dict(_fields(value))
                model.kind = spec.get(3, UNIGRAM)
                model.byte_fallback = bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix = bool(spec.get(3, 1))
                model.squeeze = bool(spec.get(4, 1))
                model.escape = bool(spec.get(5, 1))
        return model

    def merges(self) -> list[tuple[str, str]]:
        """Every way to join two pieces to a third, best score first."""
        known = {p: s for p, s, k in self.pieces if k == NORMAL}
        found = []
        for piece, score in known.items():
            for i in range(1, len(piece)):
                if piece[:i] in known and piece[i:] in known:
                    found.append((-score, piece[:i], piece[i:]))
        found.sort(key=lambda x: x[0])
        return [(a, b) for _, a, b in found]

    def tokenizer(self):
        """The same pipeline built from the tokenizers library."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if any(k in (USER, UNUSED) for _, _, k in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        unk = next((p for p, _, k in self.pieces if k == UNKNOWN), None)
        if self.kind == BPE:
            tok = Tokenizer(models.BPE(ids, self.merges(), unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback))
        elif self.kind == UNIGRAM:
            tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=ids[unk], byte_fallback=self.byte_fallback))
        else:
            raise ValueError(f"model type {self.kind}")
        steps: list = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if steps:
            tok.normalizer = normalizers.Sequence(steps)
        out: list = [decoders.Replace(MARK, " ")]
        if self.byte_fallback:
            out.append(decoders.ByteFallback())
        out.append(decoders.Fuse())
        if self.dummy_prefix:
            out.append(decoders.Strip(" ", 1, 0))
        tok.decoder = decoders.Sequence(out)
        return tok


class PieceBytes:
    """Decoding of whole id arrays at once: the bytes of every piece in one table, gathered by offsets.

    Stands for the pipeline's decoder on ids of plain pieces and byte pieces; it knows nothing of other kinds, nor of
    bytes that are no text, and leaves those to the decoder.
    """

    def __init__(self, model: PieceModel):
        plain = [self._bytes(p, kind) for p, _, kind in model.pieces]
        self.known = np.array([b is not None for b in plain])
        parts = [b or b"" for b in plain]
        self.sizes = np.array([len(b) for b in parts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(b"".join(parts), np.uint8)
        self.strip = model.dummy_prefix

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes | None:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode() if kind in (NORMAL, USER) else None

    def same(self, flat: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Whether each run of ids is seen to decode to its text; false where it does not or cannot be told here."""
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.begins[flat], sizes)
        data = self.table[at].tobytes()
        bound = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        odd = np.concatenate(([0], np.cumsum(~self.known[flat])))[np.concatenate(([0], np.cumsum(counts)))]
        out = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            got = data[bound[i] : bound[i + 1]]
            out[i] = odd[i] == odd[i + 1] and (got[1:] if self.strip and got[:1] == b" " else got) == text
        return out


_loaded: dict[str, tuple] = {}


def backend(path: str):
    """(tokenizers pipeline, reference processor, piece bytes) of a model file, once per Python worker."""
    if path not in _loaded:
        import sentencepiece

        model = PieceModel.load(path)
        _loaded[path] = (model.tokenizer(), sentencepiece.SentencePieceProcessor(model_file=path), PieceBytes(model))
    return _loaded[path]


def encoded(tok, reference, texts: list[str], threads: int, verify: int) -> tuple[list[list[int]], list[bool | None]]:
    """(ids, parity) of every text; where the two differ the ids are the reference's."""
    got = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    parity: list = [None] * len(texts)
    audit = [i for i, t in enumerate(texts) if zlib.crc32(t.encode("utf-8")) % verify == 0]
    for i, want in zip(audit, reference.encode([texts[i] for i in audit], num_threads=threads) if audit else []):
        parity[i] = got[i] == want
        got[i] = want
    return got, parity


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, verify: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, n_pieces, piece_ids, parity, round_trip.

    Batches are encoded and decoded with ``threads`` threads. Every text is also encoded by the reference processor:
    parity says that its ids are equal, and where they are not the reference's ids are returned. A larger ``verify``
    audits only every ``verify``-th text, by a hash of its bytes, and leaves parity null and the ids as they are for the
    others. round_trip says that decoding gives the text back
    (false where the model's normaliser changes it). Null and empty texts have no pieces; a null text counts as the
    empty one. Whole texts are encoded whatever their length. Ids may be null or repeated; other columns are not read;
    an empty table gives an empty result. A map without a shuffle.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        tok, reference, plain = backend(path)
        for batch in batches:
            for ids, texts in text_slices([batch], 1 << 20):
                clean = [t.encode("utf-8", "replace").decode("utf-8") for t in texts]
                got, parity = encoded(tok, reference, clean, threads, verify)
                # one flat array and offsets: building a list array from nested lists costs more than the encoding
                sizes = np.array([len(g) for g in got], np.int64)
                flat = np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum()))
                pieces = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
                same = plain.same(flat, sizes, [t.encode("utf-8") for t in clean])
                rest = np.flatnonzero(~same).tolist()  # the decoder itself decides on what the table cannot tell
                for i, back in zip(rest, tok.decode_batch([got[i] for i in rest], skip_special_tokens=False) if rest else []):
                    same[i] = back == texts[i]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, batch.schema.field(0).type), pa.array(sizes), pieces, pa.array(parity, pa.bool_()),
                    pa.array(same)], ["id", "n_pieces", "piece_ids", "parity", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_pieces long, piece_ids array<int>, parity boolean, round_trip boolean")
    return out.select(F.col("id").alias(id_col), "n_pieces", "piece_ids", "parity", "round_trip")


def decode_pieces(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """(id, text) of encoded rows; null and empty id lists give the empty text."""
    ready(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        tok, _, _ = backend(path)
        for batch in batches:
            texts = tok.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    out = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.select(F.col("id").alias(id_col), "text")
