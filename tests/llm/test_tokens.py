"""Token counts and SentencePiece pieces against the libraries they stand for."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from lynceus.llm.pieces import PieceModel, decode_pieces, encode_pieces, encoded
from lynceus.llm.token_counts import CountTransducer, token_counts

EDGES = [
    "", " ", "a", "I'd've don't 'sing ''s !'s 's's'", "x" * 3000, "ΑΣ İstanbul é é", "日本 123 ½²", "<|endoftext|>hi<|startoftext|> x <|end",
    "'re 'r 'l 'll", "\x85 a\x1cb　c", "'", "!!''s", "👨‍👩‍👧", "\n\n\t", "Word " * 2000]


@pytest.fixture(scope="module")
def machine(vocab):
    return CountTransducer(vocab("word_bpe_49k.json"), chunk=64)


@pytest.fixture(scope="module")
def library(vocab):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab("word_bpe_49k.json"))
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(machine, library):
    rnd = random.Random(1)
    texts = EDGES + ["".join(rnd.choice("abcé 's1!Ω \n世tthe'") for _ in range(rnd.randint(0, 700))) for _ in range(400)]
    assert list(machine.counts(texts)) == library(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_counts_of_any_text(machine, library, texts):
    assert list(machine.counts(texts)) == library(texts)


def test_words_longer_than_chunks_and_full_tables(vocab, library):
    small = CountTransducer(vocab("word_bpe_49k.json"), cells=1, chunk=7)
    texts = ["internationalization" * 9, "a b " * 20, "", "zz" * 100]
    for _ in range(2):  # the table is emptied before every run
        assert list(small.counts(texts)) == library(texts)


def test_token_count_rows(spark, docs_of, vocab):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, "x"), (2, None), (3, ""), (4, "word " * 3000)]
    got = token_counts(docs_of(rows), vocab("word_bpe_49k.json")).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_bytes, r.n_tokens, r.over_limit))
    assert by[1] == [(11, 2, False)] * 2 and by[2] == by[3] == [(0, 0, False)]
    assert by[4] == [(15000, 3000, True)] and by[None] == [(1, 1, False)]
    assert token_counts(docs_of([]), vocab("word_bpe_49k.json")).collect() == []


def test_pieces_equal_the_reference(vocab):
    import sentencepiece

    path = vocab("piece_bpe_32k.model")
    tok, ref = PieceModel.load(path).tokenizer(), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(2)
    texts = EDGES + ["".join(rnd.choice("abcé 's1!Ω \n世tthe'  ▁") for _ in range(rnd.randint(0, 500))) for _ in range(300)]
    assert [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)] == ref.encode(texts)


def test_unigram_model_with_normaliser(tmp_path):
    """A hand-written unigram model with byte fallback, read by both libraries."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("▁", -3.0, 1), ("▁ab", -2.0, 1), ("a", -4.0, 1), ("b", -4.1, 1), ("ab", -3.5, 1), *((f"<0x{i:02X}>", 0, 6) for i in range(256))]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = True
    m.normalizer_spec.remove_extra_whitespaces = True
    m.normalizer_spec.add_dummy_prefix = True
    path = tmp_path / "tiny.model"
    path.write_bytes(m.SerializeToString())
    ref = sentencepiece.SentencePieceProcessor(model_file=str(path))
    tok = PieceModel.load(str(path)).tokenizer()
    texts = ["ab ab", "  aab   b ", "aé", ""]
    assert [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)] == ref.encode(texts)


def test_piece_rows_round_trip(spark, docs_of, vocab):
    path = vocab("piece_bpe_32k.model")
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (None, "é世"), (2, None), (3, ""), (4, "word " * 5000)]
    out = encode_pieces(docs_of(rows), path, verify=1)
    got = out.collect()
    assert len(got) == 6 and all(r.parity and r.round_trip for r in got)
    assert {r.doc_id: r.n_pieces for r in got}[2] == 0
    back = sorted((r.doc_id or 0, r.text) for r in decode_pieces(out, path).collect())
    assert back == sorted((i or 0, t or "") for i, t in rows)
    assert encode_pieces(docs_of([]), path).collect() == []


def test_every_text_is_verified_and_repaired(spark, docs_of, vocab):
    import sentencepiece

    path = vocab("piece_bpe_32k.model")
    out = encode_pieces(docs_of([(i, f"text number {i}") for i in range(40)]), path).collect()
    assert len(out) == 40 and all(r.parity is True for r in out)

    model, ref = PieceModel.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    model.merges = lambda: []  # a pipeline that joins nothing differs on every word
    texts = ["Hello world", "", "one two three"]
    ids, parity = encoded(model.tokenizer(), ref, texts, threads=1, verify=1)
    assert ids == ref.encode(texts) and parity == [False, True, False]


def test_piece_bytes_agree_with_the_decoder(vocab):
    import numpy as np

    from lynceus.llm.pieces import PieceBytes

    model = PieceModel.load(vocab("piece_bpe_32k.model"))
    tok, plain = model.tokenizer(), PieceBytes(model)
    rnd = random.Random(4)
    texts = EDGES + ["".join(rnd.choice("abcé 's1!Ω \n世tthe'  ▁👩") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    ids[3] = ids[3][:-1]  # one that does not decode to its text
    ids[5] = [0, 1, 2]  # kinds the table does not know
    got = plain.same(np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids]), [t.encode() for t in texts])
    back = [b == t for b, t in zip(tok.decode_batch(ids, skip_special_tokens=False), texts)]
    assert all(b or not g for g, b in zip(got, back)) and sum(got) == sum(back) and not got[3] and not got[5]
