"""Against the library's own unigram encoder, run with the same pieces and scores."""

import random
import struct

import pytest

from bidloom.llm import sentencepiece as sp


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, kind, body):
    return varint(number << 3 | kind) + (varint(len(body)) + body if kind == 2 else body)


KINDS = {"normal": 1, "unknown": 2, "control": 3, "unused": 5, "byte": 6}


def unigram_model(v):
    """A unigram model file in the public format: pieces, trainer (type unigram, byte fallback), identity normaliser."""
    out = b""
    for piece, score, kind in zip(v.pieces, v.scores, v.kinds, strict=True):
        out += field(1, 2, field(1, 2, piece.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, varint(KINDS[kind])))
    out += field(2, 2, field(3, 0, varint(1)) + field(35, 0, varint(1)))
    return out + field(3, 2, field(1, 2, b"identity") + field(3, 0, varint(1)) + field(4, 0, varint(0)) + field(5, 0, varint(1)))


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=unigram_model(vocabulary))


def texts():
    rng = random.Random(3)
    letters = "abcdethe  éüñ\n\t中文字😀_-.,0123▁"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    return ["", " ", "   ", "a", "the quick brown fox", "naïve café\nnew line", "x" * 500, "中" * 300, *made]


def test_same_as_library(vocabulary, library):
    encoder = sp.Encoder(vocabulary)
    for text, ids in zip(texts(), encoder.encode(texts()), strict=True):
        want = library.encode(text)
        if ids.tolist() != want:  # float sums may break ties otherwise, never the score
            cost = lambda x: sum(vocabulary.scores[i] if vocabulary.kinds[i] == "normal" else 0 for i in x)
            assert cost(ids.tolist()) == pytest.approx(cost(want), abs=1e-3), text
        assert vocabulary.decode(ids.tolist()) == text.replace("▁", " ")  # a marker in the text itself reads as a space


def test_one_and_many_agree(vocabulary):
    units = [u.encode() for t in texts() for u in vocabulary.parts(t) if len(u.encode()) <= sp.SHORT]
    assert vocabulary.many(units) == [vocabulary.one(u) for u in units]


def test_bytes_that_are_no_text(vocabulary):
    assert vocabulary.decode([int(vocabulary.bytes[0xFF]), int(vocabulary.bytes[65])]) == "�A"


def test_rows(spark, vocabulary):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None), (None, "  é", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces string")
    out = sp.encode(docs, vocabulary)
    got = {(r.doc_id, None if r.ids is None else len(r.ids)) for r in out.collect()}
    assert {(1, None), (2, 0)} <= got and all(r.round_trip for r in out.collect()) and out.count() == 5
    assert sorted(str(r.text) for r in sp.decode(out, vocabulary).collect()) == sorted(str(r[1]) for r in rows)
    assert sp.encode(docs.limit(0), vocabulary).count() == 0
