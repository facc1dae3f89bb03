import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bidloom.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, max_words=1, buckets=10_000):
    words = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, max_words=1, buckets=10_000, least=20):
    """All of it by the contract's words: {doc_id: (n_features, weight, score, rank)}."""
    s, t = (Counter(x for _, text in rows for x in plain_features(text, max_words, buckets)) for rows in (docs, [(0, x) for x in target]))
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets)))) for b in s}
    out = {}
    for doc_id, text in docs:
        f = plain_features(text, max_words, buckets)
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[doc_id] = (len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    may = sorted((-out[d][2], d) for d, text in docs if len(plain_features(text)) >= least)
    rank = {d: i + 1 for i, (_, d) in enumerate(may[: 10 * len(may) // 100])}
    return {d: (*v, rank.get(d)) for d, v in out.items()}


TEXTS = ["Alpha beta GAMMA. " * 9, "über Ärger, naïve 東京 " * 8, "x\ny\x00z-a_b`c{d", "", None, "one " * 25, "Benchmark words here only " * 6, "a" * 2_000_000 + " tail"]


@pytest.mark.parametrize("max_words", [1, 2, 3])
def test_batches_equal_single_texts(max_words):
    data = [None if t is None else t.encode() for t in TEXTS]
    doc, bucket, words = resampling.features(data, max_words, 10_000)
    for i, text in enumerate(TEXTS):
        assert sorted(bucket[doc == i].tolist()) == sorted(plain_features(text, max_words))
        assert words[i] == len(plain_features(text))


def test_no_gram_crosses_documents():
    doc, bucket, _ = resampling.features([b"a b", b"c d", b"", b"e"], 2, 1 << 32)
    pairs = {zlib.crc32(x) for x in (b"a b", b"c d")}
    assert {int(b) for b in bucket} - {zlib.crc32(x) for x in (b"a", b"b", b"c", b"d", b"e")} == pairs


@pytest.mark.parametrize("max_words", [1, 2])
def test_scores_and_draws(spark, max_words):
    docs = [(i, f"{TEXTS[i % len(TEXTS)] or ''} doc {i % 50} " * (1 if i % 8 == 7 else 2)) for i in range(230)] + [(1000, None), (1001, "")]
    target = ["benchmark words only", None, "alpha beta"]
    got = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS weight", "'x' AS rank"), spark.createDataFrame([(x,) for x in target], "text string"), max_words=max_words)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain(docs, target, max_words)


def test_ties_repeats_nulls_and_empty_tables(spark):
    text = "word " * 30
    rows = [(1, text)] * 30 + [(None, text)] * 5
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("word",)], "text string")
    got = resampling.resampled(docs, target).collect()
    assert len(got) == 35 and sorted(r.rank for r in got if r.rank) == [1, 2, 3]
    assert len({(r.n_features, r.weight) for r in got}) == 1
    assert resampling.resampled(docs.limit(0), target).collect() == []
    assert len(resampling.resampled(docs, target.limit(0)).collect()) == 35
    assert resampling.drawn(docs.where("doc_id = 1"), target).count() == 30


def test_gains_of_no_text():
    assert (resampling.gains(np.zeros(10, np.int64), np.zeros(10, np.int64)) == 0).all()
