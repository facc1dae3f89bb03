import math
import re
import zlib
from collections import Counter

import pytest

from bidloom.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


class Brute:
    """The same model with dictionaries, term by term."""

    def __init__(self, texts):
        seqs = [words(t) for t in texts]
        self.c = Counter(w for s in seqs for w in s)
        self.n = sum(self.c.values())
        self.pairs = Counter(p for s in seqs for p in zip(["<s>", *s[:-1]], s, strict=True))
        self.d1 = katz.Discount(Counter(self.c.values()))
        self.d2 = katz.Discount(Counter(self.pairs.values()))
        kept = sum(self.keep(self.d1, c) for c in self.c.values())
        self.whole = self.n if kept < self.n - 1e-9 else self.n + 1
        self.unknown = 1 - kept / self.whole if self.n else 1.0
        after = {}
        for (h, w), c in self.pairs.items():
            after.setdefault(h, []).append((w, c))
        self.times = {h: self.c[h] if h != "<s>" else len(seqs) for h in after}
        self.alpha = {}
        for h, own in after.items():
            kept = sum(self.keep(self.d2, c) for _, c in own)
            if self.times[h] - kept <= 1e-9:
                self.times[h] += 1
            self.alpha[h] = (1 - kept / self.times[h]) / (1 - sum(self.one(w) for w, _ in own))

    def keep(self, d, c):
        return c * d.factors[c] if c < len(d.factors) else c

    def one(self, w):
        return self.keep(self.d1, self.c[w]) / self.whole if self.c[w] else self.unknown

    def two(self, w, h):
        if (h, w) in self.pairs:
            return self.keep(self.d2, self.pairs[h, w]) / self.times[h]
        return self.alpha.get(h, 1.0) * self.one(w)

    def score(self, text):
        s = words(text)
        return sum(math.log10(self.two(w, h)) for h, w in zip(["<s>", *s[:-1]], s, strict=True))

    def base(self, text):
        return sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (len(self.c) + 1))) for w in words(text))


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def compare(rows, spark):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", katz.F.lit("clash")).withColumn("held_out", katz.held_out(katz.F.col("doc_id")))
    found, model = katz.scored(docs)
    brute = Brute([t for d, t in rows if not held(d)])
    for h in [*list(brute.times)[:30], *list(brute.times)[-30:], "never seen"]:
        assert sum(brute.two(w, h) for w in brute.c) + brute.two("unseen word", h) == pytest.approx(1)
    got = sorted(tuple(r) for r in found.select("n_tokens", "n_known", "base_score", "score", "held_out").collect())
    want = sorted((len(words(t)), sum(brute.c[w] > 0 for w in words(t)), brute.base(t), brute.score(t), held(d)) for d, t in rows)
    assert len(got) == len(want) and all(a == pytest.approx(b, rel=1e-9) for a, b in zip(got, want, strict=True))
    assert model.words.tokens == brute.n


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    compare(rows, spark)


def test_rows(spark):
    rows = [(None, "a b a"), (1, None), (2, ""), (3, "A b\tc"), (3, "A b\tc"), (7, "z " * 30000), (8, "a b c d"), (9, "b a")]
    compare(rows, spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", katz.F.lit(True))
    assert {r.score for r in katz.scored(docs)[0].collect()} == {0.0}
    assert katz.scored(docs.limit(0))[0].count() == 0


def test_batches_and_parts(spark, monkeypatch):
    """Neither the size of batches nor the number of parts changes a score, and pairs count however rare their words are."""
    rows = [(d, f"the r{d // 4} s{d // 4} the of x{d % 7} y{d % 5}" + " z" * d) for d in range(40)] + [(None, "the of " * 50), (77, "rare pair " + "common " * 500)]
    for batch, keys in ((64, 16), (1 << 24, 1 << 21)):
        monkeypatch.setattr(katz, "BATCH", batch)
        monkeypatch.setattr(katz, "KEYS", keys)
        compare(rows, spark)


def test_counts_beyond_a_byte():
    value = katz.np.array([0, 254, 255, 256, 1 << 40], katz.np.int64)
    row = katz._answer(katz.WORD, 1, 0, value)
    assert katz.told([row], katz.WORD, katz.np.arange(5)[::-1]).tolist() == value.tolist()[::-1]
