import zlib

import numpy as np
import pytest

from bidloom.llm import lang_id


def test_codewords_differ_enough():
    for n in (1, 2, 4, 6, 12):
        code = lang_id.codewords(n)
        assert len(code) == n and all((code[i] != code[j]).sum() >= max(1, code.shape[1] // 4) for i in range(n) for j in range(i))


def test_blocks_lose_no_ngram(monkeypatch):
    text = "abc déf " * 50
    whole = next(lang_id.blocks([text]))[0]
    monkeypatch.setattr(lang_id, "BLOCK", 17)
    cut = np.concatenate([lang_id.slots(part[a:b], 3) for part, _, starts in lang_id.blocks([text]) for a, b in zip(starts, starts[1:], strict=False) if b - a > 2])
    assert np.bincount(cut, minlength=lang_id.SLOTS).tolist() == np.bincount(lang_id.slots(whole, 3), minlength=lang_id.SLOTS).tolist()


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in lang_id.op9_lang_id(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs} == {k: r.held_out for k, r in got.items()}
    held = [d for d in docs if got[d.doc_id].held_out]
    right = sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held)
    assert right > 0.97, right
    assert all(0 <= r.score <= 1 for r in got.values())


def test_rows(spark):
    train = [(i, "the cat and the dog", "en") for i in range(5)] + [(i, "der hund und die katze", "de") for i in range(5, 9)]
    odd = [(20, None, "en"), (21, "", None), (22, "12 34 !!", "de"), (None, "the dog", None), (23, "und der die " * 40000, None), (23, "und der die", None)]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string").withColumn("score", lang_id.F.lit("x"))
    got = {(r.doc_id, r.lang_pred) for r in lang_id.predict(docs, lang_id.fit(docs)).collect()}
    assert {(20, "und"), (21, "und"), (22, "und"), (None, "en"), (23, "de"), (0, "en"), (6, "de")} <= got
    assert lang_id.predict(docs.limit(0), lang_id.fit(docs)).count() == 0
    assert {r.lang_pred for r in lang_id.predict(docs, lang_id.fit(docs.limit(0))).collect()} == {"und"}
    assert lang_id.predict(docs, lang_id.fit(docs)).where("lang_pred = 'und' AND score <> 0").count() == 0


def test_ambiguity_is_flagged():
    model = lang_id.Model(["a", "b"], np.random.default_rng(0).integers(0, 9, (2, 2 * lang_id.SLOTS)))
    _, score, near = model.decode(np.array([[0.0], [3.0]]))
    assert near.tolist() == [True, False] and score[0] == pytest.approx(0.5)


def plain(rows, texts):
    """The same classifiers and decoding with dictionaries, n-gram by n-gram."""
    import math
    from collections import Counter

    def grams(text):
        data = [b if b >= 0x80 or 97 <= b <= 122 else 32 for b in f" {text} ".lower().encode("utf-8", "replace")]
        for order in lang_id.ORDERS:
            for i in range(len(data) - order + 1):
                key = 0
                for b in data[i : i + order]:
                    key = (key << 8 | b) & 0xFFFFFFFF
                yield order, key & 0xFFFF if order == 2 else (key * 2654435761 & 0xFFFFFFFF) >> 16

    langs = sorted({k for _, t, k in rows if k is not None and t is not None and lang_id.has_letter(t)})
    seen = {k: Counter(g for _, t, own in rows if own == k and lang_id.has_letter(t) for g in grams(t)) for k in langs}
    whole = {k: {o: sum(n for (p, _), n in seen[k].items() if p == o) + 0.5 * lang_id.SLOTS for o in lang_id.ORDERS} for k in langs}
    share = lambda k, g: (seen[k][g] + 0.5) / whole[k][g[0]]
    codes = lang_id.codewords(len(langs)).tolist()
    every = [(o, s) for o in lang_id.ORDERS for s in range(lang_id.SLOTS)]
    bits, scale, trust = [], [], []
    for bit in range(len(codes[0])):
        plus, minus = ([k for k, c in zip(langs, codes, strict=True) if c[bit] == sign] for sign in (1, -1))
        weight = {g: math.log(sum(share(k, g) for k in plus) / len(plus)) - math.log(sum(share(k, g) for k in minus) / len(minus)) for g in every}
        hoped = [c[bit] * sum(share(k, g) * weight[g] for g in every) for k, c in zip(langs, codes, strict=True)]
        bits.append(weight)
        scale.append(1 / max(sum(hoped) / len(hoped), 1e-9))
        trust.append(max(min(hoped) * scale[-1], 0.05))
    for text in texts:
        if text is None or not lang_id.has_letter(text):
            yield "und", 0.0
            continue
        found = list(grams(text))
        n = len(f" {text} ".lower().encode("utf-8", "replace"))
        margins = [sum(w[g] for g in found) / n * s for w, s in zip(bits, scale, strict=True)]
        loss = [sum(t / sum(trust) * math.log1p(math.exp(-2 * max(-4, min(4, c * m)))) for t, c, m in zip(trust, code, margins, strict=True)) for code in codes]
        best = loss.index(min(loss))
        yield langs[best], 1 / sum(math.exp(-lang_id.SHARPNESS * (x - min(loss))) for x in loss)


def test_against_a_plain_version(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows = [(d, t and t[:400], k) for d, t, k in rows] + [(-1, None, "en"), (-2, "", None), (-3, "12 !", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(docs, lang_id.fit(docs)).collect()}
    want = dict(zip((d for d, _, _ in rows), plain(rows, [t for _, t, _ in rows]), strict=True))
    assert got.keys() == want.keys()
    for doc, (lang, score) in want.items():
        assert got[doc][1] == pytest.approx(score, abs=1e-4)
        assert got[doc][0] == lang or score < 0.51
