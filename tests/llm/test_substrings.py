import hashlib
import random

from bidloom.llm import substrings


def brute(rows, length):
    """By a dictionary of all strings of that length, in order of doc_id."""
    first, out = {}, {}
    key = lambda r: (r[0] is None, r[0] or 0)
    for doc, text in sorted(set(rows), key=key):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if first.setdefault(data[s : s + length], (doc, s)) != (doc, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc, text] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return [(doc, *out[doc, text]) for doc, text in rows]


def same(spark, rows, length):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", substrings.F.lit("clash"))
    got = [tuple(r) for r in substrings.removed(docs, length).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows, length), key=key)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    made = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [made(rng.randrange(90, 400)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 500), (5, "a" * 130), (6, "ab" * 200), (None, made(150)), (7, passages[0]), (7, passages[0])]
    for i in range(40):
        text = made(rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            text += p[a : a + rng.randrange(50, 400)] + made(rng.randrange(0, 60))
        rows.append((10 + i, text))
    rows += [(100 + i, rows[-1][1]) for i in range(5)]
    same(spark, rows, 100)
    same(spark, rows, 40)
    monkeypatch.setattr(substrings, "SEGMENT", 256)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    batches = [spark.createDataFrame(rows, "doc_id long, text string").toArrow()]
    assert batches and docs.count() == len(rows)
    cut = list(substrings.segments([("x" * 1000).encode()], 100))
    assert sum(sum(max(0, b - a - 99) for a, b in zip(s[2], s[2][1:], strict=False)) for s in cut) == 901


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    same(spark, [tuple(r) for r in docs.collect()], 100)
    assert substrings.removed(docs.limit(0)).count() == 0
