import random
import re
from collections import defaultdict

import numpy as np

from bidloom.llm import graph, near_dups, tokens
from bidloom.llm.near_dups import Similarity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, width):
    w = WORD.findall(lower(text))
    return frozenset([tuple(w)] if 0 < len(w) < width else (tuple(w[i : i + width]) for i in range(len(w) - width + 1)))


def brute(rows, width, percent):
    """{place: (number of shingles, least id of the component)} by union-find over all pairs that share a shingle."""
    sets = [shingle_set(t, width) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for pair in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        a, b = (sets[i] for i in pair)
        if 100 * len(a & b) >= percent * len(a | b):
            top[find(pair[0])] = find(pair[1])
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return [(rows[i][0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def test_words_and_shingles():
    texts = ["The Cat\tsat  down", "", None, "one two", " \n", "É a b c"]
    hashes, at = tokens.word_hashes(texts)
    assert np.diff(at).tolist() == [4, 0, 0, 2, 0, 4]
    again, _ = tokens.word_hashes(["x the cat SAT down"])
    assert again[1:].tolist() == hashes[:4].tolist() and len(set(hashes.tolist())) == 10
    assert np.diff(tokens.shingles(texts, 3)[1]).tolist() == [2, 0, 0, 1, 0, 2]


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(0)
    for like in (Similarity(3, 85), Similarity(5, 80)):
        a = rng.integers(0, 1 << near_dups.BITS, (200, near_dups.HASHES)).astype(np.uint16)
        b = a.copy()
        for row in b:
            row[rng.choice(near_dups.HASHES, like.distance, replace=False)] ^= 1
        for x, y in zip(a, b, strict=True):
            assert any((x[list(k)] == y[list(k)]).all() for k in like.keys)
        assert (near_dups.positions(near_dups.planes(a)) == a).all()


def test_first_shared_key(spark):
    rng = np.random.default_rng(1)
    like = Similarity(3, 85)
    a = rng.integers(0, 1 << near_dups.BITS, (200, near_dups.HASHES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dups.HASHES, rng.integers(0, like.distance + 1), replace=False)] ^= 5
    rows = [(x, y) for x, y in zip(near_dups.planes(a).tolist(), near_dups.planes(b).tolist(), strict=True)]
    mask = near_dups.differing("a", "b")
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(near_dups.first_key(mask, like), near_dups.apart("a", "b")).collect()
    for (key, apart), x, y in zip(got, a, b, strict=True):
        same = [i for i, k in enumerate(like.keys) if (x[list(k)] == y[list(k)]).all()]
        assert apart == (x != y).sum() and key == same[0]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    top = {}
    for a, b in edges:
        if a != b:
            pa, pb = top.get(a, {a}), top.get(b, {b})
            for v in (both := pa | pb):
                top[v] = both
    got = {r.v: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: min(s) for v, s in top.items()}


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (None, "one two"), (None, None), (7, "lone"), (7, "lone"), (7, "other text here now")]
    body = [word() for _ in range(150)]
    for i in range(60):  # a group of near copies of which some are links between others
        own = list(body)
        for _ in range(rng.randrange(0, 8)):
            own[rng.randrange(len(own))] = word()
        rows.append((100 + i, " ".join(own)))
    drift = [word() for _ in range(80)]
    for i in range(30):  # a chain: neighbours are alike, its ends are not
        drift[i * 2 % 80] = word()
        rows.append((200 + i, " ".join(drift)))
    passage = " ".join(body[:60])
    rows += [(300 + i, passage + " " + " ".join(word() for _ in range(80))) for i in range(30)]
    return rows


def test_against_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("vertex", near_dups.F.lit("clash"))
    for like in (Similarity(3, 85), Similarity()):
        got = near_dups.classes(docs, like).collect()
        key = lambda x: tuple((v is None, v) for v in x)
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(rows, like.width, like.percent), key=key)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dups.classes(docs.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = near_dups.classes(docs, Similarity(3, 85)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute([tuple(r) for r in docs.collect()], 3, 85))


def test_ranges_of_texts_cover_them_and_stay_small():
    import pyarrow as pa

    from bidloom.llm import tokens

    sizes = [10, 3, None, 0, 25, 1, 7, 7, 7, 0]
    texts = pa.array([None if n is None else "é" * n for n in sizes], pa.string())
    found = list(tokens.ranges(texts, 16))
    assert found[0][0] == 0 and found[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    assert all(sum(2 * (n or 0) for n in sizes[low + 1 : high]) < 16 for low, high in found)
    assert list(tokens.ranges(pa.array([], pa.string()))) == [] and list(tokens.ranges(pa.array([None]).cast(pa.string()))) == [(0, 1)]
