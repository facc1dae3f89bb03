import hashlib
import random
import re
import time

import pytest

from bidloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text, out = text or "", []
    num = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(num(m[0])) <= 19 and pii.luhn(num(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(num(m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(4)
    for letters in ("a@.b-1", "0123.4 5-+()", "+1 (2).3", "x@y.z 4111111111111111 1.2.3.4"):
        for _ in range(4000):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
            assert pii.base_spans(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "+49 30 123456", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0000000001.2.3.4", "é a.b@c.de"):
        assert pii.base_spans(text) == brute(text) != []


def test_long_runs_take_linear_time():
    began = time.monotonic()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(text)
    assert time.monotonic() - began < 20


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_repeats_are_added(field):
    text = "Write to anna.k77@mail.example.com or call +1 (632) 555-4827 today. Later: 632-555-4827, or ANNA.K77(at)mail.example.com; version 2.0 of 1999, item 123456789."
    base = pii.base_spans(text)
    spans = field.spans(text, base)
    assert set(base) <= set(spans)
    more = {text[a:b]: pii.KINDS[k] for a, k, b in set(spans) - set(base)}
    assert more == {"632-555-4827": "phone", "ANNA.K77(at)mail.example.com": "email"}
    assert pii.masked("mail a@b.cd now", [(5, 0, 11)]) == "mail <EMAIL> now"


def test_clean_texts_are_left_alone(field):
    for text in ("", "Plain prose.", "version 2.0 and 555-4827 and a@b", "call 632-555-4827 or 632-555-4827"):
        assert field.spans(text, pii.base_spans(text)) == pii.base_spans(text) == []


def test_loopy_beliefs_are_exact_on_a_tree(field):
    """One chain edge and one skip edge: beliefs against the sum over all labelings."""
    import itertools

    import numpy as np

    text = "a1@b.cd 555-4827 x9"
    found = [(0, pii.OTHER, 7), (8, pii.OTHER, 16), (17, pii.OTHER, 19)]
    got = field.beliefs(text, found, [(0, 1)], [(1, 2)])
    local = np.array([pii.features(text[a:b]) for a, _, b in found]) @ field.node
    want = np.zeros((3, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=3):
        p = np.exp(sum(local[i, y[i]] for i in range(3)) + field.chain[y[0], y[1]] + field.skip[y[1], y[2]])
        for i in range(3):
            want[i, y[i]] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_rows(spark, field):
    rows = [(1, None), (2, ""), (3, "a@b.cd"), (3, "a@b.cd"), (None, "10.0.0.1"), (4, "word " * 50000 + "+1 222 333 4444")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", pii.F.lit(7))
    got = {(r.doc_id, r.spans, r.n_email, r.n_ip, r.n_phone, r.base_sha256) for r in pii.found(docs, field).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(d, s, s.count("email"), s.count("ip"), s.count("phone"), sha(s)) for d, s in [(1, ""), (2, ""), (3, "email:0:6"), (None, "ip:0:8"), (4, "phone:250000:250015")]}
    assert pii.redact(docs, field).columns == docs.columns and pii.redact(docs.where("doc_id = 3"), field).first().text == "<EMAIL>"
    assert pii.found(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pii.op4_pii(spark, "/root/testdata/sf0.001").collect()}
    for d in docs.collect():
        r, want = got[d.doc_id], pii.listed(brute(d.text))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_short_ips(field):
    for ip in ("10.0.0.1", "127.0.0.1", "8.8.8.8"):
        text = f"host {ip} is down, see {ip.replace('.', '-')} again, not 1-0-0-7"
        base = pii.base_spans(text)
        _, skip = pii.edges(text, pii.nodes(text, base))
        assert len(base) == 1 and len(skip) == 1
        assert [text[a:b] for a, _, b in field.spans(text, base)] == [ip, ip.replace(".", "-")]


def test_sample_is_bounded_whatever_the_ids(spark):
    mails = "concat('mail a', id % 30000, '@x.org now')"
    for doc_id in ("cast(null as long)", "id % 3"):
        docs = spark.range(60_000).selectExpr(f"{doc_id} AS doc_id", f"{mails} AS text")
        assert 4000 < pii.sampled(docs).count() < 10_500
    hot = spark.range(60_000).selectExpr("id AS doc_id", "'mail a@x.org now' AS text")
    assert pii.sampled(hot).count() <= 1


def test_fit_takes_no_more_kinds_of_nodes_than_told(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('call +49 30 ', 1000000 + id * 7919, ' or x', id, '@y.org') AS text")
    assert pii.fit(docs, forms=5).fitted in (True, False)
    assert pii.fit(docs).fitted


def test_taken_stretches():
    taken = pii.Taken([(5, 0, 9), (7, 1, 12), (20, 2, 25)])
    assert [taken.free(*x) for x in ((0, 5), (0, 6), (12, 20), (11, 13), (24, 30), (25, 26))] == [True, False, True, False, False, True]
    taken.add(12, 20)
    assert not taken.free(15, 16)
