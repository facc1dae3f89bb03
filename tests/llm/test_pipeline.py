"""Each stage against a plain version, and the whole of them in a row."""

from collections import Counter

import corpus_pipeline as cp
import duckdb
from bidloom.llm import mixing, pii, quality_rules, sentencepiece
from test_near_dups import brute
from test_pii import brute as base_spans


def sql(query, docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.execute(query).df()


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns

    clean = cp.drop_junk(spark, docs, "")
    verdict = sql(quality_rules.ORACLE, docs.toPandas())
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == set(verdict.doc_id[verdict.kept])

    single = cp.drop_copies(spark, clean, "")
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert single.columns == columns
    assert Counter(r.doc_id for r in single.collect()) == Counter(d for d, _, c in brute(rows, 5, 80) if d == c)

    masked = cp.mask_pii(spark, single, "")
    texts = {r.doc_id: r.text for r in single.collect()}
    assert masked.columns == columns and masked.count() == single.count()
    for r in masked.collect():
        want = texts[r.doc_id]
        for a, kind, b in sorted(base_spans(want), reverse=True):
            want = want[:a] + f"<{pii.KINDS[kind].upper()}>" + want[b:]
        assert r.text == want and r.n_chars == len(want)

    mix = cp.mix_sources(spark, masked, "")
    taken = sql(mixing.oracle(), masked.toPandas())
    want = Counter({d: int(t / s) for d, s, t in zip(taken.doc_id, taken["size"], taken.taken, strict=True) if t})
    assert mix.columns == columns and Counter(r.doc_id for r in mix.collect()) == want

    vocabulary = sentencepiece.Vocabulary.load()
    known = {r.doc_id: r.text for r in masked.collect()}
    ids = cp.to_ids(spark, mix, "").collect()
    assert Counter(r.doc_id for r in ids) == want
    assert all(vocabulary.decode(r.ids) == known[r.doc_id] and r.round_trip for r in ids)

    whole = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole) == Counter((r.doc_id, tuple(r.ids)) for r in ids)


def test_odd_rows(spark):
    prose = " ".join(f"word{i} and more text here" for i in range(40))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, prose, "en", None, 5), (3, prose, "en", None, 5), (None, prose + " end", None, "s", None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, out, "")
            assert out.columns == docs.columns
        assert cp.to_ids(spark, out, "").count() == out.count()
