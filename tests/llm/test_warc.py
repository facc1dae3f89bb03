import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from bidloom.llm import warc

ROWS = [(1, "http://a/x", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b/é y", None), (4, "u", ""), (5, "bad\r\nWARC-Type: x", "é" * 40_000), (5, "v", "é" * 40_000), (None, "n", "<p>one</p>"), (None, "n", "alone")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, pages, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    warc.write(warc.records(pages), path, compression=compression, max_bytes=300)
    got = warc.load(spark, path, verify="true")
    back = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes, r.payload_digest, bytes(r.payload or b"")) for r in got.collect())
    want = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        first = min((p for p, _, h in ROWS if (h or "").encode() == data and p is not None), default=None)
        same = first is None or page == first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((f"urn:page:{'' if page is None else page}", "response" if same else "revisit", "" if same else f"urn:page:{first}", len(data), digest, data if same else b""))
    assert back == sorted(want)
    heads = warc.load(spark, path, payload="false")
    assert sorted((r.record_id, r.payload_bytes) for r in heads.collect()) == sorted((w[0], w[3]) for w in want)
    assert heads.where("payload IS NOT NULL").count() == 0


def test_filters_reach_the_reader(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(warc.records(pages), path)
    asked = warc.load(spark, path).where("record_type = 'response' AND target_uri LIKE 'http://%'")
    assert sorted(r.record_id for r in asked.collect()) == ["urn:page:1", "urn:page:3"]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.equal == {"record_type": {"revisit"}}
    assert warc.load(spark, path).where("record_type = 'revisit'").count() == 3


def test_min_bytes_and_empty(spark, pages, tmp_path):
    small = warc.records(pages, min_bytes=100)
    assert small.where("record_type = 'revisit'").count() == 0
    path = f"file://{tmp_path}/none"
    warc.write(warc.records(pages.limit(0)), path)
    assert warc.load(spark, path).count() == 0


def test_other_writers_members(tmp_path):
    """A gzip member without the length field is stepped over by decoding it."""
    data = warc.record({"record_id": "urn:page:9", "record_type": "response", "target_uri": "u", "payload": b"x" * 5000})
    source = io.BytesIO(gzip.compress(data) * 2)
    reader = warc.WarcReader({"path": str(tmp_path), "payload": "true"})
    more, row = reader.record(source, True)
    assert more and row["payload"] == b"x" * 5000
    more, row = reader.record(source, True)
    assert more and row["record_id"] == "urn:page:9" and reader.record(source, True) == (False, None)


def test_damage_is_found(spark, pages, tmp_path):
    path = tmp_path / "w"
    warc.write(warc.records(pages), f"file://{path}", compression="none")
    for f in path.glob("*.warc"):
        f.write_bytes(f.read_bytes().replace(b"<p>one", b"<p>two"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.load(spark, f"file://{path}", verify="true").collect()


FOREIGN = [
    ("request", b"GET / HTTP/1.1\r\nhost: x\r\n\r\n"), ("response", b"HTTP/1.1 200 OK\r\n\r\n<p>body</p>"), ("metadata", b"fetchTimeMs: 12\r\n\r\n"),
    ("resource", b"plain payload"), ("conversion", b""),
]


def foreign(names=str.lower):
    """Records as another writer may write them: other header case, no digests, all types."""
    out = []
    for i, (kind, block) in enumerate(FOREIGN):
        heads = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x:{i}>"), ("WARC-Target-URI", "http://x/"), ("Content-Length", str(len(block)))]
        out.append(b"WARC/1.0\r\n" + b"".join(f"{names(k)}:{v}\r\n".encode() for k, v in heads) + b"\r\n" + block + b"\r\n\r\n")
    return out


def test_archives_of_other_writers(spark, tmp_path):
    import gzip

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(b"".join(foreign()))
    (tmp_path / "a" / "y.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in foreign(str.upper)))
    for payload in ("true", "false"):
        rows = warc.load(spark, f"file://{tmp_path}/a", payload=payload).collect()
        assert sorted(r.record_type for r in rows) == sorted(2 * [k for k, _ in FOREIGN])
        sizes = {"request": 0, "response": 11, "metadata": 19, "resource": 13, "conversion": 0}
        assert all(r.payload_bytes == sizes[r.record_type] for r in rows)
    assert warc.load(spark, f"file://{tmp_path}/a").where("record_type = 'metadata'").count() == 2


def test_cut_archives_are_errors(spark, tmp_path):
    import gzip

    for name, data in (("x.warc", b"".join(foreign())[:-60]), ("z.warc", b"".join(foreign())[:30]), ("y.warc.gz", gzip.compress(foreign()[1])[:-30])):
        folder = tmp_path / name.replace(".", "")
        folder.mkdir()
        (folder / name).write_bytes(data)
        with pytest.raises(Exception, match="ends within|shorter than|no record"):
            warc.load(spark, f"file://{folder}").collect()
