"""WARC archives as a Spark data source, written and read in Arrow batches.

``spark.dataSource.register(WarcSource)``, then ``df.write.format("warc")`` and ``spark.read.format("warc")``.

Writing: each task streams its records into archives of its own, each record a gzip member (or plain), and starts a
new archive after ``max_bytes``. A member's header carries its length, so that a reader can step over it. Names are
unique to the attempt, and the driver lists the archives of the attempts that succeeded in ``_COMMITTED``; what a
lost executor left behind is never read.

Reading: the driver packs whole archives into partitions of about ``split_bytes``. A task parses a record's headers
first; filters on ``record_type``, ``record_id``, ``target_uri``, ``refers_to`` and ``payload_digest`` are pushed down
to that point, and the payload of a record that fails them, or of any record with ``payload=false``, is not decoded
(stepped over by the length in the gzip header, or by Content-Length in a plain archive). With ``verify=true`` the
digest of each response is computed anew and a difference raises. Records of all types and of any writer come: header
names count in any case, a payload is what follows the HTTP headers (of a request too) or else the whole block, and the
``warcinfo`` that describes an archive comes only to a filter that names it. An archive that ends within a record raises.

Paths are URIs of any store that pyarrow's file systems open. Edge cases: null payloads are written as empty ones,
null URIs and references are left out, line breaks in header values become spaces, an empty table makes no archive
and reads back as no rows, repeated records are kept.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from bidloom.llm import common

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: gzip header with an extra field "SL": the lengths of the whole member and of what it holds.
GZIP = struct.Struct("<4B I 2B H 2s H Q Q")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(row: dict) -> bytes:
    """The bytes of one record; a revisit has the HTTP headers only."""
    payload = row["payload"] or b""
    length = len(payload) if row.get("payload_bytes") is None else row["payload_bytes"]
    block = HTTP % length + (b"" if row["record_type"] == "revisit" else payload)
    head = {"WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": DATE}
    if row.get("target_uri") is not None:
        head["WARC-Target-URI"] = " ".join(row["target_uri"].split())
    head["WARC-Payload-Digest"] = f"sha1:{row.get('payload_digest') or digest(payload)}"
    if row["record_type"] == "revisit":
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{row['refers_to']}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    whole = GZIP.size + len(body) + 8
    return GZIP.pack(31, 139, 8, 4, 0, 0, 255, 20, b"SL", 16, whole, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.gzip = options["path"].rstrip("/"), options.get("compression", "gzip") == "gzip"
        self.level, self.max_bytes = int(options.get("level", 3)), int(options.get("max_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        files, out, size = [], None, 0
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: " + DATE.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n"
        try:
            for batch in iterator:
                columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    if out is None or size >= self.max_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                        fs.create_dir(root, recursive=True)
                        out, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                        files.append(name)
                        first = info % uuid.uuid4().hex.encode()
                        out.write(member(first, self.level) if self.gzip else first)
                    data = record({name: column[i].as_py() for name, column in columns.items()})
                    data = member(data, self.level) if self.gzip else data
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_COMMITTED") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{name}")


#: Record types whose block begins with HTTP headers.
WITH_HTTP = ("response", "request", "revisit")


@dataclass
class Archives(InputPartition):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload, self.verify = options.get("payload", "true") == "true", options.get("verify", "false") == "true"
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.equal: dict[str, set] = {}
        self.prefix: dict[str, str] = {}

    def pushFilters(self, filters):
        """Equalities and sets on header columns, and prefixes of them, are decided on the headers; the rest is Spark's."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.equal[column] = self.equal.get(column, {f.value}) & {f.value}
            elif column in HEADERS and isinstance(f, In):
                self.equal[column] = self.equal.get(column, set(f.value)) & set(f.value)
            elif column in HEADERS and isinstance(f, StringStartsWith) and column not in self.prefix:
                self.prefix[column] = f.value
            else:
                yield f

    def partitions(self) -> list[Archives]:
        from pyarrow import fs as arrow_fs

        fs, root = filesystem(self.path)
        info = {x.base_name: x for x in fs.get_file_info(arrow_fs.FileSelector(root)) if x.is_file}
        names = sorted(x for x in info if x.endswith((".warc", ".warc.gz")))
        if "_COMMITTED" in info:
            with fs.open_input_stream(f"{root}/_COMMITTED") as source:
                names = json.loads(source.read())
        parts, size = [Archives([])], 0
        for name in names:
            if size and size + info[name].size > self.split_bytes:
                parts.append(Archives([]))
                size = 0
            parts[-1].files.append(name)
            size += info[name].size
        return parts

    def wanted(self, row: dict) -> bool:
        return all(row[c] in v for c, v in self.equal.items()) and all((row[c] or "").startswith(v) for c, v in self.prefix.items())

    def headers(self, text: bytes) -> tuple[dict, int] | None:
        """The row of a record's headers and its Content-Length; None for a record that no filter asks for."""
        lines = (line.split(":", 1) for line in text.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
        fields = {name.strip().lower(): value.strip() for name, value in lines}
        row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else None
        row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"a record without a length: {text[:80]!r}")
        length = int(fields["content-length"])
        # What describes the archive itself only comes where it is asked for.
        keep = self.wanted(row) and (row["record_type"] != "warcinfo" or "record_type" in self.equal)
        return (row, length) if keep else (None, length)

    def finish(self, row: dict, block: bytes, length: int) -> dict:
        """The row with what its block, of which the HTTP headers at least are here, says: a response's or request's payload
        comes after its HTTP headers, other records' payload is their block; a revisit has none, only the size in its headers."""
        http = row["record_type"] in WITH_HTTP
        head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        row["payload"] = payload if self.payload else None
        row["payload_bytes"] = length - len(block) + len(payload)
        if row["record_type"] == "revisit":
            size = head.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0].strip() if b"content-length:" in head.lower() else b""
            row["payload_bytes"], row["payload"] = int(size) if size.isdigit() else None, None
        elif self.verify and row["payload_digest"] and digest(payload) != row["payload_digest"]:
            raise ValueError(f"payload of {row['record_id']} differs from its digest")
        return row

    def whole(self, row: dict) -> bool:
        """Whether a record's block is needed as a whole."""
        return self.payload or self.verify or row["record_type"] == "revisit"

    def record(self, source, compressed: bool) -> tuple[bool, dict | None]:
        """Whether there is another record, and its row if it is wanted. source stands at its start, then behind it. An
        archive that ends within a record is an error."""

        def read(n: int) -> bytes:
            found = source.read(n)
            if not found:
                raise EOFError(f"the archive ends within the record at byte {start}")
            return found

        start = source.tell()
        if compressed:
            head = source.read(GZIP.size)
            if not head:
                return False, None
            known = len(head) == GZIP.size and head[3] == 4 and head[12:14] == b"SL"
            whole = GZIP.unpack(head)[-2] if known else None
            inflate = zlib.decompressobj(31)
            data, more = b"", head
            while b"\r\n\r\n" not in data:
                more = more or read(2048)
                data += inflate.decompress(more, 4096)
                more = inflate.unconsumed_tail
                if inflate.eof and b"\r\n\r\n" not in data:
                    raise ValueError(f"no record at byte {start}")
            top, _, block = data.partition(b"\r\n\r\n")
            row, length = self.headers(top)
            if row is not None:
                while len(block) < length and (self.whole(row) or (row["record_type"] in WITH_HTTP and b"\r\n\r\n" not in block)):
                    if inflate.eof:
                        raise EOFError(f"the record at byte {start} is shorter than its length")
                    block += inflate.decompress(more or read(1 << 16), 1 << 20)
                    more = inflate.unconsumed_tail
                row = self.finish(row, block[:length], length)
            if whole is None:
                while not inflate.eof:
                    inflate.decompress(more or read(1 << 16), 1 << 20)
                    more = inflate.unconsumed_tail
                whole = source.tell() - start - len(inflate.unused_data)
            source.seek(start + whole)
            return True, row
        data = source.read(2048)
        while data and not data.strip(b"\r\n"):  # blank lines after the last record
            data = source.read(2048)
        if not data:
            return False, None
        while b"\r\n\r\n" not in data:
            data += read(2048)
        at = data.index(b"\r\n\r\n") + 4
        row, length = self.headers(data[: at - 4])
        if row is not None:
            source.seek(start + at)
            block = b""
            while len(block) < length and (self.whole(row) or (row["record_type"] in WITH_HTTP and b"\r\n\r\n" not in block)):
                block += read(min(length - len(block), 1 << 20 if self.whole(row) else 1024))
            row = self.finish(row, block, length)
        source.seek(start + at + length + 4)
        return True, row

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        rows, size = [], 0
        for name in partition.files:
            with io.BufferedReader(fs.open_input_file(f"{root}/{name}"), 1 << 18) as source:
                more = True
                while more:
                    more, row = self.record(source, name.endswith(".gz"))
                    if row is not None:
                        rows.append(row)
                        size += 512 + len(row["payload"] or b"")
                    if size >= self.batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """WARC records of pages (page_id, url, html): of equal payloads of at least min_bytes, the smallest page_id is the
    response and the others revisit it. Rows that repeat that page_id are responses too; a null page_id sorts last.

    Only digests are grouped; the payloads are joined by page, so a payload that many pages share makes no hot task.
    """
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    keys = pages.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    copies = keys.join(firsts, "digest").where("page_id IS NULL OR page_id <> first").distinct()
    copies = copies.select(F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"), "first")
    found = pages.join(copies, F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("digest") == F.col("copy_digest")), "left")
    revisit = F.col("first").isNotNull()
    return found.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        base32("digest").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(hex_column: str):
    """A 40-digit hex string in upper-case base32: each five hex digits are four letters."""
    return F.expr(
        f"array_join(transform(sequence(0, 31), i -> substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
        f"(shiftright(cast(conv(substring({hex_column}, (i div 4) * 5 + 1, 5), 16, 10) as int), cast(15 - 5 * (i % 4) as int)) & 31) + 1, 1)), '')"
    )


def write(df: DataFrame, path: str, **options) -> None:
    df.sparkSession.dataSource.register(WarcSource)
    df.write.format("warc").mode("append").options(**options).save(path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of the archives under path; filters on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written as WARC archives in the shared folder, and their records read back with digests verified."""
    path = common.new_path(spark, "warc")
    write(records(common.read(spark, sf_dir, "pages")), path)
    found = load(spark, path, payload="false", verify="true").where(F.col("record_type").isin("response", "revisit"))

    def page(column: str):
        return F.nullif(F.regexp_replace(column, "^urn:page:", ""), F.lit("")).cast("long")

    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(t)) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
