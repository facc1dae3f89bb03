"""Removing repeated byte strings: a depth-limited, most-significant-digit-first radix grouping of suffixes.

Only the first ``length`` bytes of a suffix count, so suffixes are grouped, not sorted: equal groups at that depth are
exactly the repeated strings. The digits, each of which leaves only groups of two and more for the next:

1. the anchor: the ``GRAM`` bytes with the least hash within the suffix's first ``length`` bytes (the leftmost of
   equals), which equal strings share at one place; consecutive suffixes with one anchor make one row, a span;
2. the span: all bytes that its suffixes reach over. A span that was seen before is removed whole;
3. the core: the first of each of several spans around one anchor falls into blocks of suffixes whose distances to the
   anchor agree but for the last three bits; equal suffixes have equal bytes in all that the suffixes of a block share;
4. the ``length`` bytes themselves, one row a suffix of a block whose core another one has.

A group is never gathered: each pass aggregates the least place of every digit and joins it back. Digits are 64-bit
hashes beside the anchor's, 128 bits in all (the core, which only decides what the last digit looks at, has 64). Texts
are read whole, in segments of ``SEGMENT`` bytes that overlap by length - 1, so that long ones take no more memory.

Edge cases: a null text is empty; a text shorter than ``length`` keeps all its bytes; places are ordered by doc_id
(null last), then a hash of the text, then the start; rows that repeat both doc_id and text are one document, and each
of them has its result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common, tokens

LENGTH, GRAM, SEGMENT, BLOCK = 100, 32, 1 << 20, 8
BYTE = tokens.mixed(np.arange(1, 257, dtype=np.uint64))
_INVERSE = np.zeros(0, np.uint64)
_POWER = np.zeros(0, np.uint64)


class Rolled:
    """Hashes of any stretches of some bytes."""

    def __init__(self, data: np.ndarray):
        global _INVERSE, _POWER
        if len(_POWER) < len(data):
            _POWER, _INVERSE = tokens.powers(tokens.BASE, len(data)), tokens.powers(tokens.INVERSE, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * _POWER[: len(data)], out=self.sums[1:])

    def hashes(self, starts, ends) -> np.ndarray:
        return tokens.mixed((self.sums[ends] - self.sums[starts]) * _INVERSE[starts])


def segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about SEGMENT together; for each piece of a text in them its row, its start here and its start in the text."""
    parts, rows, froms, size = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            part = text[at : at + SEGMENT + length - 1]
            if len(part) >= length:
                parts.append(part)
                rows.append(row)
                froms.append(at)
                size += len(part)
            if size >= SEGMENT:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.cumsum([0] + [len(p) for p in parts]), np.array(froms)
                parts, rows, froms, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.cumsum([0] + [len(p) for p in parts]), np.array(froms)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if width > have else out


def spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, span, doc, tie, lo, n, d): the n suffixes from byte lo on that share an anchor, which is d bytes after lo."""
    for batch in batches:
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
        docs, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
        for data, rows, begins, froms in segments(texts, length):
            roll = Rolled(data)
            at = np.arange(len(data) - GRAM + 1)
            gram = roll.hashes(at, at + GRAM)
            # 40 bits of hash, then the place: the least is the leftmost of the least hashes.
            least = sliding_min((gram & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64), length - GRAM + 1)
            anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
            piece = np.repeat(np.arange(len(rows)), np.diff(begins))[: len(anchor)]
            start = np.flatnonzero(np.arange(len(anchor)) + length <= begins[1:][piece])
            new = np.ones(len(start), bool)
            new[1:] = (np.diff(anchor[start]) != 0) | (np.diff(piece[start]) != 0)
            lo = start[new]
            n = np.diff(np.concatenate((np.flatnonzero(new), [len(start)])))
            owner = piece[lo]
            yield pa.record_batch({
                "anchor": pa.array(gram[anchor[lo]].view(np.int64)),
                "span": pa.array(tokens.mixed(roll.hashes(lo, lo + n - 1 + length) + n.astype(np.uint64)).view(np.int64)),
                "doc": pa.array(docs[rows[owner]]), "tie": pa.array(ties[rows[owner]]),
                "lo": pa.array((lo - begins[owner] + froms[owner]).astype(np.int32)), "n": pa.array(n.astype(np.int32)), "d": pa.array((anchor[lo] - lo).astype(np.int32)),
            })


def stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[int, int, Rolled, int, dict[str, np.ndarray]]]:
    """For runs of the rows listed in ``open``, in order of lo: the document, its tie, the hashes of the bytes that they
    reach over, the first of these bytes, and the rows' columns."""
    for batch in batches:
        texts, docs, ties, lists = (batch.column(c) for c in ("text", "doc", "tie", "open"))
        ends = lists.offsets.to_numpy()
        fields = {f.name: lists.values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(lists.type.value_type)}
        for row in range(batch.num_rows):
            data = np.frombuffer(texts[row].as_py().encode("utf-8", "replace"), np.uint8)
            mine = {c: x[ends[row] : ends[row + 1]] for c, x in fields.items()}
            order = np.argsort(mine["lo"], kind="stable")
            mine = {c: x[order] for c, x in mine.items()}
            at = 0
            while at < len(order):
                low = int(mine["lo"][at])
                to = max(at + 1, int(np.searchsorted(mine["lo"], low + SEGMENT)))
                part = {c: x[at:to] for c, x in mine.items()}
                high = int((part["lo"].astype(np.int64) + part["n"]).max()) - 1 + length
                yield docs[row].as_py(), ties[row].as_py(), Rolled(data[low:high]), low, part
                at = to


def gathered(found: Iterator[dict[str, np.ndarray]], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Small groups of rows as larger record batches."""
    held, size = [], 0
    for part in found:
        held.append(part)
        size += len(part["doc"])
        if size >= rows:
            yield pa.record_batch({c: pa.array(np.concatenate([x[c] for x in held])) for c in part})
            held, size = [], 0
    if held:
        yield pa.record_batch({c: pa.array(np.concatenate([x[c] for x in held])) for c in held[0]})


def blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (core, anchor, doc, tie, lo, n): the blocks of the spans listed in ``open``, and the hash of what each shares."""

    def rows():
        for doc, tie, roll, low, part in stretches(batches, length):
            lo, n, far = (part[c].astype(np.int64) for c in ("lo", "n", "d"))
            least, most = (far - n + 1) // BLOCK, far // BLOCK
            times = most - least + 1
            span = np.repeat(np.arange(len(lo)), times)
            block = least[span] + np.arange(len(span)) - np.repeat(np.cumsum(times) - times, times)
            anchor, place = part["anchor"][span], lo[span] + far[span] - low
            core = place - BLOCK * block
            digit = tokens.mixed(roll.hashes(core, core - BLOCK + 1 + length) + anchor.view(np.uint64) * np.uint64(tokens.BASE) + block.astype(np.uint64))
            first = np.minimum(BLOCK * block + BLOCK - 1, far[span])
            last = np.maximum(BLOCK * block, (far - n + 1)[span])
            yield {
                "core": digit.view(np.int64), "anchor": anchor, "doc": np.full(len(span), doc, np.int64), "tie": np.full(len(span), tie, np.int32),
                "lo": (place - first + low).astype(np.int32), "n": (first - last + 1).astype(np.int32),
            }

    yield from gathered(rows())


def suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, digit, doc, tie, start) for each suffix of the blocks listed in ``open``."""

    def rows():
        for doc, tie, roll, low, part in stretches(batches, length):
            n = part["n"].astype(np.int64)
            start = np.repeat(part["lo"].astype(np.int64) - low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            digit = roll.hashes(start, start + length).view(np.int64)
            yield {"anchor": np.repeat(part["anchor"], n), "digit": digit, "doc": np.full(len(start), doc, np.int64), "tie": np.full(len(start), tie, np.int32), "start": (start + low).astype(np.int32)}

    yield from gathered(rows())


def cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tie, n_removed, n_spans, kept_sha256, kept_text) from the stretches in ``seen`` and suffixes in ``starts``."""
    for batch in batches:
        out = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, seen, starts in zip(*(batch.column(c).to_pylist() for c in ("text", "seen", "starts")), strict=True):
            data = text.encode("utf-8", "replace")
            gone = np.zeros(len(data) + 1, np.int32)
            lows = np.array([s["lo"] for s in seen or ()] + list(starts or ()), np.int64)
            ends = np.array([s["lo"] + s["n"] - 1 + length for s in seen or ()] + [s + length for s in starts or ()], np.int64)
            np.add.at(gone, lows, 1)
            np.add.at(gone, ends, -1)
            gone = np.cumsum(gone[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        yield pa.record_batch({"doc": batch.column("doc"), "tie": batch.column("tie")} | {k: pa.array(v, pa.binary() if k == "kept" else pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of docs (doc_id, text), rows (doc, tie, n_removed, n_spans, kept_sha256, kept) for the texts that lose bytes."""
    docs = keyed(docs)
    every = docs.mapInArrow(lambda b: spans(b, length), "anchor long, span long, doc long, tie int, lo int, n int, d int")
    # First digit.
    twice = common.stored(every.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "twice")
    every = common.stored(every.join(twice, "anchor", "left_semi"), "anchors")
    # Second digit: the first place of each span; later ones are seen.
    place = F.struct("doc", "tie", "lo")
    firsts = common.stored(every.groupBy("anchor", "span").agg(F.min(F.struct("doc", "tie", "lo", "n", "d")).alias("first")), "spans")
    seen = every.join(firsts, ["anchor", "span"]).where(place > F.struct("first.doc", "first.tie", "first.lo"))
    seen = seen.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "n")).alias("seen"))
    # Stored, so that Spark can split the join at an anchor of very many spans.
    several = common.stored(firsts.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "several")
    rest = firsts.join(several, "anchor", "left_semi").select("anchor", "first.*")
    rest = rest.groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "lo", "n", "d")).alias("open"))
    todo = common.stored(seen.join(rest, ["doc", "tie"], "full"), "todo")
    common.removed(twice), common.removed(every), common.removed(firsts)
    texts = common.stored(docs.join(todo, ["doc", "tie"]), "texts")
    common.removed(todo)
    # Third digit.
    cores = texts.where("open IS NOT NULL").select("doc", "tie", "text", "open").mapInArrow(lambda b: blocks(b, length), "core long, anchor long, doc long, tie int, lo int, n int")
    cores = common.stored(cores, "cores")
    shared = cores.groupBy("core").agg(F.count("*").alias("times")).where("times > 1").select("core")
    rest = cores.join(common.stored(shared, "shared"), "core", "left_semi").groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "lo", "n")).alias("open"))
    rest = common.stored(rest, "open")
    common.removed(cores)
    # Fourth digit.
    place = F.struct("doc", "tie", "start")
    last = texts.select("doc", "tie", "text").join(rest, ["doc", "tie"]).mapInArrow(lambda b: suffixes(b, length), "anchor long, digit long, doc long, tie int, start int")
    last = common.stored(last, "suffixes")
    first = common.stored(last.groupBy("anchor", "digit").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"), "digits")
    later = last.join(first, ["anchor", "digit"]).where(place > F.col("first")).groupBy("doc", "tie").agg(F.collect_list("start").alias("starts"))
    later = common.stored(later, "later")
    common.removed(last), common.removed(first)
    texts = texts.drop("open").join(later, ["doc", "tie"], "left").where("seen IS NOT NULL OR starts IS NOT NULL")
    return texts.select("text", "seen", "starts", "doc", "tie").mapInArrow(lambda b: cut(b, length), "doc long, tie int, n_removed long, n_spans long, kept_sha256 string, kept binary")


def keyed(docs: DataFrame) -> DataFrame:
    """docs as (doc, tie, text): the order of documents, and their texts."""
    return docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.hash(F.coalesce("text", F.lit(""))).alias("tie"), F.coalesce("text", F.lit("")).alias("text"))


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = repeats(docs, length).drop("kept").dropDuplicates(["doc", "tie"])
    whole = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.hash("text").alias("tie"))
    none = F.lit(0).cast("long")
    return whole.join(found, ["doc", "tie"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that start earlier elsewhere."""
    return removed(common.read(spark, sf_dir, "documents"))
