"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, whitespace markers.

``Vocabulary`` holds pieces with log scores and their trie. Spaces become U+2581, one is put before the text, and the
segmentation with the greatest sum of scores is found; a character that no piece covers is spelt in byte pieces. The
first best wins ties (the longer last piece). Where no piece has a marker behind another character, a text falls apart
before each run of markers and the parts are segmented alone: the parts that a task has met are kept in a cache of
bounded size, and new ones are segmented together, with numpy stepping all of them through the trie at once. Long parts
(text without spaces) are segmented one by one.

Decoding joins pieces, turns byte pieces into bytes and markers into spaces and drops the first space; bytes that are
not UTF-8 become U+FFFD.

Edge cases: a null text has null ids, an empty one none; texts are read whole whatever their length; repeated rows are
encoded alike; an empty table gives an empty result; other columns pass through ``encode``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bidloom.llm import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Parts kept in a task's cache; bytes of the longest part that is segmented together with others; parts at a time.
CACHE, SHORT, TOGETHER = 400_000, 48, 20_000
UNKNOWN_PENALTY = 10.0


class Trie:
    """Double array: state s goes on with byte b to base[s] + code[b] if check[] there is s; value[] is the piece that ends.

    Codes number the bytes by how often pieces hold them, so that a state's cells lie close together.
    """

    def __init__(self, pieces: dict[bytes, int]):
        often = np.bincount(np.frombuffer(b"".join(pieces), np.uint8), minlength=256)
        self.code = np.argsort(np.argsort(-often, kind="stable"), kind="stable").astype(np.int32)
        pieces = {bytes(self.code[list(p)].astype(np.uint8)): i for p, i in pieces.items()}
        keys = sorted(pieces)
        self.base, self.check, self.value = (np.full(1 << 20, fill, np.int32) for fill in (0, -1, -1))
        self.check[0] = 0
        self.used, free = 1, 1
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            if low < high and len(keys[low]) == depth:
                self.value[state] = pieces[keys[low]]
                low += 1
            if low == high:
                continue
            runs, start = [], low
            for i in range(low + 1, high + 1):
                if i == high or keys[i][depth] != keys[start][depth]:
                    runs.append((keys[start][depth], start, i))
                    start = i
            labels = np.array([r[0] for r in runs])
            while self.check[free] >= 0:
                free += 1
            # First fit near the first free cell; a node that finds no place soon goes behind all others.
            base = max(1, free - int(labels[0]))
            for step in range(40):
                if (self.check[base + step + labels] < 0).all():
                    base += step
                    break
            else:
                base = self.used
            if base + 1024 >= len(self.check):
                self._grow()
            self.base[state] = base
            self.check[base + labels] = state
            self.used = max(self.used, base + int(labels[-1]) + 1)
            todo += [(base + c, a, b, depth + 1) for c, a, b in runs]
        self.base, self.check, self.value = (x[: self.used + 256].copy() for x in (self.base, self.check, self.value))

    def _grow(self) -> None:
        self.base, self.check, self.value = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))


class Vocabulary:
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """kinds: normal, byte, unknown, control or unused, by piece."""
        self.pieces, self.kinds = pieces, kinds
        self.scores = np.array(scores, np.float64)
        normal = {p.encode(): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        self.trie, self.longest = Trie(normal), max(map(len, normal), default=0)
        self.bytes = np.full(256, kinds.index("unknown") if "unknown" in kinds else 0, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == "byte":
                self.bytes[int(p[1:-1], 16)] = i
        self.unknown = min((self.scores[i] for i in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.splits = not any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds, strict=True) if k == "normal")
        spelt = {"normal": lambda p: p.replace(MARK, " ").encode(), "byte": lambda p: bytes([int(p[1:-1], 16)]), "unknown": lambda p: " ⁇ ".encode()}
        self.spelt = [spelt.get(k, lambda p: b"")(p) for p, k in zip(pieces, kinds, strict=True)]

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        """The pieces of a model file with log scores: its own if it is a unigram model's, else (merge ranks) Zipf's log probability of the rank."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = ["unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "unused" if model.is_unused(i) else "byte" if model.is_byte(i) else "normal" for i in ids]
        scores = [model.get_score(i) for i in ids]
        order = sorted((i for i in ids if kinds[i] == "normal"), key=lambda i: (-scores[i], i))
        if order and scores[order[0]] - scores[order[len(order) // 2]] > 1000:
            logs = -np.log(np.arange(len(order)) + 2.7)
            for i, log in zip(order, logs - np.log(np.exp(logs).sum()), strict=True):
                scores[i] = float(np.float32(log))
        return cls([model.id_to_piece(i) for i in ids], scores, kinds)

    def one(self, unit: bytes) -> list[int]:
        """The best segmentation of one part."""
        base, check, value, score, code = self._lists()
        n = len(unit)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            width, state, single = _width(unit[i]), 0, False
            for k in range(i, n):
                to = base[state] + code[unit[k]]
                if check[to] != state:
                    break
                state = to
                v = value[state]
                if v >= 0:
                    single |= k + 1 - i == width
                    if best[i] + score[v] > best[k + 1]:
                        best[k + 1], back[k + 1], piece[k + 1] = best[i] + score[v], i, v
            end = min(n, i + width)
            if not single and best[i] + self.unknown > best[end]:
                best[end], back[end], piece[end] = best[i] + self.unknown, i, -1
        return self._walk(unit, n, back, piece)

    def _lists(self):
        if not hasattr(self, "_listed"):
            self._listed = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.scores, self.trie.code))
        return self._listed

    def _walk(self, unit: bytes, end: int, back, piece) -> list[int]:
        ids = []
        while end:
            start = back[end]
            ids.append([piece[end]] if piece[end] >= 0 else self.bytes[list(unit[start:end])].tolist())
            end = start
        return [i for part in reversed(ids) for i in part]

    def many(self, units: list[bytes]) -> list[list[int]]:
        """The best segmentations of parts of SHORT bytes at most, all stepped through the trie together."""
        order = sorted(range(len(units)), key=lambda i: -len(units[i]))
        lens = np.array([len(units[i]) for i in order])
        n, longest = len(units), int(lens[0])
        text = np.frombuffer(b"".join(units[i].ljust(longest, b"\0") for i in order), np.uint8).reshape(n, longest).T
        code = self.trie.code[text]
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((longest + 1, n), np.int16), np.full((longest + 1, n), -1, np.int32)
        for i in range(longest):
            start = np.flatnonzero(best[i, : np.searchsorted(-lens, -i)] > -np.inf)
            width, single = WIDTH[text[i]], np.zeros(n, bool)
            now, state = start, np.zeros(len(start), np.int32)
            for k in range(i, longest):
                more = np.searchsorted(-lens, -k)
                if len(now) and now[-1] >= more:
                    cut = np.searchsorted(now, more)
                    now, state = now[:cut], state[:cut]
                to = base[state] + code[k, now]
                ok = check[to] == state
                now, state = now[ok], to[ok]
                if not len(now):
                    break
                found = value[state]
                has = found >= 0
                who, what = now[has], found[has]
                single[who[width[who] == k + 1 - i]] = True
                score = best[i, who] + self.scores[what]
                up = score > best[k + 1, who]
                who = who[up]
                best[k + 1, who], back[k + 1, who], piece[k + 1, who] = score[up], i, what[up]
            rest = start[~single[start]]
            end = np.minimum(i + width[rest], lens[rest])
            up = best[i, rest] + self.unknown > best[end, rest]
            rest, end = rest[up], end[up]
            best[end, rest], back[end, rest], piece[end, rest] = best[i, rest] + self.unknown, i, -1
        back, piece, out = back.T.tolist(), piece.T.tolist(), [[]] * n
        for row, i in enumerate(order):
            out[i] = self._walk(units[i], len(units[i]), back[row], piece[row])
        return out

    def parts(self, text: str) -> list[str]:
        text = MARK + text.replace(" ", MARK) if text else ""
        return UNIT.findall(text) if self.splits else [text] * bool(text)

    def decode(self, ids) -> str:
        spelt = self.spelt
        return b"".join([spelt[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


WIDTH = np.ones(256, np.int32)
WIDTH[0xC0:0xE0], WIDTH[0xE0:0xF0], WIDTH[0xF0:] = 2, 3, 4


def _width(byte: int) -> int:
    return int(WIDTH[byte])


class Encoder:
    """Encodes texts with a cache of parts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.cache = vocabulary, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.vocabulary.parts(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache = {}
        new = list(set().union(*split) - self.cache.keys())
        short = [u for u in new if len(u) <= SHORT // 4 or len(u.encode("utf-8", "replace")) <= SHORT]
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            for unit, ids in zip(some, self.vocabulary.many([u.encode("utf-8", "replace") for u in some]), strict=True):
                self.cache[unit] = np.array(ids, np.int32).tobytes()
        for unit in set(new) - set(short):
            self.cache[unit] = np.array(self.vocabulary.one(unit.encode("utf-8", "replace")), np.int32).tobytes()
        cache = self.cache
        return [np.frombuffer(b"".join([cache[u] for u in parts]), np.int32) for parts in split]


def chunks(texts: list[str | None], size: int = 1 << 20) -> Iterator[list[int]]:
    """Places of texts in groups of about size characters."""
    group, n = [], 0
    for i, text in enumerate(texts):
        group.append(i)
        n += len(text or "")
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """docs without the text, and with ``ids``, ``n_pieces``, ``n_byte_pieces`` and ``round_trip`` (decoding gives the text)."""
    names = {"ids", "n_pieces", "n_byte_pieces", "round_trip"}
    kept = [c for c in docs.columns if c != text and c not in names]
    kinds = np.array([k == "byte" for k in vocabulary.kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for group in chunks(texts):
                some = [texts[i] for i in group]
                ids = encoder.encode([t or "" for t in some])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids)
                null = np.array([t is None for t in some])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                lists = lists if not null.any() else pa.array([None if t is None else x for t, x in zip(some, ids, strict=True)], pa.list_(pa.int32()))
                same = [t is None or vocabulary.decode(x.tolist()) == t for t, x in zip(some, ids, strict=True)]
                out = {c: batch.column(c).take(pa.array(group)) for c in kept}
                out |= {"ids": lists, "n_pieces": pa.array(np.diff(ends).astype(np.int64)), "n_byte_pieces": pa.array([int(kinds[x].sum()) for x in ids], pa.int64()), "round_trip": pa.array(same)}
                yield pa.record_batch(out)

    fields = [docs.schema[c] for c in kept] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return docs.select(*kept, text).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """encoded without the ids and with ``text``."""
    kept = [c for c in encoded.columns if c not in (ids, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.record_batch({c: batch.column(c) for c in kept} | {"text": pa.array(texts, pa.string())})

    return encoded.select(*kept, ids).mapInArrow(run, T.StructType([encoded.schema[c] for c in kept] + [T.StructField("text", T.StringType())]))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, each checked by decoding it."""
    return encode(common.read(spark, sf_dir, "documents").select("doc_id", "text"), Vocabulary.load())
