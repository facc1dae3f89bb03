"""Katz backoff scoring of texts: Good-Turing discounted counts, exactly normalised backoff weights.

P(w | h) is d(c) c(h, w) / c(h) where the pair was seen in training, else alpha(h) P(w), with alpha(h) such that the
probabilities of all words and of the unknown word add up to 1; P(w) is d(c) c(w) / N, and what the discounts free is
P(unknown). Counts up to ``MOST_DISCOUNTED`` are discounted by Good and Turing's estimate. Where a history would keep no
mass, its denominator is one more.

Words and pairs of all words count, without limit; the start of a text is a history like a word. The order is 2, so that
backing off is one step.

Texts become batches of about ``BATCH`` characters, stored once as numbers of the batch's own words. A batch asks for the
counts of its words, then of its pairs, then for its histories' backoff weights, and each time sends every key once,
whatever the key's frequency, with what the batch adds to it. Keys are 64-bit hashes, dealt out by themselves: a part adds
up its share of the table and answers each batch in the order it asked. So no part grows with how often a word or pair
occurs, only with the number of batches that have it, and parts grow in number with the corpus (``KEYS`` keys or so each).
A pair counts for its history's mass once, in the batch that the pair's part names its owner.

Edge cases: a null or blank text has one token, its end; texts are read whole; repeated rows count and are scored each
on their own; without training texts all words are unknown, with probability 1; a null doc_id trains; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common, tokens

MOST_DISCOUNTED = 5
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Characters of texts that make up a batch; keys that a part gets on average.
BATCH, KEYS = 1 << 23, 1 << 21


def sequences(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of texts: their range, their tokens' hashes with an end after each text, and each token's text."""
    for low, high in tokens.groups(texts):
        words, at = tokens.word_hashes(texts[low:high])
        yield low, high, np.insert(words, at[1:], END), np.repeat(np.arange(high - low), np.diff(at) + 1)


class Discount:
    """Good-Turing discounts from the numbers of keys seen 1, 2, ... times; half a count where the estimate fails."""

    def __init__(self, times: dict[int, int], k: int = MOST_DISCOUNTED):
        n = [times.get(r, 0) for r in range(k + 2)]
        self.factors = np.ones(k + 1)
        tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
            self.factors[r] = d if 0 < d < 1 else 1 - 0.5 / r

    def kept(self, c: np.ndarray) -> np.ndarray:
        return c * np.where(c < len(self.factors), self.factors[np.minimum(c, len(self.factors) - 1)], 1.0)


class Words:
    """Probabilities of single words, from the totals of their table."""

    def __init__(self, totals: list[int]):
        self.tokens, self.distinct = totals[:2]
        times = dict(enumerate(totals[2:], 1))
        self.discount = Discount(times)
        lost = sum((1 - self.discount.factors[r]) * r * times.get(r, 0) for r in range(1, MOST_DISCOUNTED + 1))
        # Without any mass for unknown words, the denominator is one more.
        self.whole = self.tokens if lost > 0 else self.tokens + 1
        self.unknown = 1 - (self.tokens - lost) / self.whole if self.tokens else 1.0

    def chance(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words seen c times."""
        return np.where(c > 0, self.discount.kept(c) / max(self.whole, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of keys by part, and each part with its range of that order."""
    part = part_of(keys, parts).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.concatenate((np.flatnonzero(np.diff(part, prepend=part[:1] + 1)), [len(part)])) if len(part) else [0]
    return order, [(int(part[a]), int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)]


BATCHES = "batch long, ids array<long>, flags array<boolean>, lengths binary, words binary, train binary, tokens binary, n_words long, n_tokens long"


def small(x: np.ndarray) -> bytes:
    """Whole numbers, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def large(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4")[:, 0]


def batched(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as batches: their words, the most frequent first, with the start, and the words' numbers for each token."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for record in records:
        ids, texts, flags = (record.column(c).to_pylist() for c in ("doc_id", "text", "held_out"))
        for low, high in list(tokens.groups(texts, BATCH)):
            found, lengths = [], []
            for a, b, token, owner in sequences(texts[low:high]):
                found.append(token)
                lengths.append(np.bincount(owner, minlength=b - a))
            token, lengths = np.concatenate(found), np.concatenate(lengths)
            words, place, times = np.unique(token, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            place = rank[place]
            learns = ~np.array(flags[low:high], bool)
            train = np.bincount(place, np.repeat(learns, lengths), len(words)).astype(np.int64)
            words, train = np.append(words[order], START), np.append(train, learns.sum())
            number += 1
            yield pa.RecordBatch.from_pylist([{
                "batch": number, "ids": ids[low:high], "flags": flags[low:high], "lengths": lengths.astype(np.int32).tobytes(), "words": words.tobytes(),
                "train": small(train), "tokens": small(place), "n_words": len(words), "n_tokens": len(token),
            }], pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), *((c, pa.binary()) for c in ("lengths", "words", "train", "tokens")), ("n_words", pa.int64()), ("n_tokens", pa.int64())]))


class Batch:
    """A stored batch: words, tokens as places in them, and the distinct pairs of history and token."""

    def __init__(self, row: dict):
        self.row = row
        self.words, self.lengths = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["lengths"], np.int32)
        self.tokens = large(row["tokens"], row["n_tokens"])
        self.owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.learns = ~np.array(row["flags"], bool)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs' histories, words and keys, and each token's pair."""
        history = np.roll(self.tokens, 1)
        history[np.cumsum(self.lengths) - self.lengths] = len(self.words) - 1
        code, place = np.unique(history * np.int64(len(self.words)) + self.tokens, return_inverse=True)
        h, w = np.divmod(code, len(self.words))
        return h, w, tokens.mixed(self.words[h] * np.uint64(tokens.BASE) + self.words[w]), place


ASKED = "part int, batch long, keys binary, counts binary"
ANSWERS = "kind int, batch long, part int, low binary, big binary, log_alpha binary, totals array<long>"
ANSWER = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("part", pa.int32()), ("low", pa.binary()), ("big", pa.binary()), ("log_alpha", pa.binary()), ("totals", pa.list_(pa.int64()))])
WORD, PAIR, HISTORY = 0, 1, 2
#: The batch of a part's totals.
TOTALS = -1


def asked(batch: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    order, cells = dealt(keys, parts)
    keys, counts = keys[order], counts[order].astype(np.int32)
    return pa.record_batch({
        "part": pa.array([p for p, _, _ in cells], pa.int32()), "batch": pa.array([batch] * len(cells), pa.int64()),
        "keys": pa.array([keys[a:b].tobytes() for _, a, b in cells], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for _, a, b in cells], pa.binary()),
    })


def asked_words(records: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for record in records:
        for row in record.to_pylist():
            yield asked(row["batch"], np.frombuffer(row["words"], np.uint64), large(row["train"], row["n_words"]), parts)


def asked_pairs(records: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for record in records:
        for i in range(record.num_rows):
            batch = Batch(record.slice(i, 1).to_pylist()[0])
            _, _, keys, place = batch.pairs()
            yield asked(batch.row["batch"], keys, np.bincount(place, batch.learns[batch.owner], len(keys)), parts)


def ranges(sizes: list[int]) -> list[tuple[int, int]]:
    ends = np.cumsum([0, *sizes])
    return list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def totalled(rows: pa.Table, kind: int) -> pa.Table:
    """A part's answers: twice each key's total, one more in the batch that owns the key; and the part's totals."""
    numbers, asked = rows.column("batch").to_pylist(), rows.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(asked), np.uint64)
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int32)
    own, first, place = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(place, counts, len(own)).astype(np.int64)
    value = 2 * total[place]
    value[first] += 1
    out = [_answer(kind, b, rows.column("part")[0].as_py(), value[x:y]) for b, (x, y) in zip(numbers, ranges([len(k) // 8 for k in asked]), strict=True)]
    total = total[own != START]
    out.append({"kind": kind, "batch": TOTALS, "totals": [int(total.sum()), int((total > 0).sum()), *np.bincount(total[total <= MOST_DISCOUNTED + 1], minlength=MOST_DISCOUNTED + 2)[1:].tolist()]})
    return pa.Table.from_pylist(out, ANSWER)


def _answer(kind: int, batch: int, part: int, value: np.ndarray) -> dict:
    """A byte each; the values beyond a byte follow by themselves."""
    return {"kind": kind, "batch": batch, "part": part, "low": np.minimum(value, 255).astype(np.uint8).tobytes(), "big": value[value >= 255].tobytes()}


def told(answers: list[dict], kind: int, order: np.ndarray, column: str = "low") -> np.ndarray:
    """What the parts answered on the keys that were sent in this order."""
    rows = sorted((r for r in answers if r["kind"] == kind), key=lambda r: r["part"])
    if column == "low":
        value = np.frombuffer(b"".join(r["low"] for r in rows), np.uint8).astype(np.int64)
        value[value == 255] = np.frombuffer(b"".join(r["big"] for r in rows), np.int64)
    else:
        value = np.frombuffer(b"".join(r[column] for r in rows), np.float64)
    out = np.empty(len(order), value.dtype)
    out[order] = value
    return out


MASSES = "part int, batch long, keys binary, n binary, known binary, below binary"


class Model:
    """What tells a batch its probabilities: the words' and pairs' totals, and the numbers of parts."""

    def __init__(self, words: Words, discount: Discount, word_parts: int, pair_parts: int):
        self.words, self.discount, self.word_parts, self.pair_parts = words, discount, word_parts, pair_parts

    def _told(self, left: pa.Table, right: pa.Table):
        batch, answers = Batch(left.to_pylist()[0]), right.to_pylist()
        order, cells = dealt(batch.words, self.word_parts)
        seen = told(answers, WORD, order) >> 1
        h, w, keys, place = batch.pairs()
        pair = told(answers, PAIR, dealt(keys, self.pair_parts)[0])
        return batch, answers, order, cells, seen, h, w, pair, place

    def masses(self, left: pa.Table, right: pa.Table) -> pa.Table:
        """For a batch's words as histories, what the pairs that the batch owns add to their known mass."""
        batch, _, order, cells, seen, h, w, pair, _ = self._told(left, right)
        own = (pair & 1 == 1) & (pair > 1)
        h, w, pair = h[own], w[own], pair[own] >> 1
        columns = {"keys": batch.words, "n": seen, "known": np.bincount(h, self.discount.kept(pair), len(seen)), "below": np.bincount(h, self.words.chance(seen[w]), len(seen))}
        columns = {c: x[order] for c, x in columns.items()}
        return pa.table({"part": pa.array([p for p, _, _ in cells], pa.int32()), "batch": pa.array([batch.row["batch"]] * len(cells), pa.int64())} | {c: pa.array([x[a:b].tobytes() for _, a, b in cells], pa.binary()) for c, x in columns.items()})

    def scores(self, left: pa.Table, right: pa.Table) -> pa.Table:
        batch, answers, order, _, seen, h, _, pair, place = self._told(left, right)
        # A text starts as often as it ends; the start's own count is that of the texts.
        whole = seen + told(answers, HISTORY, order)
        log_alpha, pair = told(answers, HISTORY, order, "log_alpha"), pair >> 1
        known = np.log10(np.maximum(self.discount.kept(pair), 1e-300) / np.maximum(whole[h], 1))
        c = seen[batch.tokens]
        log_p = np.where(pair[place] > 0, known[place], log_alpha[h[place]] + np.log10(self.words.chance(c)))
        sums = lambda x: np.bincount(batch.owner, x, len(batch.lengths))
        return pa.table({
            "doc_id": pa.array(batch.row["ids"], pa.int64()), "held_out": pa.array(batch.row["flags"], pa.bool_()), "n_tokens": pa.array(batch.lengths.astype(np.int64)),
            "n_known": pa.array(sums(c > 0).astype(np.int64)), "base_score": pa.array(sums(self.words.base(c))), "score": pa.array(sums(log_p)),
        })


def weighed(rows: pa.Table) -> pa.Table:
    """A part's answers on histories: log10 alpha, and 1 where the denominator is one more."""
    numbers, asked = rows.column("batch").to_pylist(), rows.column("keys").to_pylist()
    keys, n, known, below = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("n", np.int64), ("known", np.float64), ("below", np.float64)))
    own, first, place = np.unique(keys, return_index=True, return_inverse=True)
    known, below = (np.bincount(place, x, len(own)) for x in (known, below))
    full = n[first] - known <= 1e-9
    alpha = np.where(n[first] > 0, (1 - known / np.maximum(n[first] + full, 1)) / np.maximum(1 - below, 1e-12), 1.0)
    log_alpha, full = np.log10(alpha)[place], full[place].astype(np.int64)
    part = rows.column("part")[0].as_py()
    return pa.Table.from_pylist([_answer(HISTORY, b, part, full[x:y]) | {"log_alpha": log_alpha[x:y].tobytes()} for b, (x, y) in zip(numbers, ranges([len(k) // 8 for k in asked]), strict=True)], ANSWER)


def totals(answers: DataFrame) -> list[int]:
    row = answers.where(F.col("batch") == TOTALS).agg(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(MOST_DISCOUNTED + 3)]).first()
    return [int(x) for x in row]


def scored(docs: DataFrame) -> tuple[DataFrame, Model]:
    """docs (doc_id, text, held_out) with n_tokens, n_known, base_score and score (log10 of the text's probability) under
    the model of those that are not held out; and what is known of that model."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches = common.stored(docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out")).mapInArrow(batched, BATCHES), "batches")
    size = batches.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    word_parts, pair_parts = (max(least, -(-int(n) // KEYS)) for n in size)
    words = batches.select("batch", "words", "train", "n_words").mapInArrow(lambda b: asked_words(b, word_parts), ASKED)
    words = common.stored(words.groupBy("part").applyInArrow(lambda t: totalled(t, WORD), ANSWERS), "words")
    pairs = batches.mapInArrow(lambda b: asked_pairs(b, pair_parts), ASKED)
    pairs = common.stored(pairs.groupBy("part").applyInArrow(lambda t: totalled(t, PAIR), ANSWERS), "pairs")
    model = Model(Words(totals(words)), Discount(dict(enumerate(totals(pairs)[2:], 1))), word_parts, pair_parts)
    answers = [words.where(F.col("batch") != TOTALS), pairs.where(F.col("batch") != TOTALS)]

    def joined(function, schema: str) -> DataFrame:
        return batches.groupBy("batch").cogroup(reduce(DataFrame.unionByName, answers).groupBy("batch")).applyInArrow(function, schema)

    masses = joined(lambda left, right: model.masses(left, right), MASSES)
    answers.append(common.stored(masses.groupBy("part").applyInArrow(weighed, ANSWERS), "histories"))
    return joined(lambda left, right: model.scores(left, right), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a model of those that are not held out."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    found, model = scored(docs)
    return found.withColumn("train_tokens", F.lit(model.words.tokens).cast("long"))
