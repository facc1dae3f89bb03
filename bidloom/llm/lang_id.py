"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword of +1 and -1. For every bit a binary classifier of hashed byte n-grams (weights: the log
ratio of the n-gram's mean share in the languages with +1 and in those with -1) gives a margin; the decoded language is
the one whose codeword has the least weighted logistic loss against the margins, and a prediction whose runner-up is
within ``AMBIGUOUS`` of it is flagged. Up to six languages have the exhaustive code of 2^(L-1) - 1 bits, more have a
seeded dense random code with the widest least distance of some tries.

Training counts come from at most about ``TRAIN_ROWS`` labelled documents, chosen by a hash of doc_id; texts are read
whole, in blocks, in training and in prediction. The model is a fixed number of floats per bit.

Edge cases: a text that is null or has no letter is ``und`` with score 0; ties go to the smaller language name; rows
that repeat are predicted alike; no labelled rows at all make every prediction ``und``; a null doc_id is not held out;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

#: Documents that the classifiers are fitted on, at most about so many.
TRAIN_ROWS = 20_000
ORDERS, SLOTS, BLOCK = (2, 3), 1 << 16, 1 << 19
AMBIGUOUS, SHARPNESS = 0.05, 12.0

#: Bytes of n-grams: lower-case ASCII letters and all of UTF-8's other bytes; the rest are one blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def slots(data: np.ndarray, order: int) -> np.ndarray:
    """The table slots of the n-grams that start at each byte of data but the last order - 1."""
    key = data[: len(data) - order + 1].astype(np.uint32)
    for i in range(1, order):
        key = (key << np.uint32(8)) | data[i : len(data) - order + 1 + i]
    return (key & np.uint32(SLOTS - 1)) if order == 2 else (key * np.uint32(2654435761)) >> np.uint32(16)


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Folded bytes of at most about BLOCK, with the rows that they belong to and where those rows start.

    Each text is set between blanks; one longer than a block is cut, and its pieces overlap so that no n-gram is lost.
    """
    over = max(ORDERS) - 1
    parts, rows, size = [], [], 0
    for row, text in enumerate(texts):
        data = f" {text or ''} ".lower().encode("utf-8", "replace")
        for at in range(0, max(1, len(data) - over), BLOCK):
            piece = data[at : at + BLOCK + over]
            parts.append(piece)
            rows.append(row)
            size += len(piece)
            if size >= BLOCK:
                yield _block(parts, rows)
                parts, rows, size = [], [], 0
    if parts:
        yield _block(parts, rows)


def _block(parts: list[bytes], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return FOLD[np.frombuffer(b"".join(parts), np.uint8)], np.array(rows), starts


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, slot, n) of a task's labelled texts."""
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in set(langs):
            own = [t for t, k in zip(texts, langs, strict=True) if k == lang and has_letter(t)]
            table = tables.setdefault(lang, np.zeros(len(ORDERS) * SLOTS, np.int64))
            for data, _, _ in blocks(own):
                for i, order in enumerate(ORDERS):
                    table[i * SLOTS : (i + 1) * SLOTS] += np.bincount(slots(data, order), minlength=SLOTS)
    for lang, table in tables.items():
        used = np.flatnonzero(table)
        yield pa.record_batch({"lang": pa.array([lang] * len(used), pa.string()), "slot": pa.array(used, pa.int64()), "n": pa.array(table[used], pa.int64())})


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 for each of n languages."""
    if n <= 6:
        bits = np.arange(1, 2 ** (n - 1))
        return np.array([np.ones(len(bits), int)] + [1 - 2 * ((bits >> i) & 1) for i in range(n - 1)])
    draws = [np.random.default_rng(seed + i).choice([-1, 1], (n, int(np.ceil(10 * np.log2(n))))) for i in range(50)]
    apart = [min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)) for c in draws]
    return draws[int(np.argmax(apart))]


class Model:
    """Codewords, one column of n-gram weights a bit, the bits' scales and weights."""

    def __init__(self, langs: list[str], table: np.ndarray):
        """table: counts by language and slot."""
        self.langs, self.codes = langs, codewords(len(langs))
        share = np.concatenate([_shares(table[:, i * SLOTS : (i + 1) * SLOTS]) for i in range(len(ORDERS))], axis=1)
        plus = (self.codes > 0).T.astype(float)
        minus = 1 - plus
        # Mean shares of each bit's two sides; weights are their log ratios.
        ratio = np.log(plus @ share / plus.sum(1, keepdims=True)) - np.log(minus @ share / minus.sum(1, keepdims=True)) if len(langs) > 1 else np.zeros((0, share.shape[1]))
        expected = (share @ ratio.T) * self.codes if len(langs) > 1 else np.zeros((1, 0))
        self.scale = 1 / np.maximum(expected.mean(0), 1e-9)
        trust = np.maximum((expected * self.scale).min(0), 0.05)
        self.trust = trust / max(trust.sum(), 1e-9)
        self.weights = np.ascontiguousarray(ratio, np.float32)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The scaled mean weight of each text's n-grams, by bit."""
        total, n = np.zeros((len(self.weights), len(texts))), np.zeros(len(texts))
        for data, rows, starts in blocks(texts):
            for i, order in enumerate(ORDERS):
                slot, table = slots(data, order), self.weights[:, i * SLOTS : (i + 1) * SLOTS]
                at = np.minimum(starts[:-1], len(slot) - 1)
                if i == 0:
                    np.add.at(n, rows, np.diff(starts))
                for bit in range(len(table)):
                    np.add.at(total[bit], rows, np.add.reduceat(table[bit][slot], at))
        return (total / np.maximum(n, 1)).T * self.scale

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's place, its score, and whether the runner-up is close, by row of margins."""
        agree = margins[:, None, :] * self.codes[None, :, :]
        loss = (np.logaddexp(0, -2 * np.clip(agree, -4, 4)) * self.trust).sum(2)
        best = loss.argmin(1)
        like = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
        near = np.partition(loss, 1, axis=1)[:, 1] - loss.min(1) < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, 1 / like.sum(1), near


def _shares(table: np.ndarray) -> np.ndarray:
    """Smoothed shares of the slots, by language."""
    table = table + 0.5
    return table / table.sum(1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """The model of labelled (doc_id, text, lang), fitted on about train_rows of them at most; None without any."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    share = train_rows / max(labelled.count(), 1)
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = labelled.select("lang", "text").mapInArrow(counts, "lang string, slot long, n long")
    # langs x slots rows at most, whatever the corpus holds
    rows = found.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.zeros((len(langs), len(ORDERS) * SLOTS))
    table[rows["lang"].map({k: i for i, k in enumerate(langs)}), rows["slot"]] = rows["n"]
    return Model(langs, table) if langs else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) with lang_pred, score and ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = np.array([has_letter(t) and model is not None for t in texts], bool)
            langs, scores, near = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known.any():
                at = np.flatnonzero(known)
                best, scores[at], near[at] = model.decode(model.margins([texts[i] for i in at]))
                for i, k in zip(at, best, strict=True):
                    langs[i] = model.langs[k]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores), "ambiguous": pa.array(near)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op9_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = common.read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
