"""Personal data by patterns and a skip-chain conditional random field.

Base spans are what four patterns match and their checks accept. The field adds mentions that no pattern takes: its
nodes are a text's base spans, whose labels are fixed, and the other stretches that hold a digit or an at sign; edges
join neighbours in the text, and skip edges join distant nodes that repeat each other (the same last seven digits, the
same four parts of a shorter IP, the same token whatever its case, or the part of an address before its at sign). Loopy belief propagation spreads labels
over a text's whole graph. A node becomes a span if it is linked by skip edges to a base span and its label is not
"other" with a belief of ``BELIEF`` or more, so a text without base spans is left alone.

Weights are fitted by pseudo-likelihood on at most about ``SAMPLE_ROWS`` documents (of more, distinct texts chosen by a
hash of the text): base spans, degraded copies of them linked by skip edges, and other nodes. Nodes of one label and the
same features are counted where they are found; the driver gets at most ``FORMS`` kinds of nodes with their numbers. Repeats of one token are joined one to the next,
so that edges grow with the text. Patterns run in time linear in the text, however long its runs are.

Edge cases: a null text counts as empty and has no spans; offsets are code points, ends exclusive; repeated rows have
equal spans; without base spans in the sample no span is added; an empty table gives an empty result; other columns pass
through ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1
SAMPLE_ROWS, FORMS, BELIEF, NEAR = 10_000, 100_000, 0.9, 40
#: Messages that have not settled after so many rounds are taken as they are.
ROUNDS = 25

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts within a run of digits, for the run's start would match too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
TOKEN = re.compile(r"[^\s,;:!?\"'<>()\[\]]+(?:[(\[](?:at|AT|@)[)\]][^\s,;:!?\"'<>()\[\]]+)?")
TAIL = re.compile(r"[0-9]{3}[\x20.-]?[0-9]{4}$")
#: A short IP, or its repeat with hyphens.
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}|[0-9]+(?:-[0-9]+){3}")
AT = re.compile(r"@|[(\[](?:at|AT|@)[)\]]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What the address pattern matches: from each at sign as far back as local characters reach, and the domain."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), in order."""
    if not HINT.search(text):
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        number = digits(m[0])
        if 12 <= len(number) <= 19 and luhn(number):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def features(mention: str) -> list[float]:
    number = digits(mention)
    n, dots, at = len(number), mention.count("."), bool(AT.search(mention))
    letters = any(c.isalpha() for c in mention)
    parts = mention.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts)
    shape = [n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 19, n > 19]
    return [float(x) for x in (1, at, at and dots > 0, letters, letters and n > 0, *shape, dots == 0, dots == 1, dots == 3, dots > 3, quad, mention[:1] == "+", mention[:1] == "(", "-" in mention, " " in mention, bool(TAIL.search(mention)), n >= 12 and n <= 19 and luhn(number))]


def keys(mention: str) -> list[str]:
    """What a mention shares with those that repeat it."""
    number, folded = digits(mention), mention.casefold().strip(".")
    found = [f"d{number[-7:]}"] if len(number) >= 7 else []
    if not found and QUAD.fullmatch(mention):
        found.append("q" + mention.replace("-", "."))
    if any(c.isalpha() for c in folded):
        name = AT.split(folded, maxsplit=1)[0]
        found += [f"t{x}" for x in {folded, name} if len(x) >= 5 and (x != name or any(not c.isalpha() for c in x))]
    return found


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, label, end) of the base spans and, labelled OTHER, of the other stretches with a digit or an at sign."""
    found, at = list(base), 0
    gaps = []
    for a, _, b in base:
        if a > at:
            gaps.append((at, a))
        at = max(at, b)
    gaps.append((at, len(text)))
    for a, b in gaps:
        for m in TOKEN.finditer(text, a, b):
            if HINT.search(m[0]) and any(c.isalpha() for c in m[0]):
                found.append((m.start(), OTHER, m.start() + len(m[0].rstrip("."))))
        for m in NUMBER.finditer(text, a, b):
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if not (before.isalnum() or after.isalnum() or after == "@" or before in ("=", "@")):
                found.append((m.start(), OTHER, m.end()))
    return sorted(found)


def edges(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges and skip edges between places of nodes."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][2] <= NEAR]
    last: dict[str, int] = {}
    skip = set()
    for i, (a, _, b) in enumerate(found):
        for key in keys(text[a:b]):
            if key in last and last[key] != i:
                skip.add((last[key], i))
            last[key] = i
    return chain, sorted(skip)


def degraded(mention: str, kind: int) -> list[str]:
    """Forms in which a text may repeat a base span and that no pattern takes."""
    number = digits(mention)
    if kind == 0:
        name, _, domain = mention.partition("@")
        return [name, f"{name}(at){domain}", f"{name}@{domain.split('.')[0]}"]
    if kind == 3:
        return [number, number[-10:], f"{number[-7:-4]}-{number[-4:]}", mention.partition(" ")[2] or number]
    return [f"{number[:-4]}.{number[-4:]}" if kind == 2 else mention.replace(".", "-"), number]


def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, x) of nodes: features, then how many chain and skip neighbours have each label."""
    for batch in batches:
        labels, rows = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            if not base:
                continue
            found = nodes(text, base)
            chain, skip = edges(text, found)
            beside = np.zeros((len(found), 2 * LABELS))
            for pairs, shift in ((chain, 0), (skip, LABELS)):
                for i, j in pairs:
                    beside[i, shift + found[j][1]] += 1
                    beside[j, shift + found[i][1]] += 1
            for i, (a, label, b) in enumerate(found):
                if label == OTHER and beside[i, LABELS : LABELS + OTHER].any():
                    continue  # a repeat of a base span: what the field is to find out
                labels.append(label)
                rows.append(features(text[a:b]) + beside[i].tolist())
                for form in degraded(text[a:b], label) if label != OTHER else ():
                    linked = np.zeros(2 * LABELS)
                    linked[LABELS + label] = 1
                    labels.append(label)
                    rows.append(features(form) + linked.tolist())
        yield pa.record_batch({"label": pa.array(labels, pa.int32()), "x": pa.array(rows, pa.list_(pa.float64()))})


class Taken:
    """Stretches of a text that spans cover."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        """Takes a stretch that was free."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


class Field:
    """Weights of the node features and of the labels on either side of chain and skip edges."""

    def __init__(self, x: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3):
        """x: features of kinds of nodes, y: their labels, times: how many nodes are of each kind."""
        self.fitted = len(y) > 0 and bool((y != OTHER).any())
        n = len(features(""))
        weights = np.zeros((n + 2 * LABELS, LABELS))
        for _ in range(steps if self.fitted else 0):
            z = x @ weights
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            weights -= rate * (x.T @ (p * times[:, None]) / times.sum() + ridge * weights)
        self.node, self.chain, self.skip = weights[:n], *(self.even(weights[n + s : n + s + LABELS]) for s in (0, LABELS))

    @staticmethod
    def even(table: np.ndarray) -> np.ndarray:
        """An edge's potential, which does not depend on its direction."""
        return (table + table.T) / 2

    def beliefs(self, text: str, found: list[tuple[int, int, int]], chain, skip) -> np.ndarray:
        """Each node's label probabilities, by loopy sum-product message passing with base spans held fixed."""
        local = np.array([features(text[a:b]) for a, _, b in found]) @ self.node
        for i, (_, label, _) in enumerate(found):
            if label != OTHER:
                local[i] = -50.0
                local[i, label] = 50.0
        pairs = np.array(chain + skip, int).reshape(-1, 2)
        tables = np.exp(np.concatenate((np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0))))
        source, target = np.concatenate((pairs[:, 0], pairs[:, 1])), np.concatenate((pairs[:, 1], pairs[:, 0]))
        tables = np.concatenate((tables, tables))
        back = np.concatenate((np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))))
        messages = np.full((len(source), LABELS), -np.log(LABELS))
        for _ in range(ROUNDS):
            total = local.copy()
            np.add.at(total, target, messages)
            send = total[source] - messages[back]
            send = np.exp(send - send.max(1, keepdims=True))
            new = np.log(np.maximum(np.einsum("el,elk->ek", send, tables), 1e-300))
            new -= np.log(np.exp(new - new.max(1, keepdims=True)).sum(1, keepdims=True)) + new.max(1, keepdims=True)
            change = np.abs(new - messages).max(initial=0)
            messages = 0.5 * messages + 0.5 * new
            if change < 1e-4:
                break
        total = local.copy()
        np.add.at(total, target, messages)
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The base spans and those that the field adds, in order."""
        if not base or not self.fitted:
            return base
        found = nodes(text, base)
        chain, skip = edges(text, found)
        if not any(found[i][1] == OTHER or found[j][1] == OTHER for i, j in skip):
            return base
        linked = self.reached(found, skip)
        belief = self.beliefs(text, found, chain, skip)
        added, taken = [], Taken(base)
        for i in sorted(linked, key=lambda i: (found[i][0] - found[i][2], found[i][0])):
            a, label, b = found[i]
            best = int(belief[i].argmax())
            if label == OTHER and best != OTHER and belief[i, best] >= BELIEF and taken.free(a, b):
                added.append((a, best, b))
                taken.add(a, b)
        return sorted(base + added)

    @staticmethod
    def reached(found, skip) -> set[int]:
        """The nodes that skip edges link, over any number of steps, to a base span."""
        beside = defaultdict(list)
        for i, j in skip:
            beside[i].append(j)
            beside[j].append(i)
        todo = [i for i in beside if found[i][1] != OTHER]
        seen = set(todo)
        while todo:
            for j in beside[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return seen


def sampled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The texts of docs, or of more than sample_rows rows about as many distinct texts at most, by a hash of the text."""
    share = sample_rows / max(docs.count(), 1)
    texts = docs.select("text").where("text IS NOT NULL")
    if share >= 1:
        return texts
    hashed = texts.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    return hashed.dropDuplicates(["h"]).drop("h")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, forms: int = FORMS) -> Field:
    """The field fitted on about sample_rows of docs (text) at most, and at most forms kinds of nodes, chosen by a hash."""
    kinds = sampled(docs, sample_rows).mapInArrow(examples, "label int, x array<double>").groupBy("label", "x").agg(F.count("*").alias("n"))
    rows = kinds.orderBy(F.xxhash64("label", "x"), "label", "x").limit(forms).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, len(features("")) + 2 * LABELS)
    y, n = rows.column("label").to_numpy(), rows.column("n").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return Field(x[order], y[order], n[order])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def found(docs: DataFrame, field: Field) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = defaultdict(list)
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = field.spans(text or "", base)
                for i, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(k == i for _, k, _ in base))
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(spans))
                out["n_added"].append(len(spans) - len(base))
            types = {"base_sha256": pa.string(), "spans": pa.string()}
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or what overlapping ones cover together, as the name of its first kind in angle brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with the spans of ``text`` masked; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked(t, field.spans(t, base_spans(t))) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return found(docs, fit(docs))
