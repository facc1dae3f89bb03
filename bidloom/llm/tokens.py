"""Word and shingle hashes of whole texts, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def groups(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size characters together; a longer text is a range of its own."""
    start, n = 0, 0
    for i, text in enumerate(texts):
        n += len(text or "")
        if n >= size:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def ranges(texts: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """The same by bytes, of a column whose texts are not read for it: the texts after a range's first have less than size bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(texts)] if len(texts) else []
    yield from zip(cuts, cuts[1:], strict=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than SPACE, A-Z lower-cased) of all texts in order, and
    the place of each text's first word; the last place is the number of words."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(data))[starts])
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    return hashes, np.searchsorted(starts, begins)


def shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of width words, and where each text's begin; a text with fewer words has one."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    short = (n > 0) & (n < width)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for i in range(width):
        rolled = mixed(rolled * np.uint64(BASE) + words[i : i + len(rolled)])
    # A window starts at each word but the last width - 1 of a text.
    full = np.maximum(n - width + 1, 0)
    first = np.concatenate(([0], np.cumsum(np.where(short, 1, full))))
    out = np.zeros(first[-1], np.uint64)
    keep = np.repeat(at[:-1], full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    mine = np.repeat(~short, np.where(short, 1, full))
    out[mine] = rolled[keep]
    for i in np.flatnonzero(short):
        value = np.array([n[i]], np.uint64)
        for w in words[at[i] : at[i + 1]]:
            value = mixed(value * np.uint64(BASE) + w)
        out[first[i]] = value[0]
    return out, first
