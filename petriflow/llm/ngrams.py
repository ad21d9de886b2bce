"""Hashed n-gram indicators of whole texts, and a linear classifier on them (naive Bayes support vectors).

The feature space is bounded: byte 3-grams, 1- to 3-grams of token shapes (kind of first, second and last byte, length
class, and whether a token repeats the one before it), and optionally lower-cased words, each hashed into a part of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.llm.common import mix, utf8, words

TRIGRAMS, SHAPES, WORDS = 1 << 17, 1 << 15, 1 << 17
#: Texts are looked at in groups of about so many bytes.
PIECE_BYTES = 2 << 20

_KIND = np.full(256, 4, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[ord(c) for c in ".,;:?"]] = 3
_KIND[ord("!")] = 5
_KIND[128:] = 6


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each (one row at least)."""
    col = batch.column(batch.schema.get_field_index(text))
    _, off = utf8(col)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def indicators(col: pa.Array, with_words: bool = False) -> Iterator[tuple[np.ndarray, int]]:
    """For each row: the sorted indices of the n-grams that occur in its text, and its number of words."""
    data, off = utf8(col)
    row, s, e, h = words(data, off, lower=True)
    flags = np.zeros(TRIGRAMS + SHAPES + (WORDS if with_words else 0), bool)
    first, last = _KIND[data[s]].astype(np.uint64), _KIND[data[e - 1]].astype(np.uint64)
    size = e - s
    second = np.where(size > 1, _KIND[data[np.minimum(s + 1, max(len(data) - 1, 0))]], 7).astype(np.uint64) if len(s) else first
    long = np.searchsorted([2, 4, 12], size, side="right").astype(np.uint64)
    same = np.zeros(len(h), np.uint64)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape = (((first * np.uint64(8) + last) * np.uint64(8) + second) * np.uint64(4) + long) * np.uint64(2) + same + np.uint64(1)
    two, three = shape.copy(), shape.copy()
    two[1:] += shape[:-1] << np.uint64(12)
    three[2:] += (shape[1:-1] << np.uint64(12)) + (shape[:-2] << np.uint64(24))
    grams = [TRIGRAMS + (mix(x + np.uint64(k << 40)) % np.uint64(SHAPES)).astype(np.int64) for k, x in enumerate((shape, two, three))]
    edges = np.searchsorted(row, np.arange(len(off))).tolist()
    for i in range(len(off) - 1):
        a, b = edges[i], edges[i + 1]
        for k, g in enumerate(grams):
            flags[g[min(a + k, b) : b]] = True
        if with_words:
            flags[TRIGRAMS + SHAPES + (h[a:b] % np.uint64(WORDS)).astype(np.int64)] = True
        for at in range(int(off[i]), int(off[i + 1]) - 2, 1 << 20):
            x = data[at : min(int(off[i + 1]), at + (1 << 20) + 2)].astype(np.uint32)
            code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
            flags[(code * np.uint32(0x9E3779B1)) >> np.uint32(15)] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found, b - a


@dataclass
class Linear:
    """Margin of a text: sum of `weights` over its n-grams, over the norm of their `scales`, plus `bias`."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = float(self.squares[found].sum()) ** 0.5
        return self.bias + (float(self.weights[found].sum()) / norm if norm else 0.0)

    def probability(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -35, 35))))


def fit(rows: list[np.ndarray], y: np.ndarray, dims: int, c: float = 4.0, epochs: int = 60, alpha: float = 1.0, seed: int = 7) -> Linear:
    """Log-count ratios scale the indicators, then dual coordinate descent fits a linear model by the hinge loss.

    y is 0 or 1. With no rows the probability is 1/2; with one class only, it is that class's smoothed share.
    """
    n, ones = len(rows), int(y.sum())
    if not 0 < ones < n:
        return Linear(np.zeros(dims, np.float32), np.zeros(dims, np.float32), 0.0, 0.0, float(np.log((ones + 1) / (n - ones + 1))))
    counts = np.full((2, dims), alpha)
    for x, k in zip(rows, y, strict=True):
        counts[int(k), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts == alpha).all(axis=0)] = 0
    short = ratio.astype(np.float32)
    values = [v / norm if (norm := float(np.sqrt(v @ v))) else v for v in (short[x] for x in rows)]
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, c * n / (2 * ones), c * n / (2 * (n - ones)))
    w, b, dual = np.zeros(dims), 0.0, np.zeros(n)
    diagonal = np.array([v @ v for v in values]) + 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(n).tolist():
            x, v = rows[i], values[i]
            g = sign[i] * (w[x] @ v + b) - 1
            new = min(max(dual[i] - g / diagonal[i], 0.0), cost[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                dual[i] = new
                w[x] += step * v
                b += step
                most = max(most, abs(g))
        if most < 1e-3:
            break
    out = Linear((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), b, 1.0, 0.0)
    m = np.array([w[x] @ v for x, v in zip(rows, values, strict=True)]) + b
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit on margins
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -35, 35)))
        d, s = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[s @ (m * m) + 1e-3, s @ m], [s @ m, s.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([d @ m, d.sum()]))
        slope, shift = slope - float(np.clip(step[0], -2, 2)), shift - float(np.clip(step[1], -2, 2))
    out.slope, out.shift = max(slope, 0.0), shift
    return out


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int, with_words: bool, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """Indicators and labels of `most` labelled rows (columns id, y), picked by the hash of the id; bounded by `most` on both sides."""
    picked = labels.where("id is not null and y is not null").distinct().orderBy(F.xxhash64("id"), "id", "y").limit(most)
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                found = [x.astype(np.int32) for x, _ in indicators(b.column(2), with_words)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["id", "y", "found"])

    kind = joined.schema["id"].dataType.simpleString()
    got = joined.mapInArrow(run, f"id {kind}, y int, found array<int>").orderBy(F.xxhash64("id"), "id", "y").limit(most).toArrow()
    found = got.column("found").combine_chunks()
    flat, off = found.values.to_numpy(), found.offsets.to_numpy()
    rows, y = [flat[a:b].copy() for a, b in zip(off, off[1:], strict=False)], got.column("y").to_numpy().copy()
    del got, found, flat
    pa.default_memory_pool().release_unused()
    return rows, y
