"""Repeated substrings by recompression.

Token runs get names, then rounds name pairs: a hash of the symbol's name puts each symbol left or right for a round, and a
left symbol followed by a right one merges. Names are hashes of what they stand for, so equal substrings get equal symbols
everywhere, except near their ends, where a merge may depend on what lies outside; each symbol carries how many words to its
left and right it depends on. A symbol whose name occurs nowhere else proves that no window holding it and what it
depends on repeats. The windows that no such symbol rules out are compared by 128 bits of their words; so equal names only
choose what to verify, and the result is exact.

Defined results: null and empty texts have 0 words and the hash of an empty string; texts shorter than a window keep all
words; copies of a text remove all words that their windows cover, in each copy; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.llm.common import mix, powers, save, words
from petriflow.llm.exchange import ask, buckets_for, cuts, expand, gather, pack, pack_numbers, shared_bits, text_blocks, unblock

WINDOW, ROUNDS = 35, 6
_FAR = 1 << 20
_RUN, _PAIR = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F)


def symbols(h: np.ndarray, row: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Name, first word, end, and words needed to the left and right of each symbol after all rounds."""
    if not len(h):
        z = np.zeros(0, np.int64)
        return h, z, z, z, z
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(h))
    size = (end - start).astype(np.uint64)
    name = np.where(size > 1, mix(h[start] + _RUN * size), h[start])
    doc = row[start]
    inner = doc[1:] == doc[:-1]
    left, right = np.full(len(name), _FAR), np.full(len(name), _FAR)
    left[1:][inner] = 1
    right[:-1][inner] = 1
    for r in range(rounds):
        goes_left = (mix(name + np.uint64((r + 1) * int(_PAIR) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        merge = np.zeros(len(name), bool)
        merge[:-1] = goes_left[:-1] & ~goes_left[1:] & (doc[1:] == doc[:-1])
        size = end - start
        first = np.ones(len(name), bool)
        first[1:] = ~merge[:-1]
        i = np.flatnonzero(first)
        j = i + merge[i]
        l_new = np.maximum(left[i], np.where(j > i, left[j] - size[i], 0))
        r_new = np.maximum(right[j], np.where(j > i, right[i] - size[j], 0))
        total = end[j] - start[i]
        # a right symbol needs to know that what precedes it doesn't go left
        p = np.maximum(i - 1, 0)
        has = (i > 0) & (doc[p] == doc[i])
        needs = ~goes_left[i]
        l_new = np.where(needs, np.where(has, np.maximum(l_new, size[p] + left[p]), _FAR), l_new)
        r_new = np.where(needs & has, np.maximum(r_new, right[p] - total), r_new)
        # a left symbol needs to know that what follows it doesn't go right
        q = np.minimum(j + 1, len(name) - 1)
        has = (j + 1 < len(name)) & (doc[q] == doc[j])
        needs = goes_left[j]
        r_new = np.where(needs, np.where(has, np.maximum(r_new, size[q] + right[q]), _FAR), r_new)
        l_new = np.where(needs & has, np.maximum(l_new, left[q] - total), l_new)
        name = np.where(j > i, mix(name[i] * _PAIR + name[j] + np.uint64(r + 1)), name[i])
        start, end, doc = start[i], end[j], doc[i]
        left, right = np.minimum(l_new, _FAR), np.minimum(r_new, _FAR)
    return name, start, end, left, right


def open_windows(row: np.ndarray, unique: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, window: int) -> np.ndarray:
    """First words of the windows that no unique symbol rules out."""
    n = len(row)
    if n < window:
        return np.zeros(0, np.int64)
    fits = np.zeros(n, bool)
    fits[: n - window + 1] = row[: n - window + 1] == row[window - 1 :]
    lo, hi = (end + right - window)[unique], (start - left)[unique]
    good = lo <= hi
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(lo[good], 0), 1)
    np.add.at(change, hi[good] + 1, -1)
    return np.flatnonzero(fits & (np.cumsum(change[:-1]) == 0))


def window_hashes(h: np.ndarray, at: np.ndarray, window: int, mult: int) -> np.ndarray:
    p = powers(mult, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p.up[: len(h)], out=total[1:])
    return mix((total[at + window] - total[at]) * p.down[at])


class _Block:
    """The words, symbols and candidate windows of one packed block."""

    def __init__(self, line: dict, window: int, rounds: int) -> None:
        self.window = window
        self.data, self.off = unblock(line["sizes"], line["body"])
        self.row, self.s, self.e, self.h, self.h2 = words(self.data, self.off, lower=False, second=True)
        self.parsed = symbols(self.h, self.row, rounds)
        self.names, self.inverse, self.counts = np.unique(self.parsed[0], return_inverse=True, return_counts=True)

    def open(self, bits: np.ndarray) -> None:
        unique = (~bits & (self.counts == 1))[self.inverse]
        self.at = open_windows(self.row, unique, *self.parsed[1:], self.window)
        a, b = window_hashes(self.h, self.at, self.window, 0x9FB21C651E98DF25), window_hashes(self.h2, self.at, self.window, 0xD1B54A32D192ED03)
        order = np.lexsort([b, a])
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first = np.flatnonzero(new)
        self.keys, self.more = a[order][first], b[order][first]
        times = np.diff(np.append(first, len(a)))
        self.group = np.empty(len(a), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.again = times > 1


def _runs(block: pa.Scalar, keys: np.ndarray, more: np.ndarray | None, buckets: int) -> list[pa.RecordBatch]:
    at = cuts(keys, buckets)
    full = np.flatnonzero(np.diff(at))
    cols = [pa.array(full, pa.int32()), pa.array([block.as_py()] * len(full), pa.int64()), pa.array([pack(keys[at[i] : at[i + 1]]) for i in full], pa.binary())]
    names = ["bucket", "block", "keys"]
    if more is not None:
        cols.append(pa.array([pack_numbers(more[at[i] : at[i + 1]]) for i in full], pa.binary()))
        names.append("more")
    return [pa.RecordBatch.from_arrays(cols, names)]


def _bits(keys: np.ndarray, answers: pa.Scalar, buckets: int) -> np.ndarray:
    """The answers to a block's keys as one array."""
    out, at = np.zeros(len(keys), bool), cuts(keys, buckets)
    for x in answers.values or []:
        i = x["bucket"].as_py()
        n = at[i + 1] - at[i]
        out[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(expand(x["bits"].as_py()), np.uint8), count=n).astype(bool)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_words, n_removed, kept): kept is the text of the words that no repeated window covers, joined by one space."""
    blocks = save(text_blocks(docs, id_col, text_col), "blocks")
    buckets = buckets_for(blocks)

    def names_of(line: dict) -> list[pa.RecordBatch]:
        return _runs(line["block"], _Block(line, window, rounds).names, None, buckets)

    first = gather(shared_bits(ask(blocks, names_of, "bucket int, block long, keys binary")), "names", "bucket", "bits")
    first = save(first, "shared")

    def windows_of(line: dict) -> list[pa.RecordBatch]:
        b = _Block(line, window, rounds)
        b.open(_bits(b.names, line["names"], buckets))
        return _runs(line["block"], b.keys, b.more, buckets)

    known = blocks.join(first, "block", "left").select("block", "sizes", "body", "names")
    second = gather(shared_bits(ask(known, windows_of, "bucket int, block long, keys binary, more binary"), second=True), "windows", "bucket", "bits")
    known = blocks.join(first, "block", "left").join(second, "block", "left").select("ids", "sizes", "body", "names", "windows")

    def kept_of(line: dict) -> Iterator[pa.RecordBatch]:
        b = _Block(line, window, rounds)
        b.open(_bits(b.names, line["names"], buckets))
        repeated = b.again | _bits(b.keys, line["windows"], buckets)
        at = b.at[repeated[b.group]]
        cover = np.zeros(len(b.h) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        edges = np.searchsorted(b.row, np.arange(len(b.off))).tolist()
        body, kept, n_words, n_gone = b.data.tobytes(), [], [], []
        for x, y in zip(edges, edges[1:], strict=False):
            n_words.append(y - x)
            n_gone.append(int(gone[x:y].sum()))
            if not n_gone[-1]:
                lo, hi = (int(b.s[x]), int(b.e[y - 1])) if y > x else (0, 0)
                kept.append(b" ".join(body[lo:hi].split()))
            else:
                stay = np.flatnonzero(~gone[x:y]) + x
                kept.append(b" ".join([body[s:e] for s, e in zip(b.s[stay].tolist(), b.e[stay].tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays([line["ids"].values, pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = ask(known, kept_of, f"id {kind}, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.decode("kept", "UTF-8"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
