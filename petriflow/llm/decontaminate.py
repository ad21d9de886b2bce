"""Benchmark decontamination by latent semantic retrieval.

Documents become sequences of the benchmark's terms. Overlapping passages get TF-IDF vectors over the terms of a block of items; a
distributed randomised SVD (subspace iteration: each task adds up its part of A'(A Q)) finds the RANK leading directions of the corpus'
passages; items take no part in it. Items are cut into parts no longer than half a passage. Candidates are, of all passages, those whose image in the
subspace has a cosine of COSINE or more with a part's (there words that keep the same company are near each other, so a reworded passage is near
its source, whichever words it keeps), and those that hold LOOSE_LCS or more of a part's words (a short item in other text turns away from its source). candidate counts if the longest common subsequence with the whole item has LCS of its words, or LOOSE_LCS of them and ANSWER of its closing
part, its answer; or, if the cosine is reached, LEAST_LCS of them and ANSWER of a closing part that has TELLING words which are in RARE of all
passages at most (answers of common words alone prove nothing). The last rule is asked of an item's last part, and only of passages that hold
enough words of the answer for it to be met.

The benchmark is a stated query set. Texts are read once for SPAN items, and become sequences of their terms; those are looked at for
blocks of ITEMS items, each with its own terms and subspace, so what a task holds is bounded by the block and not by the corpus.

Defined results: null and empty texts match nothing; items that are null or empty match nothing; repeated items each match; items
keep their ids, of any type; repeated rows match alike; without items there are no matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from petriflow.llm.common import save, utf8, words
from petriflow.llm.exchange import expand, squeeze
from petriflow.llm.ngrams import pieces

SPAN, ITEMS = 64 * 224, 224
#: Directions of the subspace, more that the range finder carries, and passes of subspace iteration.
RANK, MORE, PASSES = 64, 8, 2
COSINE, LCS, LOOSE_LCS, LEAST_LCS, ANSWER = 0.6, 0.8, 0.6, 0.25, 0.8
TELLING, RARE = 3, 0.01
_CHUNK, _NNZ = 256, 16384
#: Passages multiplied at a time, and the most frequent terms that are multiplied as columns of a dense matrix.
_ROWS, DENSE = 2048, 1024

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def term_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and hash of each term (letters and digits; Latin-1 letters in lower case), and the number of rows."""
    data, off = utf8(col)
    plain = _PLAIN[data]
    tail = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    plain[tail] += 0x20
    row, _, _, h = words(plain, off, lower=False)
    return row, h, len(off) - 1


class Block:
    """A block of items: their terms, term sequences, the passage stride, and their parts of one stride at most."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        row, h, n = term_hashes(pa.array([t or "" for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.terms, seq = np.unique(h, return_inverse=True)
        self.items = [seq[row == i] for i in range(n)]
        sizes = np.bincount(row, minlength=n)
        self.stride = int(np.clip(np.ceil(np.percentile(sizes, 90)) if n else 0, 8, 256))
        cut = [np.array_split(x, max(1, -(-len(x) // self.stride))) for x in self.items]
        self.parts = [x for c in cut for x in c]
        self.owner = np.repeat(np.arange(n), [len(c) for c in cut])
        self.kind = np.uint16 if len(self.terms) < 65535 else np.uint32
        self.none = np.iinfo(self.kind).max

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The block's number of each of the sorted terms, and `none` at the end, for words that are not among them."""
        out = np.full(len(terms) + 1, self.none, self.kind)
        out[np.searchsorted(terms, self.terms)] = np.arange(len(self.terms))
        return out

    def counts(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passage (numbered over all sequences), term and count of each entry, and the first passage of each sequence."""
        firsts = np.cumsum([0, *(-(-len(s) // self.stride) for s in seqs)])
        size = len(self.terms)
        keys, kind = [], np.int32 if int(firsts[-1] + 1) * (size + 1) < 1 << 31 else np.int64  # narrow keys sort faster
        for s, first in zip(seqs, firsts.tolist(), strict=False):
            at = np.flatnonzero(s != self.none)
            t = s[at].astype(kind)
            p = (at // self.stride).astype(kind)
            keys.append((p + first) * size + t)
            keys.append((p[p > 0] - 1 + first) * size + t[p > 0])
        keys, tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, kind), return_counts=True)
        row = keys // kind(max(size, 1))
        return row.astype(np.int64), (keys - row * kind(max(size, 1))).astype(np.int64), tf, firsts


def unit_rows(row: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values scaled so that each row (rows are sorted) has norm 1, and where rows begin."""
    if not len(row):
        return val, np.zeros(0, np.int64)
    begin = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
    norm = np.sqrt(np.add.reduceat(val * val, begin))
    return val / np.maximum(np.repeat(norm, np.diff(np.append(begin, len(row)))), 1e-30), begin


def _sums(begin: np.ndarray, values: np.ndarray | None, index: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each run of entries (they begin at `begin`) the sum of values * q[index] (None: 1), some _NNZ entries at a time."""
    edges, parts, lo = np.append(begin, len(index)), [np.zeros((0, q.shape[1]), np.float32)], 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + _NNZ, side="right")) - 1)
        s, e = int(edges[lo]), int(edges[hi])
        x = q[index[s:e]]
        if values is not None:
            x *= values[s:e, None]
        parts.append(np.add.reduceat(x, begin[lo:hi] - s, axis=0))
        lo = hi
    return np.concatenate(parts)


class Passages:
    """Some sparse rows (sorted by row, numbered from 0) over the block's terms; the terms `dense` are kept as columns of a dense matrix."""

    def __init__(self, row: np.ndarray, term: np.ndarray, val: np.ndarray, n: int, dense: np.ndarray, size: int) -> None:
        column = np.full(size, -1)
        column[dense] = np.arange(len(dense))
        at = column[term]
        inside = at >= 0
        self.dense, self.n, val = dense, n, val.astype(np.float32)
        self.matrix = np.zeros((n, len(dense)), np.float32)
        self.matrix[row[inside], at[inside]] = val[inside]
        self.row, self.term, self.val = row[~inside], term[~inside], val[~inside]

    def times(self, q: np.ndarray, held: bool = False) -> np.ndarray:
        """A q; held: with 1 for every value of A."""
        y = (self.matrix > 0).astype(np.float32) @ q[self.dense] if held else self.matrix @ q[self.dense]
        begin = np.flatnonzero(np.diff(self.row, prepend=-1))
        y[self.row[begin]] += _sums(begin, None if held else self.val, self.term, q)
        return y

    def images(self, q: np.ndarray) -> np.ndarray:
        """Images of norm 1 of the rows in the subspace q."""
        y = self.times(q)
        return y / np.maximum(np.sqrt((y**2).sum(axis=1, keepdims=True)), 1e-12)

    def add_back(self, y: np.ndarray, out: np.ndarray) -> None:
        """out += A' y."""
        out[self.dense] += self.matrix.T @ y
        order = np.argsort(self.term, kind="stable")
        terms = self.term[order]
        begin = np.flatnonzero(np.diff(terms, prepend=-1))
        out[terms[begin]] += _sums(begin, self.val[order], self.row[order], y)


def passages_of(term: np.ndarray, val: np.ndarray, begin: np.ndarray, dense: np.ndarray, size: int) -> Iterator[tuple[int, Passages]]:
    """The sparse rows that begin at `begin`, _ROWS at a time, with the place of the first."""
    edges = np.append(begin, len(term))
    for lo in range(0, len(begin), _ROWS):
        hi = min(lo + _ROWS, len(begin))
        s, e = int(edges[lo]), int(edges[hi])
        yield lo, Passages(np.repeat(np.arange(hi - lo), np.diff(edges[lo : hi + 1])), term[s:e], val[s:e], hi - lo, dense, size)


def gram_times(term: np.ndarray, val: np.ndarray, begin: np.ndarray, q: np.ndarray, out: np.ndarray, dense: np.ndarray) -> None:
    """out += A'(A q) for the sparse rows of A."""
    for _, a in passages_of(term, val, begin, dense, len(q)):
        a.add_back(a.times(q), out)


def lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    masks: dict[int, int] = {}
    for i, t in enumerate(item.tolist()):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for t in text.tolist():
        m = masks.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v & ~m)) & full
    return len(item) - v.bit_count()


def _placed(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The columns of flags at the places `at` of wider ones."""
    out = np.zeros((len(flags), len(at)), bool)
    out[:, at] = flags
    return out


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with their packed sequences."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part, [expand(x.as_py()) for x in part.column(1)]


def sequences(docs: DataFrame, terms: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, seq): each text as packed numbers of the sorted terms; len(terms) stands for any other word."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                row, h, n = term_hashes(part.column(1))
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                seq = np.where(terms[at] == h, at, len(terms)).astype(np.uint32)
                edges = np.searchsorted(row, np.arange(n + 1)).tolist()
                packed = [squeeze(seq[s:e].tobytes()) for s, e in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "seq"])

    return save(slim.mapInArrow(shorten, f"id {kind}, seq binary"), "sequences")


def find_block(known: DataFrame, terms: np.ndarray, items: list[tuple[object, str]], item_kind: pa.DataType, rank: int = RANK, seed: int = 3) -> list[DataFrame]:
    """Matches (id, item, cosine, lcs, answer) of one block of items in the sequences of the sorted terms, among which are the items'."""
    b = Block(items)
    if not len(b.terms):
        return []
    if len(b.parts) > ITEMS and len(items) > 1:
        by_size = [items[i] for i in np.argsort([len(x) for x in b.items], kind="stable")]
        return [x for half in (by_size[: len(items) // 2], by_size[len(items) // 2 :]) for x in find_block(known, terms, half, item_kind, rank, seed)]
    kind, to_block = known.schema["id"].dataType.simpleString(), b.numbers(terms)

    def sequence(packed: bytes) -> np.ndarray:
        return to_block[np.frombuffer(packed, np.uint32)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(b.terms) + 1, np.int64), 0
        for _, seqs in _sequences(batches):
            _, term, _, firsts = b.counts([sequence(s) for s in seqs])
            total[:-1] += np.bincount(term, minlength=len(b.terms))
            n += int(firsts[-1])
        total[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

    got = known.mapInArrow(spread, "term long, n long").groupBy("term").sum("n").toArrow()  # a row for each of the block's terms
    if not got.num_rows:
        return []
    df = np.zeros(len(b.terms) + 1)
    df[got.column(0).to_numpy()] = got.column(1).to_numpy()
    passages = max(float(df[-1]), 1.0)
    dense = np.argsort(-df[:-1], kind="stable")[:DENSE]
    idf = np.log((passages + len(b.parts)) / (df[:-1] + 1)).clip(1e-6)

    def closing(x: np.ndarray) -> np.ndarray:
        """The item's last quarter, and before it as much as makes TELLING rare words, or all."""
        rare = np.flatnonzero(df[x] <= RARE * passages)
        return x[min(max(len(x) - max(3, len(x) // 4), 0), int(rare[-TELLING]) if len(rare) >= TELLING else 0) :]

    answers = [closing(x) for x in b.items]

    def rows_of(seqs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        row, term, tf, firsts = b.counts(seqs)
        val, begin = unit_rows(row, tf * idf[term])
        return row, term, val, begin, firsts

    # parts as rows, one passage each
    item_keys, tf = np.unique(np.concatenate([i * len(b.terms) + s for i, s in enumerate(b.parts)]), return_counts=True)
    item_row, item_term = item_keys // len(b.terms), item_keys % len(b.terms)
    item_val, item_begin = unit_rows(item_row, tf * idf[item_term])
    held = np.zeros((len(b.terms), len(b.parts)), np.float32)  # the share of a part's words that a term is
    held[item_term, item_row] = tf / np.bincount(item_row, tf, len(b.parts))[item_row]

    told = np.zeros_like(held)  # the share of an item's answer that a term is, beside the item's last part
    for k, x in enumerate(answers):
        np.add.at(told, (x, int(np.searchsorted(b.owner, k, side="right")) - 1), 1 / max(len(x), 1))
    last = np.diff(b.owner, append=-1) != 0
    both = np.hstack([held, told[:, last]])

    def grams(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(q.shape, np.float32)
            for _, seqs in _sequences(batches):
                _, term, val, begin, _ = rows_of([sequence(s) for s in seqs])
                gram_times(term, val, begin, q, out, dense)
            for at in range(0, len(out), _CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([out[at : at + _CHUNK].tobytes()], pa.binary())], ["at", "part"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x.as_py(), np.float32) for x in table.column("part")], axis=0, dtype=np.float64)
            return pa.table({"at": table.column("at")[:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        total = np.zeros(q.shape)
        parts = known.mapInArrow(run, "at int, part binary").groupBy("at").applyInArrow(add, "at int, part binary").toArrow()
        for at, part in zip(parts.column("at").to_pylist(), parts.column("part").to_pylist(), strict=True):
            x = np.frombuffer(part, np.float32).reshape(-1, q.shape[1])
            total[at : at + len(x)] += x
        return total

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(b.terms), min(rank + MORE, len(b.terms)))))[0].astype(np.float32)
    for _ in range(PASSES):
        q = np.linalg.svd(grams(q), full_matrices=False)[0].astype(np.float32)
    q = q[:, :rank]
    image = np.zeros((len(b.parts), q.shape[1]))
    np.add.at(image, item_row, item_val[:, None] * q[item_term])
    image /= np.maximum(np.sqrt((image**2).sum(axis=1, keepdims=True)), 1e-12)
    image = image.astype(np.float32).T

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, packed in _sequences(batches):
            seqs = [sequence(s) for s in packed]
            row, term, val, begin, firsts = rows_of(seqs)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for lo, some in passages_of(term, val, begin, dense, len(b.terms)):
                near, shares = some.images(q) @ image[:, last] >= COSINE, some.times(both, held=True)
                share = shares[:, : len(last)] >= LOOSE_LCS - 1e-4
                near &= shares[:, len(last) :] >= ANSWER - 1e-4
                near = np.zeros_like(share) if not near.any() else _placed(near, last)
                for i, part_no in np.argwhere(near | share).tolist():
                    least = LEAST_LCS if near[i, part_no] else LOOSE_LCS
                    k = int(b.owner[part_no])
                    passage = int(row[begin[lo + i]])
                    doc = int(np.searchsorted(firsts, passage, side="right")) - 1
                    if best.get((doc, k), (0.0,))[0] == 1:
                        continue
                    item, start = b.items[k], (passage - int(firsts[doc])) * b.stride
                    text = seqs[doc][max(0, start - len(item)) : start + 2 * b.stride + len(item)]
                    text = text[np.isin(text, item)]
                    if len(text) < least * len(item):
                        continue
                    whole, close = lcs(item, text) / len(item), item[-max(3, len(item) // 4) :]
                    if whole < least:
                        continue
                    answer = lcs(close, text) / len(close)
                    if near[i, part_no] and (whole < LOOSE_LCS or answer < ANSWER):
                        answer = lcs(answers[k], text) / len(answers[k])
                    if whole >= LCS or answer >= ANSWER:
                        at = int(begin[lo + i]), int(begin[lo + i + 1]) if lo + i + 1 < len(begin) else len(term)
                        low = val[at[0] : at[1]] @ q[term[at[0] : at[1]]]
                        cosine = float(low @ image[:, part_no] / max(float(np.sqrt(low @ low)), 1e-12))
                        found = (whole, cosine, answer)
                        best[doc, k] = max(best.get((doc, k), found), found)
            if best:
                at = sorted(best)
                cols = [part.column(0).take(pa.array([d for d, _ in at])), pa.array([b.ids[k] for _, k in at], item_kind), *(pa.array([best[x][j] for x in at], pa.float64()) for j in (1, 0, 2))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "item", "cosine", "lcs", "answer"])

    return [known.mapInArrow(search, f"id {kind}, item {_sql(item_kind)}, cosine double, lcs double, answer double")]


def _sql(kind: pa.DataType) -> str:
    return from_arrow_type(kind).simpleString()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rank: int = RANK) -> DataFrame:
    """(id, item, cosine, lcs, answer): a row for each document and item that it holds."""
    kind, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    out, held = docs.sparkSession.createDataFrame([], f"id {kind}, item {item_type.simpleString()}, cosine double, lcs double, answer double"), []

    def look() -> DataFrame:
        terms = np.unique(term_hashes(pa.array([t for _, t in held], pa.string()))[1])
        if not len(terms):
            return out
        known = sequences(docs, terms, id_col, text_col)
        blocks = (held[at : at + ITEMS] for at in range(0, len(held), ITEMS))
        return reduce(DataFrame.union, (x for block in blocks for x in find_block(known, terms, block, to_arrow_type(item_type), rank)), out)

    rows = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null").orderBy("item", "text")
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == SPAN:
            out, held = look(), []
    return look() if held else out


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "cosine", F.col("lcs").alias("lcs_share"), F.col("answer").alias("answer_share"))


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no item of the benchmark; rows are known by id and hash of the text."""
    keyed = docs.select(F.struct("*").alias("doc"), F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")).alias("key"))
    found = save(find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key", "doc.text").select(F.col("id").alias("leak")).distinct(), "leaks")
    return keyed.join(found, F.expr("key.d <=> leak.d and key.h <=> leak.h"), "left_anti").select("doc.*")
