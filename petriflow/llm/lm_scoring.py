"""Language-model scoring with a weighted backoff automaton.

States are n-grams seen in training (up to order - 1 words), arcs the n-grams that extend them, weighted with interpolated
probabilities; a failure arc leads from a state to its longest proper suffix at the cost of the weight left for words not
seen after it. Texts are scored in one left-to-right traversal that carries the state. Counts are gathered from the whole
corpus; each packed block of texts gets the counts of its own n-grams, so it holds exactly the part of the automaton
that its texts can enter, and no process holds the model.

P(w) = (c(w) - DISCOUNT) / N, and DISCOUNT * V / N for all unknown words together; P(w | h) = SHARE * c(hw) / c(h) + (1 - SHARE) *
P(w | shorter h) where c(h) > 0, else P(w | shorter h): normalised for every h.

Defined results: null and empty texts are the end token alone; repeated rows count and score each; with no training text every
probability is 1 / (V + 1) = 1; rows with a null id are never held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.llm.common import mix, save, words
from petriflow.llm.exchange import ask, buckets_for, cuts, gather, pack, pack_numbers, text_blocks, unblock, unpack, unpack_numbers

#: Order 3: states of one and of two words, with failure arcs between them.
ORDER, SHARE, DISCOUNT = 3, 0.35, 0.7
FOLDS, FOLD = 7, 2
_BEGIN, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_CHAIN = np.uint64(0xC2B2AE3D27D4EB4F)


class _Block:
    """Token stream (begin, words, end of each text) and the n-grams of one packed block, of the orders `which`."""

    def __init__(self, line: dict, which: range) -> None:
        data, off = unblock(line["sizes"], line["body"])
        row, _, _, h = words(data, off, lower=True)
        n_docs = len(off) - 1
        size = np.bincount(row, minlength=n_docs) + 2
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.h = np.empty(int(size.sum()), np.uint64)
        self.h[self.starts], self.h[self.ends - 1] = _BEGIN, _END
        inner = np.ones(len(self.h), bool)
        inner[self.starts] = inner[self.ends - 1] = False
        self.h[inner] = h
        doc = np.repeat(np.arange(n_docs), size)
        learns = ~np.array(line["held"].values.to_numpy(zero_copy_only=False), bool)[doc]
        place = np.arange(len(self.h)) - self.starts[doc]
        self.keys, self.inverse, self.counts, self.at = [], [], [], []
        g = self.h
        for k in range(1, which.stop):
            if k > 1:
                last, g = g, np.empty_like(self.h)
                g[1:] = mix(last[:-1] * _CHAIN + self.h[1:] + np.uint64(k))
            if k not in which:
                continue
            there = np.flatnonzero(place >= k - 1)
            keys, inverse = np.unique(g[there], return_inverse=True)
            full = np.full(len(self.h), -1, np.int64)
            full[there] = inverse
            at = np.empty(len(keys), np.int64)
            at[inverse] = there
            self.keys.append(keys)
            self.inverse.append(full)
            self.at.append(at)
            self.counts.append(np.bincount(inverse[learns[there]], minlength=len(keys)))


def _totals(blocks: DataFrame, which: range, buckets: int) -> DataFrame:
    """(block, n, bucket, totals) for each run of a block's keys, and rows with block -1 and a bucket's V and N."""

    def keys_of(line: dict) -> Iterator[pa.RecordBatch]:
        b = _Block(line, which)
        for n, keys, counts in zip(which, b.keys, b.counts, strict=True):
            at = cuts(keys, buckets)
            full = np.flatnonzero(np.diff(at))
            cols = [pa.array([n] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([line["block"].as_py()] * len(full), pa.int64())]
            cols += [pa.array([f(x[at[i] : at[i + 1]]) for i in full], pa.binary()) for f, x in ((pack, keys), (pack_numbers, counts))]
            yield pa.RecordBatch.from_arrays(cols, ["n", "bucket", "block", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        n, bucket = table.column("n")[0].as_py(), table.column("bucket")[0].as_py()
        keys = [unpack(x.as_py()) for x in table.column("keys")]
        ends = np.cumsum([0, *map(len, keys)])
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack_numbers(x.as_py()) for x in table.column("counts")])
        total = np.zeros(len(every), np.uint64)
        np.add.at(total, inverse, counts)
        back = total[inverse]
        word = every != _BEGIN
        blocks_ = [*table.column("block").to_pylist(), -1]
        answers = [*(pack_numbers(back[s:e]) for s, e in zip(ends, ends[1:], strict=False)), b""]
        k = len(answers)
        return pa.table(
            {
                "block": pa.array(blocks_, pa.int64()), "n": pa.array([n] * k, pa.int32()), "bucket": pa.array([bucket] * k, pa.int32()), "totals": pa.array(answers, pa.binary()),
                "kinds": pa.array([0] * (k - 1) + [int((total[word] > 0).sum())], pa.int64()), "tokens": pa.array([0] * (k - 1) + [int(total[word].sum())], pa.int64()),
            }
        )

    asked = ask(blocks, keys_of, "n int, bucket int, block long, keys binary, counts binary")
    return asked.groupBy("n", "bucket").applyInArrow(add, "block long, n int, bucket int, totals binary, kinds long, tokens long")


class Automaton:
    """The part of the automaton that a block's texts can enter.

    States are the seen n-grams of up to order - 1 words; as every suffix of a seen n-gram is seen, the state that a traversal carries
    after a place is the longest seen n-gram that ends there. So all texts of a block are traversed at once: each place knows
    the state before it, and follows failure arcs from there until an arc for its word is found."""

    def __init__(self, b: _Block, totals: list[np.ndarray], n_tokens: int, n_kinds: int, share: float, discount: float) -> None:
        self.block, self.cost = b, float(np.log10(1 - share))
        self.seen = [t > 0 for t in totals]
        if n_tokens:
            p = np.where(self.seen[0], (totals[0].astype(np.float64) - discount) / n_tokens, discount * n_kinds / n_tokens)
        else:
            p = np.ones(len(totals[0]))
        self.weight = [np.log10(p)]
        for k in range(2, len(totals) + 1):
            at = b.at[k - 1]
            context, tail = b.inverse[k - 2][at - 1], b.inverse[k - 2][at]
            under = totals[k - 2][context].astype(np.float64)
            p = np.where(under > 0, share * totals[k - 1] / np.maximum(under, 1) + (1 - share) * p[tail], p[tail])
            self.weight.append(np.log10(p))

    def states(self) -> np.ndarray:
        """How many words the state after each place has (0: the empty state)."""
        depth = np.zeros(len(self.block.h), np.int64)
        for k in range(1, len(self.seen)):
            ids = self.block.inverse[k - 1]
            depth[(ids >= 0) & self.seen[k - 1][ids]] = k
        return depth

    def scores(self) -> np.ndarray:
        """Log10 probability of each text: its words and its end, read from the state of its beginning."""
        b, total = self.block, np.zeros(len(self.block.h))
        before = np.concatenate([[0], self.states()[:-1]])
        before[b.starts] = -1  # nothing is read at a beginning
        for k in range(len(self.seen), 0, -1):
            at = np.flatnonzero(before == k - 1)
            ids = b.inverse[k - 1][at]
            found = self.seen[k - 1][ids] if k > 1 else np.ones(len(at), bool)
            total[at[found]] += self.weight[k - 1][ids[found]]
            total[at[~found]] += self.cost
            before[at[~found]] = k - 2
        return np.add.reduceat(total, b.starts) if len(b.starts) else total


def score_texts(docs: DataFrame, held: F.Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, share: float = SHARE, discount: float = DISCOUNT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; rows where `held` is true teach nothing."""
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held")).alias("id"), F.col(text_col).alias("text"))
    blocks = text_blocks(named, "id", "text").select("block", F.col("ids.id").alias("ids"), F.col("ids.held").alias("held"), "sizes", "body")
    blocks = save(blocks, "blocks")
    buckets = buckets_for(blocks)
    # one order after another, so that the disk holds the keys of one at a time
    totals = [save(_totals(blocks, range(k, k + 1), buckets), "totals") for k in range(1, order + 1)]
    stats = totals[0].where("block = -1").agg(F.sum("kinds"), F.sum("tokens")).first()
    n_kinds, n_tokens = stats[0] or 0, stats[1] or 0
    known = blocks.join(gather(reduce(DataFrame.union, totals).where("block >= 0"), "totals", "n", "bucket", "totals"), "block").select("ids", "held", "sizes", "body", "totals")

    def run(line: dict) -> Iterator[pa.RecordBatch]:
        b = _Block(line, range(1, order + 1))
        found = [[] for _ in range(order)]
        for x in line["totals"].values:
            found[x["n"].as_py() - 1].append(unpack_numbers(x["totals"].as_py()))
        got = [np.concatenate(x) for x in found]
        machine = Automaton(b, got, n_tokens, n_kinds, share, discount)
        c = got[0][b.inverse[0]].astype(np.float64)
        plain = np.concatenate([[0.0], np.cumsum(np.log10((c + 1) / (n_tokens + n_kinds + 1)))])
        hits = np.concatenate([[0], np.cumsum(c > 0)])
        a, z = b.starts + 1, b.ends
        scores = machine.scores()
        cols = [line["ids"].values, line["held"].values, pa.array(z - a, pa.int64()), pa.array(hits[z] - hits[a], pa.int64()), pa.array(np.full(len(a), n_tokens), pa.int64()), pa.array(plain[z] - plain[a]), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ask(known, run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == FOLD
    return score_texts(docs, held).withColumnRenamed("id", "doc_id")
