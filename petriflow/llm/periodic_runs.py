"""Periodic runs of words, found by scanning all lags.

Word i of a document is compared with word i + q for every lag q up to n / min_exp; a stretch of L equal places is a run of L + q
words with period q. At lag q a stretch must have `least` = max(min_words - q, (min_exp - 1) * q) places, so the shift is compared at
every (least / 8)-th place first, and in full only where eight such places in a row are equal: exact, and n log n places in all.
A stretch of a lag that a shorter period explains covers the same words as the run of that period, so of runs with one start and
one length the smallest period counts.

Documents of one Arrow batch are scanned together, longest first, as those that a lag is too long for then lie behind the others.
A document whose lags exceed RANGE_LAGS is written once and goes to several tasks, a range of lags each.

Defined results: null and empty texts have no words and no runs; a repeated row has a result each; ids may be null or repeated;
other columns are left aside whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petriflow.llm.common import mix, save, utf8, words
from petriflow.llm.ngrams import pieces

MIN_WORDS, MIN_EXP = 24, 3
#: Lags of a document that one task scans; a longer document goes to several tasks.
RANGE_LAGS = 4096
_PROBES = 8
_RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _known(spans: list[tuple[int, int, int]], lo: int, hi: int, reach: int) -> bool:
    """Whether a run that is already found holds [lo, hi) and has a period of at most `reach`."""
    at = bisect_right(spans, (lo, 1 << 62, 0))
    return any(end >= hi and period <= reach for _, end, period in spans[max(0, at - 4) : at])


def scan(h: np.ndarray, row: np.ndarray, first: int, last: int, min_words: int = MIN_WORDS, min_exp: int = MIN_EXP) -> np.ndarray:
    """(row, start, length, period) of each run with a period from `first` to `last`; h, row: hash and document of each word.

    Of runs with one start and one length only the one of the smallest of these periods is returned."""
    n_of = np.bincount(row) if len(row) else np.zeros(0, np.int64)
    order = np.argsort(-n_of[row], kind="stable")
    docs = row[order]
    x = h[order] ^ mix(docs.astype(np.uint64) + np.uint64(1))
    sizes = np.sort(n_of)[::-1]
    total = np.concatenate([[0], np.cumsum(sizes)])
    last = min(last, int(sizes[0]) // min_exp if len(sizes) else 0)
    lags = np.arange(first, last + 1)
    ends = total[np.searchsorted(-sizes, -np.maximum(min_exp * lags, min_words), side="right")]
    found: dict[tuple[int, int], int] = {}
    spans: list[tuple[int, int, int]] = []
    for q, n in zip(lags.tolist(), ends.tolist(), strict=True):
        if n <= q:
            break
        least = max(min_words - q, (min_exp - 1) * q)
        step = max(1, least // _PROBES)
        need = least // step
        hit = np.flatnonzero(x[: n - q : step] == x[q:n:step])
        if len(hit) < need or not (hit[need - 1 :] - hit[: len(hit) - need + 1] == need - 1).any():
            continue
        cut = np.flatnonzero(np.diff(hit) != 1) + 1
        lo, hi = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut, [len(hit)]]) - 1]
        wide = hi - lo + 1 >= need
        for a, b in zip((lo[wide] * step).tolist(), (hi[wide] * step).tolist(), strict=True):
            if _known(spans, a, b + q + 1, (need - 1) * step + 1):
                continue
            start = max(0, a - step + 1)
            stop = min(n - q, b + step)
            same = np.concatenate([[False], x[start:stop] == x[start + q : stop + q], [False]])
            edge = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= least and (start + s, e - s + q) not in found:
                    found[start + s, e - s + q] = q
                    insort(spans, (start + s, start + e + q, q))
    if not found:
        return np.zeros((0, 4), np.int64)
    got = np.array([(s, n, q) for (s, n), q in found.items()], np.int64)
    begin = np.full(len(n_of), -1)
    new = np.flatnonzero(np.diff(docs, prepend=-1))
    begin[docs[new]] = new
    of = docs[got[:, 0]]
    return np.column_stack([of, got[:, 0] - begin[of], got[:, 1], got[:, 2]])


def _finish(ids: pa.Array, texts: pa.Array, per: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    """A row per document from its runs (start, length, period)."""
    n_words, kept = [], []
    for text, runs in zip(texts, per, strict=True):
        w = (text.as_py() or "").encode().split()
        n_words.append(len(w))
        if runs:
            gone = np.zeros(len(w) + 1, np.int64)
            for s, n, q in runs:
                gone[s + q] += 1
                gone[s + n] -= 1
            w = [w[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        kept.append(b" ".join(w).decode())
    runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in sorted(r, key=lambda r: (r[0], r[2]))] for r in per], pa.list_(_RUNS))
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), runs, pa.array(kept, pa.string())], ["id", "n_words", "runs", "kept"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_exp: int = MIN_EXP, range_lags: int = RANGE_LAGS) -> DataFrame:
    """(id, n_words, runs, kept): runs are the maximal stretches of at least min_words words and min_exp (2 or more) smallest periods, by start;
    kept is the text of the words that are in no run or in the first period of each run that holds them."""
    if min_exp < 2:
        raise ValueError("a run has two periods or more")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string"
    # so many words have two bytes each at least, but for the last
    long_text = F.octet_length("text") >= 2 * min_exp * range_lags

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                data, off = utf8(b.column(1))
                row, _, _, h = words(data, off, lower=False)
                per: list[list[tuple[int, int, int]]] = [[] for _ in range(b.num_rows)]
                for i, s, n, q in scan(h, row, 1, len(h), min_words, min_exp).tolist():
                    per[i].append((s, n, q))
                yield _finish(b.column(0), b.column(1), per)

    def some_lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                uid, lag = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                data, off = utf8(batch.column(1).slice(k, 1))
                row, _, _, h = words(data, off, lower=False)
                got = scan(h, row, lag, lag + range_lags - 1, min_words, min_exp)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), uid), pa.int64()), *(pa.array(got[:, j]) for j in (1, 2, 3))], ["uid", "start", "length", "period"])

    def with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                runs = [tuple(r.values()) for r in batch.column(2)[k].as_py() or []]
                yield _finish(batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), [runs])

    short = slim.where(F.coalesce(~long_text, F.lit(True))).mapInArrow(whole, schema)
    long = save(slim.where(long_text).withColumn("uid", F.monotonically_increasing_id()), "long")
    lags = F.sequence(F.lit(1), F.floor(F.octet_length("text") / (2 * min_exp)).cast("int") + 1, F.lit(range_lags))
    ranges = long.select("uid", "text", F.explode(lags).alias("lag")).repartition("uid", "lag")
    runs = ranges.mapInArrow(some_lags, "uid long, start long, length long, period long").groupBy("uid", "start", "length").agg(F.min("period").alias("period"))
    runs = runs.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return short.union(long.join(runs, "uid", "left").select("id", "text", "runs").mapInArrow(with_runs, schema))


def repeat_words(doc_id: Column, text: Column) -> Column:
    """The text, in one of ten documents with its words from a place on replaced by repeats of the first ones from there (h, g, a and p of the query)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    w = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size(w)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    block = F.slice(w, (a + 1).cast("int"), p.cast("int"))
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
    planted = F.array_join(F.concat(F.slice(w, 1, a.cast("int")), again), " ")
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of the documents, a tenth of which repeat some of their words; null ids are never among these, null texts have no words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", repeat_words(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = F.aggregate("runs", F.element_at("runs", 1), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    out = out.withColumn("best", F.when(F.size("runs") > 0, best))
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("kept", "UTF-8"), 256).alias("collapsed_sha256"),
    )
