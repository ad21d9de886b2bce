"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table predicts each document's posterior over domains; nonnegative rates r of documents
are fitted by projected-gradient least squares so that the expected tokens of each domain, sum of r * tokens * posterior,
match their targets. A document's rate follows from its posterior and the few step vectors so far, r <- max(0, r - p . g), so
an iteration is one aggregation over a slim table, which carries the rates of the steps so far, and the driver sees domain totals only.
Steps are preconditioned by the domains' Gram matrix of documents whose rate is within its bounds; where such a step brings the totals
no nearer, a plain gradient step, which always does, takes its place. Starting at 1, rates stay as near to 1 as the targets allow.

Defined results: null and empty texts have 0 tokens and the posterior of a text without n-grams; repeated rows are rated
alike, and each is drawn for by itself; a domain without labelled rows has a small constant posterior; an empty table gives no rows; a
target that no rates can meet is met as nearly as possible, and the residual (what the totals are off, over all tokens) tells how nearly;
columns of docs are carried along, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petriflow.llm.common import drop, save
from petriflow.llm.ngrams import SHAPES, TRIGRAMS, WORDS, Linear, fit, indicators, labelled_rows, pieces

DOMAINS = ("good", "poor", "toxic")
#: Labelled rows that the classifier is fitted on at most.
MAX_TRAIN = 3000
#: Shares of all tokens that the production query mixes to; clean documents have some toxic posterior, so 0 could not be met.
TARGETS = {"good": 0.945, "poor": 0.05, "toxic": 0.005}
#: Steps at most, the residual that ends them, the least part of the squared distance that a step must take away, and steps between two tables
#: that carry the rates.
ITERATIONS, TOLERANCE, LEAST_GAIN, CARRY = 200, 1e-6, 1e-6, 6


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, id_col: str = "doc_id") -> list[Linear]:
    """One classifier for each domain: toxic if so labelled, else poor or good by quality."""
    y = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).when(F.col("quality") <= 0, 1)
    rows, y = labelled_rows(docs, labels.select(F.col(id_col).alias("id"), y.alias("y")), most, with_words=True, id_col=id_col)
    return [fit(rows, (y == k).astype(np.int64), TRIGRAMS + SHAPES + WORDS) for k in range(len(DOMAINS))]


def with_posteriors(docs: DataFrame, models: list[Linear], text_col: str = "text") -> DataFrame:
    """docs with `n_tokens` and a posterior `p_<domain>` for each domain."""
    new = ["n_tokens", *(f"p_{d}" for d in DOMAINS)]
    docs = docs.drop(*new, "rate")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, text_col):
                got = list(indicators(b.column(at), with_words=True))
                p = np.array([[m.probability(x) for m in models] for x, _ in got]).reshape(-1, len(models))
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([n for _, n in got], pa.int64()), *map(pa.array, p.T.copy())], [*names, *new])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in new[1:])])
    return docs.mapInArrow(run, schema)


def rate(steps: list[np.ndarray], most: float | None = None, start: Column | None = None) -> Column:
    """The rate that a row's posteriors and the steps give from `start` (1) on, `most` at most."""
    r = F.lit(1.0) if start is None else start
    for g in steps:
        r = F.greatest(F.lit(0.0), r - sum(F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS, g, strict=True)))
        r = r if most is None else F.least(F.lit(float(most)), r)
    return r


@dataclass
class Fit:
    """The steps of a fit, the shares of all tokens that its rates give each domain, those wanted, and their distance."""

    steps: list[np.ndarray]
    shares: np.ndarray
    wanted: np.ndarray
    residual: float


def fit_rates(rows: DataFrame, targets: dict[str, float] | None = None, factors: dict[str, float] | None = None, most: float | None = None) -> Fit:
    """Fit rates over `rows` (with n_tokens and posteriors).

    targets: wanted share of all tokens by domain; factors: wanted multiple of a domain's own expected tokens;
    most: an upper bound of the rates.
    """
    k = len(DOMAINS)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    t = F.col("n_tokens").cast("double")
    table = rows.select("n_tokens", *[f"p_{d}" for d in DOMAINS])
    carried, fresh, tables = [], [], []  # steps inside the table's column r, and those since

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Domain totals, and the Gram matrices of documents within the bounds and of all."""
        r = F.col("_r")
        free = (r > 0) & (r < most) if most is not None else r > 0
        aggs = [F.sum(r * t * x) for x in p] + [F.sum(F.when(c, t * p[i] * p[j])) for c in (free, F.lit(True)) for i in range(k) for j in range(k)]
        now = table.withColumn("_r", rate(steps, most, F.col("r") if carried else None))
        got = np.array([x or 0.0 for x in now.agg(*aggs).first()])
        return got[:k], *got[k:].reshape(2, k, k)

    now, inner, every = totals([])
    total = float(now.sum())
    want = np.array([total * targets[d] if targets else now[i] * factors[d] for i, d in enumerate(DOMAINS)])
    total, plain, gain = total or 1.0, most is not None, 1.0
    for _ in range(ITERATIONS):
        off = now - want
        if float(np.abs(off).sum()) <= TOLERANCE * total or gain < LEAST_GAIN:
            break
        step = off / np.linalg.eigvalsh(every)[-1] if plain else np.linalg.lstsq(inner + 1e-9 * np.eye(k) * max(np.trace(every), 1e-9), off, rcond=None)[0]
        after, after_inner, _ = totals([*fresh, step])
        part = 1 - float((after - want) @ (after - want)) / float(off @ off)
        if part <= 0 and not plain:
            plain = True  # for this step
            continue
        gain, plain = part if plain else max(part, LEAST_GAIN), False
        if part <= 0:
            break
        fresh, now, inner = [*fresh, step], after, after_inner
        if len(fresh) == CARRY:
            table = save(table.withColumn("r", rate(fresh, most, F.col("r") if carried else None)), "rates")
            tables.append(table)
            carried, fresh = [*carried, *fresh], []
    drop(*tables)
    return Fit([*carried, *fresh], now / total, want / total, float(np.abs(now - want).sum()) / total)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = save(with_posteriors(docs.select("doc_id", "text"), models).drop("text"), "posteriors")
    found = fit_rates(rows, targets=TARGETS)
    return rows.withColumn("rate", rate(found.steps)).withColumn("residual", F.lit(found.residual))


def mix_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: toxic tokens go to zero as nearly as the rates can bring them there, the other domains keep theirs; rates are 1 at
    most, so no document is repeated. Each row is kept with the chance of its rate; the draw hangs on its doc_id and text alone, not on how the
    table is stored, so rows equal in both stay or go together.

    Null and empty texts are rated like any other, by the posterior of a text without n-grams; an empty table stays empty."""
    models = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = save(with_posteriors(docs.select("text"), models).drop("text"), "posteriors")
    found = fit_rates(rows, factors={"good": 1.0, "poor": 1.0, "toxic": 0.0}, most=1.0)
    drop(rows)
    # texts are not written beside their posteriors, but scored once more with the fitted rates
    rated = with_posteriors(docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text", F.lit(11)).alias("draw"), "text"), models)
    chance = F.pmod("draw", F.lit(1 << 40)) / (1 << 40)
    return rated.where(F.floor(rate(found.steps, 1.0) + chance) >= 1).select("doc.*")
