"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows of source partition p go to cell c (a block of a shard) in numbers M[p, c] drawn from the exact law of a uniform
permutation: row p of M, given the rows before it, is multivariate hypergeometric. Source partitions are blocks of rows of
Parquet files, however Spark splits these. No process holds M: the partitions are
the leaves of a binary tree, each inner node splits the cells' sizes between its halves with draws seeded by the node, and
a task finds its own row of M by walking down from the root. Rows are permuted within their partition, exchanged, and
permuted again within their cell; cells have sizes known beforehand, so slots are gapless without any global count.

Defined results: an empty table gives no rows; null texts have size 8 and crc32 0; repeated rows are separate rows with
slots of their own; copies of one text are dealt like any other rows; columns of other names are carried along.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from petriflow.llm.common import mix, save

#: Shards of the production query.
SHARDS = 24
SEED = 20_240_607
#: A shard is cut into blocks of about so many rows, and at least MIN_BLOCKS: no task sorts a whole shard.
ROWS_PER_CELL, MIN_BLOCKS = 200_000, 64
#: Rows of a file that make one source partition: the places of a bitmap of Spark's.
BLOCK_ROWS = 1 << 15


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw; beyond numpy's range by inversion around the mode."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    total = good + bad
    spread = int(12 * (draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5) + 40
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(p - p.max()))
    return int(a + np.searchsorted(p, rng.random() * p[-1], side="right").clip(0, b - a))


def _split(sizes: np.ndarray, left: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of `left` rows drawn without replacement fall into each cell of the given sizes."""
    rng = np.random.default_rng(seed)
    total = int(sizes.sum())
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(sizes, left, method="marginals")
    out = np.zeros_like(sizes)
    for i, s in enumerate(sizes.tolist()):
        total -= s
        out[i] = _hypergeometric(rng, s, total, left)
        left -= int(out[i])
    return out


def matrix_row(p: int, counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row p of the communication matrix; counts: rows of each partition, sizes: rows of each cell."""
    before = [0, *itertools.accumulate(counts)]
    lo, hi = 0, len(counts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(sizes, before[mid] - before[lo], (seed, lo, hi))
        sizes, lo, hi = (left, lo, mid) if p < mid else (sizes - left, mid, hi)
    return sizes


def cell_sizes(n: int, shards: int, blocks: int) -> np.ndarray:
    per_shard = n // shards + (np.arange(shards) < n % shards)
    return (per_shard[:, None] // blocks + (np.arange(blocks)[None, :] < per_shard[:, None] % blocks)).ravel().astype(np.int64)


def _placed(df: DataFrame) -> DataFrame:
    """(doc, file, block, at): each row with its place in the Parquet files that df reads, in blocks of BLOCK_ROWS rows of a file."""
    doc = F.struct(*[c for c in df.columns if c not in ("shard", "slot")])  # names inside cannot clash with those below
    row = F.col("_metadata.row_index")
    return df.select(doc.alias("doc"), F.col("_metadata.file_path").alias("file"), F.floor(row / BLOCK_ROWS).alias("block"), (row % BLOCK_ROWS).alias("at"))


def _counted(placed: DataFrame) -> tuple[list[tuple], bool]:
    """(file, block, first place, rows) of each block, and whether every place between the first and the last holds one row."""
    places = F.bitmap_count(F.bitmap_construct_agg("at"))
    blocks = placed.groupBy("file", "block").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"), places.alias("places"))
    found = blocks.orderBy("file", "block").collect()
    return [(r["file"], r["block"], r["lo"], r["n"]) for r in found], all(r["n"] == r["places"] == r["hi"] - r["lo"] + 1 for r in found)


def _in_blocks(df: DataFrame, in_place: bool) -> tuple[DataFrame, list[tuple]]:
    """Placed rows and their blocks; rows are written first, unless (in_place) df reads files as they are."""
    if in_place:
        try:
            placed = _placed(df)
        except AnalysisException:  # rows that come from no file
            pass
        else:
            blocks, whole = _counted(placed)
            if whole:
                return placed, blocks
    placed = _placed(save(df, "dealt"))
    return placed, _counted(placed)[0]


def uniform_shards(df: DataFrame, n_shards: int = SHARDS, seed: int = SEED, rows_per_cell: int = ROWS_PER_CELL, in_place: bool = False) -> DataFrame:
    """df with `shard` (int) and `slot` (long): a uniform random order cut into shards whose row counts differ by one at most.

    in_place: the rows of Parquet files that stay until the result is read are known by their places there and not written again."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    placed, found = _in_blocks(df, in_place)
    counts = [n for *_, n in found]
    n = sum(counts)
    blocks = max(MIN_BLOCKS, -(-n // (n_shards * rows_per_cell)))
    numbered = df.sparkSession.createDataFrame([(file, block, lo, k) for k, (file, block, lo, _) in enumerate(found)], "file string, block long, lo long, k long")

    held: dict[int, np.ndarray] = {}

    def dealt(k: int) -> np.ndarray:
        """The cells of the rows of source block k, in its own random order; the last one asked for is kept."""
        if k not in held:
            sizes = matrix_row(k, counts, cell_sizes(n, n_shards, blocks), seed)
            held.clear()
            held[k] = np.random.default_rng((seed, 1, k)).permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))
        return held[k]

    @F.pandas_udf("cell int, key long")
    def deal(row: pd.Series) -> pd.DataFrame:
        r = row.to_numpy(np.int64)
        k, at, cell = r // BLOCK_ROWS, r % BLOCK_ROWS, np.zeros(len(r), np.int32)
        for x in np.unique(k):
            cell[k == x] = dealt(int(x))[at[k == x]]
        key = mix(mix(r.astype(np.uint64) + np.uint64(seed)) + np.uint64(0x632BE59BD9B4E019))
        return pd.DataFrame({"cell": cell, "key": key.view(np.int64)})

    fixed = placed.join(F.broadcast(numbered), ["file", "block"]).select("doc", (F.col("k") * BLOCK_ROWS + F.col("at") - F.col("lo")).alias("row"))
    out = fixed.withColumn("to", deal("row")).select("doc", "row", "to.cell", "to.key")
    out = out.withColumn("shard", F.floor(F.col("cell") / blocks).cast("int")).withColumn("block", (F.col("cell") % blocks).cast("long"))
    per_shard = F.lit(n // n_shards) + (F.col("shard") < n % n_shards).cast("long")
    before = F.col("block") * F.floor(per_shard / blocks) + F.least(F.col("block"), per_shard % blocks)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("key", "row"))
    return out.withColumn("slot", (before + rank - 1).cast("long")).select("doc.*", "shard", "slot")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = uniform_shards(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their shard and slot, dealt from the files of the stage before."""
    return uniform_shards(docs, in_place=True)
