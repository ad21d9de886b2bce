"""Packed texts and keys: documents travel in compressed blocks, 64-bit keys in sorted, compressed runs.

A block holds whole documents, about BLOCK_BYTES of text. What a block asks of the whole corpus (is this name shared, how
often does that n-gram occur) goes out as one sorted run of distinct keys per bucket of the key space, and comes back as one
answer per run: far less to shuffle than a row for each occurrence, and a frequent key costs each block one entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.llm.common import partitions, utf8
from petriflow.llm.ngrams import pieces

BLOCK_BYTES = 2 << 20
#: Buckets of the key space: so many for each shuffle partition, and more where a bucket would get more than BUCKET_BYTES of text.
BUCKETS_PER_PARTITION, BUCKET_BYTES = 6, 32 << 20


def squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed byte planes of their differences."""
    step = np.diff(keys, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(x), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Any 64-bit numbers as compressed byte planes."""
    return squeeze(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_numbers(x: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(x), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def pack_table(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, the first one sorted, as one compressed run of byte planes."""
    planes = [np.diff(columns[0], prepend=np.uint64(0)), *(c.astype(np.uint64) for c in columns[1:])]
    return squeeze(np.ascontiguousarray(np.concatenate([x.view(np.uint8).reshape(-1, 8) for x in planes], axis=1).T).tobytes())


def unpack_table(x: bytes, width: int) -> list[np.ndarray]:
    planes = np.frombuffer(expand(x), np.uint8).reshape(8 * width, -1)
    columns = [np.ascontiguousarray(planes[8 * j : 8 * j + 8].T).view(np.uint64).ravel() for j in range(width)]
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]]


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, ids, sizes, body): whole documents, packed; save it before use, as block numbers hold for one run only."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k, held, size = (TaskContext.get().partitionId() << 32), 0, [], 0

        def flush() -> pa.RecordBatch:
            ids = pa.chunked_array([h.column(0) for h in held]).combine_chunks()
            parts = [utf8(h.column(1)) for h in held]
            sizes = np.concatenate([np.diff(o) for _, o in parts])
            body = squeeze(b"".join(d.tobytes() for d, _ in parts))
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), ids, pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([body], pa.binary())], ["block", "ids", "sizes", "body"])

        for batch in batches:
            for b in pieces(batch, "text", BLOCK_BYTES // 8):
                held.append(b)
                size += int(utf8(b.column(1))[1][-1])
                if size >= BLOCK_BYTES:
                    yield flush()
                    k, held, size = k + 1, [], 0
        if held:
            yield flush()

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"block long, ids array<{kind}>, sizes array<long>, body binary")


def unblock(sizes: pa.Scalar, body: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the documents of a block."""
    return np.frombuffer(expand(body.as_py()), np.uint8), np.concatenate([[0], np.cumsum(sizes.values.to_numpy())]).astype(np.int64)


def buckets_for(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return max(BUCKETS_PER_PARTITION * partitions(blocks.sparkSession), -(-total // BUCKET_BYTES))


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run of the sorted keys begins and the last one ends."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def shared_bits(asked: DataFrame, second: bool = False) -> DataFrame:
    """asked: (bucket, block, keys[, more]) with sorted distinct keys; returns (block, bucket, bits): 1 where another block has the key too.

    second: `more` holds another 64 bits of each key, both must agree.
    """

    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack(x.as_py()) for x in table.column("keys")]
        more = [unpack_numbers(x.as_py()) for x in table.column("more")] if second else None
        sizes = np.cumsum([0, *map(len, keys)])
        every = np.concatenate(keys)
        other = np.concatenate(more) if second else None
        order = np.lexsort([other, every]) if second else np.argsort(every, kind="stable")
        a = every[order]
        same = a[1:] == a[:-1]
        if second:
            b = other[order]
            same &= b[1:] == b[:-1]
        hit = np.zeros(len(a), bool)
        hit[1:] = same
        hit[:-1] |= same
        flags = np.zeros(len(a), bool)
        flags[order] = hit
        bits = [squeeze(np.packbits(flags[s:e]).tobytes()) for s, e in zip(sizes, sizes[1:], strict=False)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, bits binary")


def gather(answers: DataFrame, name: str, *cols: str) -> DataFrame:
    """(block, name): the answers of a block in the order of their buckets."""
    return answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))


def ask(blocks: DataFrame, keys_of: Callable[..., list[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run keys_of on each row of blocks (as a dict of scalars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from keys_of({n: b.column(j)[i] for j, n in enumerate(b.schema.names)})

    return blocks.mapInArrow(run, schema)
