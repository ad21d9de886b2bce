"""Nearest neighbours through robust-pruned directed graphs, one for each shard of the vectors.

Distinct vectors are dealt to shards of about SHARD vectors. A shard's graph is built in growing batches: greedy beam searches
from the medoid propose neighbours, relaxed distance pruning (a candidate goes when an edge already kept is ALPHA times
nearer to it) keeps diverse edges, and reverse edges are pruned alike. Each query runs a beam search in each shard; the
candidates' distances are computed anew in double precision. Queries travel in blocks of a fixed size.

Equal vectors are one node of a graph that stands for its k + 1 smallest ids; no others can be among the k nearest.
Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part; fewer than k candidates are all returned; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from petriflow.llm.common import partitions, save

K, EVERY = 10, 100
SHARD, DEGREE, BEAM_BUILD, BEAM, ALPHA = 4096, 24, 48, 96, 1.2
QUERY_BLOCK = 8192
_LANES = 256


def _distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of q[i] to x[ids[i, :]]; norms are of the rows of x."""
    return np.maximum(norms[ids] - 2 * np.einsum("brd,bd->br", x[ids], q) + np.einsum("bd,bd->b", q, q)[:, None], 0)


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> np.ndarray:
    """For each query the ids of its `beam` best nodes met, nearest first; -1 fills up. All queries step together."""
    b, n = len(q), len(x)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf)
    seen = np.zeros((b, n), bool)
    done = np.ones((b, beam), bool)
    ids[:, 0], done[:, 0], seen[:, start] = start, False, True
    dist[:, 0] = _distances(x, norms, q, np.full((b, 1), start))[:, 0]
    rows = np.arange(b)
    while True:
        at = np.argmin(done, axis=1)
        live = rows[~done[rows, at]]
        if not len(live):
            return ids
        pick = ids[live, at[live]]
        done[live, at[live]] = True
        near = graph[pick]
        fresh = near >= 0
        near = np.where(fresh, near, 0)
        fresh &= ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        seen_start = fresh & (near == start)
        fresh &= ~seen_start
        d = np.where(fresh, _distances(x, norms, q[live], near), np.inf)
        all_d = np.concatenate([dist[live], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), order, 1)


def robust_prune(x: np.ndarray, norms: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point, up to `degree` diverse candidates, nearest first; -1 fills up."""
    b = len(points)
    cand = np.sort(cand, axis=1)
    open_ = (cand >= 0) & (cand != points[:, None])
    open_[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    safe = np.where(open_, cand, 0)
    d = np.where(open_, _distances(x, norms, x[points], safe), np.inf)
    v = x[safe]
    between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    out, rows = np.full((b, degree), -1, np.int64), np.arange(b)
    for k in range(degree):
        at = np.argmin(d, axis=1)
        live = np.isfinite(d[rows, at])
        if not live.any():
            break
        out[live, k] = safe[rows, at][live]
        gone = alpha * alpha * between[rows, at] <= d
        gone[rows, at] = True
        d[gone & live[:, None]] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM_BUILD, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, int]:
    """The graph (n x degree neighbour ids, -1 fills up) of the rows of x and the node that searches start from."""
    n = len(x)
    norms = np.einsum("nd,nd->n", x, x)
    start = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for factor in (1.0, alpha):
        at = 1 if factor == 1.0 else 0
        while at < n:
            size = min(_LANES, max(16, at)) if factor == 1.0 else _LANES
            batch = order[at : at + size]
            at += size
            found = beam_search(x, norms, graph, start, x[batch], beam)
            graph[batch] = robust_prune(x, norms, batch, np.concatenate([found, graph[batch]], axis=1), degree, factor)
            src = np.repeat(batch, degree)
            dst = graph[batch].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            to, first, count = np.unique(dst, return_index=True, return_counts=True)
            for lo in range(0, len(to), _LANES):
                part = slice(lo, lo + _LANES)
                width = int(count[part].max())
                back = np.full((len(to[part]), width), -1, np.int64)
                for i, (f, c) in enumerate(zip(first[part].tolist(), count[part].tolist(), strict=True)):
                    back[i, :c] = src[f : f + c]
                for w in range(0, width, 2 * degree):
                    both = np.concatenate([graph[to[part]], back[:, w : w + 2 * degree]], axis=1)
                    graph[to[part]] = robust_prune(x, norms, to[part], both, degree, factor)
    return graph, start


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows with a usable vector."""
    x = F.col(vec_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    kept = rows.where(fine).select(F.col(id_col).alias("id"), x.cast("array<double>").alias("v"))
    size = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.where(F.size("v") == (size["n"] if size else 0))


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among the other rows."""
    spark = rows.sparkSession
    good = save(usable(rows, id_col, vec_col), "vectors")
    lowest = Window.partitionBy("v").orderBy("id")
    nodes = good.withColumn("_n", F.row_number().over(lowest)).where(F.col("_n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = save(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard))
    # queries in blocks of a fixed size, each block copied once for each group of shards
    asked = good.join(queries.select(F.col(id_col).alias("id")).where("id is not null").distinct(), "id")
    n_queries, groups = asked.count(), min(shards, 4 * partitions(spark))
    blocks = max(1, -(-n_queries // QUERY_BLOCK), min(n_queries // _LANES, partitions(spark) // groups))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).repartition(min(shards, 8 * partitions(spark)), "shard").sortWithinPartitions("shard")

    def pack(shard_id: int, ids: list, v: np.ndarray) -> pa.RecordBatch:
        graph, start = build(v)
        flat = np.concatenate([np.asarray(i, np.int64) for i in ids])
        ends = np.cumsum([len(i) for i in ids])
        cols = [pa.array([shard_id], pa.int32()), pa.array([start], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (v, graph.astype(np.int32), flat, ends.astype(np.int64)))]
        return pa.RecordBatch.from_arrays(cols, ["shard", "start", "v", "graph", "ids", "ends"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, v = -1, [], []
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(at, prepend=now))
            for s, e in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]), strict=True):
                if s == e:
                    continue
                if at[s] != now and ids:
                    yield pack(now, ids, np.concatenate(v))
                    ids, v = [], []
                now = int(at[s])
                part = b.slice(int(s), int(e - s))
                ids += part.column(1).to_pylist()
                flat = part.column(0).flatten().to_numpy()
                v.append(flat.reshape(int(e - s), -1))
        if ids:
            yield pack(now, ids, np.concatenate(v))

    graphs = save(dealt.select("v", "ids", "shard").mapInArrow(index, "shard int, start int, v binary, graph binary, ids binary, ends binary"), "graphs")

    def ask(names: tuple, g: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        own, flat_v = asked.column("id").to_numpy(), asked.column("v").combine_chunks().flatten().to_numpy()
        for i in range(g.num_rows if len(own) else 0):
            start, v, graph, flat, ends = (g.column(c)[i] for c in ("start", "v", "graph", "ids", "ends"))
            ends = np.frombuffer(ends.as_py(), np.int64)
            flat = np.frombuffer(flat.as_py(), np.int64)
            x = np.frombuffer(v.as_py(), np.float64).reshape(len(ends), -1)
            graph = np.frombuffer(graph.as_py(), np.int32).reshape(len(ends), -1)
            begins = np.concatenate([[0], ends[:-1]])
            norms, vectors = np.einsum("nd,nd->n", x, x), flat_v.reshape(len(own), -1)
            for at in range(0, len(own), _LANES):
                part = vectors[at : at + _LANES]
                found = beam_search(x, norms, graph, start.as_py(), part, min(beam, len(ends)))
                for r, (query, mine) in enumerate(zip(own[at : at + _LANES].tolist(), found, strict=True)):
                    mine = mine[mine >= 0][: 3 * k]
                    true = np.sqrt(((x[mine] - part[r]) ** 2).sum(axis=1))
                    sizes = (ends - begins)[mine]
                    ids = np.concatenate([flat[begins[m] : ends[m]] for m in mine.tolist()])
                    score = np.repeat(true, sizes)
                    keep = ids != query
                    ids, score = ids[keep], score[keep]
                    order = np.lexsort([ids, score])[:k]
                    out[0].append(np.full(len(order), query))
                    out[1].append(ids[order])
                    out[2].append(score[order])
        return pa.table([np.concatenate(o) for o in out], ["query_id", "vec_id", "score"])

    # a task meets one block of queries and one group of graphs at a time; no graph becomes a row for each slice of queries
    held = graphs.withColumn("group", F.col("shard") % groups).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = held.groupBy("group", "block").cogroup(asked.groupBy("group", "block")).applyInArrow(ask, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))
