"""SimHash near-duplicates: fingerprints of 3-word shingles linked through BK-trees.

Fingerprints within Hamming distance 2 agree on one of three blocks of bits, and on one of three blocks of the other bits:
nine masks, under one of which any such pair has equal bits. Distinct fingerprints are dealt by their masked bits, each
shard builds BK-trees (children keyed by integer distance to the parent) of its groups and searches them, following only
edges within the radius. The trees together grow with the corpus, so they are not sent to every executor: the masks bring to
a tree all fingerprints that can match in it. A group of more than TILE fingerprints becomes several trees, each of which
is searched by all of the group. Each tree tells a forest of the links found in it, which connects what all of them do.

Defined results: null and empty texts have fingerprint 0 and link like any other; equal texts share fingerprint and component;
rows with a null id are fingerprinted, take part in links and never name a component unless it has no other id; an empty
table gives no rows; other columns are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from petriflow.llm.common import components, drop, mix, partitions, save

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in one BK-tree at most.
TILE = 1024
_STEP = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of whole UTF-8 text, majority of the bits of its shingles' XXH64."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(width, len(parts))
    n = len(parts) - width + 1
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        to = min(n, at + _STEP)
        s, e = starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist()
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(s, e, strict=True)], np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs."""
    slim = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py() or b"") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fp long")


def masks() -> list[int]:
    """The nine masks as signed 64-bit numbers."""

    def cut(bits: list[int]) -> list[list[int]]:
        k = len(bits)
        return [bits[i * k // 3 : (i + 1) * k // 3] for i in range(3)]

    out = []
    for block in cut(list(range(64))):
        for sub in cut([b for b in range(64) if b not in block]):
            m = sum(1 << b for b in block + sub)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


class BKTree:
    """Integers under Hamming distance; a child hangs under its parent by their distance."""

    def __init__(self, values: list[int]) -> None:
        self.values, self.children, self.parents = [], [], []
        for v in values:
            self.add(v)

    def add(self, v: int) -> None:
        parent = -1
        if self.values:
            at = 0
            while True:
                d = (self.values[at] ^ v).bit_count()
                if not d:
                    return
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = len(self.values)
                    parent = at
                    break
                at = nxt
        self.values.append(v)
        self.children.append({})
        self.parents.append(parent)

    def within(self, v: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ v).bit_count()
            if d <= radius:
                found.append(self.values[at])
            kids = self.children[at]
            if len(kids) > 2 * radius + 1:
                todo += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids]
            else:
                todo += [c for k, c in kids.items() if -radius <= k - d <= radius]
        return found


def forest(found: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs among `found` that join what was not connected before: at most one for each value."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[p]
        return v

    out = []
    for v, w in found:
        x, y = root(v), root(w)
        if x != y:
            parent[y] = x
            out.append((v, w))
    return out


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, every: bool = True) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that differ in `radius` bits at most; radius up to 2.

    every: all such pairs; else, of each tree's, those that connect the same values, no more than there are values."""
    if not 0 <= radius <= 2:
        raise ValueError("the masks find pairs within 2 bits")
    spark, nine = prints.sparkSession, masks()
    keys = prints.select("fp").distinct().select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(nine)])).alias("k"))
    keys = save(keys.select("fp", "k.i", "k.bits"), "masked")
    several = keys.groupBy("i", "bits").agg(F.count("*").alias("n")).where("n > 1")
    grouped = keys.join(several, ["i", "bits"]).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    grouped = grouped.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = grouped.select("i", "bits", "tile", "fp", (F.col("own") == F.col("tile")).alias("member")).repartition(partitions(spark), "i", "bits", "tile").sortWithinPartitions("i", "bits", "tile")
    unsigned = (1 << 64) - 1
    whole = [m & unsigned for m in nine]

    def search(i: int, fps: np.ndarray, member: np.ndarray, out: list[tuple[int, int]]) -> None:
        values = fps.view(np.uint64).tolist()
        tree = BKTree([v for v, m in zip(values, member.tolist(), strict=True) if m])
        near = ((min(v, w), max(v, w)) for v in values for w in tree.within(v, radius) if v != w)
        if every:  # under the first mask that makes the pair equal, and from its smaller value's tile
            mine = set(tree.values)
            out += [(v, w) for v, w in set(near) if w in mine and next(k for k, m in enumerate(whole) if not (v ^ w) & m) == i]
        else:
            out += forest(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for last, b in _with_last(batches):
            cols = [b.column(j).to_numpy(zero_copy_only=False) for j in range(5)]
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held.pop(), cols, strict=True)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            at = np.flatnonzero(new).tolist() + [len(new)]
            if not last and len(at) > 1:
                held.append([c[at[-2] :] for c in cols])
                at.pop()
            out: list[tuple[int, int]] = []
            for s, e in zip(at, at[1:], strict=False):
                search(int(cols[0][s]), cols[3][s:e], cols[4][s:e], out)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _with_last(it: Iterator) -> Iterator[tuple[bool, object]]:
    held = None
    for x in it:
        if held is not None:
            yield False, held
        held = x
    if held is not None:
        yield True, held


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of fingerprints within the radius."""
    prints = save(fingerprints(docs, id_col, text_col), "prints")
    nodes = save(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = components(links(nodes, radius, every=False))
    rooted = save(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("low").alias("component"))
    return prints.join(rooted.join(named, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: Near copies of the pipeline: five-word shingles, and the similarity from which documents are copies.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a wide fingerprint, standard deviations that candidates may be farther than expected, and the chance to miss a pair at the
#: least similarity.
WIDE, SPREAD, MISS = 4, 3, 0.02
#: Nodes in one BK-tree of wide fingerprints at most.
WIDE_TILE = 1 << 13
#: Documents of a candidate group that one task compares with as many others, and shingles of them.
SET_TILE, TILE_SHINGLES = 256, 1 << 20


def shingle_set(text: bytes, width: int = WIDE_SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(width, len(parts))
    n = len(parts) - width + 1
    digest, out = xxhash.xxh64_intdigest, np.empty(n, np.uint64)
    for at in range(0, n, _STEP):
        to = min(n, at + _STEP)
        s, e = starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist()
        out[at:to] = [digest(joined[a:b], SEED) for a, b in zip(s, e, strict=True)]
    return np.unique(out)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of WIDE * 64 bits of a set of shingles: each one's hash is spread over WIDE independent words."""
    if not len(shingles):
        return np.zeros(WIDE, np.uint64)
    set_bits = np.zeros((WIDE, 64), np.int64)
    for at in range(0, len(shingles), _STEP):
        h = shingles[at : at + _STEP]
        for j in range(WIDE):
            x = mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
            set_bits[j] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(set_bits * 2 > len(shingles), axis=1, bitorder="little").view(np.uint64).ravel()


def expected_distance(similarity: float) -> float:
    """Share of bits in which fingerprints of sets with that Jaccard similarity differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _tree_of(fps: np.ndarray) -> tuple[BKTree, list[int], list[tuple[int, int]]]:
    """The BK-tree of the rows' fingerprints, the first row of each of its values, and pairs of rows with one value."""
    first: dict[int, int] = {}
    data, step, same = fps.astype("<u8").tobytes(), 8 * fps.shape[1], []
    for row in range(len(fps)):
        at = first.setdefault(int.from_bytes(data[row * step : row * step + step], "little"), row)
        if at != row:
            same.append((at, row))
    return BKTree(list(first)), list(first.values()), same


def spanning(tree: BKTree, radius: int) -> tuple[list[tuple[int, int]], list[int]]:
    """A spanning forest of the tree's values within the radius, and the number of each one's part: each value found is looked around from
    once, past the subtrees whose values are all found."""
    values, children, parents = tree.values, tree.children, tree.parents
    part, rest, edges = [-1] * len(values), [1] * len(values), []
    for x in range(len(values) - 1, 0, -1):
        rest[parents[x]] += rest[x]

    def take(x: int, of: int) -> None:
        part[x] = of
        while x >= 0:
            rest[x] -= 1
            x = parents[x]

    for start in range(len(values)):
        if part[start] >= 0:
            continue
        take(start, start)
        front = [start]
        while front and rest[0]:
            at = front.pop()
            v, todo = values[at], [0]
            while todo:
                x = todo.pop()
                d = (values[x] ^ v).bit_count()
                if d <= radius and part[x] < 0:
                    take(x, start)
                    edges.append((at, x))
                    front.append(x)
                todo += [c for k, c in children[x].items() if rest[c] and -radius <= k - d <= radius]
    return edges, part


def flood(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows within the radius, found in a BK-tree."""
    tree, row, same = _tree_of(fps)
    return same + [(row[x], row[y]) for x, y in spanning(tree, radius)[0]]


def visits(fps: np.ndarray, radius: int) -> tuple[list[tuple[int, int]], Callable[[np.ndarray], list[int]]]:
    """The forest of the rows, and a search: of each part of the rows that lies within the radius of a fingerprint, one row.

    Subtrees that hold one part only are passed once it is found."""
    tree, row, same = _tree_of(fps)
    edges, part = spanning(tree, radius)
    whole = list(part)  # the part that a subtree belongs to as a whole, else -1
    for x in range(len(whole) - 1, 0, -1):
        if whole[x] != whole[tree.parents[x]]:
            whole[tree.parents[x]] = -1

    def search(fp: np.ndarray) -> list[int]:
        v, found, todo = int.from_bytes(fp.astype("<u8").tobytes(), "little"), {}, [0] if tree.values else []
        while todo:
            x = todo.pop()
            d = (tree.values[x] ^ v).bit_count()
            if d <= radius:
                found.setdefault(part[x], row[x])
            todo += [c for k, c in tree.children[x].items() if -radius <= k - d <= radius and (whole[c] < 0 or whole[c] not in found)]
        return list(found.values())

    return same + [(row[x], row[y]) for x, y in edges], search


def tables_for(bits: int, far: float, radius: int, k: int) -> int:
    """Tables of k sampled bits that find pairs whose bits each differ with chance `far`, up to a chance of MISS (or what the radius leaves)."""
    d = range(radius + 1)
    share = np.array([comb(bits, x) * far**x * (1 - far) ** (bits - x) for x in d])
    same = np.array([comb(bits - x, k) / comb(bits, k) for x in d])
    most, tables = share.sum() - MISS, 1
    while tables < 1 << 12 and (share * (1 - (1 - same) ** tables)).sum() < most:
        tables += 1
    return tables


def wide_links(nodes: DataFrame, n: int, similarity: float = SIMILARITY, tile: int = WIDE_TILE) -> DataFrame:
    """Edges (a, b) that connect nodes (node, f0..) whose wide fingerprints are at most SPREAD standard deviations farther than sets of that
    similarity are expected to be: candidates, among them sets that are less similar.

    Bits are sampled into tables: k = log2(n / 8) bits each, so a key holds about eight unrelated nodes at any size, and as many tables as make
    the chance of a similar pair to share no key MISS. The nodes of one key make a BK-tree, and their links are found in it. Keys of more
    than `tile` nodes become several trees, each of which is searched by all nodes of the key, so no link of theirs is lost either. Edges
    form forests, so a large group of copies costs what it has members."""
    spark, bits = nodes.sparkSession, 64 * WIDE
    far = expected_distance(similarity)
    radius = int(np.ceil(bits * far + SPREAD * np.sqrt(bits * far * (1 - far))))
    k = int(np.clip(np.ceil(np.log2(max(n, 2))) - 3, 10, 48))
    tables = tables_for(bits, far, radius, k)
    rng = np.random.default_rng(SEED)
    pick = [rng.choice(bits, k, replace=False) for _ in range(tables)]
    names = [f"f{j}" for j in range(WIDE)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = (np.uint64(1) << np.arange(k, dtype=np.uint64))[None, :]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                f = np.column_stack([b.column(1 + j).to_numpy().view(np.uint64) for j in range(WIDE)])
                flat = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
                for t, p in enumerate(pick):
                    key = mix((flat[:, p] * place).sum(axis=1, dtype=np.uint64) ^ mix(np.full(len(f), t + 1, np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns], ["key", "node", *names])

    columns = "".join(f", {x} long" for x in names)
    dealt = nodes.select("node", *names).mapInArrow(deal, f"key long, node long{columns}")

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        x = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x.min(axis=1, initial=2**63 - 1)), pa.array(x.max(axis=1, initial=-(2**63)))], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges inside each key of `tile` nodes at most; larger keys are named, with a null beside them."""
        held, large = np.zeros((0, 2 + WIDE), np.uint64), None
        for last, b in _with_last(batches):
            x = np.concatenate([held, np.column_stack([b.column(j).to_numpy().view(np.uint64) for j in range(2 + WIDE)])])
            if large is not None:
                x = x[np.searchsorted(x[:, 0] != large, True) :]
            if not len(x):
                held = x
                continue
            begin = np.flatnonzero(np.append(True, x[1:, 0] != x[:-1, 0]))
            size = np.diff(np.append(begin, len(x)))
            begun, over = len(begin) - (not last), size > tile
            if not last:
                held = x[begin[-1] :] if not over[-1] else x[:0]
                large = x[begin[-1], 0] if over[-1] else None
            out: list[tuple[int, int]] = []
            node = x[:, 1].view(np.int64)
            for i in np.flatnonzero((size[:begun] > 1) & ~over[:begun]).tolist():
                s = int(begin[i])
                out += [(node[s + u], node[s + v]) for u, v in flood(x[s : s + size[i], 2:], radius)]
            yield pairs(out)
            named = x[begin[over], 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.nulls(len(named), pa.int64())], ["a", "b"])

    found = save(dealt.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(link, "a long, b long").distinct(), "candidates")
    edges, large = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("key"))
    if large.isEmpty():
        return edges
    again = dealt.join(large, "key")
    again = again.join(again.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    again = again.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", "tile", (F.col("own") != F.col("tile")).alias("visitor"), "node", *names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a tile come first and make its tree; then the other nodes of the key look into it."""
        at, node, prints, find = None, [], [], None
        for b in batches:
            out: list[tuple[int, int]] = []
            f = np.column_stack([b.column(3 + j).to_numpy().view(np.uint64) for j in range(1 + WIDE)])
            for r, (key, number, visitor) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)):
                if at != (key, number) or (visitor and find is None):
                    if find is None and node:
                        forest_, find = visits(np.array(prints), radius)
                        out += [(node[u], node[v]) for u, v in forest_]
                    if at != (key, number):
                        at, node, prints, find = (key, number), [], [], None
                name = int(f[r, 0].view(np.int64))
                if visitor:
                    out += [(node[u], name) for u in (find(f[r, 1:]) if find else [])]
                else:
                    node.append(name)
                    prints.append(f[r, 1:])
            yield pairs(out)
        if find is None and node:
            yield pairs([(node[u], node[v]) for u, v in flood(np.array(prints), radius)])

    parts = again.repartition(partitions(spark), "key", "tile").sortWithinPartitions("key", "tile", "visitor")
    return edges.union(parts.mapInArrow(search, "a long, b long")).distinct()


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (of distinct numbers) whose Jaccard similarity is reached, by counting what they share."""
    size = np.array([len(x) for x in sets], np.int64)
    _, every = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    held, edges, rest = np.zeros(len(every), bool), [], np.arange(len(sets))
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            at = front.pop()
            own = every[begin[at] : begin[at] + size[at]]
            fit = np.flatnonzero(np.minimum(size[rest], size[at]) >= similarity * np.maximum(size[rest], size[at]) - 1e-9)
            if not len(fit):
                continue
            held[own] = True
            near = rest[fit]
            edge = np.concatenate([[0], np.cumsum(size[near])])
            place = np.arange(edge[-1]) + np.repeat(begin[near] - edge[:-1], size[near])
            both = np.add.reduceat(held[every[place]].astype(np.int64), edge[:-1])
            held[own] = False
            hit = both >= similarity * (size[near] + size[at] - both) - 1e-9
            new = near[hit].tolist()
            edges += [(at, x) for x in new]
            front += new
            rest = np.delete(rest, fit[hit])
    return edges


def exact_links(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) that connect the rows (group, node, size, shingles) of each group whose sets reach the similarity.

    Groups are cut into tiles of about SET_TILE rows and TILE_SHINGLES shingles; every pair of tiles is compared in some task."""
    spark = sets.sparkSession
    per = sets.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / SET_TILE), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("int").alias("tiles"))
    dealt = sets.join(per, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")
    dealt = dealt.repartition(partitions(spark), "group", "i", "j").sortWithinPartitions("group", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, found = None, [], []

        def link() -> pa.RecordBatch:
            pairs = np.array(jaccard_forest(found, similarity) if len(found) > 1 else [], np.int64).reshape(-1, 2)
            at = np.array(nodes, np.int64)
            a, b = at[pairs[:, 0]], at[pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            for r, (new, node) in enumerate(zip(keys, batch.column(3).to_pylist(), strict=True)):
                if new != key:
                    if nodes:
                        yield link()
                    key, nodes, found = new, [], []
                nodes.append(node)
                found.append(np.frombuffer(batch.column(4)[r].as_py(), np.uint64))
        if nodes:
            yield link()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, component): documents whose sets of five-word shingles reach the Jaccard similarity, and those reachable through such.

    Wide SimHash fingerprints name candidates through BK-trees; groups of candidates are then linked by their sets. Equal sets share a node."""
    slim = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    names = [f"f{j}" for j in range(WIDE)]
    kind = slim.schema["id"].dataType.simpleString()

    def name_of(shingles: np.ndarray) -> int:
        return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, nodes = np.zeros((b.num_rows, WIDE), np.uint64), []
            for r, x in enumerate(b.column(1)):
                shingles = shingle_set(x.as_py() or b"")
                f[r] = wide_fingerprint(shingles)
                nodes.append(name_of(shingles))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, j].copy().view(np.int64)) for j in range(WIDE)), pa.array(nodes, pa.int64())], ["id", *names, "node"])

    columns = "".join(f", {x} long" for x in names)
    prints = save(slim.mapInArrow(run, f"id {kind}{columns}, node long"), "prints")
    nodes = save(prints.groupBy("node", *names).agg(F.min("id").alias("low")), "nodes")
    coarse = components(wide_links(nodes, nodes.count(), similarity))
    coarse = coarse.union(coarse.select("root", "root")).distinct().select("node", F.col("root").alias("group"))
    suspects = save(nodes.join(coarse, "node").select("node", "group", "low"), "suspects")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(x.as_py() or b"") for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "size", "shingles"])

    # one document of each candidate node; rows that repeat its id may bring others
    lows = suspects.select("low").distinct()
    texts = slim.join(lows, F.expr("id <=> low"), "left_semi").select("text")
    sets = texts.mapInArrow(sets_of, "node long, size long, shingles binary").dropDuplicates(["node"])
    sets = save(suspects.select("node", "group").join(sets, "node"), "sets")
    roots = components(exact_links(sets, similarity))
    drop(suspects, sets)
    rooted = save(nodes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("low").alias("component"))
    return prints.select("id", "node").join(rooted.join(named, "root").select("node", "component"), "node").select("id", "component")


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of near copies (candidates by BK-trees of SimHash fingerprints, Jaccard similarity 0.8 of five-word
    shingles checked on the sets), that of the smallest id (ties: of the smallest hash of the text).

    Rows are known by id and hash of the text, so the texts need not be written to be numbered."""
    keyed = docs.select(F.struct("*").alias("doc"), F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")).alias("key"))
    groups = similar_groups(keyed, "key", "doc.text").where(F.col("id").eqNullSafe(F.col("component")))
    first = save(groups.groupBy(F.col("id").alias("one")).agg(F.count("*").alias("n")), "first")
    kept = keyed.join(first, F.expr("key.d <=> one.d and key.h <=> one.h"), "left_semi")
    if first.where("n > 1").isEmpty():
        return kept.select("doc.*")
    again = F.row_number().over(Window.partitionBy("key").orderBy("key"))  # rows that repeat id and text are alike
    return kept.withColumn("again", again).where("again = 1").select("doc.*")
