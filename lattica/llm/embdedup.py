"""Near duplicates among embeddings: all pairs in tiles, leading principal dimensions first.

Vectors are scaled to length one and turned to the principal axes of the table, which keeps their inner products and
puts most of each into the leading dimensions. A k-d tree over those dimensions groups the vectors into tiles. Two
tiles whose boxes lie too far apart for the threshold are never compared. Within a pair of tiles one product over the
leading dimensions plus the product of the suffix norms bounds every cosine; pairs whose bound misses the threshold
stop there, the rest gather further dimensions against tighter suffix bounds, and what is left is decided by the
cosine of the original vectors in double precision.

Neighbouring tiles form blocks. A task compares the tiles of two blocks, so a tile travels once for each block whose
box is near and not once for each tile, in the width that its components came in. Which blocks are near is found where
the tile lies.

Equal vectors are one row with a count before any tile is made, so copies cost nothing; two blocks return counts and
edges that span what they linked, never its pairs, so sets of near copies stay linear. What the driver holds is the
moment matrix, a bounded sample for the tree, and one box a tile (some 100 bytes for at least 1,024 vectors).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so
do vectors without vec_id; vectors of different lengths don't link; rows that share a vec_id count one by one; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import stored
from lattica.llm.components import components

THRESHOLD = 0.9
LEAD, STEP, BOX = 16, 16, 6
MARGIN = 1e-4  # over the rounding of bounds in single precision
BLOCK, LARGEST_TILE, TREE_SAMPLE = 2048, 16384, 20_000
BLOCK_BYTES, TASK_BYTES = 1 << 26, 1 << 27


def unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components neither overflow nor vanish
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _moments(vectors: DataFrame, size: int) -> np.ndarray:
    """Sum of the outer products of the unit vectors, added up where they lie."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for part in parts:
            if part.num_rows:
                x = unit(_matrix(part.column(0), size))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["at", "value"])

    out = np.zeros(size * size)
    for r in vectors.select("embedding").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(size, size)


def _tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits of a k-d tree in heap order: (dimension, cut) at the median of the widest dimension."""
    splits, level = [], [points]
    for _ in range(depth):
        below = []
        for p in level:
            d = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
            cut = float(np.median(p[:, d])) if len(p) else 0.0
            splits.append((d, cut))
            below += [p[p[:, d] < cut], p[p[:, d] >= cut]]
        level = below
    return splits


def _leaf(points: np.ndarray, splits: list[tuple[int, float]], depth: int) -> np.ndarray:
    at = np.zeros(len(points), dtype=np.int64)
    dims, cuts = np.array([d for d, _ in splits], dtype=np.int64), np.array([c for _, c in splits])
    for _ in range(depth):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] >= cuts[at])
    return at - (2**depth - 1)


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs (u, v) connect, at most one for each end."""
    nodes, inverse = np.unique(np.r_[u, v], return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


class Tile:
    """Rows of one tile, in the principal axes and as they came."""

    def __init__(self, ids: bytes, counts: bytes, data: bytes, axes: np.ndarray, width: type = np.float64) -> None:
        self.ids, self.counts = np.frombuffer(ids, dtype=np.int64), np.frombuffer(counts, dtype=np.int64)
        self.raw = np.frombuffer(data, dtype=width).reshape(len(self.ids), -1).astype(np.float64)
        self.unit = unit(self.raw)
        self.turned = self.unit @ axes
        size = self.turned.shape[1]
        rest = np.sqrt(np.maximum(np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1], 0))
        self.suffix = np.c_[rest, np.zeros(len(self.ids))]  # norm from each dimension on
        self.lead = min(LEAD, size)
        self.bound = np.c_[self.turned[:, : self.lead], self.suffix[:, self.lead]].astype(np.float32)


def compare(a: Tile, b: Tile, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in a, j in b) of all linked pairs; i < j if it is the same tile."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    least, size = threshold - MARGIN, a.turned.shape[1]
    for x in range(0, len(a.ids), BLOCK):
        for y in range(x if same else 0, len(b.ids), BLOCK):
            bound = a.bound[x : x + BLOCK] @ b.bound[y : y + BLOCK].T
            i, j = np.nonzero(bound >= least)
            i, j = i + x, j + y
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 200_000):
                p, q = i[k : k + 200_000], j[k : k + 200_000]
                so_far = np.einsum("nd,nd->n", a.turned[p, : a.lead], b.turned[q, : a.lead])
                for d in range(a.lead, size, STEP):
                    so_far += np.einsum("nd,nd->n", a.turned[p, d : d + STEP], b.turned[q, d : d + STEP])
                    ok = so_far + a.suffix[p, min(size, d + STEP)] * b.suffix[q, min(size, d + STEP)] >= least
                    p, q, so_far = p[ok], q[ok], so_far[ok]
                ok = np.einsum("nd,nd->n", a.unit[p], b.unit[q]) >= threshold
                found.append((p[ok], q[ok]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _near_boxes(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the boxes that hold points near enough to one box: unit vectors at that cosine lie sqrt(2 - 2 cos) apart."""
    gap = np.maximum(0, np.maximum(lows - high, low - highs))
    return np.flatnonzero((gap**2).sum(axis=1) <= 2 - 2 * threshold + 1e-6)


def _pairs_of_boxes(low: np.ndarray, high: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs i <= j of near boxes."""
    return [(i, i + int(k)) for i in range(len(low)) for k in _near_boxes(low[i], high[i], low[i:], high[i:], threshold)]


def _tiles_a_block(tiles: int, tile_bytes: int, cores: int) -> int:
    """Tiles in a block: as many as memory allows, but not so many that there are under some four pairs of blocks a core."""
    return max(1, min(BLOCK_BYTES // tile_bytes, tiles // (math.isqrt(8 * cores) + 1)))


def links(vectors: DataFrame, size: int, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rep, n, embedding) with distinct embeddings of one size -> (rep, linked) with the rows linked to each, and spanning edges (u, v)."""
    spark = vectors.sparkSession
    total = vectors.count()
    axes = np.linalg.eigh(_moments(vectors, size))[1][:, ::-1].copy()
    rows = min(LARGEST_TILE, max(1024, total // 12))
    depth = max(0, int(np.ceil(np.log2(max(1, total / rows)))))
    box = min(BOX, size)
    width = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    sample = vectors.select("embedding").sample(min(1.0, TREE_SAMPLE / max(1, total)), seed=3).toArrow()["embedding"].combine_chunks()
    points = unit(_matrix(sample, size)) @ axes[:, :box] if len(sample) else np.zeros((0, box))
    splits = _tree(points, depth)

    def place(parts: Iterator[pa.RecordBatch], many: dict[int, int]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                rep = part.column(0).to_numpy()
                leaf = _leaf(unit(_matrix(part.column(2), size)) @ axes[:, :box], splits, depth)
                share = np.array([many.get(int(k), 1) for k in leaf])  # a leaf that outgrew the sample's guess is dealt out
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(rep.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) % share.astype(np.uint64)).cast(pa.int64()), *part.columns], names=["leaf", "share", "rep", "n", "embedding"])

    schema = "leaf long, share long, rep long, n long, embedding array<double>"
    flat = vectors.select("rep", "n", F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = flat.mapInArrow(functools.partial(place, many={}), schema).groupBy("leaf").count().collect()
    many = {r["leaf"]: -(-r["count"] // rows) for r in sizes if r["count"] > 2 * rows}

    def pack(group: pa.Table) -> pa.Table:
        x = _matrix(group["embedding"].combine_chunks(), size)
        p = unit(x) @ axes[:, :box]
        one = lambda v: pa.array([np.ascontiguousarray(v).tobytes()], type=pa.binary())
        return pa.table({"leaf": group["leaf"].slice(0, 1), "share": group["share"].slice(0, 1), "ids": one(group["rep"].to_numpy()), "counts": one(group["n"].to_numpy()), "data": one(x.astype(width)), "low": one(p.min(axis=0)), "high": one(p.max(axis=0))})

    tiles = stored(flat.mapInArrow(functools.partial(place, many=many), schema).groupBy("leaf", "share").applyInArrow(pack, "leaf long, share long, ids binary, counts binary, data binary, low binary, high binary"))
    boxes = sorted(((r["leaf"], r["share"]), np.frombuffer(r["low"]), np.frombuffer(r["high"])) for r in tiles.select("leaf", "share", "low", "high").collect())
    low, high = (np.array([b[k] for b in boxes]).reshape(-1, box) for k in (1, 2))
    tile_bytes, cores = rows * size * np.dtype(width).itemsize, spark.sparkContext.defaultParallelism
    per = _tiles_a_block(len(boxes), tile_bytes, cores)
    starts = np.arange(0, len(boxes), per)
    blocks = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
    # a box a tile
    shared = spark.sparkContext.broadcast(({b[0]: k for k, b in enumerate(boxes)}, low, high, *blocks))

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of blocks that each tile is part of."""
        names, low, high, lows, highs = shared.value
        for part in parts:
            at = [names[k] for k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            near = [_near_boxes(low[k], high[k], lows, highs, threshold).tolist() for k in at]
            cells = [[{"a": min(k // per, q), "b": max(k // per, q)} for q in found] for k, found in zip(at, near, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), *part.columns[2:5]], names=["at", "cells", "ids", "counts", "data"])

    sent = tiles.select("leaf", "share", "ids", "counts", "data").mapInArrow(send, "at long, cells array<struct<a: long, b: long>>, ids binary, counts binary, data binary")
    cells = len(starts) * (len(starts) + 1) // 2
    tasks = max(min(4 * cells, 16 * cores), -(-len(boxes) * len(starts) * tile_bytes // TASK_BYTES))
    work = sent.select(F.explode("cells").alias("cell"), "at", "ids", "counts", "data").select("cell.a", "cell.b", "at", "ids", "counts", "data").repartition(tasks, "a", "b")

    def run(key: tuple[pa.Scalar, pa.Scalar], group: pa.Table) -> pa.Table:
        """Compares the tiles of block a with those of block b."""
        _, low, high, _, _ = shared.value
        places = {int(at): k for k, at in enumerate(group["at"].to_pylist())}
        left, right = (sorted(at for at in places if at // per == k.as_py()) for k in key)

        def tile(at: int) -> Tile:
            return Tile(*(group[c][places[at]].as_py() for c in ("ids", "counts", "data")), axes, width)

        seen: list[tuple[np.ndarray, np.ndarray]] = []
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for x in left:
            later = [y for y in right if y >= x]
            a = tile(x) if later else None
            for y in (later[k] for k in _near_boxes(low[x], high[x], low[later], high[later], threshold)):
                b = a if x == y else tile(y)
                i, j = compare(a, b, x == y, threshold)
                if len(i):
                    edges.append(spanning(a.ids[i], b.ids[j]))
                    rep, at = np.unique(np.r_[a.ids[i], b.ids[j]], return_inverse=True)
                    seen.append((rep, np.bincount(at, weights=np.r_[b.counts[j], a.counts[i]]).astype(np.int64)))
        none = np.zeros(0, dtype=np.int64)
        u, v = spanning(*(np.concatenate([none, *(e[k] for e in edges)]) for k in (0, 1))) if edges else (none, none)
        rep, linked = (np.concatenate([none, *(r[k] for r in seen)]) for k in (0, 1))
        return pa.table({"u": np.r_[u, rep], "v": pa.array([*v.tolist(), *[None] * len(rep)], pa.int64()), "linked": pa.array([*[None] * len(u), *linked.tolist()], pa.int64())})

    found = stored(work.groupBy("a", "b").applyInArrow(run, "u long, v long, linked long"))
    return found.where("linked is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("linked").alias("linked")), found.where("v is not null").select("u", "v")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = e.isNotNull() & (F.size(e) > 0) & F.col("vec_id").isNotNull() & ~F.coalesce(F.exists(e, bad), F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).withColumn("whole", whole)
    reps = stored(rows.where("whole").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    counts = spark.createDataFrame([], "rep long, linked long")
    edges = spark.createDataFrame([], "u long, v long")
    for size in sorted(r["s"] for r in reps.select(F.size("embedding").alias("s")).distinct().collect()):
        linked, pairs = links(reps.where(F.size("embedding") == size), size, threshold)
        counts, edges = counts.union(linked), edges.union(pairs)
    found = components(edges)
    # the copies of a vector link each other and what their representative links
    named = reps.join(counts, "rep", "left").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("embedding", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = rows.where("whole").join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not whole").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
