"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one, so cosine >= c means a squared distance of at most 2 - 2c, and turned by a fixed
random rotation, which spreads that distance evenly. Cut into blocks of coordinates, two linked vectors are within a
block's proportional share of the budget in at least one block. Each block is joined by range: a block's vectors are
dealt into strips of its first coordinate as wide as its radius, so partners are in the same or the next strip, strips
into tiles of bounded size, and a task compares two tiles. It counts links and reports, instead of pairs, each vector's
number of links and the smallest member of its component there. A pair found in several blocks counts in the first of
them. Every candidate is verified by the cosine of the original components in double precision.

Equal vectors form a class that takes part once, with its size as weight. On data without structure most vectors share
a few strips: the work in the tiles then grows with the square of the number of vectors, though their sizes don't.

Nulls and extremes: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do
vectors of different lengths with one another. Repeated rows each count as vectors. A null id stays null and is never
a component's name unless alone. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components

BLOCKS = 4
TILE = 8192
SLACK = 1e-9


def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).normal(size=(size, size)))[0]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cuts(size: int, blocks: int) -> list[tuple[int, int]]:
    at = np.linspace(0, size, min(blocks, size) + 1).astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def placed(vectors: DataFrame, cosine: float, blocks: int) -> DataFrame:
    """node, weight, vec, size and, for each block, the strip the vector is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights, arrays = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            order: dict[int, list[int]] = {}
            for i, a in enumerate(arrays):
                order.setdefault(len(a), []).append(i)
            for size, rows in order.items():
                raw = np.array([arrays[i] for i in rows], np.float64)
                turned = unit(raw) @ rotation(size)
                spans = cuts(size, blocks)
                radius = [np.sqrt((2 - 2 * cosine) * (b - a) / size) * (1 + SLACK) for a, b in spans]
                strips = np.stack([np.floor(turned[:, a] / r) for (a, _), r in zip(spans, radius, strict=True)], axis=1).astype(np.int64)
                take = pa.array(rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(spans)), pa.array(strips.ravel()))
                yield pa.RecordBatch.from_arrays([ids.take(take), weights.take(take), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array([size] * len(rows), pa.int32()), flat], names=["node", "weight", "vec", "size", "strips"])

    return vectors.mapInArrow(run, "node bigint, weight bigint, vec binary, size int, strips array<bigint>")


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by spreading minima along links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(cosine: float, blocks: int):
    budget = 2 - 2 * cosine

    def links(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, block: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        size = x.shape[1]
        spans = cuts(size, blocks)
        a, b = spans[block]
        limit = budget * (b - a) / size
        bx, by = rx[:, a:b], ry[:, a:b]
        ny = (by * by).sum(axis=1)
        left, right = [], []
        for at in range(0, len(x), 512):
            part = bx[at : at + 512]
            i, j = np.nonzero((part * part).sum(axis=1)[:, None] + ny - 2 * part @ by.T <= limit + 1e-6)
            i = i + at
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 200_000):
                p, q = i[k : k + 200_000], j[k : k + 200_000]
                gap = (rx[p] - ry[q]) ** 2
                inside = np.stack([gap[:, s:e].sum(axis=1) <= budget * (e - s) / size * (1 + SLACK) + SLACK for s, e in spans[: block + 1]], axis=1)
                first = inside[:, block] & ~inside[:, :block].any(axis=1)
                p, q = p[first], q[first]
                good = (x[p] * y[q]).sum(axis=1) / np.sqrt((x[p] * x[p]).sum(axis=1) * (y[q] * y[q]).sum(axis=1)) >= cosine
                left.append(p[good])
                right.append(q[good])
        cat = lambda z: np.concatenate(z) if z else np.empty(0, np.int64)
        return cat(left), cat(right)

    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        node, weight = rows.column("node").to_numpy(), rows.column("weight").to_numpy()
        vec = matrix(rows.column("vec"))
        block = int(rows.column("block")[0].as_py())
        turned = unit(vec) @ rotation(vec.shape[1])
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(r)
        if same:
            p, q = links(vec[l], vec[l], turned[l], turned[l], block, True)
            p, q = l[p], l[q]
        else:
            p, q = links(vec[l], vec[r], turned[l], turned[r], block, False)
            p, q = l[p], r[q]
        n = len(node)
        count = np.bincount(p, weight[q], n) + np.bincount(q, weight[p], n)
        order = np.argsort(node, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        root = node[order[components(n, rank[p], rank[q])[rank]]]
        hit = count > 0
        return pa.table({"node": node[hit], "n": count[hit].astype(np.int64), "root": root[hit]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, blocks: int = BLOCKS, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, one row a vector."""
    ws = Workspace(vectors.sparkSession, "nearvec")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fine & F.col("vec_id").isNotNull(), F.transform("v", lambda x: x + 0.0)))
    classes = ws.cut(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    at = ws.cut(placed(classes.select("node", "weight", "v"), cosine, blocks))
    every = at.select("node", "weight", "vec", "size", F.posexplode("strips").alias("block", "strip"))
    #: Tiles of each strip; there are few strips, as a coordinate of a unit vector is within one and minus one.
    strip = ["size", "block", "strip"]
    tiles = every.groupBy(*strip).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    here = every.join(F.broadcast(tiles), strip)
    beside = lambda by, name: F.broadcast(tiles.select("size", "block", (F.col("strip") + by).alias("strip"), F.col("tiles").alias(name)))
    here = here.join(beside(-1, "after"), strip, "left").join(beside(1, "before"), strip, "left").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    until = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda s, a, b, off, side: F.struct(s.alias("strip"), a.alias("a"), b.alias("b"), F.lit(off).alias("off"), side.cast("int").alias("side"))
    meetings = F.concat(
        F.transform(until(F.col("tiles")), lambda t: task(F.col("strip"), F.least(t, F.col("own")), F.greatest(t, F.col("own")), 0, F.col("own") > t)),
        F.transform(until(F.col("after")), lambda t: task(F.col("strip"), F.col("own"), t, 1, F.lit(0))),
        F.transform(until(F.col("before")), lambda t: task(F.col("strip") - 1, t, F.col("own"), 1, F.lit(1))),
    )
    dealt = here.select("node", "weight", "vec", "size", "block", F.explode(meetings).alias("m")).select("node", "weight", "vec", "size", "block", "m.*")
    found = ws.cut(dealt.groupBy("size", "block", "strip", "a", "b", "off").applyInArrow(compare(cosine, blocks), "node bigint, n bigint, root bigint"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), ws)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    ends = classes.join(counts, "node", "left").join(labels, "node", "left").select("v", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = rows.join(ends, "v", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
