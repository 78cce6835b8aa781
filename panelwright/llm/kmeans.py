"""Centroid clustering of integer vectors with scalar lookup tables.

Vectors are packed into blocks once: for each dimension the integer values
that occur in the block, and for each vector the place of its value among
them. In a round every block tabulates, for each dimension, the squared
difference of each occurring value and each centroid; a vector's distances are
sums of rows gathered from these tables. Tasks return exact sums by cluster,
which Spark adds up; the driver sees ``k`` centroids and nothing else.

Everything is exact: 64-bit integers where values and centroids stay below
2^27, Python's integers where they do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite, joined, limbs, written

#: Vectors of a block at most; places among its values fit 16 bits.
BLOCK = 1 << 14
#: Below it, squared differences of up to 64 dimensions add up in 64 bits.
NARROW = 1 << 27
#: From here on a double is a multiple of 1/256.
WHOLE = 2.0**45


@dataclass
class Block:
    """``values[j]`` are the integers that occur in dimension j, ``places[:, j]`` where each vector's is."""

    values: list[np.ndarray]
    places: np.ndarray

    def integers(self) -> np.ndarray:
        return np.stack([v[self.places[:, j]] for j, v in enumerate(self.values)], axis=1)


def _packed(scaled: np.ndarray, ids: list) -> pa.RecordBatch:
    values, places = [], np.empty(scaled.shape, "<u2")
    for j in range(scaled.shape[1]):
        own, at = np.unique(scaled[:, j], return_inverse=True)
        values.append(own)
        places[:, j] = at.ravel()
    cols = [pa.array([ids], pa.list_(pa.int64())), pa.array([[len(v) for v in values]], pa.list_(pa.int32())), pa.array([np.concatenate(values).astype("<f8").tobytes()]), pa.array([places.tobytes()])]
    return pa.RecordBatch.from_arrays(cols, ["ids", "sizes", "vals", "places"])


def _blocks(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = [], []
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), float).reshape(-1, dim)
            small = np.abs(x) < WHOLE
            held.append(np.where(small, np.floor(np.where(small, x, 0.0) * scale) / scale, x) + 0.0)
            ids += batch.column(0).to_pylist()
            if len(ids) >= BLOCK:
                rows = np.concatenate(held)
                full = len(ids) // BLOCK * BLOCK
                for at in range(0, full, BLOCK):
                    yield _packed(rows[at : at + BLOCK], ids[at : at + BLOCK])
                held, ids = [rows[full:]], ids[full:]
        if ids:
            yield _packed(np.concatenate(held), ids)

    return run


def _block(batch: pa.RecordBatch, i: int, scale: int) -> Block:
    sizes = batch.column(1)[i].as_py()
    flat = np.frombuffer(batch.column(2)[i].as_py(), "<f8")
    if not len(flat) or np.abs(flat).max() * scale < NARROW:
        whole = (flat * scale).astype(np.int64)
    else:
        whole = np.array([int(v) * scale if abs(v) >= WHOLE else int(v * scale) for v in flat.tolist()], object)
    values = np.split(whole, np.cumsum(sizes)[:-1])
    return Block(values, np.frombuffer(batch.column(3)[i].as_py(), "<u2").reshape(-1, len(sizes)))


def distances(block: Block, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of the block's vectors and the centroids, exact, from one table a dimension."""
    own = block.values[0].dtype == object if block.values else False
    wide = np.array([own or max(map(abs, c), default=0) >= NARROW for c in centroids])
    out = np.zeros((len(block.places), len(centroids)), object if wide.any() else np.int64)
    for columns, kind in ((np.flatnonzero(~wide), np.int64), (np.flatnonzero(wide), object)):
        if not len(columns):
            continue
        c = np.array([centroids[i] for i in columns], kind)
        part = np.zeros((len(block.places), len(columns)), kind)
        for j, values in enumerate(block.values):
            table = (values.astype(kind)[:, None] - c[None, :, j]) ** 2
            part += table[block.places[:, j]]
        out[:, columns] = part
    return out


def _sums(centroids: list[list[int]], scale: int):
    """Rows (cluster, limb, parts): the number of a cluster's vectors and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), len(centroids[0]) + 1), object)
        for batch in batches:
            for i in range(batch.num_rows):
                block = _block(batch, i, scale)
                near = distances(block, centroids).argmin(axis=1)
                order = np.argsort(near, kind="stable")
                found, starts = np.unique(near[order], return_index=True)
                total[found, 0] += np.diff(np.r_[starts, len(near)]).astype(object)
                if block.values:
                    total[found, 1:] += np.add.reduceat(block.integers()[order], starts, axis=0).astype(object)
        yield limbs(total, "cluster")

    return run


def _assigned(centroids: list[list[int]], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d = distances(_block(batch, i, scale), centroids)
                near = d.argmin(axis=1)
                least = d[np.arange(len(near)), near]
                if least.dtype == object:
                    least = [v if v < 1 << 63 else None for v in least.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(near.astype(np.int32)), pa.array(least, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, scale: int = 256) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every vector that takes part, and the final centroids.

    Needs ``vec_id, embedding``; other columns are not looked at. Vectors of
    ``dim`` components, none of them NULL, NaN or infinite, take part;
    components become ``floor(scale * x)``, ``scale`` a power of two up to 256.
    Centroids start as the ``k`` vectors with the smallest sha256 of
    ``seed:vec_id``; rows without an id come last, equal ids in order of their
    vectors. With fewer than ``k`` vectors each is a centroid, with none the
    result is empty. Repeated rows count as often as they occur. Ties go to
    the smaller number; a centroid without vectors stays. A distance that does
    not fit 64 bits is NULL; clusters are right even then.
    """
    own = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & finite("embedding"))
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = own.select(place.alias("place"), "embedding").orderBy(F.col("place").asc_nulls_last(), "embedding").limit(k).collect()  # k rows
    centroids = [[int(v) * scale if abs(v) >= WHOLE else int(np.floor(v * scale)) for v in r.embedding] for r in first]
    blocks = written(own.mapInArrow(_blocks(dim, scale), "ids array<long>, sizes array<int>, vals binary, places binary"), "kmeans-blocks")
    if not centroids:
        return blocks.selectExpr("explode(ids) AS vec_id", "0 AS cluster", "CAST(0 AS BIGINT) AS distance"), centroids
    for _ in range(rounds):
        sums = joined(blocks.mapInArrow(_sums(centroids, scale), "cluster int, limb int, parts array<long>"), "cluster", len(centroids), dim + 1)
        centroids = [[s // row[0] for s in row[1:]] if row[0] else old for row, old in zip(sums, centroids, strict=True)]
    return blocks.mapInArrow(_assigned(centroids, scale), "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds ``cluster_inertia, inertia`` (sums of distances; NULL where one does not fit 64 bits) and ``centroid_sha256``."""
    assigned = written(assigned, "kmeans-assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("open")).collect()  # one row a centroid
    by = {r.cluster: None if r.open else int(r.total) for r in sums}
    whole = None if None in by.values() else sum(by.values())
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    rows = [(i, fits(by.get(i, 0)), fits(whole), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    facts = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # facts has k rows
