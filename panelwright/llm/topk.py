"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors become integers, are ranged by length and packed into buckets of
``BUCKET`` vectors that are next to each other in length, so equal vectors and
hot lengths fill many buckets and no task takes more than its share. A first
threshold for each query comes from the ``SEEDS`` longest vectors. Blocks of
queries then meet the buckets in an equality join on a salt, of which there are
twice the square root of the buckets' number, so that both the copies of a
block and the buckets of a salt grow slowly; a bucket whose longest vector cannot reach the block's least threshold is left out by the
join itself. Inside a bucket each query has a local threshold on the cosine:

* above 1: nothing in the bucket can be among its best;
* high: coordinate pruning, on the query's largest coordinate: with cosine c
  at least, the unit vectors' coordinates lie between ``q c -+ sqrt((1 - q^2)(1 - c^2))``;
* else: length pruning, on the vectors long enough for the threshold.

What is left is verified by exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import finite, written

BUCKET, BLOCK, SEEDS = 2048, 128, 1024
#: From this local cosine on the coordinate is what prunes best.
STEEP = 0.6


#: From here on a double is a multiple of 1/256.
WHOLE = 2.0**45


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, q, norm, dim`` of vectors whose components are all finite; 256 times ``q`` are the integers, ``norm`` is the length of ``q``."""
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite("embedding")
    x = F.transform("embedding", lambda v: v.cast("double"))
    q = F.transform(x, lambda v: F.when(F.abs(v) < WHOLE, F.floor(v * 256.0).cast("double") / 256.0).otherwise(v))
    out = vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))
    most = F.coalesce(F.array_max(F.transform("q", F.abs)), F.lit(0.0))  # divided by first, so that squares of large components stay finite
    scaled = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + (v / F.col("most")) * (v / F.col("most"))))
    out = out.withColumn("most", most).withColumn("norm", F.when(F.col("most") > 0, F.least(F.col("most") * scaled, F.lit(1.7e308))).otherwise(0.0))
    return out.drop("most").withColumn("dim", F.size("q"))


def _whole(x: np.ndarray) -> np.ndarray:
    """256 times exact doubles as Python integers."""
    return np.array([[int(v) * 256 if abs(v) >= WHOLE else int(v * 256) for v in row] for row in x.tolist()], object).reshape(x.shape)


def scores_of(a: np.ndarray, b: np.ndarray, most: float | None = None) -> np.ndarray:
    """Exact integer products of 256 times the rows; 64-bit ones where they fit, Python integers where one does not.

    ``most`` is a bound of b's components, for callers that know one.
    """
    if most is not None and np.abs(a).max(initial=0.0) * most < 2.0**53 / UNIT / max(1, a.shape[1]):
        return ((a * UNIT) @ b.T).astype(np.int64)  # sums of integers below 2^53
    far = np.abs(b).max(axis=1, initial=0.0) >= 2.0**52
    if np.abs(a).max(initial=0.0) >= 2.0**52:
        far[:] = True
    if not far.any():
        return products((a * 256).astype(np.int64), (b * 256).astype(np.int64))
    out = np.empty((len(a), len(b)), object)
    if not far.all():
        out[:, ~far] = products((a * 256).astype(np.int64), (b[~far] * 256).astype(np.int64)).astype(object)
    out[:, far] = _whole(a) @ _whole(b[far]).T
    return out


def _floats(scores: np.ndarray) -> np.ndarray:
    """Near the scores; what is beyond all doubles is at their ends."""
    if scores.dtype != object:
        return scores.astype(float)
    return np.array([max(-MOST, min(MOST, v)) for v in scores.ravel().tolist()], object).astype(float).reshape(scores.shape)


#: The largest double, as an integer, and what 256 squared is: scores are that many times products of ``q``.
MOST, UNIT = int(np.finfo(float).max), 65536.0


_PACKED = "block long, dim int, top double, least double, ids binary, q binary, norms binary, theta binary"
_TYPES = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]


def _packs(size: int, seeds, k: int):
    """Rows sorted by dim and falling norm, packed; with seeds (ids, matrix), thresholds of queries too."""

    def pack(part: int, n: int, dim: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, q, norms = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<f8").reshape(len(rows), dim), np.array([r[2] for r in rows])
        theta = np.full(len(rows), -np.inf)
        if seeds is not None and dim in seeds.value:
            seed_ids, m = seeds.value[dim]
            scores = np.where(seed_ids[None, :] == ids[:, None], -np.inf, _floats(scores_of(q, m)))
            if m.shape[0] >= k:
                theta = np.partition(scores, m.shape[0] - k, axis=1)[:, m.shape[0] - k]
                theta = np.where(np.abs(theta) < 2.0**53, theta, np.nextafter(theta, -np.inf))  # not above the exact score
        row = (part << 32 | n, dim, float(norms.max()), float(theta.min()), ids.tobytes(), q.tobytes(), norms.tobytes(), theta.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], [f.split()[0] for f in _PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, rows, dim = TaskContext.get().partitionId(), 0, [], None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and (len(rows) == size or row[3] != dim):
                    yield pack(part, n, dim, rows)
                    rows, n = [], n + 1
                dim = row[3]
                rows.append(row)
        if rows:
            yield pack(part, n, dim, rows)

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats where sums stay below 2**53, the other rows of b by 64-bit or Python integers."""
    if not a.size or not b.size:
        return a.astype(np.int64) @ b.astype(np.int64).T
    bound = np.abs(b).max(axis=1).astype(float) * float(np.abs(a).max()) * a.shape[1]
    wide = np.flatnonzero(bound >= 2.0**53)
    if not len(wide):
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    kind = np.int64 if bound.max() < 2.0**62 else object
    out = np.empty((len(a), len(b)), kind)
    small = np.flatnonzero(bound < 2.0**53)
    out[:, small] = (a.astype(float) @ b[small].astype(float).T).astype(np.int64)
    out[:, wide] = a.astype(kind) @ b[wide].astype(kind).T
    return out


def _best(k: int):
    def one(q, q_norm, theta, own, ids, m, norms, unit, most):
        """(vec_id, score) of at most k candidates of a bucket for a query; norms fall."""
        top = norms[0]
        at = np.arange(len(ids))
        reach = theta / UNIT
        if theta > 0 and q_norm > 0:
            local = reach / q_norm / top if top > 0 else np.inf
            if local > 1 + 1e-9:
                return
            if local >= STEEP:
                f = int(np.abs(q).argmax())
                x, c = float(q[f]) / q_norm, min(1.0, local)
                spread = np.sqrt(max(0.0, 1 - x * x) * max(0.0, 1 - c * c)) + 1e-9
                # a cosine above c moves the lower end towards x and may leave the upper end open beyond it
                low = x * c - spread if x >= 0 else -1.0
                high = x * c + spread if x < 0 else 1.0
                at = np.flatnonzero((unit[:, f] >= low) & (unit[:, f] <= high))
            else:
                at = at[: int(np.searchsorted(-norms, -(reach / q_norm) * (1 - 1e-9), side="right"))]
        if not len(at):
            return
        scores = scores_of(q[None, :], m[at], most)[0]
        ok = (scores >= theta) & (ids[at] != own)
        at, scores = at[ok], scores[ok]
        if len(at) > k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= cut
            at, scores = at[keep], scores[keep]
        order = np.lexsort((ids[at], -scores))[:k] if scores.dtype != object else sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]]))[:k]
        yield from zip(ids[at][order].tolist(), scores[order].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                dim, q_ids, q, q_norms, thetas, ids, m, norms = (batch.column(j)[i].as_py() for j in range(8))
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                q, m = np.frombuffer(q, "<f8").reshape(len(q_ids), dim), np.frombuffer(m, "<f8").reshape(len(ids), dim)
                q_norms, thetas, norms = np.frombuffer(q_norms), np.frombuffer(thetas), np.frombuffer(norms)
                unit, most = m / np.maximum(norms, 1e-300)[:, None], float(np.abs(m).max(initial=0.0))
                for j, own in enumerate(q_ids.tolist()):
                    out += ((own, *hit) for hit in one(q[j], q_norms[j], thetas[j], own, ids, m, norms, unit, most))
            cols = [[r[0] for r in out], [r[1] for r in out], *zip(*(_ordered(r[2]) for r in out), strict=True)] if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["query_id", "vec_id", "side", "score", "digits"])

    return run


def _ordered(score: int) -> tuple[int, int, str]:
    """A score as something that sorts like it: where it does not fit 64 bits, by its side and its digits (of negative ones their complements)."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, score, ""
    digits = str(abs(score))
    if score > 0:
        return 1, 0, f"{len(digits):04d}{digits}"
    return -1, 0, "".join(str(9 - int(d)) for d in f"{len(digits):04d}{digits}")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` (of ``vec_id``) the k best others.

    Components are ``floor(256 * x)``; the score is the inner product. Ties go
    to the smaller vec_id. Vectors that are NULL or have NULL, NaN or
    infinite components take no part, nor do rows without an id. Products and
    sums are exact at any size, and so is the order; a score that does not fit
    64 bits is NULL.
    Vectors of another dimension than the query's are not compared with it.
    Rows that share the query's id are its own, not candidates; repeated rows
    are candidates once each. A query without candidates has no rows. Vectors
    without components score 0.
    """
    spark = vectors.sparkSession
    whole = written(integers(vectors.select("vec_id", "embedding")), "vectors")
    longest = whole.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect()
    seeds: dict[int, list] = {}
    for r in longest:
        seeds.setdefault(r["dim"], []).append((r["vec_id"], r["q"]))
    shared = spark.sparkContext.broadcast({d: (np.array([x[0] for x in own], "<i8"), np.array([x[1] for x in own], "<f8").reshape(len(own), d)) for d, own in seeds.items()})
    order = ["dim", F.desc("norm"), "vec_id"]
    ranged = whole.repartitionByRange(*order).sortWithinPartitions(*order)
    buckets = written(ranged.select("vec_id", "q", "norm", "dim").mapInArrow(_packs(BUCKET, None, k), _PACKED), "buckets")
    asked = whole.filter(is_query).dropDuplicates(["vec_id", "q"]).repartitionByRange(*order).sortWithinPartitions(*order)
    salts = max(8, 2 * isqrt(buckets.count()))
    blocks = asked.select("vec_id", "q", "norm", "dim").mapInArrow(_packs(BLOCK, shared, k), _PACKED)
    asks = blocks.select(F.col("dim").alias("q_dim"), F.col("top").alias("q_top"), F.col("least").alias("q_least"), F.col("ids").alias("q_ids"), F.col("q").alias("q_q"), F.col("norms").alias("q_norms"), "theta", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("q_salt"))
    held = buckets.drop("theta").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    reach = F.col("q_top") * F.col("top") * (1 + 1e-9) >= F.col("q_least") / UNIT
    pairs = held.join(asks, (F.col("dim") == F.col("q_dim")) & (F.col("salt") == F.col("q_salt")) & reach)
    found = pairs.select("dim", "q_ids", "q_q", "q_norms", "theta", "ids", "q", "norms").mapInArrow(_best(k), "query_id long, vec_id long, side int, score long, digits string")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("digits"), "vec_id"))
    score = F.when(F.col("side") == 0, F.col("score")).alias("score")
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
