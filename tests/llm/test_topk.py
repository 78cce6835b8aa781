import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.llm import topk


def brute(rows, asks, k):
    own = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = set()
    for i, q in own:
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p in own if j != i and len(p) == len(q))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def run(spark, rows, asks, k=5):
    frame = spark.createDataFrame([(i, x, 0, 1.0) for i, x in rows], "vec_id long, embedding array<float>, label int, norm double")
    return [tuple(r) for r in topk.top_k(frame, asks, k).collect()]


def vectors(n, dim, seed, scale):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) * scale(r) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "scale"), [(1, lambda r: 1.0), (2, lambda r: r.lognormvariate(0, 2)), (3, lambda r: -abs(r.gauss(0, 0.01)))])
def test_equals_brute_force(spark, monkeypatch, seed, scale):
    for name, value in (("BUCKET", 64), ("BLOCK", 8), ("SEEDS", 32)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors(600, 8, seed, scale)
    rows = [(i, [float(v) for v in spark.createDataFrame([(x,)], "x array<float>").first().x]) if i < 3 else (i, [math.floor(v * 64) / 64 for v in x]) for i, x in rows]
    rows += [(1000 + i, rows[7][1]) for i in range(100)]  # copies tie
    got = run(spark, rows, F.col("vec_id") % 20 == 0)
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda i: i % 20 == 0, 5)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (7, [1.0]), (100, [3.0]), (8, [])]
    asks = lambda i: i % 50 == 0
    assert set(run(spark, rows, F.col("vec_id") % 50 == 0)) == brute(rows, asks, 5)
    assert run(spark, [], F.col("vec_id") % 50 == 0) == []
    assert run(spark, [(0, [1.0])], F.col("vec_id") % 50 == 0) == []


def test_sql_gives_empty_vectors_zero(spark, tmp_path):
    import duckdb

    from panelwright.llm import queries

    rows = [(0, []), (50, []), (7, []), (1, [1.0, 2.0]), (100, [0.5, -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(r[0], r[1], r[2], r[3]) for r in con.execute(queries.ORACLE_SQL["op8_topk"]).fetchall()}
    assert {tuple(r) for r in queries.op8_topk(spark, str(tmp_path)).collect()} == want == {(0, 1, 7, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 7, 0), (100, 1, 1, -98304)}


def test_large_components_take_part(spark, monkeypatch):
    """Beyond 2**22, and with sums beyond 2**53 and, inside, 2**63."""
    for name, value in (("BUCKET", 8), ("BLOCK", 4), ("SEEDS", 16)):
        monkeypatch.setattr(topk, name, value)
    rows = [(i, [math.floor(v * 64) / 64 for v in x]) for i, x in vectors(60, 4, 5, lambda r: 1.0)]
    rows += [(100, [2.0**22, 1.0, 0.0, -3.0]), (101, [-(2.0**23), 2.0**22, 1.0, 0.0]), (102, [2.0**24, -(2.0**24), 0.0, 0.0]), (120, [0.0, 0.0, 0.0, 2.0**22])]
    assert set(run(spark, rows, F.col("vec_id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0, 5)
    a, b = topk.np.array([[2**60, 2**60]]), topk.np.array([[2**60, 5 - 2**60], [1, 2]])
    assert topk.products(a, b).tolist() == [[5 * 2**60, 3 * 2**60]]


@pytest.mark.parametrize("far", [2.0**46, 1e15, 1e30, 1e155, 1e300, 1.7e308])
def test_components_beyond_64_bits_take_part(spark, monkeypatch, far):
    """Ranks are those of exact scores; scores that are no 64-bit number are NULL."""
    for name, value in (("BUCKET", 8), ("BLOCK", 4), ("SEEDS", 16)):
        monkeypatch.setattr(topk, name, value)
    rows = [(i, [math.floor(v * 64) / 64 for v in x]) for i, x in vectors(60, 3, 6, lambda r: 1.0)]
    rows += [(100, [far, 1.0, 0.0]), (101, [-far, far, 0.25]), (102, [far, far, far]), (103, [far, 1.0, 0.0]), (120, [0.0, -far, far / 2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 5).collect()}
    whole = [(i, [math.floor(256 * v) if abs(v) < 2.0**45 else int(v) * 256 for v in x]) for i, x in rows]
    want = set()
    for i, q in whole:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p in whole if j != i)[:5]
            want |= {(i, n + 1, j, -s if -(2**63) <= -s < 2**63 else None) for n, (s, j) in enumerate(best)}
    assert got == want
