import hashlib
import math
import random

import pytest

from panelwright.llm import kmeans

DIM = 4


def brute(rows, k, rounds, seed=2):
    own = [(i, [math.floor(256 * v) if abs(v) < 2**45 else int(v) * 256 for v in x]) for i, x in rows if x is not None and len(x) == DIM and all(v is not None and math.isfinite(v) for v in x)]
    place = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [q for _, q in sorted(own, key=place)[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in own:
            groups.setdefault(nearest(q)[1], []).append(q)
        centroids = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    got = [(i, *nearest(q)) for i, q in own]
    fits = lambda v: v if v < 2**63 else None
    out = []
    for i, d, n in got:
        inertia = sum(e for _, e, m in got if m == n) if all(e < 2**63 for _, e, m in got if m == n) else 2**63
        whole = sum(e for _, e, _ in got) if all(e < 2**63 for _, e, _ in got) else 2**63
        out.append((i, n, fits(d), fits(inertia), fits(whole), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()))
    return out


def run(spark, rows, k, rounds=3):
    frame = spark.createDataFrame([(i, x, 0, "c") for i, x in rows], "vec_id long, embedding array<double>, cluster int, place string").repartition(3)
    return [tuple(r) for r in kmeans.with_inertia(*kmeans.cluster(frame, k=k, rounds=rounds, dim=DIM)).collect()]


def same(got, want):
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted(got, key=key) == sorted(want, key=key)


def vectors(n, seed):
    r = random.Random(seed)
    return [(i, [r.gauss(r.choice((-1, 0, 2)), 0.3) for _ in range(DIM)]) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "BLOCK", 32)
    rows = vectors(300, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a hot vector
    rows += [rows[5], (5, rows[6][1]), (None, rows[7][1]), (None, rows[8][1])]
    assert same(run(spark, rows, 7), brute(rows, 7, 3))


def test_awkward_rows(spark):
    good = vectors(5, 2)
    rows = [*good, (50, None), (51, [1.0]), (52, [1.0, None, 0.0, 0.0]), (53, [float("nan"), 0.0, 0.0, 0.0]), (54, [float("-inf"), 0.0, 0.0, 0.0]), (55, []), (56, [-0.0, 0.0, -0.001, 1e-300])]
    assert same(run(spark, rows, 3), brute(rows, 3, 3))
    assert same(run(spark, rows, 40), brute(rows, 40, 3))  # fewer vectors than centroids
    assert run(spark, [], 3) == [] == run(spark, [(1, None)], 3)


@pytest.mark.parametrize("far", [1e6, 1e12, 1e30, 1e300, 1.7e308])
def test_large_components_take_part(spark, far):
    rows = [*vectors(40, 4), (100, [far, -far, 0.5, 0.0]), (101, [far, far, far, -1.0])]
    assert same(run(spark, rows, 5), brute(rows, 5, 3))


def test_empty_centroids_stay(spark):
    rows = [(i, [0.0] * DIM) for i in range(6)]  # all alike: only centroid 0 gets vectors
    assert {r[1] for r in run(spark, rows, 3)} == {0}
    assert same(run(spark, rows, 3), brute(rows, 3, 3))
