import re

from pyspark.sql import functions as F

from panelwright.llm import mixing

from . import corpus


def slow_targets(sizes, weights, most):
    """The excess goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def check(spark, rows):
    docs = corpus.docs(spark, rows)
    got = mixing.mix_sources(docs).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = slow_targets(sizes, (1, 2, 3), 3)
    assert len(got) == len(rows)
    largest = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.size * r.copies <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    return want, taken, largest


def test_targets_and_nearness(spark):
    rows = [r for r in corpus.rows() if r[0] is not None and r[0] < 60]
    want, taken, largest = check(spark, rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(largest[s] / 2, 0.1 * t)


def test_awkward_rows(spark):
    check(spark, corpus.rows())


def test_one_huge_document_about_the_cut(spark):
    """Wherever the huge document stands in the order, the others fill up what it leaves open."""
    for huge in (7,):
        rows = [(i, "w " * (20000 if i == huge else 10 + i % 40), "en", "s" if i < 1000 else "t", 0, 0, 0.0, 0, "") for i in range(1500)]
        want, taken, _ = check(spark, rows)
        for s, t in want.items():
            assert abs(taken[s] - t) <= 0.006 * t


def slow_mix(rows, seed=7, near=0.005):
    """One document after another, in plain Python."""
    import hashlib

    text = {r[0]: r[1] for r in rows}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r[0])
    targets = slow_targets({s: sum(size[i] for i in ids) for s, ids in sources.items()}, (1, 2, 3), 3)
    out = {}
    for s, ids in sources.items():
        total = sum(size[i] for i in ids)
        whole = int(targets[s] // total) if total else 0
        gap = targets[s] - whole * total
        chance = targets[s] / total - whole if total else 0
        u = {i: (int(hashlib.md5(f"{seed}:{i}:{hashlib.md5((text[i] or '').encode()).hexdigest()}:0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in ids}
        order = sorted((i for i in ids if size[i] and 0 < chance), key=lambda i: (u[i] / (1 - u[i]) / (chance / (1 - chance)), i))
        took, at, most = set(), 0, float("inf")
        while True:
            here, k = gap, len(order)
            for n in range(at, len(order)):
                if size[order[n]] > most:
                    continue
                if size[order[n]] > gap:
                    k = n
                    break
                took.add(order[n])
                gap -= size[order[n]]
            at, most = k, gap
            if gap <= near * targets[s] or (gap == here and most != float("inf") and k == len(order)) or k == len(order):
                break
        left = [(abs(size[i] - gap), n, i) for n, i in enumerate(order) if i not in took and abs(size[i] - gap) < gap]
        took |= {min(left)[2]} if left else set()
        out |= {i: whole + (i in took) for i in ids}
    return out


def test_against_a_slow_mix(spark):
    rows = [(i, t, lang, source, *rest) for i, t, lang, source, *rest in corpus.rows() if i is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r.copies for r in mixing.mix_sources(corpus.docs(spark, rows)).collect()}
    assert got == slow_mix(rows)


def test_query_against_its_sql(spark, tmp_path):
    import duckdb

    from panelwright.llm import queries

    rows = [(i, "w " * (9000 if i % 50 == 0 else 5 + i % 70), "en", [None, "a", "b", "c"][i % 4 if i < 300 else 1], 0, 0, 0.0, 0, "") for i in range(500)]
    rows += [(7, "one w", "en", "a", 0, 0, 0.0, 0, ""), (None, "w w w", "en", "b", 0, 0, 0.0, 0, ""), (1000, None, "en", "c", 0, 0, 0.0, 0, "")]
    corpus.docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, con.execute(queries.ORACLE_SQL["op6_mixing"]).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op6_mixing(spark, str(tmp_path)).collect()) == want


def test_repeated_ids_and_alike_rows_come_near_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE", 64)  # alike rows are numbered in several blocks
    for name, text in ((None, "w " * 100), (7, None)):
        rows = [(name, text or f"{'w ' * 99}no{i}", "en", "ab"[i % 2], 0, 0, 0.0, 0, "") for i in range(600)]
        want, taken, _ = check(spark, rows)
        for s, t in want.items():
            assert abs(taken[s] - t) <= 50, (name, text)


def test_limits(spark):
    rows = [(i, "w " * (1000 if i < 3 else 2), "en", "abc"[min(i, 2)], 0, 0, 0.0, 0, "") for i in range(30)]
    want, taken, _ = check(spark, rows)
    assert want["a"] < 3000 and want["c"] > 1000


def test_sources_without_words_and_empty(spark):
    check(spark, [(1, None, "en", "a", 0, 0, 0.0, 0, ""), (2, "", "en", "b", 0, 0, 0.0, 0, "")])
    assert mixing.mix_sources(corpus.docs(spark, [])).count() == 0


def test_certain_copies_and_chances(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2], 0, 0, 0.0, 0, "") for i in range(400)]
    got = mixing.mix_sources(corpus.docs(spark, rows)).groupBy("source").agg(F.min("copies").alias("low"), F.max("copies").alias("high"), F.sum("copies").alias("n")).collect()
    # a third of all words is 2/3 of a's, two thirds are 4/3 of b's
    assert {r.source: (r.low, r.high, r.n) for r in got} == {"a": (0, 1, 133), "b": (1, 2, 267)}


def test_no_python_in_the_plan(spark):
    plan = mixing.mix_sources(corpus.docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
