import random

import xxhash
from pyspark.sql import functions as F

from panelwright.llm import simhash
from panelwright.llm.common import written
from panelwright.llm.components import components

from . import corpus

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text, n=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, bits):
    """fps: list of (id, fp); the smallest id that can be reached."""
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return [least[find(i)] for i in range(len(fps))]


def test_equals_brute_force(spark):
    rows = corpus.rows()
    r = random.Random(1)
    for i, base in enumerate(rows[:12]):
        words = base[1].split(" ")
        words[r.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words) if len(words) > 60 else base[1] + " ", *base[2:]))
    fps = [(d[0], slow_fingerprint(d[1])) for d in rows]
    want = sorted(zip([str(f[0]) for f in fps], [f"{f[1]:016x}" for f in fps], [str(c) for c in slow_components(fps, 4)], strict=True))
    got = simhash.near_groups(corpus.docs(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got) == want


def test_links_equal_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(8)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4, 5) for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    for bits in (2, 3, 4, 6):
        got = [(x.fp, x.other) for x in simhash.links(frame, bits).collect()]
        want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        assert len(got) == len(set(got)) and set(got) == want


def test_the_index_is_not_broadcast(spark):
    """It has 64 rows a fingerprint, which Spark's estimate of its size leaves out; tables under the threshold would be sent to the driver."""
    fps = written(spark.range(1000).select(F.xxhash64("id").alias("fp")), "fps")
    found = simhash.links(fps)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_text_in_pieces():
    words = ["w%d" % (i % 977) for i in range(5000)]
    text = " ".join(words).encode()
    pieces = [w for p in simhash.word_pieces(text, 512) for w in p]
    assert pieces == text.split()
    assert simhash.fingerprint(text, 4) == slow_fingerprint(text.decode())


def slow_kept(rows, n, bits, similarity):
    """The ids that stay: links by fingerprint or by sets of shingles, all pairs."""
    import re

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    own = [(d[0], slow_fingerprint(d[1], n), grams(d[1])) for d in rows]
    up = list(range(len(own)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, f, g) in enumerate(own):
        for j, (_, f2, g2) in enumerate(own[:i]):
            if (f ^ f2).bit_count() <= bits or (g | g2 and len(g & g2) >= similarity * len(g | g2)):
                a, b = sorted((find(i), find(j)), key=lambda x: own[x][0])
                up[b] = a
    return sorted({own[find(i)][0] for i in range(len(own))})


def test_keep_one_finds_four_fifths(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):
        words = ["w%d" % r.randrange(5000) for _ in range(r.randint(60, 400))]
        rows.append(" ".join(words))
        for changes in (1, 2, 4, 8):
            near = list(words)
            for _ in range(changes):
                near[r.randrange(len(near))] = "other"
            rows.append(" ".join(near))
    r.shuffle(rows)
    docs = corpus.simple(spark, rows)
    want = slow_kept([(i, t) for i, t in enumerate(rows)], 5, 4, 0.8)
    got = sorted(x.doc_id for x in simhash.keep_one(docs).collect())
    only_bits = simhash.keep_one(docs, similarity=None).count()
    assert set(want) <= set(got) and len(got) <= len(want) + 3, (len(want), len(got), only_bits)
    assert only_bits > len(want) + 20


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(50)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)] + [(200, 200 + i) for i in range(1, 30)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_keep_one_and_empty(spark):
    docs = corpus.simple(spark, ["a b c d e f g"] * 3 + ["other words are in here now", None, ""])
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]
    assert kept.columns == docs.columns
    assert simhash.near_groups(corpus.docs(spark, [])).count() == 0
    assert simhash.keep_one(docs.filter(F.lit(False))).count() == 0


def test_keep_one_decides_by_row(spark):
    """NULL ids, repeated rows and one id with two texts."""
    near, far = "a b c d e f g", "other words are in here now"
    rows = [(1, near), (1, near), (1, far), (2, far), (None, near), (None, "only this one has no id"), (None, "only this one has no id"), (None, "nor has this one any id")]
    docs = corpus.docs(spark, [(i, t, "en", "s", 0, 0, 0.0, 0, "") for i, t in rows])
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, near), (1, far), (None, "only this one has no id"), (None, "nor has this one any id")], key=str)
