import hashlib
import random
import re

import numpy as np

from panelwright.llm import decontam
from panelwright.llm.grams import Grams

from . import corpus

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(text, items):
    w = words(text)
    hit, seen = set(), set()
    for item, other in items:
        b = words(other)
        n = min(13, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                seen.add(item)
    names = ",".join(sorted(map(str, seen)))
    return len(w), len(hit), len(seen), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_equals_brute_force(spark):
    r = random.Random(7)
    rows = corpus.rows()
    items = []
    for i in range(25):
        src = words(rows[r.randrange(50)][1])
        at, n = r.randrange(max(1, len(src) - 20)), r.choice([1, 3, 7, 12, 13, 14, 20, 40])
        items.append((i, "  ".join(src[at : at + n]).upper()))
    items += [(100, ""), (101, None), (102, "--"), (103, "never seen words here"), (3, "a second text of item three"), (7, items[7][1])]
    for i in range(20):  # items inside other texts
        own = words(items[i][1])
        rows.append((500 + i, f"{corpus.texts(1, i)[0]}\n{', '.join(own)}; end é", "en", "s", 0, 0, 0.0, 0, ""))
    docs = corpus.docs(spark, rows)
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, n int, hash string")
    got = decontam.contamination(docs, benchmark).collect()
    want = [(d[0], *brute(d[1], items)) for d in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = decontam.clean(docs, benchmark)
    bad = {w[0] for w in want if w[5]}
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(d[0]) for d in rows if d[0] not in bad)


def test_long_texts_in_pieces(spark, monkeypatch):
    r = random.Random(11)
    own = [f"w{i % 700}" for i in range(6000)]
    text = " ".join(own)
    items = [(i, " ".join(own[at : at + n])) for i, (at, n) in enumerate((r.randrange(5000), r.choice([2, 5, 13, 30])) for _ in range(12))] + [(50, text + " more")]
    monkeypatch.setattr(decontam, "LONG", 900)
    batch = decontam.pa.RecordBatch.from_arrays([decontam.pa.array([text.encode(), b"", b"a b"])], ["text"])
    chunks = [c for chunk in decontam._chunks(batch.slice(0, 1), 0, 12) for c in chunk]
    assert [w for _, first, words, total in chunks for w in words[12 if first and total is None else 0 :]] == text.encode().split() and chunks[-1][3] == 6000
    got = decontam.contamination(corpus.simple(spark, [text, "", None]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(0, *brute(text, items)), (1, *brute("", items)), (2, *brute(None, items))]


def test_shared_windows_share_a_fingerprint():
    r = random.Random(9)
    for _ in range(60):
        shared = [b"w%d" % r.randrange(4) for _ in range(13)]
        a, b = ([b"x%d" % r.randrange(5) for _ in range(r.randrange(30))] + shared + [b"y%d" % r.randrange(5) for _ in range(r.randrange(30))] for _ in range(2))
        prints = [set(decontam.winnowed(Grams([x]), 13)[0].tolist()) for x in (a, b)]
        assert prints[0] & prints[1]
    lone = [b"w%d" % i for i in range(3000)]
    assert len(np.unique(decontam.winnowed(Grams([lone]), 13)[0])) < 0.3 * 3000


def test_empty_sides(spark):
    docs, none = corpus.simple(spark, ["a b c"]), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontam.contamination(docs, none).collect()] == [(3, 0, 0)]
    assert decontam.contamination(corpus.docs(spark, []), none).count() == 0


def test_clean_rows_decides_by_row(spark):
    """Clean rows stay where a row of the same id, or another one without an id, is contaminated."""
    item = " ".join(f"bench{i}" for i in range(30))
    rows = [(1, item), (1, "a clean text"), (None, item), (None, "clean without an id"), (2, None), (None, None)]
    docs = corpus.docs(spark, [(i, t, "en", "s", 0, 0, 0.0, 0, "") for i, t in rows])
    kept = decontam.clean_rows(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a clean text"), (None, "clean without an id"), (2, None), (None, None)], key=str)
