import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from panelwright.llm import lm_scoring as lm
from panelwright.llm.common import crc_mod, written

from . import corpus

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), END]


def out_of(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows):
    c = Counter(t for d in rows if not out_of(d[0]) for t in tokens(d[1]))
    n, v = sum(c.values()), len(c)
    for d in rows:
        own = tokens(d[1])
        yield (str(d[0]), out_of(d[0]), len(own), sum(c[t] > 0 for t in own), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), 6))


def test_exact_columns(spark, monkeypatch):
    rows = corpus.rows()
    scores = []
    for lot in (1 << 21, 1 << 12):  # with small lots long texts are in pieces
        monkeypatch.setattr(lm, "LOT", lot)
        got = lm.score_texts(corpus.docs(spark, rows), crc_mod("doc_id", 7) == 2).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(brute(rows))
        assert all(r.score < 0 for r in got)
        scores.append(sorted(round(r.score, 6) for r in got))
    assert scores[0] == scores[1]


def test_pieces_hold_every_token_once(monkeypatch):
    monkeypatch.setattr(lm, "LOT", 16)
    for text in (b"", b"one", b"a bb ccc dddd " * 40, b" " * 100 + b"x" * 100 + b" " * 50 + b"y z", b"w" * 300, b"x y " * 3 + b" " * 90):
        found = list(zip(*lm._pieces(text), strict=True))
        one, two, n, first = lm.tokens(list(found[0]), np.array(found[1]), np.array(found[2]))
        want = lm.tokens([text])
        assert (one == want[0]).all() and (two == want[1]).all() and n.sum() == want[2].sum()


def test_scores_follow_the_model(spark):
    """Against the same interpolation over exact counts: quantised counts are off by less than a factor of 1.5."""
    rows = [r for r in corpus.rows() if r[0] is not None and r[0] < 60 and r[0] != 5]
    c1, c2 = Counter(), Counter()
    for d in rows:
        if not out_of(d[0]):
            own = tokens(d[1])
            c1.update(own)
            c2.update(zip([END, *own[:-1]], own, strict=True))
    n, v = sum(c1.values()), len(c1)
    got = {r.doc_id: r for r in lm.score_texts(corpus.docs(spark, rows), crc_mod("doc_id", 7) == 2).collect()}
    off = []
    for d in rows:
        own = tokens(d[1])
        want = 0.0
        for a, b in zip([END, *own[:-1]], own, strict=True):
            alone = (c1[b] + 1) / (n + v + 1)
            want += math.log10(0.6 * min(1, c2[a, b] / c1[a]) + 0.4 * alone if c1[a] else alone)
        off.append((got[d[0]].score - want) / len(own))
    assert max(map(abs, off)) < 0.3 and abs(np.mean(off)) < 0.1
    assert sum(r.score - r.base_score for r in got.values()) > 0


def test_filter_reads_counts_back():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2))
    counts = r.integers(1, 5000, len(keys))
    words = 1 << 14
    levels = lm.levels_of(counts)
    bits = np.zeros(words, np.uint64)
    for level in range(1, levels.max() + 1):
        at, mask = lm._word_and_mask(keys[levels >= level], level, words)
        np.bitwise_or.at(bits, at, mask)
    found = lm.Filter(bits, 1).levels(keys)
    assert (found >= levels).all()  # a Bloom filter never forgets
    assert (found == levels).mean() > 0.8
    assert lm.count_of(np.array([0, 1, 2, 3])).tolist() == [0.0, 1.0, 2.5, 5.5]


def test_no_training_and_empty(spark):
    docs = corpus.simple(spark, ["a b", None])
    got = lm.score_texts(docs, F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert lm.score_texts(corpus.docs(spark, []), F.lit(False)).count() == 0


def test_every_pair_is_kept_whatever_the_size(spark, monkeypatch):
    """Pairs seen once are known, by a filter that is as full as at any size."""
    monkeypatch.setattr(lm, "LOT", 1 << 12)
    rows = [(i, " ".join(f"w{(i * 37 + j * j) % 401}" for j in range(200)), "en", "s", 0, 0, 0.0, 0, "") for i in range(30)]
    c1, c2 = Counter(), Counter()
    for d in rows:
        if not out_of(d[0]):
            own = tokens(d[1])
            c1.update(own)
            c2.update(zip([END, *own[:-1]], own, strict=True))
    n, v = sum(c1.values()), len(c1)
    assert sum(c == 1 for c in c2.values()) > 500

    def read(c):
        return lm.count_of(lm.levels_of(np.array([c])))[0] if c else 0.0

    off = []
    for r in lm.score_texts(corpus.docs(spark, rows), crc_mod("doc_id", 7) == 2).collect():
        own, want = tokens(rows[r.doc_id][1]), 0.0
        for a, b in zip([END, *own[:-1]], own, strict=True):
            alone = (read(c1[b]) + 1) / (n + v + 1)
            want += math.log10(0.6 * min(1, read(c2[a, b]) / read(c1[a])) + 0.4 * alone if c1[a] else alone)
        off.append((r.score - want) / len(own))
    assert max(map(abs, off)) < 0.1


def test_filter_takes_its_size_from_the_members():
    r = np.random.default_rng(2)
    for n in (1000, 100_000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        filt = lm.filter_of(keys, np.ones(len(keys), np.int64))
        assert abs(len(filt.words) * 64 / len(keys) - lm.BITS_EACH) < 0.1
        assert (filt.levels(keys) >= 1).all()
        others = r.integers(0, 1 << 63, 50_000, dtype=np.uint64)
        assert 0.01 < (filt.levels(others) > 0).mean() < 0.04  # at full load, whatever the size


def test_few_lots_are_read_at_once(spark, monkeypatch):
    """Readers and writers hold a page and a group of rows; in one task with 40 lots they are no larger than with a few."""
    monkeypatch.setattr(lm, "LOT", 1 << 16)
    paths = []

    def kept(df, name, *options):
        out = written(df, name, *options)
        paths.extend(out.inputFiles() if name == "lm-lots" else [])
        return out

    monkeypatch.setattr(lm, "written", kept)
    rows = [(i, " ".join(f"w{(i * 37 + j * j) % 9973}" for j in range(1000)), "en", "s", 0, 0, 0.0, 0, "") for i in range(400)]
    assert lm.score_texts(corpus.docs(spark, rows).coalesce(1), F.lit(False)).count() == len(rows)
    (found,) = (pq.read_metadata(p.removeprefix("file:")) for p in paths)
    assert found.num_rows > 30 and sum(found.row_group(i).num_rows for i in range(found.num_row_groups)) == found.num_rows
    assert max(found.row_group(i).num_rows for i in range(found.num_row_groups)) <= 4


def test_a_filter_takes_little_memory_beside_its_keys():
    keys = np.random.default_rng(4).integers(0, 1 << 63, 600_000).astype(np.uint64)
    counts = np.arange(len(keys)) % 7 + 1
    tracemalloc.start()
    filt = lm.filter_of(keys, counts)
    levels = filt.levels(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (levels >= lm.levels_of(counts)).all() and peak < 24 * len(keys)
