import hashlib
from collections import defaultdict

import pytest

from panelwright.llm import line_dedup

from . import corpus

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANK).translate(LOW)


def brute(rows, mode, min_docs):
    """Documents are distinct pairs of id and text."""
    own = {(r[0], r[1] or "") for r in rows}
    where = defaultdict(set)
    for d in own:
        for line in d[1].split("\n"):
            where[key(line)].add(d)
    seen, kept = set(), {}
    for d in sorted(own, key=lambda d: (d[0] is not None, d[0] or 0, d[1])):
        keep = []
        for line in d[1].split("\n"):
            k = key(line)
            gone = k and (len(where[k]) >= min_docs if mode == "frequent" else k in seen)
            seen.add(k)
            if not gone:
                keep.append(line)
        kept[d] = "\n".join(keep)
    return kept


@pytest.mark.parametrize(("mode", "min_docs"), [("frequent", 2), ("frequent", 10), ("frequent", 1), ("first", 2)])
def test_equals_brute_force(spark, mode, min_docs):
    common = ["Same Line here"] * 3
    own = [r if r[0] == 5 else (r[0], f"{r[1] or ''}\n{common[0]}\n other {r[0] % 7} " if r[0] is not None and r[0] % 2 else r[1], *r[2:]) for r in corpus.rows()]
    if mode == "first":  # order of equal ids is by row key, so keep ids apart
        own = [r for r in own if r[0] != 5]
    docs = corpus.docs(spark, own).repartition(5)
    bitmaps = line_dedup.keep_bitmaps(docs, mode=mode, min_docs=min_docs)
    got = line_dedup.apply_bitmaps(docs, bitmaps).collect()
    kept = brute(own, mode, min_docs)
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got if r.doc_id is not None) == sorted((False, d[0], kept[d[0], d[1] or ""]) for d in own if d[0] is not None)
    digests = line_dedup.apply_bitmaps(docs, bitmaps, digest=True).collect()
    assert sorted(r.kept_sha256 for r in digests) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in got)
    for r in got:
        assert r.n_lines - r.n_dropped == (r.text.count("\n") + 1 if r.n_dropped < r.n_lines else 0)


def test_group_over_many_tasks(spark):
    docs = corpus.simple(spark, ["hot line\nown %d" % i for i in range(400)])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for mode, dropped in (("first", 399), ("frequent", 400)):
            got = line_dedup.keep_bitmaps(docs, mode=mode, min_docs=10).collect()
            assert sum(r.n_dropped for r in got) == dropped
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_bad_arguments(spark):
    docs = corpus.docs(spark, [])
    assert line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(docs, mode="some")
