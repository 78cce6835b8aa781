import os
import random

import numpy as np
import pytest

from panelwright.llm import packing

from . import corpus

pytestmark = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files")


def slow_best_fit(lengths, size):
    rows, left = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        able = [(c, r) for r, c in enumerate(left) if c >= lengths[i]]
        if able:
            least = min(able)[0]
            r = [r for c, r in able if c == least][0]
        else:
            r = len(rows)
            rows.append([])
            left.append(size)
        rows[r].append(i)
        left[r] -= lengths[i]
    return rows


def test_best_fit_is_best():
    r = random.Random(4)
    for size in (2, 7, 64, 100):
        lengths = [r.randint(1, size) for _ in range(300)]
        got, want = packing.best_fit(lengths, size), slow_best_fit(lengths, size)
        assert sorted(i for row in got for i in row) == list(range(300))
        # which of several equal rows is taken is free: the fillings agree
        assert sorted(sum(lengths[i] for i in row) for row in got) == sorted(sum(lengths[i] for i in row) for row in want)


def test_round_trip(spark):
    docs = corpus.docs(spark)
    encoded = packing.encode(docs)
    packed = packing.pack(encoded, row_tokens=64, lot_tokens=5000)
    pieces = {}
    for r in packing.unpack(packed).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    want = {}
    for r in encoded.collect():
        want.setdefault(r.doc_id, []).append(bytes(r.ids))
    for doc, own in want.items():
        assert sum(len(b) for _, b in pieces[doc]) == sum(map(len, own))
        if len(own) == 1:
            assert b"".join(b for _, b in sorted(pieces[doc])) == own[0]
    assert set(pieces) == set(want)
    rows = packed.collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    for r in rows:
        ids, places, cuts = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u2"), r.cu_seqlens
        assert len(ids) == 64 and cuts[0] == 0 and cuts[-1] == r.n_tokens <= 64 and r.position_resets == cuts[:-1]
        assert (ids[r.n_tokens :] == 50256).all() and not places[r.n_tokens :].any()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
    assert sum(r.n_tokens for r in rows) / (64 * len(rows)) > 0.9


def test_tokens_decode_to_text(spark):
    import base64

    with open(packing.TOKENIZER, "rb") as f:
        back = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f.read().splitlines())}
    own = ["A text, with <|endoftext|> in it.", "", "é\n\n x  y"]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.encode(corpus.simple(spark, own)).collect()}
    for i, text in enumerate(own):
        assert got[i][-1] == 50256
        assert b"".join(back[x] for x in got[i][:-1]).decode() == text


def plain_encoder():
    import base64

    import tiktoken

    with open(packing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_have_the_tokens_of_the_whole(monkeypatch):
    with open(packing.TOKENIZER, "rb") as f:
        encode = packing.rank_encoder(f.read())
    plain, r = plain_encoder(), random.Random(8)
    monkeypatch.setattr(packing, "PIECE", 40)
    monkeypatch.setattr(packing, "RUN", 6)
    monkeypatch.setattr(packing, "_RUN", packing.re.compile(f"[{packing.SPACES}]{{6,}}"))
    stock = ["a", "word", "it's", " ", "  ", " " * 9, "\n", "\n" * 7, "\t \n   \n", "12", "!?", "é", "\x1c", "\xa0", "\u2003" * 8, "x" * 90]
    for _ in range(400):
        text = "".join(r.choice(stock) for _ in range(r.randint(0, 60)))
        assert encode(text).tolist() == plain.encode_ordinary(text)


def test_very_long_runs(spark):
    own = ["a" + " " * 4_000_000 + "b", "\n" * 10_000_000, "word" * 100_000, "a word " * 300_000]
    plain = plain_encoder()
    got = {r.doc_id: np.frombuffer(r.ids, "<u4")[:-1] for r in packing.encode(corpus.simple(spark, own)).collect()}
    for i, text in enumerate(own):
        assert b"".join(map(plain.decode_single_token_bytes, got[i].tolist())).decode() == text
    assert packing.pack(packing.encode(corpus.simple(spark, own[:2]))).count() > 0


def packed_plainly(encoded, size):
    """Rows of (document, start, ids) for one lot in the operator's order, by slow search."""
    pieces = [(doc, at, ids[at : at + size]) for doc, ids in encoded for at in range(0, len(ids), size)]
    return [[pieces[i] for i in row] for row in slow_best_fit([len(p[2]) for p in pieces], size)]


def test_query_against_a_slow_packer(spark, tmp_path):
    from panelwright.llm import queries

    corpus.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    plain = plain_encoder()
    own = [(r[0], plain.encode_ordinary(r[1] or "") + [50256]) for r in corpus.rows()]
    got = queries.op5_packing(spark, str(tmp_path)).collect()
    segments = sorted((-1 if d is None else d, s, tuple(np.frombuffer(r.input_ids, "<u4")[a:b].tolist())) for r in got for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True))
    want = packed_plainly(own, 2048)
    assert segments == sorted((-1 if d is None else d, s, tuple(ids)) for row in want for d, s, ids in row)
    by_task = {}
    for r in got:  # a pack_id begins with the lot's name
        by_task.setdefault(r.pack_id.rsplit("-", 1)[0], []).append(r)
    for rows in by_task.values():
        lengths = [b - a for r in rows for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True)]
        assert len(rows) == len(slow_best_fit(lengths, 2048))


def test_empty_and_bad_arguments(spark):
    encoded = packing.encode(corpus.docs(spark, []))
    assert packing.pack(encoded).count() == 0
    assert packing.pack(packing.encode(corpus.simple(spark, ["", None]), end_id=None)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(encoded, row_tokens=1)
