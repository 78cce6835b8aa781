import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import token_counts

from . import corpus

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(token_counts.default_path())
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    with open(token_counts.default_path(), "rb") as f:
        return token_counts.Counter(token_counts.tables(f.read()))


def counts(counter, text):
    return np.cumsum(np.frombuffer(b"".join(counter.differences(text)), "<i2"), dtype=np.int64).tolist()


FIXED = ["Hello world", "don't they're we've I'll 're 'r e''s", "<|endoftext|>a<|endoftext|b!<|startoftext|>>", "ΑΣ ΑΣ İstanbul é", "a\x1cb\x85c\xa0d e\x1f f​g", "日本語テキスト 12345 １２ ½ Ⅷ", "", " \n\t", "x" * 700, "''''''ss", "😀😀 👩‍👩‍👧"]


@pytest.mark.parametrize("text", FIXED)
def test_every_prefix(counter, library, text):
    assert counts(counter, text) == [library(text[:i]) for i in range(1, len(text) + 1)]


def test_every_prefix_of_random_texts(counter, library):
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice("abcdefthe 'srvl'e .,!1\n<|>ÀéßωΣσ") for _ in range(r.randint(1, 25)))
        assert counts(counter, text) == [library(text[:i]) for i in range(1, len(text) + 1)], text


def test_totals_of_texts_that_normalisation_changes(counter, library):
    r = random.Random(6)
    for _ in range(600):
        text = "".join(r.choice("aẹ̸́>< öİ각 Å") for _ in range(r.randint(1, 20)))
        got = counts(counter, text)
        assert len(got) == len(text) and got[-1] == library(text), ascii(text)


def test_pieces_equal_the_whole(counter, library, monkeypatch):
    text = " ".join(corpus.texts(200)) + "y" * 3000 + " 'tis <|endoftext|> é" * 50
    want = counts(counter, text)
    assert want[-1] == library(text)
    for segment in (1, 7, 100):
        monkeypatch.setattr(token_counts, "SEGMENT", segment)
        assert counts(counter, text) == want
    monkeypatch.setattr(token_counts, "SPAN", 5)  # the walk over a word forgets what no token reaches
    assert counts(token_counts.Counter({**counter.kept.make.__self__.tables, "special": ["<|endoftext|>"]}), text) == want


def test_rows(spark, library, monkeypatch):
    docs = corpus.docs(spark).withColumn("n_tokens", F.lit(-1)).withColumn("blocks", F.lit("x"))
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_chars, r.n_tokens) for r in token_counts.prefix_counts(docs).collect())
    want = sorted((i is None, i, len((t or "").encode()), len(t or ""), library(t or "")) for i, t, *_ in corpus.rows())
    assert got == want
    assert token_counts.prefix_counts(corpus.docs(spark, [])).collect() == []


def test_questions_are_answered_from_the_table(spark, library):
    text = {i: t for i, t, *_ in corpus.rows()[:30]} | {90: "x y " * 20000, 91: "z" * 70000}
    table = token_counts.prefix_counts(corpus.docs(spark, [(i, t, "en", "s", 0, 0, 0.0, 0, "") for i, t in text.items()])).cache()
    for at in (-1, 0, 1, 17, 32768, 32769, 65000, 10**6):
        for r in token_counts.counts_at(table, F.lit(at)).collect():
            assert r.n_tokens == (None if at < 0 else library(text[r.doc_id][:at]))
    for budget in (-1, 0, 1, 9, 3000):
        for r in token_counts.cut_at_budget(table, budget).collect():
            t, at = text[r.doc_id], r.position
            assert r.n_tokens == (library(t[:at]) if at else 0) <= max(0, budget)
            assert all(library(t[:i]) > budget for i in range(at + 1, min(len(t), at + 30) + 1)) or budget < 0


def test_seams_are_those_of_merging():
    with open(token_counts.default_path(), "rb") as f:
        tables = token_counts.tables(f.read())
    seams, r = token_counts.Seams(tables), random.Random(1)
    made = {(a, b): t for t, (a, b, _) in tables["parts"].items()}
    tokens, opened = [t for t in tables["parts"] if seams.whole(t)], {t for t in tables["open"] if t >= 0}

    def spelled(t):
        return [y for x in tables["parts"][t][:2] for y in spelled(x)] if t in tables["parts"] else [t]

    for a, b in zip(r.choices([t for t in tokens if t in opened], k=3000), r.choices(tokens, k=3000), strict=True):
        row = spelled(a) + spelled(b)
        while found := [(tables["merges"][p], i) for i, p in enumerate(zip(row, row[1:], strict=False)) if p in made]:
            i = min(found)[1]
            row[i : i + 2] = [made[row[i], row[i + 1]]]
        assert (row == [a, b]) == seams.apart(a, b)
