import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import langid
from panelwright.llm.common import crc_mod

from . import corpus

WORDS = {"en": "the and thing with that there was", "de": "der und zu nicht auß über ein", "fr": "être le avec que pour été où", "es": "ñandú los que para está una el"}


def sample(n=240, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 4]
        stock = WORDS[lang].split()
        text = " ".join(r.choice(stock)[: r.randint(2, 6)] + r.choice(stock)[:2] for _ in range(r.randint(8, 60)))
        out.append((i, text, lang, "s", 0, 0, 0.0, 0, ""))
    return out


def test_held_out_accuracy_and_calibration(spark):
    docs = corpus.docs(spark, sample())
    model = langid.train(docs, crc_mod("doc_id", 4) != 2)
    got = langid.predict(docs, model).join(docs, "doc_id").filter(crc_mod("doc_id", 4) == 2).collect()
    assert len(got) > 30
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0.25 <= r.score <= 1 for r in got)
    assert 0.05 <= model.temperature <= 20
    assert (model.weights == 0).mean() > 0.5  # elastic net


def plain_columns(text):
    """Counts by column, n-gram by n-gram, with plain integers."""
    letters = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    while "  " in letters:
        letters = letters.replace("  ", " ")
    m, odd, out = (1 << 32) - 1, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), Counter()
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            if gram == " ":
                continue
            h = ord(gram[0]) * odd[0] & m
            for k in range(1, n):
                h = ((h ^ h >> 15) * odd[k] + ord(gram[k]) * odd[0]) & m
            out[((h ^ h >> 16) * odd[1] & m) >> 17] += 1
    return out


def test_against_a_dense_model(spark):
    """TF-IDF, FTRL with elastic net and temperature, written plainly over dense vectors."""
    rows = sample(120, seed=9)
    docs = corpus.docs(spark, rows)
    alpha, beta, l1, l2, epochs = 0.3, 1.0, 0.3, 1e-3, 2
    model = langid.train(docs, F.lit(True), max_rows=100_000, epochs=epochs)
    order = [r.doc_id for r in docs.orderBy(F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11), "doc_id").select("doc_id").collect()]
    columns = {r[0]: plain_columns(r[1]) for r in rows}
    df = Counter(c for own in columns.values() for c in own)
    used = sorted(df)
    at = {c: i for i, c in enumerate(used)}
    idf = np.array([math.log((1 + len(rows)) / (1 + df[c])) + 1 for c in used])
    vectors, place = {}, Counter()
    for i, own in columns.items():
        v = np.zeros(len(used) + 1)
        for c, n in own.items():
            v[at[c]] = n / sum(own.values()) * 50.0 * idf[at[c]]
        v[-1] = 1.0
        vectors[i] = v
    lang, languages = {r[0]: r[2] for r in rows}, sorted(WORDS)
    numbered = []
    for i in order:
        place[lang[i]] += 1
        numbered.append((place[lang[i]], lang[i], i))
    z, n = np.zeros((2, len(used) + 1, 4))

    def weights():
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for k, x, i in sorted(numbered):
            if k % 5:
                w = weights()
                e = np.exp(vectors[i] @ w)
                g = np.outer(vectors[i], e / e.sum() - (np.array(languages) == x))
                touched = vectors[i] != 0
                z[touched] += (g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w)[touched]
                n[touched] += (g * g)[touched]
    w = weights()
    tuned = [(vectors[i] @ w, languages.index(x)) for k, x, i in numbered if k % 5 == 0]

    def loss(t):
        total = 0.0
        for logits, y in tuned:
            p = np.exp(logits / t) / np.exp(logits / t).sum()
            share = np.full(4, 1 / (len(tuned) + 2) / 3)
            share[y] = (len(tuned) + 1) / (len(tuned) + 2)
            total -= (share * np.log(p)).sum()
        return total

    best = min((math.exp(x) for x in np.linspace(math.log(0.05), math.log(20), 3000)), key=loss)
    assert abs(math.log(model.temperature / best)) < 0.02
    for r in langid.predict(docs, model).collect():
        logits = vectors[r.doc_id] @ w / best
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert r.lang_pred == languages[p.argmax()] and abs(r.score - p.max()) < 0.01


def test_long_texts_in_pieces(spark, monkeypatch):
    r, table = random.Random(4), langid.letters()
    texts = ["".join(r.choice(["a", "bc", "É", "ñ", "1", " ", "   ", "x" * 70, "-", "\n", "Straße"]) for _ in range(r.randint(200, 900))) for _ in range(30)]
    whole = [np.bincount(langid.features([t], table)[0], minlength=langid.FEATURES) for t in texts]
    docs = corpus.simple(spark, [*texts, "", None])
    model = langid.train(corpus.docs(spark, sample()), F.lit(True), epochs=1)
    want = {x.doc_id: (x.lang_pred, round(x.score, 6)) for x in langid.predict(docs, model).collect()}
    monkeypatch.setattr(langid, "PIECE", 37)
    for t, counts in zip(texts, whole, strict=True):
        assert (langid.long_features(t, table) == counts).all()
    shared = langid.Model(model.languages, model.weights, model.bias, model.temperature)
    for i, t in enumerate(texts):
        p = langid.softmax(shared.long_logits(langid.long_features(t, table)) / shared.temperature)[0]
        assert (shared.languages[p.argmax()], round(p.max(), 6)) == want[i]


def test_every_language_is_learnt(spark):
    r = random.Random(2)
    stock = {f"l{k:03d}": ["".join(chr(0x4E00 + 40 * k + r.randrange(40)) for _ in range(2)) for _ in range(10)] for k in range(600)}
    rows = [(i, " ".join(r.choice(stock[x]) for _ in range(20)), x, "s", 0, 0, 0.0, 0, "") for i, x in enumerate(sorted(stock) * 3)]
    docs = corpus.docs(spark, rows)
    model = langid.train(docs, F.lit(True), max_rows=1800, epochs=6, l1=0.05)
    assert len(model.languages) == 600
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len({x.lang_pred for x in got}) > 590 and sum(x.lang == x.lang_pred for x in got) > 0.9 * len(got)


def test_null_and_repeated_ids_lose_no_language(spark):
    rows = sample(400)
    for new_id in (lambda r: None, lambda r: 7, lambda r: r[0] if r[2] == rows[0][2] else None):
        docs = corpus.docs(spark, [(new_id(r), *r[1:]) for r in rows])
        for seed in range(3):
            model = langid.train(docs, F.lit(True), max_rows=40, epochs=2, seed=seed)
            keyed = corpus.docs(spark, rows)
            got = langid.predict(keyed, model).join(keyed.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL").collect()
            assert model.languages == sorted({r[2] for r in rows if r[2]})
            for lang in model.languages:
                own = [x.lang_pred == lang for x in got if x.lang == lang]
                assert sum(own) > 0.8 * len(own)


def test_a_row_that_is_there_often_is_learnt_once(spark):
    rows = sample(60)
    copies = [(None, "la même phrase partout ici", "zz", "s", 0, 0, 0.0, 0, "")] * 3000
    model = langid.train(corpus.docs(spark, rows + copies), F.lit(True), max_rows=40, epochs=2)
    assert "zz" in model.languages
    assert langid.predict(corpus.docs(spark, copies[:1]), model).first().lang_pred == "zz"


def test_learns_from_allowed_rows_only(spark):
    rows = sample()
    changed = [r if r[0] % 2 else (r[0], r[1], "xx", *r[3:]) for r in rows]
    a, b = (langid.train(corpus.docs(spark, x), F.col("doc_id") % 2 == 1, epochs=1) for x in (rows, changed))
    assert a.languages == b.languages and (a.weights == b.weights).all()


def test_bounded_sample(spark):
    model = langid.train(corpus.docs(spark, sample()), F.lit(True), max_rows=20, epochs=2)
    assert model.languages == sorted(WORDS)


def test_awkward_rows(spark):
    docs = corpus.docs(spark)
    got = langid.predict(docs, langid.train(docs, F.lit(True))).collect()
    assert len(got) == len(corpus.rows())
    plain = {r[0]: r[1] for r in corpus.rows() if r[0] != 5}
    for r in got:
        if r.doc_id in plain and r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in plain[r.doc_id] or ""))
    none = langid.train(docs, F.lit(False))
    assert none is None
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    empty = corpus.docs(spark, [])
    assert langid.predict(empty, langid.train(empty, F.lit(True))).count() == 0
