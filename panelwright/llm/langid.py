"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, what is not a letter becomes a blank, and all n-grams
of 1 to 3 characters are hashed to ``FEATURES`` columns. A column's value is
its share of the text's n-grams times SCALE times its inverse document
frequency, which is counted over all training texts. The weights are fitted by
follow-the-regularised-leader (per-coordinate rates, elastic net, so most
weights are zero), on a sample of labelled rows whose size is bounded by
``max_rows``; the scores are then calibrated by a temperature on rows of that
sample that were not trained on.

All languages are learnt. The fit streams its rows, once an epoch, past two
tables of FEATURES x languages numbers, half a megabyte a language; the model
is sent to the workers as its weights that are not zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .grams import parts

FEATURES = 1 << 15
SCALE = 50.0
#: Bytes of text whose n-grams are held at a time.
PIECE = 1 << 18
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a blank."""
    table = np.full(0x110000, 32, np.uint32)
    at = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.uint32)
    table[at] = at
    return table


def _spread(codes: np.ndarray, doc: np.ndarray, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the n-grams that end behind the first ``old`` codes, and the text of each; runs of blanks are one blank already."""
    cols, docs = [], []
    h = codes * _ODD[0]
    for n in (1, 2, 3):
        if n > 1:
            h = (h[: len(codes) - n + 1] ^ (h[: len(codes) - n + 1] >> np.uint32(15))) * _ODD[n - 1] + codes[n - 1 :] * _ODD[0]
        x = h[: max(0, len(codes) - n + 1)]
        ok = doc[: len(x)] == doc[n - 1 :][: len(x)]
        if n == 1:
            ok &= codes != 32
        ok[: max(0, old - n + 1)] = False
        x = (x ^ (x >> np.uint32(16))) * _ODD[1]
        cols.append((x[ok] >> np.uint32(17)).astype(np.int64))
        docs.append(doc[: len(x)][ok])
    return np.concatenate(cols), np.concatenate(docs)


def features(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of all n-grams in order of the texts, where each text's begin, and which texts have letters."""
    codes = [table[np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts]
    lens = np.array([len(c) for c in codes])
    c = np.concatenate(codes)
    blank = c == 32
    keep = np.r_[True, ~(blank[1:] & blank[:-1])]  # a run of blanks is one
    keep[np.cumsum(lens) - lens] = True
    doc = np.repeat(np.arange(len(lens)), lens)[keep]
    c = c[keep]
    any_letter = np.bincount(doc[c != 32], minlength=len(lens)) > 0
    cols, docs = _spread(c, doc)
    counts = np.bincount(docs, minlength=len(lens))
    return cols[np.argsort(docs, kind="stable")], np.cumsum(counts) - counts, any_letter


def long_features(text: str, table: np.ndarray) -> np.ndarray:
    """How often a text of any length has each column: the counts of ``features``, some characters at a time."""
    counts, held, at = np.zeros(FEATURES, np.int64), np.array([32], np.uint32), 0
    old = 0
    while True:
        end = at + PIECE
        while end < len(text) and text[end].isalpha() and end < at + 2 * PIECE:
            end += 1  # what lower() makes of a letter may depend on its word
        piece = text[at:end].lower() + (" " if end >= len(text) else "")
        codes = np.r_[held, table[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]]
        blank = codes == 32
        keep = np.r_[True, ~(blank[1:] & blank[:-1])]
        keep[:old] = True
        codes = codes[keep]
        counts += np.bincount(_spread(codes, np.zeros(len(codes), np.int8), old)[0], minlength=FEATURES)
        held, old, at = codes[-2:], min(2, len(codes)), end
        if end >= len(text):
            break
    return counts


def _short_and_long(texts: list[str | None]) -> Iterator[tuple[int, list[str | None], bool]]:
    """Runs of texts and the number of the first; a very long text is one of its own."""
    start = 0
    for i, t in enumerate(texts):
        if t and len(t) > PIECE:
            if i > start:
                yield start, texts[start:i], False
            yield i, [t], True
            start = i + 1
    if start < len(texts):
        yield start, texts[start:], False


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (column, texts); column -1 counts the texts."""
    table, df, n = letters(), np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for _, texts in parts(batch, 0, PIECE):
            n += len(texts)
            for _, own, long in _short_and_long(texts):
                if long:
                    df += long_features(own[0], table) > 0
                    continue
                for i in range(0, len(own), 128):
                    few = own[i : i + 128]
                    cols, starts, _ = features(few, table)
                    doc = np.repeat(np.arange(len(few)), np.diff(np.r_[starts, len(cols)]))
                    seen = np.zeros((len(few), FEATURES), np.uint8)
                    seen[doc, cols] = 1
                    df += seen.sum(axis=0, dtype=np.int64)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]])], ["feature", "n"])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages, inverse document frequencies included
    bias: np.ndarray
    temperature: float

    def logits(self, cols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of texts by all their n-grams; some at a time, so that many languages don't multiply a whole slice."""
        counts = np.diff(np.r_[starts, len(cols)])
        out = np.zeros((len(starts), len(self.languages)))
        few = max(1, (1 << 22) // len(self.languages))
        for i in range(0, len(cols), few):
            part = cols[i : i + few]
            first = int(np.searchsorted(starts, i, side="right")) - 1
            own = np.arange(first, int(np.searchsorted(starts, i + len(part), side="left")))
            own = own[counts[own] > 0]
            out[own] += np.add.reduceat(self.weights[part], np.maximum(starts[own] - i, 0), axis=0)
        return out / np.maximum(counts, 1)[:, None] * SCALE + self.bias

    def long_logits(self, counts: np.ndarray) -> np.ndarray:
        return (counts @ self.weights / max(1, counts.sum()) * SCALE + self.bias)[None, :]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Weights (FEATURES + 1) x k, the last row the bias, by one row of columns, values and class after another."""

    def __init__(self, k: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1.0
        g = x[:, None] * p
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm.

    The true class counts (n + 1) / (n + 2) of a row and the others share the
    rest, so few rows that are all right do not call for certainty.
    """
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    share = np.full(logits.shape, 1 / (len(y) + 2) / (logits.shape[1] - 1))
    share[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)

    def loss(t):
        return -(share * np.log(softmax(logits / np.exp(t)) + 1e-300)).sum(axis=1).mean()

    low, high, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _vectors(idf: np.ndarray):
    """Rows (lang, part, place, at, x): columns and values of a text, four bytes each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for batch in batches:
            for part, texts in parts(batch, 3, PIECE):
                cols = []
                for t in texts:
                    if t and len(t) > PIECE:
                        counts = long_features(t, table)
                    else:
                        counts = np.bincount(features([t], table)[0], minlength=FEATURES)
                    at = np.flatnonzero(counts)
                    x = counts[at] / max(1, counts.sum()) * SCALE * idf[at]
                    cols.append((at.astype("<i4").tobytes(), x.astype("<f4").tobytes()))
                own = batch.slice(part.start, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns[:3], *(pa.array([c[i] for c in cols], pa.binary()) for i in (0, 1))], ["lang", "part", "place", "at", "x"])

    return rows


def _fit(languages: list[str], epochs: int, **rates: float):
    """Trains on rows in order of epoch; those of the last one are what the temperature is taken from."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = Ftrl(len(languages), **rates), {x: i for i, x in enumerate(languages)}
        logits, classes = [], []
        for batch in batches:
            for i in range(batch.num_rows):  # one row at a time is in numpy
                lang, at, x, epoch = (batch.column(j)[i].as_py() for j in range(4))
                at, x = np.r_[np.frombuffer(at, "<i4"), FEATURES], np.r_[np.frombuffer(x, "<f4").astype(float), 1.0]
                if epoch < epochs:
                    model.learn(at, x, number[lang])
                else:
                    logits.append(x @ model.weights(at))
                    classes.append(number[lang])
        t = temperature(np.array(logits).reshape(len(logits), len(languages)), np.array(classes, np.int64))
        w = model.weights(slice(None))
        at, k = np.nonzero(w)
        # the temperature rides along as a row without a class
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[k, -1].astype(np.int32)), pa.array(np.r_[w[at, k], t])], ["feature", "class", "weight"])

    return fit


def train(docs: DataFrame, allowed: Column, max_rows: int = 6000, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 1e-3, seed: int = 11) -> Model | None:
    """Fit on rows of ``docs`` for which ``allowed`` holds and lang is not NULL; None if there are none.

    Languages share ``max_rows`` evenly, one row each at least: of each, the
    different rows are drawn by a hash of seed, id and text, so NULL and
    repeated ids are no loss, and ordered by one of seed and id; every fifth is
    kept for the temperature. Document frequencies are counted over all texts
    that may be learnt from. Every language is learnt. Texts of any length are
    gone through in pieces; NULL and empty ones have no n-grams.
    """
    spark = docs.sparkSession
    own = docs.filter(allowed & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    number = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "text")  # of a row by id and text
    counts = written(own.groupBy("lang").agg(F.approx_count_distinct(number, 0.02).alias("n")), "langid-counts")  # one row a language
    languages = sorted(r.lang for r in counts.select("lang").collect())  # one row a language
    if not languages:
        return None
    seen = {r.feature: r.n for r in own.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # FEATURES rows at most
    idf = np.full(FEATURES, np.log(1.0 + seen[-1]) + 1.0)
    at = np.array([k for k in seen if k >= 0], np.int64)
    idf[at] = np.log((1.0 + seen[-1]) / (1.0 + np.array([seen[int(k)] for k in at]))) + 1.0
    each = max(1, max_rows // len(languages))
    # all but a few rows go by their hash alone, before anything is sorted; twice the share and a margin, so enough stay
    rate = counts.select("lang", F.least(F.lit(1.0), F.lit(2.0 * each + 50) / F.greatest("n", F.lit(1))).alias("rate"))
    share = F.shiftrightunsigned("number", 11).cast("double") / F.lit(float(2**53))
    numbered = own.withColumn("number", number).withColumn("share", share).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0))), 11))
    drawn = numbered.join(F.broadcast(rate), "lang").filter(F.col("share") < F.col("rate")).dropDuplicates(["lang", "number"])  # rate has one row a language
    drawn = written(drawn.select("text", "lang", "u", "doc_id", "number"), "langid-drawn")
    order = ["u", "doc_id", "number", "text"]
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= each)
    part = F.when((F.col("place") % 5 == 0) & (F.lit(each) > 1), 0).otherwise(1)
    vectors = written(ranked.select("lang", part.alias("part"), "place", "text").mapInArrow(_vectors(idf), "lang string, part int, place int, at binary, x binary"), "langid-vectors")
    epoch = F.when(F.col("part") == 0, F.array(F.lit(epochs))).otherwise(F.sequence(F.lit(0), F.lit(epochs - 1)))
    rows = vectors.withColumn("epoch", F.explode(epoch)).repartition(1).sortWithinPartitions("epoch", "place", "lang").select("lang", "at", "x", "epoch")
    found = rows.mapInArrow(_fit(languages, epochs, alpha=alpha, beta=beta, l1=l1, l2=l2), "feature int, class int, weight double").toPandas()
    w, body = np.zeros((FEATURES + 1, len(languages))), found[found["class"] >= 0]
    w[body["feature"], body["class"]] = body["weight"]
    return Model(languages, w[:FEATURES] * idf[:, None], w[FEATURES], float(found.loc[found["class"] < 0, "weight"].iloc[0]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score``, one row for each row of ``docs``; whole texts, nothing but texts.

    Without a letter (NULL and empty texts included), or without a model,
    ``lang_pred`` is "und" and the score 0; else the score is the calibrated
    probability of the language. Ties go to the language that sorts first.
    """
    # plain values only, and of the weights those that are not zero
    at = None if model is None else np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.languages, at, model.weights.ravel()[at], model.bias, model.temperature))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = None, letters()
        if shared.value is not None:
            languages, at, values, bias, t = shared.value
            weights = np.zeros(FEATURES * len(languages))
            weights[at] = values
            m = Model(languages, weights.reshape(FEATURES, -1), bias, t)
        for batch in batches:
            names, scores = [], []
            for _, texts in parts(batch, 1, PIECE):
                for _, own, long in _short_and_long(texts):
                    if m is None:
                        names += ["und"] * len(own)
                        scores += [0.0] * len(own)
                        continue
                    if long:
                        counts = long_features(own[0], table)
                        logits, able = m.long_logits(counts), [bool(counts.any())]
                    else:
                        cols, starts, able = features(own, table)
                        logits = m.logits(cols, starts)
                    p = softmax(logits / m.temperature)
                    names += [m.languages[i] if ok else "und" for i, ok in zip(p.argmax(axis=1), able, strict=True)]
                    scores += np.where(able, p.max(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")
