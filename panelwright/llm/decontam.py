"""Benchmark decontamination by winnowing.

Of every ``window - K + 1`` consecutive K-grams of words the one with the
smallest hash is a fingerprint, so two texts that share ``window`` words share
a fingerprint. Fingerprints of documents are held against a bitmap of the
items' fingerprints. One that is there is extended to all windows around it;
these are held against a second bitmap, of the items' windows, and what is left
meets them in an equality join on 128 bits of the words themselves. So a
fingerprint that many items have is never multiplied by them, and neither texts
of documents nor of items are shuffled or gathered: a document gets places and
item ids only.

An item of fewer words than a window is one window of its own. It has no full
set of K-grams to choose from, so its one fingerprint is the hash of all its
words, and documents offer the hashes of all their runs of that many words.

Each bitmap has ``1 << FILTER_BITS`` bits, a fixed size; with very many items
it lets more through, and the join is what decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, row_key, same, written
from .grams import Grams, minima, parts, word_pieces

K = 5
FILTER_BITS = 23
#: Bytes of a text whose words are held at a time.
LONG = 1 << 20
#: Stands for a NULL item_id, which counts as an item without a name.
NO_ID = -(2**63)
#: ASCII but for 0-9, A-Z, a-z parts words; A-Z are lower-cased; other bytes stay.
TABLE = bytes(c + 32 if chr(c) in UPPER else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def winnowed(g: Grams, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the fingerprints, and the text of each. Among equal smallest hashes of a window all are taken."""
    h = g.hashes(K)
    took = np.flatnonzero(minima(h, g.whole(window), window - K + 1))
    return h[took], g.doc[took]


def _chunks(batch: pa.RecordBatch, column: int, overlap: int) -> Iterator[list[tuple[int, int, list[bytes], int | None]]]:
    """Lists of (row, number of the first word, words, number of all words).

    A very long text comes in several, each with the last words of the one
    before, and then without words; only then its number of words is known.
    """
    for part, texts in parts(batch, column):
        if len(texts) > 1 or len(texts[0] or b"") <= LONG:
            found = [words_of(t) for t in texts]
            yield [(part.start + i, 0, words, len(words)) for i, words in enumerate(found)]
            continue
        at, carry = 0, []
        for piece in word_pieces(texts[0].translate(TABLE), LONG):
            yield [(part.start, at - len(carry), carry + piece, None)]
            at += len(piece)
            carry = (carry + piece)[-overlap:]
        yield [(part.start, at, [], at)]


def _has(bits: bytes, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - FILTER_BITS)
    return np.frombuffer(bits, np.uint8)[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


_FOUND = "doc_id long, row_key long, n_words long, start long, n int, w1 long, w2 long"


def _digests(g: Grams, starts: np.ndarray, n: int) -> bytes:
    first, last = g.start[starts].tolist(), g.end[starts + n - 1].tolist()
    return b"".join([xxhash.xxh3_128_digest(g.joined[a:b], n) for a, b in zip(first, last, strict=True)])


def _found(window: int, lengths: list[int], bits):
    """Windows of documents that may be items': places and digests; and a row for each document with its number of words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, windows = bits.value
        for batch in batches:
            for chunk in _chunks(batch, 2, window - 1):
                g = Grams([words for _, _, words, _ in chunk])
                offset = np.cumsum(g.counts) - g.counts  # of a chunk's part among all its words
                base = np.array([b for _, b, _, _ in chunk], np.int64) - offset
                h = g.hashes(K)
                took = np.flatnonzero(minima(h, g.whole(window), window - K + 1))
                near = np.unique(took[_has(prints, h[took])][:, None] - np.arange(window - K + 1))
                able = g.whole(window)
                near = near[(near >= 0) & (near < len(able))]
                near = near[able[near]]
                found = [(window, near[_has(windows, g.hashes(window)[near])])]
                for n in lengths:
                    at = np.flatnonzero(g.whole(n))
                    found.append((n, at[_has(windows, g.hashes(n)[at])]))
                starts = np.concatenate([at for _, at in found])
                doc = g.doc[starts]
                digests = np.frombuffer(b"".join([_digests(g, at, n) for n, at in found]), ">i8").astype("i8").reshape(-1, 2)
                done = [i for i, c in enumerate(chunk) if c[3] is not None]
                row = pa.array(np.array([c[0] for c in chunk], np.int64)[np.r_[np.array(done, np.int64), doc]])
                none, lengths_of = [None] * len(done), np.repeat([n for n, _ in found], [len(at) for _, at in found])
                cols = [pa.array([chunk[i][3] for i in done] + [None] * len(doc), pa.int64())]
                for x, kind in ((starts + base[doc], pa.int64()), (lengths_of, pa.int32()), (digests[:, 0], pa.int64()), (digests[:, 1], pa.int64())):
                    cols.append(pa.concat_arrays([pa.array(none, kind), pa.array(x, kind)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *cols], [f.split()[0] for f in _FOUND.split(", ")])

    return rows


def _items(window: int):
    """Rows (item_id, hash, n) of items; n is the length of a short item, else 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, lengths = [], [], []
            for item, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                words = words_of(text)
                g = Grams([words])
                h = np.unique(winnowed(g, window)[0]) if len(words) >= window else g.hashes(len(words)) if words else np.zeros(0, np.uint64)
                hashes.append(h.view(np.int64))
                ids += [item] * len(h)
                lengths += [len(words) if len(words) < window else 0] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)), pa.array(lengths, pa.int32())], ["item_id", "hash", "n"])

    return rows


def _item_windows(window: int):
    """Rows (item_id, hash, n, w1, w2): the different windows of items, by the rolling hash and by digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch, 1, window - 1):
                for row, first, words, _ in chunk:
                    n = len(words) if not first and len(words) < window else window
                    g = Grams([words])
                    h = g.hashes(n) if words else np.zeros(0, np.uint64)
                    h, at = np.unique(h, return_index=True)
                    d = np.frombuffer(_digests(g, at, n), ">i8").astype("i8").reshape(-1, 2)
                    ids = batch.column(0).take(pa.array(np.full(len(h), row)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])], ["item_id", "hash", "n", "w1", "w2"])

    return rows


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, np.uint8)
    for batch in batches:
        h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = 1
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in batches:
        for m in batch.column(0):
            bits |= np.frombuffer(m.as_py(), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])


def _filter(hashes: DataFrame) -> bytes:
    """Bitmap of a column of hashes; four maps of a megabyte come to the driver."""
    maps = hashes.mapInArrow(_bitmap, "bits binary").repartition(4).mapInArrow(_joined, "bits binary").collect()
    return np.bitwise_or.reduce([np.frombuffer(m.bits, np.uint8) for m in maps] or [np.zeros(1 << (FILTER_BITS - 3), np.uint8)]).tobytes()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row for each row of ``docs``.

    A word is hit if it is inside any occurrence of a window of any item;
    ``contaminated`` means some hits, one in ``one_in`` words or more. Needs
    ``doc_id, text`` and ``item_id, text``. NULL and empty texts have no words.
    Rows that repeat a doc_id are judged one by one; of a repeated item_id all
    texts count, as one item. Rows with a NULL id are judged, too. Very long
    texts are gone through in pieces that overlap by a window. Without
    documents there are no rows, without items no hits.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("row_key"), F.col("text").cast("binary").alias("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    prints = items.mapInArrow(_items(window), "item_id long, hash long, n int")
    windows = written(items.mapInArrow(_item_windows(window), "item_id long, hash long, n int, w1 long, w2 long").distinct(), "item-windows")
    lengths = sorted(r.n for r in windows.filter(F.col("n") < window).select("n").distinct().collect())  # fewer than a window has words
    bits = spark.sparkContext.broadcast((_filter(prints.select("hash")), _filter(windows.select("hash"))))
    found = written(docs.mapInArrow(_found(window, lengths, bits), _FOUND), "doc-windows")
    asked, by, row = found.filter("start IS NOT NULL"), ["n", "w1", "w2"], ["doc_id", "row_key"]
    hits = asked.join(windows.select(*by).distinct(), by, "left_semi")
    ahead = Window.partitionBy(*row).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # some windows of one document
    end = F.col("start") + F.col("n")
    own = end - F.greatest("start", F.coalesce(F.max(end).over(ahead), F.lit(0)))
    words = hits.select(*row, F.greatest(own, F.lit(0)).alias("own")).groupBy(*row).agg(F.sum("own").alias("n_hit"))
    named = asked.join(windows.select("item_id", *by), by).select(*row, "item_id").distinct()
    names = named.groupBy(*row).agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(F.when(F.col("item_id") != NO_ID, F.col("item_id").cast("string")))).alias("items"))
    counted = found.filter("n_words IS NOT NULL").select(*row, "n_words")
    met = words.join(names, same(words, names, *row)).select(words["doc_id"].alias("met_id"), words["row_key"].alias("met_key"), "n_hit", "n_items", "items")
    both = counted.join(met, F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("row_key") == F.col("met_key")), "left")
    names = F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256)
    out = both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), names.alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that are not contaminated. An id goes if any row with it is."""
    bad = contamination(docs, benchmark, **kw).filter("contaminated").select("doc_id").distinct()
    return docs.join(bad, same(docs, bad, "doc_id"), "left_anti").select(*docs.columns)


def clean_rows(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, each judged by its own text, whatever its id."""
    keyed = docs.withColumn("row key", row_key(docs, "doc_id", "text"))
    bad = contamination(keyed.select(F.col("row key").alias("doc_id"), "text"), benchmark, **kw).filter("contaminated").select(F.col("doc_id").alias("row key")).distinct()
    return keyed.join(bad, "row key", "left_anti").select(*docs.columns)
