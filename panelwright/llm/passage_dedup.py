"""Substring dedup by hashing normalised units.

Units are lines and, as the query uses them, clauses beside them. Lines come
first: a line that is the same from end to end is known by one digest. Clauses
find what whole lines miss, passages that begin or end inside a line or are
wrapped anew: paragraphs (parted by empty lines) are cut after each word whose
hash, with that of the word before, is the smallest of some ``WITHIN`` words in
a row, whatever the line breaks. Such cuts depend on the words around them
alone, so a passage is cut alike wherever it stands. Of ``WITHIN`` words one is
always a cut, so a repeat of n words shares units of ``n - 2 * WITHIN - 1``
words at least: with 20 words asked for, every repeat of 50 words or more is
found.

Both kinds are hashed in one pass. A clause inside a line that goes anyway
costs a row and changes nothing, and to leave it out would take a second
reading of all texts.

Digests of units are grouped over all documents in two steps. Counts by half a
digest, summed before the shuffle, tell which can repeat at all; only units
with such a half go on to be compared in full. The earliest occurrence by rank,
document and place stays; later ones go if, with the repeated units that touch
or overlap them, they make up ``min_words`` words. Whole lines that repeat but
are not part of so many words, headings and signatures, are removed on request
(``short_lines``) and are marked, so that a document with such lines alone can be
told from one that repeats a passage. Removed spans keep their offsets in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import same, written
from .grams import SPACE, minima, mixed, parts, word_pieces

WITHIN = 14
#: Bytes of text that are cut at a time, and bytes on either side that are looked at for it.
PIECE, AROUND = 1 << 20, 1 << 16
_UNITS = "doc_id long, row_key long, rank long, h1 long, h2 long, place long, words long, first int, last int, line boolean"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TURN = 0x9E3779B97F4A7C15


def _ends(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of each word, and whether a line and whether a clause ends with it."""
    raw = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, _BLANK[raw], True].astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    breaks = np.diff(np.searchsorted(np.flatnonzero(raw == 10), start))
    line, paragraph = (np.r_[breaks > n, np.ones(min(1, len(start)), bool)] for n in (0, 1))
    # a hash of the word's length, its first bytes and its last ones; need not be strong, only a function of the word
    low = np.frombuffer(text.translate(_LOWER), np.uint8)
    mix = (end - start).astype(np.uint64)
    for i in range(4):
        mix = mix * np.uint64(_TURN) + low[np.maximum(end - 1 - i, start)]
        mix = mix * np.uint64(_TURN) + low[np.minimum(start + i, end - 1)]
    before = np.r_[np.uint64(0), np.where(paragraph, np.uint64(0), mix)[:-1]][: len(mix)]  # none at the start of a paragraph
    pair = mixed(mix + before * np.uint64(_TURN), 4)
    number = np.cumsum(paragraph) - paragraph
    inside = number[WITHIN - 1 :] == number[: max(0, len(number) - WITHIN + 1)]
    return start, end, line, paragraph | minima(pair, inside, WITHIN)


def units(text: bytes, clauses: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of lines, and of clauses: first and last byte (exclusive), number of the first word, and number of words.

    Lines without words are none. A very long text is gone through in pieces,
    each with what stands around it; only blanks or words of ``AROUND`` bytes
    could make a cut depend on where a piece ends.
    """
    found: list[list[tuple]] = [[], []][: 1 + clauses]
    fresh, at, word = [True, True], 0, 0
    while True:
        m = SPACE.search(text, at + PIECE) if len(text) - at > PIECE + AROUND else None
        to, low = m.start() if m else len(text), max(0, at - AROUND)
        start, end, *kinds = _ends(text[low : to + AROUND])
        own = slice(*np.searchsorted(start, (at - low, to - low)))
        for i, cut in enumerate(kinds[: len(found)]):
            cut = cut[own]
            begins = np.r_[fresh[i], cut[:-1]][: len(cut)]
            found[i].append((start[own][begins] + low, word + np.flatnonzero(begins), end[own][cut] + low, word + np.flatnonzero(cut)))
            fresh[i] = bool(cut[-1]) if len(cut) else fresh[i]
        word += own.stop - own.start
        at = to
        if not m:
            break
    out = []
    for kind in found:
        first, number, last, upto = (np.concatenate(c) for c in zip(*kind, strict=True))
        out.append((first, last, number, upto - number + 1))
    return out


def _digest(low: bytes, kind: int) -> bytes:
    """Of the words, with one blank between them."""
    if len(low) <= PIECE:
        return xxhash.xxh3_128_digest(b" ".join(low.split()), kind)
    h, blank = xxhash.xxh3_128(seed=kind), b""
    for words in word_pieces(low, PIECE):
        if words:
            h.update(blank + b" ".join(words))
            blank = b" "
    return h.digest()


def _found(batch: pa.RecordBatch, column: int, clauses: bool) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    """Row, digest as two longs, and (place, words, first, last, whether it is a line) of units, some at a time.

    Short texts are cut together, an empty line between them.
    """
    for part, texts in parts(batch, column, PIECE):
        whole = b"\n\n".join(t or b"" for t in texts)
        offset = np.cumsum([0] + [len(t or b"") + 2 for t in texts[:-1]])
        low = whole.translate(_LOWER)
        seen = None
        for kind, (first, last, number, words) in enumerate(units(whole, clauses)):
            row = np.searchsorted(offset, first, side="right") - 1
            if seen is None:  # lines say at which word each text begins
                seen = np.full(len(texts), len(low))
                np.minimum.at(seen, row, number)
            for i in range(0, len(first), 1 << 16):
                few = slice(i, i + (1 << 16))
                h = np.frombuffer(b"".join([_digest(low[a:b], kind) for a, b in zip(first[few].tolist(), last[few].tolist(), strict=True)]), ">i8").astype("i8").reshape(-1, 2)
                r = row[few]
                yield part.start + r, h, (number[few] - seen[r], words[few], (first[few] - offset[r]).astype(np.int32), (last[few] - offset[r]).astype(np.int32), np.full(len(r), kind == 0))


def _halves(clauses: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, _ in _found(batch, 0, clauses):
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0])], ["h1"])

    return rows


def _rows(clauses: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h, more in _found(batch, 3, clauses):
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(3)), pa.array(h[:, 0]), pa.array(h[:, 1]), *map(pa.array, more)], [f.split()[0] for f in _UNITS.split(", ")])

    return rows


def _with_key(docs: DataFrame, rank: str | None) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row_key"), (F.col(rank).cast("long") if rank else F.lit(0).cast("long")).alias("rank"), text.cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, unit: str = "clause", min_words: int = 20, rank: str | None = None, short_lines: bool = False) -> DataFrame:
    """``doc_id, row_key, first, last, words, kept_doc, passage``: a row for each run of units to remove.

    ``unit`` is "line", or "clause" for lines and clauses. ``first`` and
    ``last`` (exclusive) are byte offsets in the UTF-8 text, from the first
    unit of the run to its last; ``kept_doc`` is the smallest doc_id that keeps
    one of them. With ``short_lines`` whole lines that repeat go at any length:
    those outside of runs of ``min_words`` words are rows of their own, for
    which ``passage`` is false. ``rank`` names an integer column that goes before the doc_id
    (NULL first). Texts are compared with A-Z lower-cased and white space as
    single blanks. NULL and empty texts have no units; very long ones are gone
    through in pieces. Documents are told apart by id and text (``row_key``);
    an exact repeat of a row is the same document. An empty table gives no rows.
    """
    if unit not in ("line", "clause"):
        raise ValueError("unit is line or clause")
    keyed, clauses = _with_key(docs, rank), unit == "clause"
    halves = keyed.select("text").mapInArrow(_halves(clauses), "h1 long").groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1")
    # tables of their own: joins right after an aggregate on the same key cannot be split at hot digests
    halves = written(halves, "passage-halves")
    able = written(keyed.mapInArrow(_rows(clauses), _UNITS).join(halves, "h1", "left_semi"), "passage-units")
    at = F.struct("rank", "doc_id", "row_key", "place")
    first = able.groupBy("h1", "h2").agg(F.min(at).alias("kept"), F.max(at).alias("final")).filter(F.col("kept") != F.col("final")).select("h1", "h2", "kept")
    later = able.join(written(first, "passage-first"), ["h1", "h2"]).filter(at != F.col("kept"))
    later = later.select("doc_id", "row_key", "place", "words", "first", "last", "line", F.col("kept.doc_id").alias("kept_doc")).distinct()
    # a window holds some units of one document; a run goes on as long as units touch or overlap
    by_doc = Window.partitionBy("doc_id", "row_key").orderBy("place", F.desc("words"))
    end = F.col("place") + F.col("words")
    apart = later.withColumn("apart", F.coalesce(F.col("place") > F.max(end).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    runs = apart.withColumn("run", F.sum(F.col("apart").cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "row_key", "run")
    long = (F.max(end).over(whole) - F.min("place").over(whole)) >= min_words
    # a short run falls apart into its lines
    parts = runs.withColumn("passage", long).filter(F.col("passage") | F.col("line") if short_lines else F.col("passage")).withColumn("part", F.when(~F.col("passage"), F.col("place")))
    spans = parts.groupBy("doc_id", "row_key", "run", "part", "passage").agg(F.min("first").alias("first"), F.max("last").alias("last"), (F.max(end) - F.min("place")).alias("words"), F.min("kept_doc").alias("kept_doc"))
    return spans.select("doc_id", "row_key", "first", "last", "words", "kept_doc", "passage")


def span_lists(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_spans, words_removed, kept_docs, spans`` of passages, and ``line_spans, line_words`` of short lines; by offset."""
    keys = _with_key(docs, None).select("doc_id", "row_key")
    at, passage = F.struct("first", "last"), F.col("passage")
    of = lambda c, kind: F.when(kind, c)
    lists = spans.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_list(of(at, passage))).alias("spans"), F.sum(of(F.col("words"), passage)).alias("words_removed"), F.array_sort(F.collect_set(of(F.col("kept_doc"), passage))).alias("kept_docs"),
        F.array_sort(F.collect_list(of(at, ~passage))).alias("line_spans"), F.sum(of(F.col("words"), ~passage)).alias("line_words"),
    )
    both = keys.join(lists, same(keys, lists, "doc_id", "row_key"), "left")
    none, zero = F.array().cast("array<struct<first:int,last:int>>"), F.lit(0)
    number = lambda c: F.coalesce(c, zero).cast("long")
    return both.select(
        keys["doc_id"], number(F.size("spans")).alias("n_spans"), number(F.col("words_removed")).alias("words_removed"), F.coalesce("kept_docs", F.array().cast("array<long>")).alias("kept_docs"), F.coalesce("spans", none).alias("spans"),
        F.coalesce("line_spans", none).alias("line_spans"), number(F.col("line_words")).alias("line_words"),
    )


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text, spans``: texts without the spans, with the spans' original offsets."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, kept = 0, []
                for span in own or []:
                    kept.append(text[at : span["first"]])
                    at = span["last"]
                out.append(b"".join([*kept, text[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(2)], ["doc_id", "text", "spans"])

    docs = _with_key(docs, None)
    lists = spans.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    both = docs.join(lists, same(docs, lists, "doc_id", "row_key"), "left").select(docs["doc_id"], "text", "spans")
    return both.mapInArrow(cut, "doc_id long, text string, spans array<struct<first:int,last:int>>")
