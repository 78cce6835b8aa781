"""LM scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered by Spark over all training texts.
A count c is quantised to ``1 + floor(log2 c)`` and stored as that many
members of a Bloom filter; a count is read back by probing level after level
until one is missing. All pairs are members, those seen once at level 1. The
filter is cut into blocks of hashes, and each block has ``BITS_EACH`` bits for
each of its members, as counted, so it grows with the corpus.

No task holds the filter. Texts are packed into lots, and each lot sends its
different words and pairs to their blocks, with their counts in training texts
(0 for those of held-out texts alone). A block sums the counts, builds its part
of the filter, probes it for the keys of each lot and sends the levels back,
and for words the exact counts that the base score needs. A lot is then scored
with what its blocks sent.

The dealt method sends the filter to all workers. With all pairs of a corpus it
outgrows any broadcast, so here the probes travel to the filter's blocks; a
block stands for about ``BLOCK`` bytes of training text at every size.

Words are told apart by 64-bit hashes, pairs by 48 bits of one. The probability
of a word is interpolated from its pair with the word before and from its own
count. A text longer than a lot is scored in pieces that begin with the last
word of the one before as their context, and the pieces are summed.

Counts travel as sorted arrays, one for each block of hashes and lot of texts,
already summed within the lot; a hot word or pair is one entry a lot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .grams import SPACE, Grams, mixed, parts

#: Bits for a member of the filter, bytes of text in a lot, and bytes of training text for each block (a power of 2).
BITS_EACH, LOT, BLOCK = 9, 2 << 20, 1 << 22
#: Keys that are hashed at once, so that what hashing needs beside them stays small.
SOME = 1 << 16
#: Lots are large rows. Parquet's writer looks at the size of a page each 100 rows, and its reader takes up to 4096 rows of a
#: group of rows at once; with these a page is a lot and a group four, however many lots a task has.
FEW_ROWS = {"parquet.page.row.count.limit": 1, "parquet.block.row.count.limit": 4}
#: Tasks that blocks are dealt to, at most; a task takes one block after another.
TASKS = 1 << 14
#: Hash of the end of a text, which is also the context of the first word.
END = np.uint64(0x5851F42D4C957F2D)
_TURN = np.uint64(0xD1342543DE82EF95)


_PAIR = np.uint64(0xFFFFFFFFFFFF0000)


def tokens(texts: list[bytes | None], carried: np.ndarray | None = None, goes_on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of all pairs with the token before, the number of tokens of each text, and what is before it.

    Words are lower-cased in A-Z and parted at 0x09-0x0D and 0x20, as bytes do
    it. Of a text that is ``carried`` on the first word is context only; one
    that ``goes_on`` has no end.
    """
    g = Grams([(t or b"").lower().split() for t in texts])
    n = g.counts + 1
    one = np.full(int(n.sum()), END, np.uint64)
    last = np.cumsum(n) - 1
    inner = np.ones(len(one), bool)
    inner[last] = False
    one[inner] = g.hashes(1)
    two = mixed(np.r_[END, one[:-1]] * _TURN + one, 2) & _PAIR
    first = np.full(len(n), END, np.uint64)
    if carried is None or not (carried | goes_on).any():
        return one, two, n, first
    keep = np.ones(len(one), bool)
    keep[(last - n + 1)[carried]] = False
    keep[last[goes_on]] = False
    first[carried] = one[(last - n + 1)[carried]]
    return one[keep], two[keep], n - carried - goes_on, first


def _pieces(text: bytes) -> Iterator[tuple[bytes, bool, bool]]:
    """The text in pieces of about a lot, whether each is carried on from one before, and whether it goes on."""
    at, context = 0, b""
    while len(text) - at > LOT and (found := SPACE.search(text, at + LOT)):
        piece = text[at : found.start()]
        yield context + b" " + piece if context else piece, bool(context), True
        context = (piece.rsplit(None, 1) or [context])[-1]
        at = found.start()
    yield context + b" " + text[at:] if context else text[at:], bool(context), False


_LOTS = "lot long, size long, doc_ids array<long>, held_out array<boolean>, texts array<binary>, carried array<boolean>, goes_on array<boolean>, whole array<long>"


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents packed, some ``LOT`` bytes of text in a row; the pieces of a long text share a number."""
    lot = whole = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        types = [pa.int64(), pa.bool_(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64()]
        cols = [pa.array([list(c)], pa.list_(t)) for c, t in zip(zip(*held, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([lot]), pa.array([size]), *cols], [f.split()[0] for f in _LOTS.split(", ")])

    for batch in batches:
        for part, texts in parts(batch, 2):
            own = batch.slice(part.start, len(texts))
            for doc_id, out, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), texts, strict=True):
                for piece, carried, goes_on in _pieces(text or b""):
                    whole += goes_on and not carried
                    held.append((doc_id, out, piece, carried, goes_on, whole if carried or goes_on else None))
                    size += len(piece)
                    if size >= LOT:
                        yield packed()
                        lot, held, size = lot + 1, [], 0
    if held:
        yield packed()
    pa.default_memory_pool().release_unused()


def _texts(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a lot, as ``tokens`` gives them; some of its texts at a time are Python objects."""
    texts = pa.RecordBatch.from_arrays([batch.column("texts")[row].values], ["text"])
    carried, goes_on = (batch.column(c)[row].values.to_numpy(zero_copy_only=False).astype(bool) for c in ("carried", "goes_on"))
    found = [tokens(own, carried[at], goes_on[at]) for at, own in parts(texts, 0, 1 << 19)]
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _short(pairs: np.ndarray) -> bytes:
    """The 48 bits of pair hashes as six bytes each."""
    return pairs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (keys >> np.uint64(64 - blocks.bit_length() + 1)).astype(np.int64) if blocks > 1 else np.zeros(len(keys), np.int64)


_COUNTED = "block int, lot long, keys1 binary, counts1 binary, keys2 binary, counts2 binary"


def _counted(blocks: int):
    """A lot's different words and pairs by block, each with its count in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lot in enumerate(batch.column("lot").to_pylist()):
                one, two, n, first = _texts(batch, row)
                learnt = np.repeat(~batch.column("held_out")[row].values.to_numpy(zero_copy_only=False).astype(bool), n)
                found = []
                for own in (np.r_[one, first], two):  # what is before a text is asked for, not counted
                    keys, where = np.unique(own, return_inverse=True)
                    found += [keys, np.bincount(where[: len(learnt)], learnt, len(keys)).astype("<u4")]
                at = [_block_of(keys, blocks) for keys in found[::2]]
                some = np.union1d(*at)
                cols = []
                for own, (keys, counts), brief in zip(at, (found[:2], found[2:]), (np.ndarray.tobytes, _short), strict=True):
                    edges = np.r_[np.searchsorted(own, some), len(own)].tolist()
                    spans = list(zip(edges[:-1], edges[1:], strict=True))
                    cols += [[brief(keys[s:e]) for s, e in spans], [counts[s:e].tobytes() for s, e in spans]]
                out = [pa.array(some, pa.int32()), pa.array([lot] * len(some), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)]
                yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in _COUNTED.split(", ")])
        pa.default_memory_pool().release_unused()

    return run


def _summed(k: np.ndarray, counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys with their counts over all lots, without those never counted."""
    c = np.frombuffer(b"".join(counts), "<u4")
    k, c = k[c > 0], c[c > 0]
    order = np.argsort(k)
    k, c = k[order], c[order]
    del order
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    return k[at], np.add.reduceat(c, at, dtype=np.int64) if len(k) else c.astype(np.int64)


def _exact(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Counts of the keys asked for; 0 for others."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, counts[at], 0)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(counts.astype(float))[1]


def count_of(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts that have so many levels; 0 for none."""
    high = np.exp2(levels.astype(float))
    return np.where(levels > 0, (high / 2 + high - 1) / 2, 0.0)


def _word_and_mask(keys: np.ndarray, level: int | np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Place within a block's words, and three bits of it."""
    h = mixed(keys + np.asarray(level, np.uint64) * _TURN, 3)
    one = np.uint64(1)
    mask = (one << (h & np.uint64(63))) | (one << (h >> np.uint64(6) & np.uint64(63))) | (one << (h >> np.uint64(12) & np.uint64(63)))
    return ((h >> np.uint64(20)) % np.uint64(words)).astype(np.int64), mask


class Filter:
    def __init__(self, words: np.ndarray, blocks: int):
        self.words, self.blocks, self.each = words, blocks, len(words) // blocks
        self.shift = np.uint64(64 - blocks.bit_length() + 1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Repeated probes: the number of levels from the first on that are all members."""
        if len(keys) > SOME:
            return np.concatenate([self.levels(keys[i : i + SOME]) for i in range(0, len(keys), SOME)])
        out = np.zeros(len(keys), np.uint8)
        base = (keys >> self.shift).astype(np.int64) * self.each if self.blocks > 1 else np.zeros(len(keys), np.int64)
        alive, level = np.arange(len(keys)), 1
        while len(alive) and level < 64:
            at, mask = _word_and_mask(keys[alive], level, self.each)
            alive = alive[self.words[base[alive] + at] & mask == mask]
            out[alive] = level
            level += 1
        return out


def filter_of(keys: np.ndarray, counts: np.ndarray) -> Filter:
    """Filter of one block with all these counts, in ``BITS_EACH`` bits for a member."""
    levels = np.concatenate([np.zeros(0, np.uint8), *(levels_of(counts[i : i + SOME]).astype(np.uint8) for i in range(0, len(counts), SOME))])
    words = max(1, -(-int(levels.sum(dtype=np.int64)) * BITS_EACH // 64))
    bits = np.zeros(words, np.uint64)
    for i in range(0, len(keys), SOME):
        own, most = keys[i : i + SOME], levels[i : i + SOME]
        for level in range(1, int(most.max(initial=0)) + 1):
            at, mask = _word_and_mask(own[most >= level], level, words)
            np.bitwise_or.at(bits, at, mask)
    return Filter(bits, 1)


_PROBED = "lot long, block int, types long, total long, counts1 binary, levels1 binary, levels2 binary"


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block knows of the keys of each lot, and a row without a lot with its number of words and their sum."""

    def block(no: int, rows: list[tuple]) -> Iterator[tuple]:
        k1, c1 = _summed(np.frombuffer(b"".join([r[1] for r in rows]), "<u8"), [r[2] for r in rows])
        filt = filter_of(*map(np.concatenate, zip((k1, c1), _summed(_long(b"".join([r[3] for r in rows])), [r[4] for r in rows]), strict=True)))
        yield None, no, len(k1), int(c1.sum()), None, None, None
        for lot, own1, _, own2, _ in rows:
            own1, own2 = np.frombuffer(own1, "<u8"), _long(own2)
            levels = filt.levels(np.r_[own1, own2]).astype(np.uint8)
            yield lot, no, None, None, _exact(k1, c1, own1).astype("<i8").tobytes(), levels[: len(own1)].tobytes(), levels[len(own1) :].tobytes()

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3]

    def batch_of(no: int, rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*block(no, rows), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in _PROBED.split(", ")])

    no, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):  # few at a time are Python objects
            for b, *row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                if b != no:
                    if rows:
                        yield batch_of(no, rows)
                    no, rows = b, []
                rows.append(row)
    if rows:
        yield batch_of(no, rows)
    pa.default_memory_pool().release_unused()


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, whole long"


def _scored(types: int, total: int, weight: float):
    def run(lots: pa.Table, known: pa.Table) -> pa.Table:
        batch = lots.combine_chunks().to_batches()[0]
        one, two, n, first = _texts(batch, 0)
        known = known.sort_by("block")  # blocks are ranges of hashes, so this is the order of the lot's sorted keys
        c, l1, l2 = (np.frombuffer(b"".join(known.column(x).to_pylist()), t) for x, t in (("counts1", "<i8"), ("levels1", np.uint8), ("levels2", np.uint8)))
        doc = np.repeat(np.arange(len(n)), n)
        kinds, where = np.unique(np.r_[one, first], return_inverse=True)
        pairs, which = np.unique(two, return_inverse=True)
        assert len(kinds) == len(c) == len(l1) and len(pairs) == len(l2)
        guess = count_of(l1)
        where, before = where[: len(one)], guess[where[len(one) :]]
        own = guess[where]
        context = np.r_[0.0, own[:-1]][: len(own)]
        context[(np.cumsum(n) - n)[n > 0]] = before[n > 0]
        pair = count_of(l2)[which]
        alone = (own + 1.0) / (total + types + 1.0)
        share = np.minimum(1.0, pair / np.maximum(context, 1.0))
        p = np.where(context > 0, weight * share + (1 - weight) * alone, alone)
        base = np.log10((c + 1.0) / (total + types + 1.0))[where]
        sums = [np.bincount(doc, x, len(n)) for x in ((c > 0)[where], base, np.log10(p))]
        cols = [batch.column("doc_ids")[0].values, batch.column("held_out")[0].values, pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(sums[1]), pa.array(sums[2]), batch.column("whole")[0].values]
        return pa.Table.from_arrays(cols, [f.split()[0] for f in _SCORED.split(", ")])

    return run


def score_texts(docs: DataFrame, held_out: Column, weight: float = 0.6) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row for each row of ``docs``.

    Learns from the rows for which ``held_out`` is not true. Tokens are the
    words of the text and one end. ``base_score`` is the sum of
    ``log10((c + 1) / (N + V + 1))`` with exact counts; ``score`` is the log10
    probability by the filter, which has ``BITS_EACH`` bits for each of its
    members however many there are, so scores of small and large tables have
    the same error: a level that is not there is read as one with a chance of
    some 2 %. A NULL or empty text is its
    end alone. A very long text is scored in pieces and summed. Repeated rows
    are counted and scored each. Without training rows all counts are 0. An
    empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    lots = written(own.mapInArrow(_lots, _LOTS), "lm-lots", FEW_ROWS)
    size = lots.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(64, 1 << (int(size) // BLOCK).bit_length())
    counted = lots.drop("size", "doc_ids", "whole").mapInArrow(_counted(blocks), _COUNTED)
    dealt = counted.repartition(min(blocks // 2, TASKS), "block").sortWithinPartitions("block")
    probed = written(dealt.mapInArrow(_probed, _PROBED), "lm-levels")
    types, total = probed.filter("lot is null").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    known = probed.filter("lot is not null").select("lot", "block", "counts1", "levels1", "levels2")
    scored = written(lots.groupBy("lot").cogroup(known.groupBy("lot")).applyInArrow(_scored(int(types), int(total), weight), _SCORED), "lm-scores")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    long = scored.filter("whole IS NOT NULL").groupBy("whole", "doc_id", "held_out", "train_tokens").agg(*sums)
    names = [f.split()[0] for f in _SCORED.split(", ")][:-1]
    return scored.filter("whole IS NULL").select(*names).unionByName(long.select(*names))
