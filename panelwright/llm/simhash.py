"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of 64 bits that differ in ``max_bits`` bits or fewer are linked.
They are cut into ``max_bits // 2 + 1`` segments: were each segment of a pair
to differ in two bits, the pair would differ in more than ``max_bits``, so one
segment differs in one bit at most. Every fingerprint is indexed under each of
its segments with one bit replaced by a wildcard, 64 keys in all; an equality
join on these keys finds each pair, and the number of differing bits is
verified. A pair is taken from one key only: that of its first segment with at
most one differing bit, with the wildcard on this bit, or on the segment's
lowest bit if the segments are equal.

Copies share a fingerprint and are one row of the index. No pair of a group is
kept: each fingerprint, and in later rounds each group, keeps the smallest one
it is linked with, summed before the shuffle; what is joined so far is
contracted (see ``components``), and the index is asked again for links between
different groups, until there are none. No links or fingerprints reach the
driver.

The guarantee is for few differing bits. Texts that share four in five shingles
differ in about ten bits of 64, and no cut of the fingerprint has keys that are
both sure to meet and rare enough then. ``keep_one`` therefore has further
candidates: ``BANDS`` keys of ``ROWS`` least shingle hashes each. Within a key
all texts meet one of them; where four bits of each least hash say that they can
be alike, their whole sets of shingles decide. Those that are not joined to it
go on and meet eight others, then 64, and so on, until none is left, so a key of
n texts takes log n rounds, and one of texts that are alike takes one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, row_key, written
from .components import components
from .grams import mixed, word_pieces

#: Two texts of Jaccard similarity 0.8 share one of 16 keys of 5 least hashes in 998 cases of 1000.
BANDS, ROWS = 16, 5
_NONE = np.uint64((1 << 64) - 1)
#: Texts of a key that the others meet, from one round to the next.
MORE = 8
_TURNS = np.random.default_rng(5).integers(1, 1 << 63, (1, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, ngram: int) -> Iterator[np.ndarray]:
    """XXH64 digests of the shingles as rows of eight bytes, some at a time; fewer words than ``ngram`` are one shingle.

    ``bytes.lower`` and ``bytes.split`` know A-Z and 0x09-0x0D, 0x20 only.
    """
    carry, some, hashed = [], False, xxhash.xxh64_digest
    for words in word_pieces((text or b"").lower()):
        words = carry + words
        if len(words) >= ngram:
            some = True
            joined = b" ".join(words)
            lens = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lens) + np.arange(len(words))
            starts = ends - lens
            spans = zip(starts[: len(words) - ngram + 1].tolist(), ends[ngram - 1 :].tolist(), strict=True)
            h = np.frombuffer(b"".join([hashed(joined[s:e], 42) for s, e in spans]), np.uint8).reshape(-1, 8)
            yield from (h[i : i + (1 << 15)] for i in range(0, len(h), 1 << 15))
            words = words[len(words) - ngram + 1 :]
        carry = words
    if carry and not some:
        yield np.frombuffer(hashed(b" ".join(carry), 42), np.uint8).reshape(1, 8)


def sketch(text: bytes | None, ngram: int, least: np.ndarray | None = None) -> int:
    """Bit i is 1 if over half of the shingles' XXH64 values have it; 0 without words. ``least`` takes up least hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingles(text, ngram):
        ones += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
        if least is not None:
            x = h.view(">u8").astype(np.uint64)
            for i in range(0, len(x), 1 << 11):
                np.minimum(least, (x[i : i + (1 << 11)] * _TURNS).min(axis=0), out=least)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes | None, ngram: int) -> int:
    return sketch(text, ngram)


def fingerprints(docs: DataFrame, ngram: int = 4) -> DataFrame:
    """``doc_id, fp`` with the 64 bits as a signed long, one row for each row of ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), ngram) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, "doc_id long, fp long")


def _sketches(keyed: DataFrame, ngram: int) -> DataFrame:
    """``doc_id, row_key, fp, bands, bits``; texts without words have no bands. ``bits`` are four of each least hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, bands, bits = [], [], []
            for t in batch.column(2):
                least = np.full(BANDS * ROWS, _NONE, np.uint64)
                fps.append(sketch(t.as_py(), ngram, least))
                bands.append([] if (least == _NONE).all() else [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))])
                four = (mixed(least) & np.uint64(15)).astype(np.uint8)
                bits.append((four[0::2] << 4 | four[1::2]).view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "row_key", "fp", "bands", "bits"])

    return keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "row_key", F.col("text").cast("binary").alias("text")).mapInArrow(rows, "doc_id long, row_key long, fp long, bands array<long>, bits array<long>")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _segments(max_bits: int) -> list[tuple[int, int]]:
    k = max_bits // 2 + 1
    edges = [64 * i // k for i in range(k + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _key(fp: Column, bit: Column, segments: list[tuple[int, int]]) -> Column:
    """The fingerprint's segment that holds ``bit``, this bit cleared, and the bit's number on top."""
    value = None
    for low, high in segments:
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
        cleared = part.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, cast(bit as int) - {low})")))
        value = cleared if value is None else F.when(bit >= low, cleared).otherwise(value)
    return F.shiftleft(bit.cast("long"), 57).bitwiseOR(value)


def _met(groups: DataFrame, max_bits: int) -> DataFrame:
    """Pairs ``fp, other, group, other_group`` of different groups that differ in few bits; fingerprints are distinct."""
    segments = _segments(max_bits)
    if max(high - low for low, high in segments) > 57:
        raise ValueError("max_bits is 2 at least")
    index = groups.select("fp", "group", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).withColumn("key", _key(F.col("fp"), F.col("bit"), segments))
    a, b = index.alias("a"), index.select("key", F.col("fp").alias("other"), F.col("group").alias("other_group")).alias("b")
    x = F.expr("fp ^ other")
    own = F.expr("shiftleft(1L, bit)")
    canonical = F.lit(False)
    for low, high in reversed(segments):
        mask = F.lit(_signed(((1 << (high - low)) - 1) << low)).cast("long")
        diff = x.bitwiseAND(mask)
        here = F.col("bit").between(low, high - 1) & ((diff == own) | ((diff == 0) & (F.col("bit") == low)))
        canonical = F.when(F.bit_count(diff) <= 1, here).otherwise(canonical)
    test = (F.col("a.key") == F.col("b.key")) & (F.col("fp") < F.col("other")) & (F.col("group") != F.col("other_group")) & (F.bit_count(x) <= max_bits) & canonical
    # Spark takes the index for no larger than what it was made from and would broadcast it, 64 rows a fingerprint
    return a.join(b.hint("merge"), test).select("fp", "other", "group", "other_group")


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Pairs ``fp, other`` (fp < other) of different fingerprints that differ in few bits; ``fps`` are distinct."""
    return _met(fps.select("fp", F.col("fp").alias("group")), max_bits).select("fp", "other")


def _joined(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, group`` after the groups that ``edges(a, b)`` lead to each other have become one, named by the smallest."""
    up = components(edges)
    out = written(groups.join(up, groups["group"] == up["node"], "left").select("fp", F.coalesce("root", "group").alias("group")), "fp-groups")
    free(up)
    return out


def _linked(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fp, group`` of the fingerprints that have links; groups are fingerprints, too."""
    groups, asked = None, fps.select("fp", F.col("fp").alias("group"))
    while True:
        met = _met(asked, max_bits).select(F.explode(F.array(F.struct(F.col("group").alias("a"), F.col("other_group").alias("b")), F.struct(F.col("other_group").alias("a"), F.col("group").alias("b")))).alias("x"))
        edges = written(met.groupBy("x.a").agg(F.min("x.b").alias("b")), "fp-edges")
        if groups is not None and edges.isEmpty():
            return groups
        groups = _joined(edges.select(F.col("a").alias("fp"), F.col("a").alias("group")) if groups is None else groups, edges)
        asked = groups


def _named(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``fp, name``: of the ``nodes(fp, name)``, the smallest name in each one's group."""
    # these tables grow with the documents, so none of them is broadcast
    own = written(nodes.join(groups.hint("merge"), "fp").select("fp", "name", "group"), "fp-own")
    least = written(own.groupBy("group").agg(F.min("name").alias("least")), "fp-least")
    shared = own.join(least, "group").select("fp", "least")
    return written(nodes.join(shared.hint("merge"), "fp", "left").select("fp", F.coalesce("least", "name").alias("name")), "fp-names")


def near_groups(docs: DataFrame, ngram: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Texts are lower-cased in A-Z and cut into words at 0x09-0x0D and 0x20;
    shingles are ``ngram`` words, or all words where there are fewer. A text
    that is NULL or has no words has fingerprint zero, linked like any other.
    Very long texts are gone through some megabytes at a time.
    ``component_id`` is the smallest doc_id that links and equal fingerprints
    lead to. Rows that repeat are in one component. A NULL doc_id is never a
    component's id: it gets that of the others, or NULL if there are none.
    An empty table gives no rows; other columns are not looked at.
    """
    found = written(fingerprints(docs, ngram), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("name")), "fp-nodes")
    out = found.join(_named(nodes, _linked(nodes, max_bits)).hint("merge"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("name.doc_id").alias("component_id"))


def _sets(docs: DataFrame, ngram: int) -> DataFrame:
    """``fp, grams`` from ``fp, text``: the different shingle hashes of each text in order, eight bytes each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(np.concatenate([h.view("<u8")[:, 0] for h in shingles(t.as_py(), ngram)])).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], ["fp", "grams"])

    return docs.select("fp", F.col("text").cast("binary")).mapInArrow(rows, "fp long, grams binary")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(fp, rep)`` whose sets have this Jaccard similarity or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(j)[i].as_py(), "<u8") for j in (2, 3))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    a, b = sets.select("fp", F.col("grams").alias("a")), sets.select(F.col("fp").alias("rep"), F.col("grams").alias("b"))
    return pairs.join(a, "fp").join(b, "rep").select("fp", "rep", "a", "b").mapInArrow(rows, "fp long, rep long")


def _may_be_alike(similarity: float) -> Column:
    """Whether ``bits`` and ``rep_bits`` differ in as few places as they would at this similarity, but for one case in two thousand."""
    n = BANDS * ROWS
    most = 2 * n * (1 - similarity) + 3.3 * (4 * n * similarity * (1 - similarity) + n * (1 - similarity)) ** 0.5
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("rep_bits", F.lit(i)))) for i in range(n // 16)))
    return differ <= most


def _similar(nodes: DataFrame, groups: DataFrame, texts: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """``groups`` joined further, where texts that share a band have this similarity; ``nodes`` have ``fp, row_key, bands, bits``."""
    own = nodes.join(groups.hint("merge"), "fp", "left").select("fp", "bands", F.coalesce("group", "fp").alias("group"))
    groups = written(own.select("fp", "group"), "fp-groups")
    every = written(own.select("fp", "group", F.explode("bands").alias("band")), "bands")
    shared = every.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("band")
    places = written(every.join(written(shared, "band-keys"), "band").join(nodes.select("fp", "bits"), "fp"), "bands")
    free(every)
    several = 1
    while not places.isEmpty():
        # texts of each key that the others meet, by hash and not by name, so that keys differ in them
        slot = F.pmod(F.xxhash64("band", "fp"), F.lit(several))
        chosen = F.min(F.struct(F.xxhash64("fp", "band").alias("order"), F.col("fp").alias("rep"), F.col("group").alias("rep_group"), F.col("bits").alias("rep_bits"))).alias("x")
        reps = written(places.groupBy("band", slot.alias("slot")).agg(chosen).select("band", "x.rep", "x.rep_group", "x.rep_bits"), "band-reps")
        near = places.join(reps, "band").filter((F.col("group") != F.col("rep_group")) & _may_be_alike(similarity))
        pairs = written(near.select("fp", "rep").distinct(), "band-pairs")
        if not pairs.isEmpty():
            needed = pairs.select("fp").union(pairs.select("rep")).distinct().join(nodes.select("fp", "row_key"), "fp")
            sets = written(_sets(texts.join(needed, "row_key").dropDuplicates(["fp"]), ngram), "shingle-sets")
            found = written(_alike(pairs, sets, similarity), "alike")
            a = found.join(groups.select("fp", F.col("group").alias("a")), "fp")
            edges = written(a.join(groups.select(F.col("fp").alias("rep"), F.col("group").alias("b")), "rep").filter("a <> b").select("a", "b"), "alike-groups")
            more = _joined(groups, edges) if not edges.isEmpty() else groups
            free(sets, found, edges, *([groups] if more is not groups else []))
            groups = more
        # the chosen texts and all that are joined to one of them are through with this key
        now = places.select("fp", "band", "bits").join(groups, "fp")
        through = reps.select("band", "rep").join(groups.select(F.col("fp").alias("rep"), "group"), "rep").select("band", "group").distinct()
        still = written(now.join(through, ["band", "group"], "left_anti"), "bands")
        free(places, reps, pairs)
        places, several = still, several * MORE
    return groups


def keep_one(docs: DataFrame, ngram: int = 5, max_bits: int = 4, similarity: float | None = 0.8) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id, rows with a NULL id last.

    Texts are linked if their fingerprints are, and if they share this part of
    their different shingles; None leaves the second out. Texts of one
    fingerprint count as one there, by the text of the least row. Among rows of
    one id the hash of all columns decides; alike rows stay once. Awkward texts
    are handled as in ``near_groups``.
    """
    keyed = docs.withColumn("row_key", row_key(docs, *docs.columns))
    found = written(_sketches(keyed, ngram), "sketches")
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    nodes = written(found.groupBy("fp").agg(F.min(name).alias("name"), F.min_by(F.struct("bands", "bits"), name).alias("own")), "fp-nodes")
    groups = _linked(nodes, max_bits)
    if similarity is not None:
        groups = _similar(nodes.select("fp", "name.row_key", "own.bands", "own.bits"), groups, keyed.select("row_key", "text"), ngram, similarity)
    kept = _named(nodes.select("fp", "name"), groups).select(F.col("name.row_key").alias("row_key")).distinct()
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*docs.columns)
