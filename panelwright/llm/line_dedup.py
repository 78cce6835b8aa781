"""Line dedup by range-partitioned hashes.

Each distinct line of a document becomes one row ``(hash, document, positions)``.
The rows are range-partitioned by hash, document and position, so that a hash
which many documents share is split over as many tasks as its rows need, and
sorted within each task. A task streams its rows once, holding at most
``min_docs - 1`` of them, and knows at once what to drop - but for a group
that may go on in the task before or after. Of those it passes on a count and
fewer than ``min_docs`` open rows, which a join over two rows a task settles.

The result has no text: each document gets a deflated bitmap of kept lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same, written

_LINES = "h1 long, h2 long, doc_id long, row_key long, positions array<int>"
_FOUND = _LINES + ", kind int, part int, n_docs long"
_DROP, _OPEN, _EDGE = 0, 1, 2


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids, keys, at = [], [], [], []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (t.as_py() for t in batch.column(2)), strict=True):
                where: dict[bytes, list[int]] = {}
                # bytes.lower and bytes.strip change A-Z and 0x09-0x0D, 0x20 only
                for i, line in enumerate(text.lower().split(b"\n")):
                    line = line.strip()
                    if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars):
                        where.setdefault(xxhash.xxh3_128_digest(line), []).append(i)
                digests += where
                at += where.values()
                ids += [doc_id] * len(where)
                keys += [key] * len(where)
            h = np.frombuffer(b"".join(digests), dtype=">i8").astype("i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(at, pa.list_(pa.int32()))],
                ["h1", "h2", "doc_id", "row_key", "positions"],
            )

    return rows


def _stream(first: bool, min_docs: int):
    """Walk over sorted rows of one task; see the module's docstring."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        run, seen, held, at_start = None, 0, [], True

        def close(at_end: bool) -> None:
            if run is None:
                return
            edge = at_start or at_end
            if edge:
                out.append((*run, None, None, None, _EDGE, part, seen))
                out.extend((*run, *row, _OPEN, part, 0) for row in held)

        for batch in _unrepeated(batches):
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            ends = np.r_[starts[1:], len(h1)]
            # a run of one row within the batch is neither frequent nor a repeat, unless a position repeats
            lists = batch.column(4)
            many = np.diff(lists.offsets.to_numpy()) > 1 if first else np.zeros(len(h1), bool)
            alone = (ends - starts == 1) & ~many[starts]
            if min_docs > 1 or first:
                alone[[0, -1]] = False
            else:
                alone[:] = False
            for s, e in zip(starts[~alone], ends[~alone], strict=True):
                key = (int(h1[s]), int(h2[s]))
                if key != run:
                    close(False)
                    at_start = run is None
                    run, seen, held = key, 0, []
                piece = batch.slice(s, e - s)
                for row in zip(*(piece.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    seen += 1
                    if first:
                        if seen == 1:
                            held = [row]
                            if len(row[2]) > 1:
                                out.append((*key, row[0], row[1], row[2][1:], _DROP, part, 0))
                        else:
                            out.append((*key, *row, _DROP, part, 0))
                    elif seen < min_docs:
                        held.append(row)
                    else:
                        out.extend((*key, *r, _DROP, part, 0) for r in (*held, row))
                        held = []
                if len(out) > 50_000:
                    yield _batch(out)
                    out.clear()
            yield _batch(out)
            out.clear()
        close(True)
        yield _batch(out)

    return walk


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64()]
    names = ["h1", "h2", "doc_id", "row_key", "positions", "kind", "part", "n_docs"]
    cols = list(zip(*rows, strict=True)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, lines, drops = (batch.column(i) for i in range(4))
        n_dropped, maps = [], []
        for n, at in zip(lines.to_pylist(), drops.to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[at or []] = False
            n_dropped.append(int(n - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([ids, keys, lines, pa.array(n_dropped, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "row_key", "n_lines", "n_dropped", "keep"])


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row_key"), text.cast("binary").alias("text"))


def keep_bitmaps(docs: DataFrame, mode: str = "first", min_docs: int = 2, min_chars: int = 1) -> DataFrame:
    """Which lines of each document stay: ``doc_id, row_key, n_lines, n_dropped, keep``.

    A line's key is the line stripped of white space, A-Z lower-cased. Keys
    under ``min_chars`` code points always stay.

    mode="first": the first line with a key, by document id and position, stays
    and all later ones go. mode="frequent": keys found in ``min_docs`` documents
    or more lose all their lines.

    ``keep`` is a deflated bitmap, most significant bit first. A NULL or empty
    text is one empty line. Rows of the same id with different texts are
    different documents, told apart by ``row_key``; exact repeats of a row are
    one document and one row here. A NULL id is an id that sorts first. An
    empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    if mode not in ("first", "frequent") or min_docs < 1 or min_chars < 1:
        raise ValueError("mode is first or frequent; min_docs and min_chars are 1 at least")
    docs = _with_key(docs)
    # a table, as ranging looks at its rows twice
    lines = written(docs.select("doc_id", "row_key", "text").mapInArrow(_line_rows(min_chars), _LINES), "line-rows")
    order = ["h1", "h2", "doc_id", "row_key"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(dealt.mapInArrow(_stream(mode == "first", min_docs), _FOUND), "line-runs")
    edges = found.filter(F.col("kind") == _EDGE).groupBy("h1", "h2").agg(F.sum("n_docs").alias("total"), F.min("part").alias("first_part"))
    gone = F.col("part") > F.col("first_part") if mode == "first" else F.col("total") >= min_docs
    settled = found.filter(F.col("kind") == _OPEN).join(edges.hint("merge"), ["h1", "h2"]).filter(gone)
    drops = found.filter(F.col("kind") == _DROP).select("doc_id", "row_key", "positions").unionByName(settled.select("doc_id", "row_key", "positions"))
    drops = drops.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("positions")).alias("drops"))
    breaks = F.length("text") - F.length(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")).cast("binary"))
    counts = docs.select("doc_id", "row_key", (breaks + 1).cast("long").alias("n_lines")).groupBy("doc_id", "row_key").agg(F.max("n_lines").alias("n_lines"))
    both = counts.join(drops, same(counts, drops, "doc_id", "row_key"), "left").select(counts["doc_id"], counts["row_key"], "n_lines", "drops")
    return both.mapInArrow(_bitmaps, "doc_id long, row_key long, n_lines long, n_dropped long, keep binary")


def _unrepeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop exact repeats from rows sorted by hash and document. Repeats are equal in
    every column they are ranged by, so they stand side by side in one task."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(2)
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3)]
        cols += [ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]
        new[0] = tuple(c[0] for c in cols) != last
        last = tuple(c[-1] for c in cols)
        yield batch if new.all() else batch.filter(pa.array(new))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, digest: bool = False) -> DataFrame:
    """Read the kept text back: ``doc_id, n_lines, n_dropped, text`` or, with digest,
    ``kept_sha256`` in place of the text. One row for each row of ``docs``."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, dropped, keep, text in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), (t.as_py() for t in batch.column(4)), strict=True):
                if dropped:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                    text = b"\n".join(line for line, bit in zip(text.split(b"\n"), bits, strict=True) if bit)
                out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_dropped", name])

    name = "kept_sha256" if digest else "text"
    docs = _with_key(docs)
    both = docs.join(bitmaps, same(docs, bitmaps, "doc_id", "row_key")).select(docs["doc_id"], "n_lines", "n_dropped", "keep", "text")
    return both.mapInArrow(kept, f"doc_id long, n_lines long, n_dropped long, {name} string")
