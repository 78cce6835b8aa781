"""Token ids, packed into rows of one length by best-fit decreasing.

Texts become token ids, documents longer than a row are split losslessly into
full rows and a rest, and pieces are placed into the fullest row that still
has room, largest pieces first. Rows with room are found by a search in a
segment tree over capacities. Documents are dealt to tasks by a hash of id and text and
packed in lots of ``lot_tokens``, so a task holds one lot, whatever comes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import parts

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: What ``\\s`` of the pattern stands for (fixed values).
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters of a text that the pattern sees at a time, and of white space that it need not see at all.
PIECE, RUN = 1 << 16, 1 << 12
_RUN, _BLANKS, _EDGE = re.compile(f"[{SPACES}]{{{RUN},}}"), re.compile(f"[{SPACES}]*"), re.compile(f"(?<=[^{SPACES}])[{SPACES}]")


def cut(text: str) -> Iterator[tuple[str, bool]]:
    """The text in pieces that have the same tokens alone as together; True marks those that are one match of the pattern.

    No match has white space after another character, so every such place is
    between two. A long run of white space is one match but for its last
    character, if more text follows, and would take the pattern's engine too
    deep. A text without white space is one piece, whatever its length.
    """
    at = 0
    while len(text) - at > PIECE:
        run = _RUN.search(text, at, at + 2 * PIECE)
        if run and run.start() == at:
            end = _BLANKS.match(text, at).end()
            end -= end < len(text)
            yield text[at:end], True
            at = end
            continue
        edge = _EDGE.search(text, at + PIECE)
        end = edge.start() if edge else len(text)
        if run and run.start() <= end:
            end = run.start()
        yield text[at:end], False
        at = end
    yield text[at:], False


def rank_encoder(data: bytes) -> Callable[[str], np.ndarray]:
    """Encoder of a file of byte-level BPE ranks, one base64 token and its id a line; whole texts, some pieces at a time."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        found = [np.array(encoding._encode_single_piece(piece) if whole else encoding.encode_ordinary(piece), "<u4") for piece, whole in cut(text)]
        return np.concatenate(found)

    return encode


class Room:
    """Segment tree over capacities 0..size: how many open rows have each, and the least one that is enough."""

    def __init__(self, size: int):
        self.width = 1 << max(1, size.bit_length())
        self.total = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(self.width)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.width
        while i:
            self.total[i] += n
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least capacity of ``need`` at least, and that capacity."""
        i = need + self.width
        while not self.total[i]:
            while i & 1:  # right children: up until there is a right sibling
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.width:
            i *= 2
            i += not self.total[i]
        capacity = i - self.width
        self._add(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows as lists of piece numbers; pieces by falling length, ties by number."""
    rows: list[list[int]] = []
    room = Room(size)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[i])
        if found is None:
            found = len(rows), size
            rows.append([])
        rows[found[0]].append(i)
        if found[1] > lengths[i]:
            room.put(found[1] - lengths[i], found[0])
    return rows


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int | None = 50256) -> DataFrame:
    """``doc_id, ids`` with little-endian 32-bit ids, ``end_id`` after each text if it is not None.

    A NULL or empty text has the end token only, or no tokens. A text of any
    length is tokenised in pieces, with the tokens of the whole. The
    tokenizer's file has a fixed size and is sent to the executors once.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = rank_encoder(data.value)
        for batch in batches:
            for part, texts in parts(batch, 1):
                ids = [tokens(t or "").tobytes() + tail.tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(ids)), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, ids binary")


PACKED = "pack_id string, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary, position_ids binary, ids_sha256 string"
_TYPES = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.string()]


def pack(encoded: DataFrame, row_tokens: int = 2048, lot_tokens: int = 1 << 22, pad_id: int = 50256) -> DataFrame:
    """Packed rows of ``row_tokens`` ids each, one DataFrame row a row.

    ``cu_seqlens`` are the cumulative lengths of the segments from 0, and
    ``position_resets`` the places where positions start anew;
    ``doc_ids`` and ``doc_starts`` say which document each segment is of, and at
    which of its tokens it starts. ``input_ids`` and ``position_ids`` are
    little-endian 32-bit and 16-bit numbers, padded with ``pad_id`` and 0 after
    ``n_tokens``. Documents without tokens are in no row. A repeated row is
    packed as often as it occurs; NULL ids are kept as NULL.
    """
    if not 1 < row_tokens <= 1 << 16:
        raise ValueError("row_tokens is between 2 and 65536")
    dealt = encoded.withColumn("deal", F.xxhash64("doc_id", "ids")).repartition("deal").sortWithinPartitions("deal", "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, held, name, lots = [], 0, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, raw, deal = (batch.column(j)[i].as_py() for j in range(3))
                ids = np.frombuffer(raw, "<u4")
                for at in range(0, len(ids), lot_tokens):  # a document longer than a lot is handed on in lots
                    piece = ids[at : at + lot_tokens]
                    if held and held + len(piece) > lot_tokens:
                        yield from _packed(lot, name, row_tokens, pad_id)
                        lot, held, lots = [], 0, lots + 1
                    if not lot:
                        name = f"{deal & (1 << 64) - 1:016x}-{doc_id}-{lots}"
                    lot.append((doc_id, at, piece))
                    held += len(piece)
        if lot:
            yield from _packed(lot, name, row_tokens, pad_id)

    return dealt.select("doc_id", "ids", "deal").mapInArrow(rows, PACKED)


def _packed(lot: list[tuple], name: str, size: int, pad_id: int) -> Iterator[pa.RecordBatch]:
    """The lot's documents in pieces, its rows in batches."""
    pieces = [(doc, start + at, ids[at : at + size]) for doc, start, ids in lot for at in range(0, len(ids), size)]
    out = []
    for n, row in enumerate(best_fit([len(p[2]) for p in pieces], size)):
        own = [pieces[i] for i in row]
        cuts = np.r_[0, np.cumsum([len(p[2]) for p in own])].astype("<i4")
        ids = np.full(size, pad_id, "<u4")
        ids[: cuts[-1]] = np.concatenate([p[2] for p in own])
        places = np.zeros(size, "<u2")
        places[: cuts[-1]] = np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))
        raw = ids.tobytes()
        out.append((f"{name}-{n}", int(cuts[-1]), [p[0] for p in own], [p[1] for p in own], cuts, cuts[:-1], raw, places.tobytes(), hashlib.sha256(raw).hexdigest()))
        if len(out) == 512:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [f.split()[0] for f in PACKED.split(", ")])


def unpack(packed: DataFrame) -> DataFrame:
    """The documents again: ``doc_id, start, ids``, one row a segment, for round trips."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at, out = [], [], []
            for ids, starts, cuts, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                docs += ids
                at += starts
                out += [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "start", "ids"])

    return packed.select("doc_ids", "doc_starts", "cu_seqlens", "input_ids").mapInArrow(rows, "doc_id long, start long, ids binary")
