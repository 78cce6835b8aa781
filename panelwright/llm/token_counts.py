"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The tokenizer is byte-pair encoding of words with word ends. For each prefix
of a word the last token of its encoding is the only token that ends there, is
its own encoding, and stands behind the last token of the prefix before it as
these two would be encoded together. So one walk over the word, with a look
back no longer than a token, gives the counts of all its prefixes, both open
(the word goes on) and closed (the word ends here); nothing is encoded twice.

A text's counts are kept as differences from one code point to the next, in
compressed blocks with the count before the block and the least one in it:
how many tokens a prefix has, and the longest prefix within a budget, are read
from one block.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import batched
from operator import sub
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grams import parts

NAME = "word_bpe_49k.json"
#: Words of the tokenizer's pattern, and white space between them (fixed values).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\s+")
#: Words that are two words as long as their last letter is missing (fixed values).
LATE = {"'re", "'ve", "'ll"}
END = "</w>"
#: Code points that are looked at together, those of a block of counts, and words that are kept by a task.
SEGMENT, SPAN, WORDS = 1 << 16, 1 << 15, 1 << 19
_BLANK, _EDGE = regex.compile(r"\s"), regex.compile(r"(?<=\S)\s")


def default_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def tables(data: bytes) -> dict:
    """Plain tables of a tokenizer's file: merges, special strings, and tokens by their bytes from the last one on.

    ``walk`` has the next node for a node and a byte, ``open`` and ``closed``
    the token that ends at a node. Tokens that no encoding has are left out.
    """
    file, letter = json.loads(data), byte_letters()
    vocab = file["model"]["vocab"]
    merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])}
    out = {"merges": {pair: rank for pair, (rank, _) in merges.items()}, "parts": {t: (*pair, rank) for pair, (rank, t) in merges.items()}, "special": [t["content"] for t in file["added_tokens"]]}
    walk: dict[int, int] = {}
    ends, seams, longest = [(-1, -1)], Seams(out), 0
    for token, i in vocab.items():
        if i in out["parts"] and not seams.whole(i):
            continue
        s, closed = bytes(letter[c] for c in token.removesuffix(END)), token.endswith(END)
        node, longest = 0, max(longest, len(s))
        for byte in reversed(s):
            node = walk.setdefault(node << 8 | byte, len(ends))
            if node == len(ends):
                ends.append((-1, -1))
        ends[node] = (ends[node][0], i) if closed else (i, ends[node][1])
    return out | {"walk": walk, "open": [e[0] for e in ends], "closed": [e[1] for e in ends], "longest": longest}


class Seams:
    """Which tokens can stand next to each other.

    Merges go by rank, and a token's parts have smaller ranks than it. So two
    tokens next to each other stay apart if no token at the end of the first
    and at the start of the second, at any depth, would be merged before one
    of them goes into the token that it is a part of; of equal ranks the one
    further left comes first.
    """

    def __init__(self, tables: dict):
        self.merges, self.parts = tables["merges"], tables["parts"]
        self.edges: tuple[dict, dict] = ({}, {})
        self.good: dict[int, bool] = {}

    def _edge(self, t: int, left: int) -> list[tuple[int, float]]:
        """Tokens at an edge of t, the outermost last, each with the rank at which it goes."""
        found = self.edges[left].get(t)
        if found is None:
            found, goes, node = [], float("inf"), t
            while True:
                found.append((node, goes))
                if node not in self.parts:
                    break
                goes, node = self.parts[node][2], self.parts[node][0 if left else 1]
            self.edges[left][t] = found
        return found

    def crossed(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        for x, x_goes in self._edge(a, 0):
            for y, y_goes in self._edge(b, 1):
                rank = self.merges.get((x, y))
                if rank is not None and rank < x_goes and rank <= y_goes:
                    yield x, y

    def apart(self, a: int, b: int) -> bool:
        return next(self.crossed(a, b), None) is None

    def whole(self, t: int) -> bool:
        """Whether a token's bytes are merged into it."""
        if t not in self.parts:
            return True
        if t not in self.good:
            a, b, _ = self.parts[t]
            self.good[t] = self.whole(a) and self.whole(b) and set(self.crossed(a, b)) == {(a, b)}
        return self.good[t]


class Prefixes:
    """Counts of all prefixes of a word."""

    def __init__(self, tables: dict):
        self.tables, self.longest, self.seams = tables, tables["longest"], Seams(tables)
        self.pairs: dict[int, bool] = {}

    def _pair(self, a: int, b: int) -> bool:
        if len(self.pairs) > 1 << 20:
            self.pairs.clear()
        found = self.pairs[a << 20 | b] = self.seams.apart(a, b)
        return found

    def closed_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of 1, 2, ... code points, as a word of its own."""
        data, step, opens, closeds, known = word.encode(), self.tables["walk"].get, self.tables["open"], self.tables["closed"], self.pairs
        n, out = len(data), []
        last, count, base = [-1], [0], 0
        for i in range(1, n + 1):
            node, to, counted = 0, -1, i < n and data[i] & 0xC0 == 0x80
            for j in range(i - 1, -1, -1):
                node = step(node << 8 | data[j])
                if node is None:
                    break
                t = opens[node]
                if t >= 0 > to and (not j or (known[k] if (k := last[j - base] << 20 | t) in known else self._pair(last[j - base], t))):
                    to, ahead = t, count[j - base] + 1
                    if counted:
                        break
                if not counted:
                    t = closeds[node]
                    if t >= 0 and (not j or (known[k] if (k := last[j - base] << 20 | t) in known else self._pair(last[j - base], t))):
                        counted = True
                        out.append(count[j - base] + 1)
                        if to >= 0:
                            break
            if to < 0 or not counted:
                raise ValueError(f"no token ends at byte {i}")
            last.append(to)
            count.append(ahead)
            if len(last) > SPAN + self.longest:  # no token reaches further back
                drop = len(last) - self.longest - 1
                last, count, base = last[drop:], count[drop:], base + drop
        return out

    def differences(self, word: str) -> bytes:
        """What each code point of a word of the pattern adds to the count, 16 bits each; white space adds nothing."""
        if _BLANK.match(word):
            return bytes(2 * len(word))
        counts = self.closed_counts(word)
        if word in LATE:
            counts[1] = self.closed_counts(word[0])[-1] + self.closed_counts(word[1])[-1]
        return pack(f"<{len(counts)}h", counts[0], *map(sub, counts[1:], counts))


class _Kept(dict):
    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        found = self.make(word)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = found
        return found


def lower(s: str) -> str:
    """Lower case letter by letter, so that a sigma does not look at what stands around it."""
    return s.replace("Σ", "σ").lower()


def joiners() -> set[str]:
    """Code points that may become one with what stands before them: second parts of compositions, vowels and final consonants of Hangul."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d:
            out.add(chr(int(d.split()[-1], 16)))
    return out


class Counter:
    """Differences of the counts of all prefixes of whole texts."""

    def __init__(self, tables: dict):
        self.kept = _Kept(Prefixes(tables).differences)
        self.special = regex.compile("|".join(map(regex.escape, sorted(tables["special"], key=len, reverse=True)))) if tables["special"] else None
        self.joiners: set[str] | None = None

    def _words(self, s: str) -> bytes:
        if len(s) <= 4 * SEGMENT:
            return b"".join(map(self.kept.__getitem__, PIECES.findall(s)))
        return b"".join(b"".join(self.kept[m.group()] for m in some) for some in batched(PIECES.finditer(s), 1 << 16))

    def _segment(self, s: str) -> bytes:
        if s.isascii():
            return self._words(s.lower())
        low = lower(s)
        if len(low) == len(s) and unicodedata.is_normalized("NFC", s):
            return self._words(low)
        if self.joiners is None:
            self.joiners = joiners()
        starts = [i for i, c in enumerate(s) if not i or not (unicodedata.combining(c) or c in self.joiners)]
        own = [s[a:b] for a, b in zip(starts, [*starts[1:], len(s)], strict=True)]
        normal = [lower(unicodedata.normalize("NFC", x)) for x in own]
        found = np.frombuffer(self._words("".join(normal)), "<i2")
        ends = np.cumsum([len(x) for x in normal])
        out = np.zeros(len(s), "<i2")
        for x, y, start, end in zip(own, normal, starts, ends.tolist(), strict=True):
            if len(x) == len(y) and unicodedata.is_normalized("NFC", x):
                out[start : start + len(x)] = found[end - len(y) : end]
            else:
                out[start + len(x) - 1] = found[end - len(y) : end].sum()
        return out.tobytes()

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        while end - start > SEGMENT:
            m = _EDGE.search(text, start + SEGMENT, end)
            to = m.start() if m else end
            yield self._segment(text[start:to])
            start = to
        if end > start:
            yield self._segment(text[start:end])

    def differences(self, text: str) -> Iterator[bytes]:
        """The text's differences, some at a time. A special string is one token, its prefixes are plain text."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            before = 0
            for found in self._plain(text, at, m.start()):
                before += int(np.frombuffer(found, "<i2").sum(dtype=np.int64))
            total = 0
            for found in self._plain(text, at, m.end() - 1):
                total += int(np.frombuffer(found, "<i2").sum(dtype=np.int64))
                yield found
            yield np.array([before + 1 - total], "<i2").tobytes()
            at = m.end()
        yield from self._plain(text, at, len(text))


def _block(first: int, raw: bytes) -> tuple[dict, int]:
    counts = first + np.cumsum(np.frombuffer(raw, "<i2"), dtype=np.int64)
    return {"first": first, "low": int(counts.min()), "diffs": zlib.compress(raw, 1)}, int(counts[-1])


BLOCKS = "array<struct<first:long,low:long,diffs:binary>>"
_BLOCKS = pa.list_(pa.struct([("first", pa.int64()), ("low", pa.int64()), ("diffs", pa.binary())]))


def prefix_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_chars, n_tokens, blocks``, one row for each row of ``docs``.

    ``blocks`` has the exact number of tokens of every prefix of the text, by
    code points; ``n_tokens`` is that of the whole text, read from the last
    block. Needs ``doc_id, text``; other columns are not looked at. A NULL
    text counts as empty: no tokens, no blocks. Texts of any length are gone
    through in pieces. Special strings in texts are one token, none are added.
    Where normalisation joins or reorders code points, cuts between these show
    the count at their start. ``tokenizer`` is the path of the vocabulary file,
    of fixed size, which goes to the executors once.
    """
    with open(tokenizer or default_path(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(tables(f.read()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # a worker keeps it, and with it the words that it has seen
        counter = held.setdefault("counter", None) or held.update(counter=Counter(held)) or held["counter"]
        for batch in batches:
            for part, texts in parts(batch, 1):
                chars, totals, found = [], [], []
                for text in texts:
                    own, total, held = [], 0, bytearray()
                    for some in counter.differences(text or ""):
                        held += some
                        while len(held) >= 4 * SPAN:
                            block, total = _block(total, bytes(held[: 2 * SPAN]))
                            own.append(block)
                            del held[: 2 * SPAN]
                    for at in range(0, len(held), 2 * SPAN):
                        block, total = _block(total, bytes(held[at : at + 2 * SPAN]))
                        own.append(block)
                    chars.append(len(text or ""))
                    totals.append(total)
                    found.append(own)
                own = batch.slice(part.start, len(texts))
                size = pc.fill_null(pc.cast(pc.binary_length(own.column(1)), pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([own.column(0), size, pa.array(chars, pa.int64()), pa.array(totals, pa.int64()), pa.array(found, _BLOCKS)], ["doc_id", "n_bytes", "n_chars", "n_tokens", "blocks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, f"doc_id long, n_bytes long, n_chars long, n_tokens long, blocks {BLOCKS}")


def counts_at(table: DataFrame, position: Column) -> DataFrame:
    """``doc_id, position, n_tokens``: tokens of the prefix of ``position`` code points, from ``prefix_counts``; beyond the text's end those of the whole, NULL below 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, chars, total, blocks in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if at is None or at < 0:
                    out.append(None)
                elif at == 0 or at >= chars:
                    out.append(total if at else 0)
                else:
                    b = blocks[(at - 1) // SPAN]
                    out.append(b["first"] + int(np.frombuffer(zlib.decompress(b["diffs"]), "<i2")[: (at - 1) % SPAN + 1].sum(dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["doc_id", "position", "n_tokens"])

    return table.select("doc_id", position.cast("long").alias("position"), "n_chars", "n_tokens", "blocks").mapInArrow(rows, "doc_id long, position long, n_tokens long")


def cut_at_budget(table: DataFrame, budget: int) -> DataFrame:
    """``doc_id, position, n_tokens``: the longest prefix of each text with at most ``budget`` tokens, from ``prefix_counts``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, counts = [], []
            for blocks in batch.column(1).to_pylist():
                at, n = 0, 0
                for i in range(len(blocks) - 1, -1, -1):
                    if blocks[i]["low"] <= budget:
                        own = blocks[i]["first"] + np.cumsum(np.frombuffer(zlib.decompress(blocks[i]["diffs"]), "<i2"), dtype=np.int64)
                        place = int(np.flatnonzero(own <= budget)[-1])
                        at, n = i * SPAN + place + 1, int(own[place])
                        break
                cuts.append(at)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "position", "n_tokens"])

    return table.select("doc_id", "blocks").mapInArrow(rows, "doc_id long, position long, n_tokens long")
