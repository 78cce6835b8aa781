"""Records of CSV files whose cells may hold line breaks, found without a whole file in one task.

Spark deals a file out in chunks of lines. Whether a chunk starts inside a
quoted cell depends on all that stands before it, so the first pass finds, for
each chunk, in which state it ends if it starts outside of quotes and if it
starts inside. These are functions of two states; composing them along a file
is a window over one row a chunk. With the states known, each chunk parses the
records that begin and end in it. What is left at chunks' edges is put together
by record, which moves those pieces alone.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Records that a task holds at once, and lines in which a header has to be complete.
LOT, HEAD = 4096, 256


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell; only quotes at a cell's start open one, and doubled ones inside are text."""
    at = 0
    if not inside:
        if line[:1] == '"':
            at = 1
        else:
            at = line.find(',"') + 2
            if at == 1:
                return False
    while True:
        at = line.find('"', at) + 1
        if not at:
            return True
        if line[at : at + 1] == '"':
            at += 1
            continue
        at = line.find(',"', at) + 2
        if at == 1:
            return False


@dataclass(frozen=True)
class Layout:
    """Header names and how many lines stand before the first record of each file."""

    names: tuple[str, ...]
    skip: int


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _named(cells: Sequence[str]) -> tuple[str, ...]:
    """Header cells as they are; empty ones by place, repeated ones with a number."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name, n = cell or f"Unnamed: {i}", 0
        while (name if not n else f"{name}.{n}") in out:
            n += 1
        out.append(name if not n else f"{name}.{n}")
    return tuple(out)


def layout(spark: SparkSession, path: str, fits: Callable[[list[str]], bool] = lambda cells: True, within: int = 1) -> Layout | None:
    """The header is the record that starts in one of the first ``within`` lines (of the first file that Spark lists) and ``fits``; it has to be in the file's first chunk."""
    head = [r.value.removesuffix("\r") for r in _lines(spark, path).filter("start = 0").select("value").head(HEAD)]
    if head:
        head[0] = head[0].removeprefix("\ufeff")
    for i in range(min(within, len(head))):
        n, inside = i, False
        while n < len(head):
            inside = ends_inside(head[n], inside)
            n += 1
            if not inside:
                break
        if not inside and head[i].strip() and fits(cells := next(csv.reader(iter(x + "\n" for x in head[i:n])))):
            return Layout(_named(cells), n)
    return None


def _chunks(batches: Iterator[pa.RecordBatch], skip: int) -> Iterator[tuple[str, int, Iterator[list[str]]]]:
    """Chunks in a partition with their lines, some at a time; the lines before a file's first record are left out."""
    state: dict = {"batch": None, "at": 0}

    def fill() -> bool:
        while state["batch"] is None or state["at"] >= state["batch"].num_rows:
            state["batch"], state["at"] = next(batches, None), 0
            if state["batch"] is None:
                return False
        return True

    def own(key: tuple[str, int]) -> Iterator[list[str]]:
        left = skip if key[1] == 0 else 0
        while fill():
            batch, at = state["batch"].slice(state["at"]), state["at"]
            alike = pc.and_(pc.equal(batch.column(1), key[0]), pc.equal(batch.column(2), key[1]))
            n = pc.index(alike, False).as_py()
            n = batch.num_rows if n < 0 else n
            if not n:
                return
            state["at"] = at + n
            some = batch.column(0).slice(0, n).to_pylist()
            drop, left = min(left, n), left - min(left, n)
            if some[drop:]:
                yield some[drop:]

    while fill():
        key = state["batch"].column(1)[state["at"]].as_py(), state["batch"].column(2)[state["at"]].as_py()
        lines = own(key)
        yield *key, lines
        for _ in lines:  # what the reader left
            pass


def _states(skip: int):
    """Rows (file, start, from_out, from_in, closes): the state at a chunk's end by that at its start; whether it leaves the quotes it starts in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, lots in _chunks(batches, skip):
            out, inside, closes = False, True, False
            for lines in lots:
                for line in lines:
                    if '"' in line:
                        out, inside = ends_inside(line, out), ends_inside(line, inside)
                        closes = closes or not inside
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "from_out": out, "from_in": inside, "closes": closes}])

    return run


def chunk_states(lines: DataFrame, skip: int) -> DataFrame:
    """``file, start, inside, ends, record, last``: whether a chunk starts and ends inside a cell, in which chunk that cell's record began, and whether it is the file's last."""
    found = lines.mapInArrow(_states(skip), "file string, start long, from_out boolean, from_in boolean, closes boolean")
    order = Window.partitionBy("file").orderBy("start")  # one row a chunk
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col("from_out") & ~F.col("from_in")
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "turned"))
    found = found.withColumn("turned", F.coalesce(F.sum(turns.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    last = F.coalesce(F.last(fixed, ignorenulls=True).over(before), F.struct(F.lit(False).alias("from_out"), F.lit(0).cast("long").alias("turned")))
    found = found.withColumns({"last": last, "ahead": F.coalesce(F.lag("turned").over(order), F.lit(0))})
    inside = F.col("last.from_out") != ((F.col("ahead") - F.col("last.turned")) % 2 == 1)
    found = found.withColumn("inside", inside).withColumn("ends", F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")))
    opens = F.when(F.col("ends") & (~F.col("inside") | F.col("closes")), F.col("start"))
    return found.select("file", "start", "inside", "ends", F.last(opens, ignorenulls=True).over(before).alias("record"), F.lead("start").over(order).isNull().alias("last"))


def _pieces(lots: Iterator[list[str]], inside: bool) -> Iterator[tuple[str, list[str]]]:
    """("head", lines) before the first record, ("whole", lines) of complete records, ("tail", lines) of one that does not end here."""
    held: list[str] = []
    first = inside
    for lines in lots:
        done: list[str] = []
        for line in lines:
            if '"' in line:
                inside = ends_inside(line, inside)
            held.append(line)
            if not inside:
                if first:
                    yield "head", held
                    first = False
                else:
                    done += held
                held = []
        if done:
            yield "whole", done
    if held:
        yield "head" if first else "tail", held


def _cells(names: tuple[str, ...], lines: Iterator[str]) -> Iterator[pa.RecordBatch]:
    """Parsed records; blank lines are none, missing cells are NULL, and a record with more cells than names is an error."""
    rows: list[list[str | None]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], [f"c{i}" for i in range(len(names))])

    csv.field_size_limit((1 << 31) - 1)
    for row in csv.reader(lines):
        if len(row) > len(names):
            if any(row[len(names) :]):
                raise ValueError(f"a record has {len(row)} cells, its header {len(names)}: {row[:3]}...")
            row = row[: len(names)]
        if not row or len(row) == 1 < len(names) and not row[0].strip():
            continue
        rows.append(row + [None] * (len(names) - len(row)))
        if len(rows) == LOT:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def _schema(names: Sequence[str]) -> str:
    return ", ".join(f"c{i} string" for i in range(len(names)))


def _parsed(lines: list[str]) -> Iterator[str]:
    """Lines as the parser takes them: only those that end inside a cell keep a carriage return, others may have one for a line break."""
    inside = False
    for line in lines:
        inside = ends_inside(line, inside) if '"' in line else inside
        if inside:
            yield line + "\n"
        elif "\r" in line and '"' not in line:
            yield from (x + "\n" for x in line.split("\r"))
        else:
            yield line.removesuffix("\r") + "\n"


def _whole(lay: Layout, starts: dict[tuple[str, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, lots in _chunks(batches, lay.skip):
            yield from _cells(lay.names, (x for kind, lines in _pieces(lots, (file, start) in starts) if kind == "whole" for x in _parsed(lines)))

    return run


def _edges(skip: int, starts: dict[tuple[str, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, lots in _chunks(batches, skip):
            for kind, lines in _pieces(lots, (file, start) in starts):
                if kind != "whole":
                    yield pa.RecordBatch.from_pylist([{"file": file, "record": starts[file, start] if kind == "head" else start, "start": start, "text": "\n".join(lines)}])

    return run


def _joined(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield from _cells(names, _parsed(text.split("\n")))

    return run


def read_records(spark: SparkSession, path: str, lay: Layout) -> DataFrame:
    """All records behind the headers of the files at ``path``; every cell text, missing ones NULL.

    One pass finds how chunks start; only those that start inside a cell are
    listed. A file that ends inside a cell is an error.
    """
    states = chunk_states(_lines(spark, path), lay.skip).filter("inside OR ends").persist()
    try:
        if broken := states.filter("ends AND last").first():
            raise ValueError(f"{broken.file} ends inside a quoted cell")
        starts = {(r.file, r.start): r.record for r in states.filter("inside").collect()}  # chunks whose first line is in the middle of a cell
    finally:
        states.unpersist()
    lines = _lines(spark, path)
    out = lines.mapInArrow(_whole(lay, starts), _schema(lay.names))
    if starts:
        parts = lines.mapInArrow(_edges(lay.skip, starts), "file string, record long, start long, text string")
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n")
        whole = parts.groupBy("file", "record").agg(text.alias("text"))  # the pieces of one record
        out = out.unionByName(whole.select("text").mapInArrow(_joined(lay.names), _schema(lay.names)))
    return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(lay.names)))

