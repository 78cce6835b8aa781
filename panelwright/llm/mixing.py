"""Mixing sources to target weights by Pareto order sampling, with Spark's own functions only.

Each source has a target of words. Its documents get ``target / source size``
copies on average: the whole part as certain copies, the rest as the chance
``p`` of one copy more. Documents are ranked by their Pareto key
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` from a hash of seed, id, text and,
for rows that are alike in these, their number, so that every row is drawn on its
own. The first ones are taken as long as they fit the words that remain. If more
than ``near`` of the target is still open then, the order is gone through again
from there, with the documents that are small enough for what is open, and so
on until the target is near or none is small enough. One closing document, the
one whose size is nearest to the words still open, goes in, too, if it brings
the source nearer to its target.

All documents of a source have the same chance, so within a source the order is
that of ``u`` alone. What fills up and closes favours sizes that fit: chances
are those of the Pareto order but for the documents about the cut.

No source is gathered in one task. The key is mapped to (0, 1) and cut in
``BINS`` x ``BINS`` bins; sums by source and bin, combined before the shuffle,
tell in which coarse and then in which fine bin the words run out. Bins before
it are taken whole; only the rows of that one fine bin are ordered singly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BINS = 4096
#: Alike rows that one task numbers.
ALIKE = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def pareto_key(seed: int, chance: Column) -> Column:
    """Random odds divided by inclusion odds; u has 52 bits of an md5 of seed, id, mark of the text and number among alike rows."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "mark", F.col("no").cast("string"))
    u = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return F.try_divide(u / (F.lit(1.0) - u), chance / (F.lit(1.0) - chance))


def _alike(docs: DataFrame) -> DataFrame:
    """``doc_id, source, mark, size, n``: rows alike in id, source and text are one, counted before the shuffle."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5(F.coalesce("text", F.lit(""))).alias("mark"), size.alias("size"))
    return own.groupBy("doc_id", "source", "mark").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))


def _single(alike: DataFrame) -> DataFrame:
    """A row for each of the alike ones, numbered by ``no`` from 0; many alike ones are numbered in several tasks."""
    few, many = alike.filter(F.col("n") <= ALIKE), alike.filter(F.col("n") > ALIKE)
    starts = many.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ALIKE).cast("long")))).repartition("doc_id", "mark", "start")
    blocks = few.withColumn("start", F.lit(0).cast("long")).unionByName(starts)
    last = F.least(F.col("start") + ALIKE, F.col("n")) - 1
    return blocks.withColumn("no", F.explode(F.sequence("start", last))).drop("start", "n")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_copies: int, share: float = 1.0) -> DataFrame:
    """``source, source_size, target`` from ``source, size``; one row a source, sources as NULL last.

    Sources by code point weigh ``weights`` in turn. Targets share ``share`` of
    all words by weight, no target above ``max_copies`` times its source. The
    excess goes to the others by weight until none is above: with sources in
    order of size / weight, the first k are at their limit, where k is the
    least for which the next one is not above at the level that remains.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the windows below run over one row a source
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (rank % len(weights) + 1).cast("int"))
    limits = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * max_copies)
    full = (F.col("limit").cast("double") / F.col("weight")).alias("full")
    order = Window.orderBy("full", "source")
    ahead, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = limits.withColumn("full", full).select(
        "*",
        F.coalesce(F.sum("limit").over(ahead), F.lit(0)).alias("limit_ahead"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))).alias("weight_left"),
        (F.sum("source_size").over(every) * F.lit(share)).alias("words"),
    )
    level = F.when((F.col("words") - F.col("limit_ahead")) / F.col("weight_left") <= F.col("full"), (F.col("words") - F.col("limit_ahead")) / F.col("weight_left"))
    found = F.first("at_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return levels.withColumn("at_level", level).withColumn("level", found).select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, share: float = 1.0, seed: int = 7, near: float = 0.005) -> DataFrame:
    """How often each document is taken: ``doc_id, source, size, source_size, target, copies, taken``.

    Size is the number of words (runs without white space). Needs ``doc_id,
    text, source``; other columns are not looked at. A NULL text has size 0, a
    NULL source is a source of its own, after all others. Documents of size 0
    get certain copies only. Rows that repeat an id, or have none, are drawn
    each on their own, alike rows too. Two runs agree.
    Texts of any length are counted in place. An empty table gives no rows.
    """
    alike = written(_alike(docs), "mix-sizes")
    targets = source_targets(alike.select("source", (F.col("size") * F.col("n")).alias("size")), weights, max_copies, share)
    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor("ratio").cast("long")
    plan = written(
        targets.withColumn("ratio", ratio).withColumn("whole", whole).withColumn("chance", F.col("ratio") - F.col("whole")).withColumn("open", F.col("target") - (F.col("source_size") * F.col("whole")).cast("double")),
        "mix-plan",
    )
    # both sides hash by source; a hot source is split by AQE, as every row is handled on its own
    by = plan.withColumnRenamed("source", "plan_source")
    keyed = _single(alike).join(by, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source", "open", "ratio")
    keyed = keyed.withColumn("key", pareto_key(seed, F.col("chance")))
    fine = F.least(F.floor(F.col("key") / (F.col("key") + 1.0) * float(BINS * BINS)), F.lit(BINS * BINS - 1)).cast("long")
    able = (F.col("size") > 0) & F.col("key").isNotNull()
    place = F.struct(fine.alias("fine"), "key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "size")
    keyed = written(keyed.withColumn("place", F.when(able, place)).drop("key", "chance", "mark", "no"), "mix-keyed")
    rounds = _rounds(keyed.filter("place IS NOT NULL").select("source", "size", "place"), plan.select("source", "target", "open"), near)
    return _taken(keyed, rounds)


def _cut(rows: DataFrame, bins: str, room: DataFrame) -> DataFrame:
    """For each source: the bin in which its words run out, NULL if all fit, and the words open before it."""
    sums = rows.groupBy("source", bins).agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy(bins).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    room = room.withColumnRenamed("source", "room_source")
    sums = sums.withColumn("upto", running).join(room, F.col("source").eqNullSafe(F.col("room_source")))
    over = F.when(F.col("upto") > F.col("open"), F.struct(F.col(bins).alias("bin"), (F.col("open") - (F.col("upto") - F.col("words"))).alias("left")))
    found = sums.groupBy("source").agg(F.min(over).alias("x"), (F.first("open") - F.sum("words")).alias("rest"))
    return written(found.select("source", F.col("x.bin").alias("cut_bin"), F.coalesce("x.left", "rest").alias("left")), f"mix-{bins}")


def _in_bin(rows: DataFrame, bins: str, cut: DataFrame) -> DataFrame:
    cut = cut.withColumnRenamed("source", "cut_source")
    return rows.join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col(bins) == F.col("cut_bin"))).drop("cut_source")


def _prefix(rows: DataFrame, room: DataFrame) -> DataFrame:
    """``source, upto, gap``: the place up to which the rows of each source fit its room, and what is open then."""
    rows = rows.withColumn("fine", F.col("place.fine")).withColumn("coarse", F.floor(F.col("fine") / BINS))
    coarse = _cut(rows, "coarse", room)
    fine = _cut(_in_bin(rows, "coarse", coarse).select("source", "fine", "size"), "fine", coarse.select("source", F.col("left").alias("open")))
    # some 1 / BINS^2 of a source's rows; rows of one place count together
    words = F.sum("size").over(Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = _in_bin(rows, "fine", fine).withColumn("words", words)
    fits = F.col("words") <= F.col("left")
    before = F.struct(F.first("cut_bin").alias("fine"), F.lit(-1.0).alias("key"), F.lit(-(2**63)).alias("id"), F.lit(0).cast("long").alias("size"))
    inner = last.groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.col("place"))), before).alias("upto"), (F.first("left") - F.coalesce(F.max(F.when(fits, F.col("words"))), F.lit(0))).alias("gap"))
    end = F.struct(F.lit(BINS * BINS).cast("long").alias("fine"), F.lit(0.0).alias("key"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("size"))
    return inner.unionByName(coarse.filter("cut_bin IS NULL").select("source", end.alias("upto"), F.col("left").alias("gap")))


def _rounds(able: DataFrame, room: DataFrame, near: float) -> DataFrame:
    """``source, rounds, gap``: which stretches of the Pareto order are taken, up to which size, and what stays open."""
    first = F.struct(F.lit(-1).cast("long").alias("fine"), F.lit(0.0).alias("key"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("size"))
    now = room.withColumn("after", first).withColumn("most", F.lit(float("inf")))
    found = None
    while True:
        by = now.select(F.col("source").alias("s"), "after", "most")
        rows = able.join(by, able["source"].eqNullSafe(by["s"])).filter((F.col("place") > F.col("after")) & (F.col("size") <= F.col("most"))).select("source", "size", "place")
        got = _prefix(rows, now.select("source", "open")).select(F.col("source").alias("s"), "upto", "gap")
        done = written(now.join(got, now["source"].eqNullSafe(got["s"])).filter((F.col("gap") < F.col("open")) | (F.col("most") == float("inf"))).select("source", "target", "after", "most", "upto", "gap"), "mix-round")
        found = done if found is None else found.unionByName(done)
        now = done.filter(F.col("gap") > F.col("target") * near).select("source", "target", F.col("gap").alias("open"), F.col("upto").alias("after"), F.col("gap").alias("most"))
        if now.isEmpty():
            break
    stretches = F.collect_list(F.struct("after", "upto", "most"))  # as many as there are rounds
    return written(found.groupBy("source").agg(stretches.alias("rounds"), F.min("gap").alias("gap")), "mix-rounds")


def _taken(keyed: DataFrame, rounds: DataFrame) -> DataFrame:
    by = rounds.withColumnRenamed("source", "s")
    rows = keyed.join(by, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = F.exists("rounds", lambda r: (F.col("place") > r["after"]) & (F.col("place") <= r["upto"]) & (F.col("size") <= r["most"]))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(False)))
    off = F.abs(F.col("size") - F.col("gap"))
    close = rows.filter(F.col("place").isNotNull() & ~F.col("inside") & (off < F.col("gap"))).groupBy(F.col("source").alias("s")).agg(F.min(F.struct(off.alias("off"), "place")).alias("closing"))
    rows = rows.join(written(close, "mix-closing"), F.col("source").eqNullSafe(F.col("s")), "left")
    closing = ~F.col("inside") & F.coalesce(F.col("place") == F.col("closing.place"), F.lit(False))
    copies = F.col("whole") + (F.col("inside") | closing).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
