"""Train, validation and test labels beside the rows. Only cutoffs and counts reach the driver."""

from __future__ import annotations


from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..sources.sinks import kept
from .clean import drop_missing_target
from .numbers import numbered_rows
from .schema import quoted, strict_year
from .stats import running_counts


#: Bins in which the cut of a random split is looked for, twice.
BINS = 4096


def _info(df: DataFrame) -> DataFrame:
    """Rows by label, as a one-row table."""
    return df.agg(*(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")))


def _reaching(counts: DataFrame, by: str, room: DataFrame) -> DataFrame:
    """One row: the first value of ``by`` at which running counts reach what is wanted, and what is wanted within it."""
    running = F.sum("n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # BINS rows at most
    over = counts.withColumn("upto", running).crossJoin(F.broadcast(room)).filter(F.col("upto") >= F.col("want"))  # one row
    return over.agg(F.min(F.struct(by, (F.col("want") - F.col("upto") + F.col("n")).alias("want"))).alias("x")).select(F.col(f"x.{by}").alias("cut"), F.col("x.want").alias("want"))


def random_split(df: DataFrame, key: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Exactly ``ceil(test_share * n)`` test rows, those with the smallest hashes of seed and key.

    The cut is one number, found by counts over BINS bins, over BINS bins of
    the one in which it lies, and over the values of the one in which it lies
    there; rows are only compared with it. Rows whose keys are equal go to one
    side, so keys should be unique.
    """
    if not 0 < test_share < 1:
        raise ValueError("test_share is between 0 and 1")
    u = uniform(seed, *key)
    fine = F.floor(u * float(BINS * BINS))
    bins = df.select(u.alias("u"), fine.alias("fine"), F.floor(fine / BINS).alias("coarse"))
    coarse = bins.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))
    first = _reaching(coarse, "coarse", coarse.agg(F.ceil(F.lit(test_share) * F.sum("n")).alias("want")))
    inner = bins.join(F.broadcast(first), F.col("coarse") == F.col("cut")).groupBy("fine").agg(F.count(F.lit(1)).alias("n"))
    second = _reaching(inner, "fine", first.select("want"))
    values = bins.join(F.broadcast(second), F.col("fine") == F.col("cut")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    third = _reaching(values, "u", second.select("want")).select(F.col("cut").alias("_cut"))
    labelled = df.withColumn("_u", u).crossJoin(F.broadcast(third))  # one row
    return labelled.withColumn("split", F.when(F.col("_u") <= F.col("_cut"), "test").otherwise("train")).drop("_u", "_cut")


def _known(df: DataFrame, least: int) -> None:
    if least < 1:
        raise ValueError("the number of times is 1 at least")


def time_split(df: DataFrame, time: str, test_times: int = 3, target: str | None = None) -> tuple[DataFrame, dict]:
    """Test from ``max - test_times + 1`` on, train before, and the split's cutoff and ends. Empty sides raise.

    Rows without the ``target``, if one is named, go before anything is decided.
    """
    _known(df, test_times)
    df = strict_year(df if target is None else drop_missing_target(df, target), time)
    low, high = df.agg(F.min(quoted(time)), F.max(quoted(time))).first()
    if high is None:
        raise ValueError("there are no rows")
    cutoff = high - test_times + 1
    if low >= cutoff:
        raise ValueError(f"no training rows before {cutoff}")
    out = df.withColumn("split", F.when(quoted(time) >= cutoff, "test").otherwise("train"))
    return out, {"cutoff": cutoff, "train_min": low, "test_max": high, "test_times": test_times}


def split_facts(labelled: DataFrame, time: str) -> DataFrame:
    """One row: rows of train, val and test, the ends of train, and the different times of val and test (as many as the split has)."""
    t, side = quoted(time), F.col("split")
    n = [F.count_if(side == s).alias(f"n_{s}") for s in ("train", "val", "test")]
    train = F.when(side == "train", t)
    times = [F.array_sort(F.collect_set(F.when(side == s, t))).alias(f"{s}_times") for s in ("val", "test")]
    return labelled.agg(*n, F.min(train).alias("train_min"), F.max(train).alias("train_max"), *times)


def label_last_times(df: DataFrame, time: str, val_times: int, test_times: int) -> DataFrame:
    """Labels by time: test from ``max - test_times + 1`` on (years or days), val the last different times before that there are, train what is before them."""
    times = df.select(quoted(time)).distinct().filter(quoted(time).isNotNull())
    last = times.agg(F.max(quoted(time)).alias("_last"))
    cutoff = F.date_sub("_last", test_times - 1) if dict(df.dtypes)[time] == "date" else F.col("_last") - (test_times - 1)
    ends = times.crossJoin(F.broadcast(last)).withColumn("_test", quoted(time) >= cutoff)  # one row
    rank = F.dense_rank().over(Window.partitionBy("_test").orderBy(F.desc(time)))  # over different times
    label = F.when(F.col("_test"), "test").when(rank <= val_times, "val").otherwise("train")
    return df.join(ends.select(quoted(time), label.alias("split")), time)


def train_val_test(df: DataFrame, time: str, val_times: int = 2, test_times: int = 3, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The labels, and their counts; a side without rows raises. Rows without the ``target``, if one is named, go."""
    _known(df, min(val_times, test_times))
    out = label_last_times(df if target is None else drop_missing_target(df, target), time, val_times, test_times)
    info = _info(out)
    row = info.first()
    if not all(row):
        raise ValueError(f"a side has no rows: {row.asDict()}")
    return out, info


def overlap_split(df: DataFrame, other: DataFrame, time: str, val_times: int = 1, test_times: int = 1) -> tuple[DataFrame, DataFrame]:
    """Val and test are the last times that both tables have; train is strictly before them; other rows go. And the split's facts.

    Fewer common times than are asked for, and a side without rows, raise.
    ``df`` is written once, as times, facts and rows all come from it.
    """
    _known(df, min(val_times, test_times))
    df = kept(df, "overlap-rows")
    common = df.select(quoted(time)).intersect(other.select(quoted(time))).filter(quoted(time).isNotNull())
    rank = F.row_number().over(Window.orderBy(F.desc(time)))  # over different times
    last = kept(common, "common-times").withColumn("_rank", rank).filter(F.col("_rank") <= val_times + test_times).withColumn("_label", F.when(F.col("_rank") <= test_times, "test").otherwise("val"))
    first = last.agg(F.min(quoted(time)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    labelled = df.join(F.broadcast(last.select(quoted(time), "_label")), time, "left").crossJoin(F.broadcast(first.select("_first")))  # val_times + test_times rows; one row
    split = F.coalesce("_label", F.when(quoted(time) < F.col("_first"), F.lit("train")))
    out = labelled.withColumn("split", split).filter("split IS NOT NULL").drop("_label", "_first")
    if first.first()["_n"] < val_times + test_times:
        raise ValueError(f"fewer than {val_times + test_times} common times")
    facts = split_facts(out, time)
    row = facts.first()
    if not (row["n_train"] and row["n_val"] and row["n_test"]):
        raise ValueError("a side has no rows")
    return out, facts


def hash_fold(key: Sequence[str], k: int, seed: int = 42) -> Column:
    """Shuffled folds: a fold by hash of seed and key."""
    return F.pmod(F.xxhash64(F.lit(seed), *map(quoted, key)), F.lit(k)).cast("int")


def equal_folds(df: DataFrame, key: Sequence[str], k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Shuffled folds 0..k-1 whose sizes differ by one at most: rows in order of a hash of seed and key, cut in k.

    All k - 1 cuts are found at once, by counts over BINS bins, over BINS bins
    of those in which cuts lie, and over the values there; rows are only
    compared with them. Rows of one key at a cut are numbered and divided.
    """
    own = df.withColumn("_u", uniform(seed, *key))
    fine = F.floor(F.col("_u") * float(BINS * BINS))

    def places(counts: DataFrame, by: str, wants: dict[int, dict[int, int]]) -> dict[int, dict[int, int]]:
        """For each cut, the value at which running counts pass it, and the rows wanted below it there; by group of the step before."""
        found: dict[int, dict[int, int]] = {}
        rows: dict[int, list] = {}
        for r in counts.collect():  # bins, or the few values in the last ones
            rows.setdefault(r["_in"], []).append((r[by], r["n"]))
        for group, cuts in wants.items():
            at, below = sorted(rows.get(group, [])), 0
            for value, n in at:
                for i, want in cuts.items():
                    if below < want <= below + n:
                        found.setdefault(value, {})[i] = want - below
                below += n
        return found

    coarse = own.groupBy(F.floor(fine / BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("_in", F.lit(0)).persist()
    try:
        total = coarse.agg(F.sum("n")).first()[0] or 0
        first = places(coarse, "bin", {0: {i: total * i // k for i in range(1, k) if total * i // k}})
    finally:
        coarse.unpersist()
    inner = own.filter(F.floor(fine / BINS).isin(*first)).groupBy(F.floor(fine / BINS).alias("_in"), fine.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    second = places(inner, "bin", first)
    values = own.filter(fine.isin(*second)).groupBy(fine.alias("_in"), F.col("_u").alias("u")).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        third = places(values, "u", second)
        sizes = {r["u"]: r["n"] for r in values.filter(F.col("u").isin(*third)).collect()}
    finally:
        values.unpersist()
    divided = sorted(u for u, cuts in third.items() if any(want < sizes[u] for want in cuts.values()))
    # a cut (u, n): rows below u, and the first n of those at u, are before it
    cuts = [(u, want) for u, own_cuts in third.items() for want in own_cuts.values()]
    after = lambda no: sum(((F.col("_u") > u) | ((F.col("_u") == u) & (no >= want))).cast("int") for u, want in cuts) if cuts else F.lit(0)
    empty = sum(1 for i in range(1, k) if not total * i // k)  # cuts before the first row
    if not divided:
        return own.withColumn(name, (after(F.lit(-1)) + empty).cast("int")).drop("_u")
    parts = own.filter(~F.col("_u").isin(*divided)).withColumn(name, (after(F.lit(-1)) + empty).cast("int"))
    for u in divided:  # k - 1 at most
        rows, _ = numbered_rows(own.filter(F.col("_u") == u))
        parts = parts.unionByName(rows.withColumn(name, (after(F.col("_no")) + empty).cast("int")).drop("_no"))
    return parts.drop("_u")


def contiguous_folds(df: DataFrame, order: str, k: int) -> DataFrame:
    """``fold`` 0..k-1 of equal sizes in the order of a unique numeric column; the first ones take the rest."""
    n = running_counts(df.groupBy(quoted(order)).agg(F.count(F.lit(1)).alias("_n")), order, "_n").select(quoted(order), "_before")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    both = df.join(n, order).crossJoin(F.broadcast(total))  # one row
    size, extra = F.floor(F.col("_total") / k), F.col("_total") % k
    large = extra * (size + 1)
    fold = F.when(F.col("_before") < large, F.floor(F.col("_before") / (size + 1))).otherwise(extra + F.floor((F.col("_before") - large) / F.greatest(size, F.lit(1))))
    return both.withColumn("fold", fold.cast("int")).drop("_before", "_total")


def time_folds(df: DataFrame, time: str, k: int = 3, val_times: int = 1) -> DataFrame:
    """Expanding windows: in fold i the i-th block of last times is val, all times before are train.

    A row is in several folds, once each; no row is before its fold's training starts.
    """
    times = df.select(quoted(time)).distinct().filter(quoted(time).isNotNull())
    ranked = times.withColumn("_back", F.dense_rank().over(Window.orderBy(F.desc(time))) - 1)  # over different times
    block = F.floor(F.col("_back") / val_times)
    own = ranked.withColumn("_block", block).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    kept = own.filter(F.col("_block") >= k - 1 - F.col("fold")).withColumn("split", F.when(F.col("_block") == k - 1 - F.col("fold"), "val").otherwise("train"))
    return df.join(kept.select(quoted(time), "fold", "split"), time)


def split_summary(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min(quoted(time)).alias("min_time"), F.max(quoted(time)).alias("max_time"))


