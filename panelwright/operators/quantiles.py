"""Exact quantiles of whole columns and of groups, without a task that holds all different values of one.

An approximate quantile on either side of the rank that is asked for brackets
it. Values below the bracket are counted, those inside it are few and gathered;
where they are too many, the bracket is narrowed first. Each step is one
aggregate over all columns, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .schema import quoted

#: Values of a bracket that are gathered at once, and how far from the rank a bracket's ends are looked for.
KEEP, SPREAD, ACCURACY = 10_000, 0.001, 10_000


def _around(share: float, spread: float) -> Column:
    return F.array(F.lit(max(0.0, share - spread)), F.lit(min(1.0, share + spread)))


def exact_quantiles(df: DataFrame, values: Mapping[str, Column], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles by name, interpolated between neighbours; None without values."""
    names = list(values)
    if not names:
        return {}
    narrow = df.select(*(values[c].cast("double").alias(f"v{i}") for i, c in enumerate(names))).persist()
    try:
        return _whole_columns(narrow, names, shares)
    finally:
        narrow.unpersist()


def _whole_columns(narrow: DataFrame, names: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    first = [x for i in range(len(names)) for x in (F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"low{i}"), F.max(f"v{i}").alias(f"high{i}"))]
    near = [F.approx_percentile(f"v{i}", _around(q, SPREAD), ACCURACY).alias(f"q{i}_{j}") for i in range(len(names)) for j, q in enumerate(shares)]
    row = narrow.agg(*first, *near).first()
    found: dict[tuple[int, int], float] = {}
    todo: dict[tuple[int, int], tuple[float, float, float]] = {}  # by column and rank: the bracket, and about how many values it has
    for i in range(len(names)):
        n = row[f"n{i}"]
        for j, q in enumerate(shares):
            for rank in {floor((n - 1) * q), ceil((n - 1) * q)} if n else ():
                todo[i, rank] = (*row[f"q{i}_{j}"], 2 * (SPREAD + 2 / ACCURACY) * n)
    while todo:
        brackets = sorted({(i, low, high, size <= KEEP) for (i, _), (low, high, size) in todo.items()})
        aggs = []
        for k, (i, low, high, few) in enumerate(brackets):
            v = F.col(f"v{i}")
            inside = F.when((v > low) & (v < high), v)
            aggs += [F.count_if(v < low).alias(f"below{k}"), F.count_if(v == low).alias(f"low{k}"), F.count(inside).alias(f"in{k}"), F.count_if(v == high).alias(f"high{k}")]
            aggs.append((F.sort_array(F.collect_list(inside)) if few else F.approx_percentile(inside, F.array(*(F.lit(x / 1000) for x in range(1001))), ACCURACY)).alias(f"x{k}"))
        got = narrow.agg(*aggs).first()
        left: dict[tuple[int, int], tuple[float, float, float]] = {}
        for (i, rank), (low, high, size) in todo.items():
            k = brackets.index((i, low, high, size <= KEEP))
            at = rank - got[f"below{k}"]
            inner, n = at - got[f"low{k}"], got[f"in{k}"]
            if at < 0:
                left[i, rank] = (row[f"low{i}"], low, got[f"below{k}"])
            elif inner < 0:
                found[i, rank] = low
            elif inner < n and size <= KEEP:
                found[i, rank] = got[f"x{k}"][inner]
            elif inner < n:
                place = inner * 1000 // n
                left[i, rank] = (got[f"x{k}"][max(0, place - 1)], got[f"x{k}"][min(1000, place + 2)], 3.5 * n / 1000)
            elif low == high or inner < n + got[f"high{k}"]:
                found[i, rank] = high
            else:
                left[i, rank] = (high, row[f"high{i}"], row[f"n{i}"])
        todo = left
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        n = row[f"n{i}"]
        out[c] = []
        for q in shares:
            at = (n - 1) * q
            a, b = floor(at), ceil(at)
            out[c].append(None if not n else found[i, a] if a == b else (b - at) * found[i, a] + (at - a) * found[i, b])
    return out


def same_keys(left: DataFrame, right: DataFrame, names: Sequence[str], others: Sequence[str]) -> Column:
    """Equality of key columns in which NULL equals NULL."""
    test = F.lit(True)
    for a, b in zip(names, others, strict=True):
        test = test & left[f"`{a}`"].eqNullSafe(right[f"`{b}`"])
    return test


def _ranks(n: Column, shares: Sequence[float]) -> list[Column]:
    """For each share, the ranks from 0 on either side of its place."""
    return [f((n - 1) * F.lit(float(q))).cast("long") for q in shares for f in (F.floor, F.ceil)]


def _between(n: Column, q: float, a: Column, b: Column) -> Column:
    at = (n - 1) * F.lit(float(q))
    part = at - F.floor(at)
    return F.when(n > 0, F.when(part == 0, a).otherwise((1 - part) * a + part * b))


def grouped_quantiles(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], shares: Sequence[float]) -> DataFrame:
    """``by`` and, for each name and share, ``name_0, name_1, ...``: exact quantiles of each group, NULL without values.

    Groups with at most ``KEEP`` values are sorted in place. Of larger ones, a
    sketch brackets each rank, what is below is counted, what is inside is
    gathered, and where that is too much the bracket is narrowed first; each
    step is one aggregate for all groups, so neither one group with all rows
    nor many groups fill a task. NULL keys are a group.
    """
    names, keys = list(values), [f"k{i}" for i in range(len(by))]
    narrow = df.select(*(quoted(c).alias(k) for c, k in zip(by, keys, strict=True)), *(values[c].cast("double").alias(f"v{i}") for i, c in enumerate(names))).persist()
    try:
        sizes = kept(narrow.groupBy(*keys).agg(*(F.count(f"v{i}").alias(f"n{i}") for i in range(len(names)))), "group-sizes")
        large = sizes.filter(F.greatest(*(F.col(f"n{i}") for i in range(len(names))), F.lit(0)) > KEEP)
        large = large.toDF(*(f"{c}_" for c in large.columns))
        some = not large.isEmpty()
        test = same_keys(narrow, large, keys, [f"{k}_" for k in keys])
        small = narrow.join(large, test, "left_anti") if some else narrow
        out = _in_place(small, keys, len(names), shares)
        if some:
            out = out.unionByName(_bracketed(narrow.join(large, test), keys, len(names), shares))
        out = kept(out, "group-quantiles")
    finally:
        narrow.unpersist()
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *(F.col(f"q{i}_{j}").alias(f"{c}_{j}") for i, c in enumerate(names) for j in range(len(shares))))


def _in_place(rows: DataFrame, keys: Sequence[str], width: int, shares: Sequence[float]) -> DataFrame:
    lists = rows.groupBy(*keys).agg(*(F.sort_array(F.collect_list(f"v{i}")).alias(f"x{i}") for i in range(width)))  # KEEP values at most
    out = []
    for i in range(width):
        n, ranks = F.size(f"x{i}"), _ranks(F.size(f"x{i}"), shares)
        out += [_between(n, q, F.try_element_at(f"x{i}", (ranks[2 * j] + 1).cast("int")), F.try_element_at(f"x{i}", (ranks[2 * j + 1] + 1).cast("int"))).alias(f"q{i}_{j}") for j, q in enumerate(shares)]
    return lists.select(*keys, *out)


def _bracketed(rows: DataFrame, keys: Sequence[str], width: int, shares: Sequence[float]) -> DataFrame:
    """Quantiles of large groups; ``rows`` carry their groups' sizes ``n0_, n1_, ...``."""
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"), F.col(f"n{i}_").alias("n")) for i in range(width)))).alias("x")).select(*keys, "x.i", "x.v", "x.n").filter("v IS NOT NULL")
    ends = [e for q in shares for e in (max(0.0, q - SPREAD), min(1.0, q + SPREAD))]
    sketch = long.groupBy(*keys, "i").agg(F.first("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.approx_percentile("v", F.array(*map(F.lit, ends)), ACCURACY).alias("x"))
    wide = F.col("n") <= KEEP  # a column of few values in a large group: all are inside
    targets = F.array(*(F.struct(F.lit(t).alias("t"), r.alias("rank"), F.when(wide, F.col("least")).otherwise(F.col("x")[t // 2 * 2]).alias("low"), F.when(wide, F.col("most")).otherwise(F.col("x")[t // 2 * 2 + 1]).alias("high")) for t, r in enumerate(_ranks(F.col("n"), shares))))
    few = (F.col("n") <= KEEP) | (F.col("n") * (2 * (SPREAD + 2 / ACCURACY)) <= KEEP)
    todo = kept(sketch.select(*keys, "i", "n", few.alias("few"), F.inline(targets)), "quantile-brackets")
    found = None
    own = [*keys, "i"]
    while True:
        brackets = todo.withColumnsRenamed({c: f"b_{c}" for c in own}).drop("n")
        joined = long.join(brackets, same_keys(long, brackets, own, [f"b_{c}" for c in own]))
        inside = F.when((F.col("v") > F.col("low")) & (F.col("v") < F.col("high")), F.col("v"))
        grid = F.array(*(F.lit(x / 1000) for x in range(1001)))
        step = joined.groupBy(*own, "t").agg(
            *(F.first(c).alias(c) for c in ("n", "rank", "low", "high", "few")), F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(F.col("v") == F.col("low")).alias("at_low"), F.count(inside).alias("inner"),
            F.sort_array(F.collect_list(F.when(F.col("few"), inside))).alias("x"), F.approx_percentile(F.when(~F.col("few"), inside), grid, ACCURACY).alias("grid"),
        )
        place = F.col("rank") - F.col("below") - F.col("at_low")
        value = F.when(place < 0, F.col("low")).when(place >= F.col("inner"), F.col("high")).when(F.col("few"), F.try_element_at("x", (place + 1).cast("int")))
        step = kept(step.withColumn("place", place).withColumn("value", value).drop("x"), "quantile-step")
        done = step.filter("value IS NOT NULL").select(*own, "n", "t", "value")
        found = done if found is None else found.unionByName(done)
        left = step.filter("value IS NULL")
        if left.isEmpty():
            break
        at = F.floor(F.col("place") * 1000 / F.col("inner")).cast("int")
        todo = kept(left.select(*own, "n", (F.col("inner") * 0.0035 <= KEEP).alias("few"), "t", "rank", F.col("grid")[F.greatest(at - 1, F.lit(0))].alias("low"), F.col("grid")[F.least(at + 2, F.lit(1000))].alias("high")), "quantile-brackets")
    pick = lambda i, t, c: F.max(F.when((F.col("i") == i) & (F.col("t") == t), F.col(c)))
    wide_rows = found.groupBy(*keys).agg(*(pick(i, t, "value").alias(f"x{i}_{t}") for i in range(width) for t in range(2 * len(shares))), *(pick(i, 0, "n").alias(f"n{i}") for i in range(width)))
    return wide_rows.select(*keys, *(_between(F.coalesce(F.col(f"n{i}"), F.lit(0)), q, F.col(f"x{i}_{2 * j}"), F.col(f"x{i}_{2 * j + 1}")).alias(f"q{i}_{j}") for i in range(width) for j, q in enumerate(shares)))
