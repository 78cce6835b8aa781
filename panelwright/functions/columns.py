"""Column expressions. A missing value is NULL; NaN counts as missing on the way in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value in CSV files (fixed values).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def known_text(c: str | Column) -> Column:
    """NULL for texts that stand for a missing value."""
    c = _col(c)
    return F.when(~c.isin(*NA_TOKENS), c)


def number(c: str | Column) -> Column:
    """As a double; what is no number, and NaN, becomes NULL."""
    d = trimmed(_col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d)


def year(c: str | Column) -> Column:
    """As a whole number by way of a double; bad values and fractions become NULL."""
    d = number(c)
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def finite(c: str | Column) -> Column:
    """NULL for NaN and the infinities."""
    d = _col(c).cast("double")
    return F.when(~F.isnan(d) & ~d.isin(float("inf"), float("-inf")), d)


def clipped(c: str | Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Within [low, high]; NULL stays NULL, which ``least`` and ``greatest`` alone would lose."""
    c = out = _col(c)
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def within(c: str | Column, low: float, high: float) -> Column:
    """Valid values lie above low and not above high."""
    c = _col(c)
    return ~((c <= low) | (c > high))


def log1p_clipped(c: str | Column) -> Column:
    return F.log1p(clipped(_col(c).cast("double"), low=0.0))


def log_eps(c: str | Column, eps: float) -> Column:
    """log(x + eps); NULL for negative x."""
    c = _col(c)
    return F.when(c >= 0, F.log(c + F.lit(eps)))


def contains_flag(c: str | Column, word: str) -> Column:
    """1 if the lower-cased text has the word anywhere in it, else 0; NULL is 0."""
    return F.coalesce(F.contains(F.lower(_col(c)), F.lit(word)), F.lit(False)).cast("int")


def missing_flag(c: str | Column) -> Column:
    return F.isnull(_col(c)).cast("int")


def row_mean(*cols: str) -> Column:
    """Mean of the columns that are not NULL; NULL if all are."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols))
    n = reduce(lambda a, b: a + b, (F.isnotnull(F.col(c)).cast("int") for c in cols))
    return F.try_divide(total, n)


def half_even(c: str | Column, digits: int) -> Column:
    return F.bround(_col(c), digits)


def error(true: str | Column, pred: str | Column) -> Column:
    return _col(true) - _col(pred)


def uniform(seed: int, *key: str | Column) -> Column:
    """A number in (0, 1) that depends on seed and key alone: 52 bits of an md5, which other engines have, too."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(_col(k).cast("string"), F.lit("null")) for k in key))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
