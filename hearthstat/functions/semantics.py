"""Missing-value, text and ratio rules as column expressions.

Spark aggregates skip NULL, its string functions return NULL on NULL and ANSI
division raises on zero. The analyses in this library need other rules in
places: a strict sum is unknown when any input is unknown, an absent address
is simply "not a match", and x/0 is infinity. Each rule is one expression
here, so everything stays in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- aggregates


def strict(agg: Column, *inputs: Column | str) -> Column:
    """``agg``, or NULL when any row of the group has a NULL input."""
    missing = as_col(inputs[0]).isNull()
    for c in inputs[1:]:
        missing = missing | as_col(c).isNull()
    return F.when(~F.bool_or(missing), agg)


def sum_of(c: Column | str, na_rm: bool = False) -> Column:
    """Sum; the sum of nothing is 0. Without ``na_rm`` one NULL makes it NULL."""
    c = as_col(c)
    total = F.coalesce(F.sum(c), F.lit(0))
    if na_rm:
        return total
    return F.when(F.coalesce(F.bool_or(c.isNull()), F.lit(False)), F.lit(None)).otherwise(total)


def mean_of(c: Column | str, na_rm: bool = False) -> Column:
    c = as_col(c)
    return F.avg(c) if na_rm else strict(F.avg(c), c)


def max_of(c: Column | str, na_rm: bool = False) -> Column:
    c = as_col(c)
    return F.max(c) if na_rm else strict(F.max(c), c)


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_distinct(c: Column | str, strict_count: bool = False, approx: bool = False) -> Column:
    """Distinct values; NULL counts as one value unless ``strict_count``.

    ``approx`` swaps in HyperLogLog++, which needs no per-value shuffle.
    """
    c = as_col(c)
    n = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    if strict_count:
        return n
    return n + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    x, w = as_col(x), as_col(w)
    return strict(F.try_divide(F.sum(x * w), F.sum(w)), x, w)


# ------------------------------------------------------------------- scalars


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that is NULL when the condition is NULL."""
    return F.when(cond, yes).when(~cond, no)


def has_text(c: Column | str, text: str) -> Column:
    """Substring test; a NULL string is not a match."""
    return F.coalesce(as_col(c).contains(text), F.lit(False))


def numeric(df: DataFrame, name: str) -> Column:
    """Column as a number; unparsable text becomes NULL. Numbers pass through."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name)
    return F.col(name).try_cast("double")


def text_key(*parts: Column | str, sep: str = "-", paste_missing: bool = False) -> Column:
    """Join key parts. A missing part gives a NULL key, or the text 'NA' on request."""
    cols = [as_col(p).cast("string") for p in parts]
    if paste_missing:
        cols = [F.coalesce(c, F.lit("NA")) for c in cols]
    joined = cols[0]
    for c in cols[1:]:
        joined = F.concat(joined, F.lit(sep), c)
    return joined


def slice_text(c: Column | str, start: int, stop: int) -> Column:
    """Characters ``start`` to ``stop``, both included, counted from 1."""
    start = max(start, 1)
    return F.substring(as_col(c), start, stop - start + 1)


def split_parcel_key(c: Column | str, stop: int, paste_missing: bool = False) -> Column:
    """Undelimited parcel number to ``block-lot`` (six characters, then up to ``stop``)."""
    return text_key(slice_text(c, 1, 6), slice_text(c, 7, stop), paste_missing=paste_missing)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num/den with x/0 = ±infinity and 0/0 = NULL; NULL where either is."""
    num, den = as_col(num).cast("double"), as_col(den).cast("double")
    return (
        F.when(den != 0, F.try_divide(num, den))
        .when((den == 0) & (num > 0), F.lit(float("inf")))
        .when((den == 0) & (num < 0), F.lit(float("-inf")))
    )


def packed_order(high: list[tuple[Column, int]], low: list[tuple[Column, int]]) -> Column:
    """One number that sorts like the given whole numbers in turn.

    Each part is a column and its largest number of digits; ``high`` and
    ``low`` may hold 18 digits each. A fixed-width key keeps ``min_by`` and
    ``max_by`` in a hash aggregate, where a struct would force a sort of the
    raw rows. A number with more digits raises an error, and so does a negative one
    unless it comes first, as it would run into its neighbours.
    """

    def pack(parts: list[tuple[Column, int]], signed: bool = False) -> Column:
        if sum(d for _, d in parts) > 18:
            raise ValueError("at most 18 digits fit in each half")
        out = F.lit(0).cast("long")
        for i, (c, digits) in enumerate(parts):
            c = c.cast("long")
            least = 1 - 10**digits if signed and i == 0 else 0
            wide = F.concat(F.lit(f"not a number of up to {digits} digits: "), c.cast("string"))
            fits = F.when((c < least) | (c >= 10**digits), F.raise_error(wide).cast("long")).otherwise(c)
            out = out * F.lit(10**digits) + fits
        return out

    scale = F.lit(10**18).cast("decimal(19,0)")
    return pack(high, signed=True).cast("decimal(19,0)") * scale + pack(low).cast("decimal(19,0)")
