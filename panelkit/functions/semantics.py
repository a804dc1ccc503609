"""Missing values, division and ordering rules that plain SQL expressions do not give by default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 1.7976931348623157e308


def ratio(num: Column, den: Column, on_zero: str = "null") -> Column:
    """``num / den`` without the ANSI division error.

    ``on_zero='null'`` gives NULL for a zero denominator; ``'ieee'`` gives +-Infinity or NaN.
    """
    if on_zero == "null":
        return F.try_divide(num, den)
    if on_zero != "ieee":
        raise ValueError("on_zero must be 'null' or 'ieee'")
    undefined = F.isnan(num) | (num == 0)
    by_zero = (
        F.when(undefined, F.lit(float("nan")))
        .when(num > 0, F.lit(float("inf")))
        .when(num < 0, F.lit(float("-inf")))
    )
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))


def nan_to_null(c: Column) -> Column:
    """NaN counts as missing: NULL never passes a filter, while ``NaN > 0.1`` is true in SQL."""
    return F.when(~F.isnan(c), c)


def clamp_negative(c: Column) -> Column:
    """Negative values become 0 and NULL stays NULL (``greatest`` would turn NULL into 0)."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def sort_key(v: Column) -> Column:
    """Order-preserving BIGINT image of a non-NULL, non-NaN double.

    It equals the exponent-and-mantissa integer of ``|v|``, negated for negative values, so a right
    shift by ``s`` groups the values of one bucket and a bucket holds at most ``2**s`` distinct
    doubles (twice that around zero). That bound is what lets ranks be found without sorting.
    """
    # No conditional branches: generated code then computes the logarithm and the power once per row.
    size = F.least(F.abs(v), F.lit(LARGEST))
    # the logarithm of 0 is NULL and skipped; that of the largest double rounds up
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    scaled = size / F.pow(F.lit(2.0), guess)
    # the logarithm may be one off next to a power of two; the scaled mantissa tells which way
    up = (scaled >= 2).cast("int")
    down = ((scaled < 1) & (guess > -1022)).cast("int")
    mantissa = scaled * (1 - 0.5 * up) * (1 + down)
    infinite = (F.abs(v) > LARGEST).cast("int")
    bits = (guess + up - down + 1022) * F.lit(1 << 52) + (mantissa * float(1 << 52)).cast("bigint") + infinite
    return bits * F.signum(v).cast("bigint")


def packed_pair(value: Column, at: Column) -> Column:
    """``(value, at)`` as one DECIMAL of fixed width that is ordered as the pair is.

    ``value`` is a double that is neither NULL nor NaN, ``at`` an integer of 32 bits. The minimum of a
    struct is sort-based, as its buffer has no fixed width; that of this number is hash-aggregated.
    """
    image = sort_key(value).cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)")
    return (image + (at.cast("bigint") + (1 << 31)).cast("decimal(10,0)")).cast("decimal(38,0)")


def packed_at(pair: Column) -> Column:
    """The second part of :func:`packed_pair`."""
    return (F.pmod(pair, F.lit(1 << 32).cast("decimal(38,0)")).cast("bigint") - (1 << 31)).cast("int")


def search_sorted(df, value: str, points: list[float], out: str):
    """Add ``out``: how many of the ascending ``points`` are smaller than ``value``.

    A binary search written as a chain of projections over one literal array, so it stays in
    generated code and costs log2(len(points)) lookups per row.
    """
    array = F.lit(points)
    size = len(points)
    df = df.withColumn(out, F.lit(0))
    step = 1 << max(size.bit_length() - 1, 0)
    while size and step:
        nxt = F.col(out) + step
        hit = (nxt <= size) & (F.get(array, nxt - 1) < F.col(value))
        df = df.withColumn(out, F.when(hit, nxt).otherwise(F.col(out)))
        step //= 2
    return df
