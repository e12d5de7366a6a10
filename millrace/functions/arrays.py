"""Column expressions over arrays of samples or scores. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D = "double"


def doubles(v: str | Column) -> Column:
    return F.transform(v, lambda x: x.cast(D))


def total(v: Column) -> Column:
    """Sum from the left; 0 for no values."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v).cast(D))


def std_pop(v: Column) -> Column:
    """Population standard deviation, from the squared differences."""
    m = mean(v)
    return F.sqrt(mean(F.transform(v, lambda x: (x - m) * (x - m))))


def peak_normalize(v: Column, epsilon: float = 1e-9) -> Column:
    """Divides by the largest magnitude plus ``epsilon``; silence stays silent."""
    peak = F.array_max(F.transform(v, lambda x: F.abs(x))) + F.lit(epsilon)
    return F.transform(v, lambda x: x / peak)


def frames(v: Column, size: int, hop: int) -> Column:
    """Overlapping frames without padding; none if the array is shorter than a frame."""
    starts = F.when(F.size(v) >= size, F.sequence(F.lit(1), F.size(v) - size + 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(v, i, size))


def rms(v: Column) -> Column:
    return F.sqrt(mean(F.transform(v, lambda x: x * x)))


def sanitize(v: Column, big: float = 1e6) -> Column:
    """NaN and null become 0, infinities the largest value allowed."""
    return F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).when(x == float("inf"), F.lit(big)).when(x == float("-inf"), F.lit(-big)).otherwise(x))


def fit_length(v: Column, n: int) -> Column:
    """Cut or padded with zeros to ``n`` values; a null is all zeros."""
    return F.slice(F.concat(F.coalesce(v, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n)), 1, n)


def concat_fixed(parts: list[tuple[Column, int]]) -> Column:
    """Parts in a fixed order, each brought to its expected length."""
    return F.concat(*[fit_length(v, n) for v, n in parts])


def softmax(v: Column) -> Column:
    """Stable: the largest score is taken off first."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def first_argmax(v: Column) -> Column:
    """Number from 0 of the first largest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def power_to_db(power: Column, floor: float = 1e-10, top_db: float = 80.0) -> Column:
    """10 log10, no lower than ``top_db`` under the largest."""
    db = F.transform(power, lambda x: 10.0 * F.log10(F.greatest(x, F.lit(floor))))
    low = F.array_max(db) - top_db
    return F.transform(db, lambda x: F.greatest(x, low))


def flatness(power: Column, floor: float = 1e-10) -> Column:
    """Geometric over arithmetic mean."""
    p = F.transform(power, lambda x: F.greatest(x, F.lit(floor)))
    return F.exp(mean(F.transform(p, lambda x: F.ln(x)))) / mean(p)


def sign_changes(v: Column) -> Column:
    """Numbers i at which the sign differs from that of i - 1; a negative zero counts as negative."""
    negative = F.transform(v, lambda x: (x < 0) | (x.cast("string") == "-0.0"))
    return F.filter(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.get(negative, i) != F.get(negative, i - 1))


def dft_magnitudes(v: Column, n: int) -> Column:
    """Magnitudes of the first n/2 + 1 bins of a short transform, by its definition."""
    import math

    out = []
    for k in range(n // 2 + 1):
        re = sum((F.get(v, F.lit(i)) * math.cos(2 * math.pi * k * i / n) for i in range(1, n)), F.get(v, F.lit(0)))
        im = sum((F.get(v, F.lit(i)) * math.sin(2 * math.pi * k * i / n) for i in range(1, n)), F.get(v, F.lit(0)) * 0.0)
        out.append(F.sqrt(re * re + im * im))
    return F.array(*out)
