"""Column helpers for the numeric rules of sensor measurements; every module takes them from here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel of the pixel at (y & 1) * 2 + (x & 1) for each colour-filter pattern (fixed values).
CFA = {"Rggb": ("R", "Gr", "Gb", "B"), "Bggr": ("B", "Gb", "Gr", "R"), "Grbg": ("Gr", "R", "B", "Gb"), "Gbrg": ("Gb", "B", "R", "Gr")}


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def cfa_channel(pattern, x, y, segment=None) -> Column:
    """Channel by absolute parity; with segment, x counts from the left edge of its side-by-side segment."""
    x = c(x) if segment is None else c(x) - F.floor(c(x) / c(segment)) * c(segment)
    place = (c(y) % 2 * 2 + x % 2 + 1).cast("int")
    out = F
    for name, channels in CFA.items():
        out = out.when(c(pattern) == name, F.element_at(F.array(*map(F.lit, channels)), place))
    return out


def pop_variance(n, s, s2) -> Column:
    """Exact population variance from integer moments: zero for constant values."""
    n, s, s2 = (c(v).cast("decimal(38,0)") for v in (n, s, s2))
    return (n * s2 - s * s).cast("double") / c(n).cast("double") / c(n).cast("double")


def half_up(x) -> Column:
    return F.floor(c(x) + F.lit(0.5))


def clamp(x, low, high) -> Column:
    return F.greatest(c(low), F.least(c(x), c(high)))


def code16(code, depth) -> Column:
    return c(code) * F.pow(F.lit(2), 16 - c(depth)).cast("int")


def grid(value, depth) -> Column:
    """A 16-bit value on the grid of N-bit codes, half up, clamped."""
    top = F.pow(F.lit(2), c(depth)).cast("int") - 1
    return clamp(half_up(c(value) / F.pow(F.lit(2.0), 16 - c(depth))), F.lit(0), top).cast("int")


def full_scale_factor(depth: int) -> float:
    return 65535.0 / (((1 << depth) - 1) << (16 - depth))


def to_db(saturation, sigma) -> Column:
    return F.when(c(sigma) > 0, 20 * F.log10(c(saturation) / c(sigma)))


def to_stops(saturation, sigma) -> Column:
    return F.when(c(sigma) > 0, F.log2(c(saturation) / c(sigma)))


def quantile_rank(q: float, n) -> Column:
    """0-based rank floor(q (n - 1) + 0.5)."""
    return F.floor(F.lit(q) * (c(n) - 1) + F.lit(0.5))


def luma(r, g, b) -> Column:
    return clamp(F.rint(0.299 * c(r) + 0.587 * c(g) + 0.114 * c(b)), F.lit(0.0), F.lit(65535.0)).cast("int")


def saturation_code(code, depth) -> Column:
    """The code at which a sensor saturates: the largest of its depth where none, or a larger one, is given."""
    top = F.pow(F.lit(2.0), c(depth)) - 1
    usable = c(code).isNotNull() & ~F.isnan(c(code)) & (c(code) > 0) & (c(code) < float("inf"))
    return F.when(usable, F.least(c(code).cast("double"), top)).otherwise(top)


def gain_db(gain, least: float = -60.0) -> Column:
    return F.when(c(gain) > 0, 20 * F.log10(c(gain))).otherwise(F.lit(least))


def gain_linear(db) -> Column:
    return F.pow(F.lit(10.0), c(db) / 20)


def transferred_level(level, from_depth, to_depth) -> Column:
    """A level code at another depth, to the nearest even."""
    top = lambda depth: F.pow(F.lit(2.0), c(depth)) - 1
    return F.rint(c(level) / top(from_depth) * top(to_depth))


def carried_level(v16, depth: int) -> Column:
    """A 16-bit level of a frame of lower depth on the full scale of its processed result."""
    return clamp(half_up(c(v16) * F.lit(full_scale_factor(depth))), F.lit(0), F.lit(65535))
