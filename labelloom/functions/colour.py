"""Colour as column expressions: grey, hue, saturation and value of 8-bit pixels, and what training does with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(v: Column) -> Column:
    """To [0, 255], cut to whole numbers."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), v)).cast("int")


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luma by the weights 0.299, 0.587, 0.114, rounded."""
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 180), saturation and value in [0, 255], not rounded."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (v - low).cast("double")
    turn = F.when(span == 0, 0.0).when(v == r, (g - b) / span).when(v == g, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span)
    return F.pmod(30.0 * turn, F.lit(180.0)), F.when(v == 0, 0.0).otherwise(255.0 * span / v), v.cast("double")


def from_hsv(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green and blue of hue in [0, 180), saturation and value in [0, 255], rounded."""

    def channel(n: int) -> Column:
        k = F.pmod(h / 30.0 + n, F.lit(6.0))
        away = F.greatest(F.lit(0.0), F.least(k, 4.0 - k, F.lit(1.0)))
        return F.floor(v - v * s / 255.0 * away + 0.5).cast("int")

    return [channel(n) for n in (5, 3, 1)]


def hue_turned(r: Column, g: Column, b: Column, by: float) -> list[Column]:
    """The hue moved on by `by` of 180."""
    h, s, v = hsv(r, g, b)
    return from_hsv(F.pmod(h + by, F.lit(180.0)), s, v)


def saturated(r: Column, g: Column, b: Column, by: float) -> list[Column]:
    """Away from (or towards) grey by a factor 1 + by."""
    dull = grey(r, g, b)
    return [clipped(c * (1 + by) + dull * -by) for c in (r, g, b)]


def contrasted(channels: list[Column], means: list[Column], factor: float, clip_input: bool = False) -> list[Column]:
    """Away from the image's mean by a factor. clip_input: the variant that clips what came in and so changes nothing."""
    return [clipped(c if clip_input else c * factor + m * (1 - factor)) for c, m in zip(channels, means, strict=True)]


def brightened(channels: list[Column], by: float) -> list[Column]:
    return [clipped(c + by) for c in channels]


def ramp(v: Column, low: float, high: float) -> Column:
    """Clamped to [low, high] and scaled to [0, 1]: the place on a colour map."""
    return (F.least(F.lit(high), F.greatest(F.lit(low), v)) - low) / (high - low + 1e-16)


def wheel(index: Column, n: int, bright: bool = True) -> list[Column]:
    """The index-th of n colours round the hue wheel, full in saturation."""
    return from_hsv(index / n * 180.0, F.lit(255.0), F.lit(255.0 if bright else 0.7 * 255))


def ember(i: int) -> tuple[int, int, int]:
    """The i-th of 256 steps of the black-red-yellow-white map, for types without a colour of their own."""
    x = i / 255
    up = lambda a, b, low=0.0: low + (1 - low) * min(1.0, max(0.0, (x - a) / (b - a)))
    return tuple(int(255 * c) for c in (up(0.0, 0.365079, 0.0416), up(0.365079, 0.746032), up(0.746032, 1.0)))


def fixed_point(v: Column, places: int = 5) -> Column:
    """A number as text with so many places."""
    return F.format_string(f"%.{places}f", v.cast("double"))
