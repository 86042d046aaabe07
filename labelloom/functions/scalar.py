"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb2int(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16) + F.shiftleft(g, 8) + b


def softmax(values: Column) -> Column:
    """Of an array; the largest value is taken off first."""
    return F.transform(F.array(F.transform(values, lambda v: F.exp(v - F.array_max(values)))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))[0]


def argmax(values: Column) -> Column:
    """The first place of the largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(kind: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == kind).cast("int"))


def foreground(share: Column, threshold: float = 0.5, strict: bool = False) -> Column:
    """1 from the threshold on, or with `strict` above it, else 0."""
    return (share > threshold if strict else share >= threshold).cast("int")


def recode(kind: Column, groups: dict[int, Sequence[int]]) -> Column:
    """Class merge: every listed class becomes its group's."""
    out = kind
    for to, members in groups.items():
        out = F.when(kind.isin(list(members)), to).otherwise(out)
    return out


#: Stain vectors by row.
STAINS = ((0.650, 0.704, 0.286), (0.072, 0.990, 0.105), (0.268, 0.570, 0.776))


def deconvolve(r: Column, g: Column, b: Column, matrix: Sequence[Sequence[float]] = STAINS) -> list[Column]:
    """Optical densities ln((c + 1) / 255) by the matrix' columns, back to [0, 255] and rounded."""
    density = [F.log((c + 1) / F.lit(255.0)) for c in (r, g, b)]
    mixed = [sum((density[k] * float(matrix[k][j]) for k in range(3)), F.lit(0.0)) for j in range(3)]
    return [F.floor(F.least(F.lit(255.0), 255 * F.exp(m)) + 0.5).cast("int") for m in mixed]


def read_level(available: Column, wanted: Column, base: Column) -> Column:
    """Place (from 0) of the magnification to read: the exact one; the base for larger ones; else the lowest above the wanted."""
    above = F.array_min(F.filter(available, lambda m: m > wanted))
    pick = F.when(F.array_contains(available, wanted), wanted).when(wanted > base, base).otherwise(above)
    return (F.array_position(available, pick) - 1).cast("int")


def scaled_size(size: Column, wanted: Column, base: Column) -> Column:
    return (size * wanted / base).cast("int")


def round_to_multiple(x: Column, y: int) -> Column:
    return F.floor(x / y) * y


def stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def escaped_glob(path: Column) -> Column:
    return F.regexp_replace(path, r"\[", "[[]")
