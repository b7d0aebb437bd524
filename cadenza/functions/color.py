"""Pixel math and sheet geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of the HLG transfer function, and BT.2020 to BT.709 primaries.
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
TO_709 = ((1.660491, -0.587641, -0.072850), (-0.124550, 1.132900, -0.008349), (-0.018151, -0.100579, 1.118730))


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def hlg_to_linear(x: Column) -> Column:
    return F.when(x <= 0.5, x * x / 3).otherwise((F.exp((x - HLG_C) / HLG_A) + HLG_B) / 12)


def to_709_primaries(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return tuple(m[0] * r + m[1] * g + m[2] * b for m in TO_709)


def bt709_oetf(x: Column) -> Column:
    return F.when(x < 0.018, 4.5 * x).otherwise(1.099 * F.pow(F.greatest(x, F.lit(0.018)), F.lit(0.45)) - 0.099)


def display_rgb(r: Column, g: Column, b: Column, transfer: Column, primaries: Column) -> tuple[Column, ...]:
    """8-bit display values, cut off not rounded, of a source in [0, 1]: HLG is made linear, wide primaries narrowed, then the display curve applied."""
    hlg = F.coalesce(transfer == "arib-std-b67", F.lit(False))
    wide = F.coalesce(primaries == "bt2020", F.lit(False))
    linear = [F.when(hlg, hlg_to_linear(c)).otherwise(c) for c in (r, g, b)]
    narrow = [F.when(wide, n).otherwise(c) for n, c in zip(to_709_primaries(*linear), linear, strict=True)]
    return tuple(F.floor(_unit(F.when(hlg, bt709_oetf(_unit(c))).otherwise(_unit(c))) * 255).cast("int") for c in narrow)


def cdl(value: Column, slope: Column | float, offset: Column | float) -> Column:
    """An 8-bit value after slope and offset, cut off not rounded; the tiny addend keeps exact products exact."""
    return F.floor(_unit(value / 255 * slope + offset) * 255 + 1e-9).cast("int")


def fit(width: Column, height: Column, cell_width: int, cell_height: int) -> tuple[Column, Column]:
    """Size of a picture scaled into a cell, cut off."""
    scale = F.least(cell_width / width, cell_height / height)
    return F.greatest(F.lit(1), F.floor(width * scale).cast("int")), F.greatest(F.lit(1), F.floor(height * scale).cast("int"))


def cell_origin(row: Column, col: Column, cell_width: int = 80, cell_height: int = 50, label: int = 18, header: int = 24, left: int = 42) -> tuple[Column, Column]:
    """(x, y) of a contact sheet's cell; rows and columns count from 0."""
    return left + col * cell_width, header + row * (cell_height + label)
