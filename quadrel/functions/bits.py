"""Bit expressions on columns: Morton keys and 2x2 block products.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and columns lie below this bound, so that keys stay below 2**62.
MAX_COORDINATE = 1 << 31

# Shift and mask of each step that spreads the bits of a number to the even positions.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))

_SPREAD_BYTES = "array(" + ", ".join(f"{int(f'{b:b}', 4)}L" for b in range(256)) + ")"


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def _spread(x: Column) -> Column:
    """x's bits at even positions, byte by byte from a table: steps that each use x twice would double the code five times, beyond what the JVM compiles."""
    table = F.expr(_SPREAD_BYTES)
    part = lambda i: F.shiftleft(F.get(table, F.shiftright(x.cast("long"), 8 * i).bitwiseAND(_lit(255)).cast("int")), 16 * i)
    return part(0).bitwiseOR(part(1)).bitwiseOR(part(2)).bitwiseOR(part(3))


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(_lit(_SPREAD[-1][1]))
    for (shift, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [0xFFFFFFFF], strict=True):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(_lit(mask))
    return x


def morton(row: Column, col: Column) -> Column:
    """Z-order key: column bits at even, row bits at odd positions."""
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))


def unmorton(key: Column) -> tuple[Column, Column]:
    """(row, col) of a z-order key."""
    return _gather(F.shiftright(key, 1)), _gather(key)


def cell_bit(key: Column) -> Column:
    """The mask bit of a cell in its 2x2 block: bit 2 * (row % 2) + col % 2 of a long."""
    last = key.bitwiseAND(_lit(3))
    return F.when(last == 0, _lit(1)).when(last == 1, _lit(2)).when(last == 2, _lit(4)).otherwise(_lit(8))


def mask_mul(a: Column, b: Column) -> Column:
    """Boolean product of two 2x2 masks.

    A column of a (bits 0 and 2 after shifting) times a row of b (two bits) puts
    that row wherever the column has a one; the two terms are or-ed.
    """
    first = a.bitwiseAND(_lit(5)) * b.bitwiseAND(_lit(3))
    second = F.shiftright(a, 1).bitwiseAND(_lit(5)) * F.shiftright(b, 2).bitwiseAND(_lit(3))
    return first.bitwiseOR(second)


def ceil_log2(x: int) -> int:
    """Smallest h with 2**h >= x; 0 for x <= 1."""
    return max(0, (x - 1).bit_length()) if x > 1 else 0


def floor_log2(x: int) -> int:
    """Largest h with 2**h <= x; 0 for x <= 1."""
    return x.bit_length() - 1 if x > 1 else 0


def log2_columns(x: Column) -> tuple[Column, Column]:
    """(ceil, floor) of the binary logarithm of whole numbers, exact for any size; 0 for x <= 1."""
    width = lambda n: F.length(F.bin(n)).cast("long")
    return F.when(x > 1, width(x - 1)).otherwise(_lit(0)), F.when(x > 1, width(x) - 1).otherwise(_lit(0))


def prefix(key: Column, levels: int) -> Column:
    """A key's ancestor so many levels up."""
    return F.shiftright(key, 2 * levels)
