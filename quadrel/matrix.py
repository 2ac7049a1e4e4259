"""A sparse Boolean matrix: a set of (row, col) cells of an n x n square."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.bits import MAX_COORDINATE, ceil_log2, morton


@dataclass(frozen=True)
class Meta:
    """n and the quadrant tree's height: at least 1, leaves are 2x2 blocks.

    side: None, or that of the squares that each have a tree of their own, if
    the n x n square is a grid of such; levels then count from their roots.
    """

    n: int
    side: int | None = None

    @property
    def height(self) -> int:
        return max(1, ceil_log2(self.side or self.n))


@dataclass(frozen=True)
class Matrix:
    """cells: (row long, col long), no cell twice.  The number of ones is counted, never stored."""

    cells: DataFrame
    meta: Meta

    @staticmethod
    def from_df(df: DataFrame, n: int | None = None, distinct: bool = True, side: int | None = None) -> Matrix:
        """Cells of df's first two columns; duplicates collapse, coordinates outside the square fail the query.

        n defaults to the largest coordinate plus one (one job).  Nulls are no cells.  side: see Meta.
        """
        r, c = df.columns[:2]
        cells = df.select(F.col(r).cast("long").alias("row"), F.col(c).cast("long").alias("col")).where("row IS NOT NULL AND col IS NOT NULL")
        if n is None:
            n = (cells.agg(F.max(F.greatest("row", "col"))).head()[0] or 0) + 1
        if not 0 < n <= MAX_COORDINATE:
            raise ValueError(f"n is {n}; it must be from 1 to {MAX_COORDINATE}")
        inside = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < n) & (F.col("col") < n)
        bad = F.raise_error(F.concat(F.lit(f"cell outside the {n} x {n} square: "), F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string")))).cast("long")
        cells = cells.select(F.when(inside, F.col("row")).otherwise(bad).alias("row"), "col")
        return Matrix(cells.distinct() if distinct else cells, Meta(n, side))

    def keyed(self) -> DataFrame:
        """(row, col, key) with the z-order key."""
        return self.cells.select("row", "col", morton(F.col("row"), F.col("col")).alias("key"))

    def same_space(self, other: Matrix) -> None:
        if self.meta.n != other.meta.n:
            raise ValueError(f"matrices of different size: {self.meta.n} and {other.meta.n}")

    # Extensions: the obvious relational look-ups.
    def cell(self, row: int, col: int) -> DataFrame:
        return self.cells.where((F.col("row") == row) & (F.col("col") == col))

    def row(self, row: int) -> DataFrame:
        return self.cells.where(F.col("row") == row)

    def col(self, col: int) -> DataFrame:
        return self.cells.where(F.col("col") == col)

    def submatrix(self, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
        """Cells of half-open ranges of rows and columns."""
        return self.cells.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))

    def transpose(self) -> Matrix:
        return Matrix(self.cells.select(F.col("col").alias("row"), F.col("row").alias("col")), self.meta)
