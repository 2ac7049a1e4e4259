"""Boolean product and union of matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.bits import mask_mul, morton
from quadrel.matrix import Matrix
from quadrel.operators.tree import cells_of_masks, to_blocks


def multiply(a: Matrix, b: Matrix, salts: int = 1) -> Matrix:
    """Ones of the OR-AND product: pairs that some k connects.

    One join on k and one distinct, whose partial step drops repeats before the
    shuffle.  salts > 1 spreads each k over so many tasks, for a k so frequent
    that splitting by adaptive execution isn't enough; b is then copied.
    """
    a.same_space(b)
    left = a.cells.select("row", F.col("col").alias("k"))
    right = b.cells.select(F.col("row").alias("k"), "col")
    keys = ["k"]
    if salts > 1:
        left = left.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        keys.append("salt")
    return Matrix(left.join(right, keys).select("row", "col").distinct(), a.meta)


def multiply_blocks(a: Matrix, b: Matrix) -> DataFrame:
    """(brow, bcol, mask) of the product, joined block by block."""
    a.same_space(b)
    left = to_blocks(a).select("brow", F.col("bcol").alias("k"), F.col("mask").alias("ma"))
    right = to_blocks(b).select(F.col("brow").alias("k"), "bcol", F.col("mask").alias("mb"))
    made = left.join(right, "k").select("brow", "bcol", mask_mul(F.col("ma"), F.col("mb")).alias("mask")).where("mask <> 0")
    return made.groupBy("brow", "bcol").agg(F.bit_or("mask").alias("mask"))


def _cells(blocks: DataFrame) -> DataFrame:
    return cells_of_masks(blocks.select(morton(F.col("brow"), F.col("bcol")).alias("key"), "mask"))


def multiply_blocked(a: Matrix, b: Matrix) -> Matrix:
    """As multiply; pays off when ones cluster in blocks."""
    return Matrix(_cells(multiply_blocks(a, b)), a.meta)


def product_flops(a: Matrix, b: Matrix) -> DataFrame:
    """One row: flops, the rows that the product's join makes before repeats go."""
    a.same_space(b)
    left = a.cells.groupBy(F.col("col").alias("k")).agg(F.count(F.lit(1)).alias("na"))
    right = b.cells.groupBy(F.col("row").alias("k")).agg(F.count(F.lit(1)).alias("nb"))
    return left.join(right, "k").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).cast("long").alias("flops"))


def boolean_or(a: Matrix, b: Matrix) -> Matrix:
    """Ones of either matrix."""
    a.same_space(b)
    return Matrix(a.cells.unionByName(b.cells).distinct(), a.meta)


def boolean_or_blocked(a: Matrix, b: Matrix) -> DataFrame:
    """(brow, bcol, mask) of either matrix."""
    a.same_space(b)
    return to_blocks(a).unionByName(to_blocks(b)).groupBy("brow", "bcol").agg(F.bit_or("mask").alias("mask"))


def boolean_and(a: Matrix, b: Matrix) -> Matrix:
    """Extension: ones of both matrices."""
    a.same_space(b)
    return Matrix(a.cells.intersect(b.cells), a.meta)


def boolean_minus(a: Matrix, b: Matrix) -> Matrix:
    """Extension: ones of a that b lacks."""
    a.same_space(b)
    return Matrix(a.cells.join(b.cells, ["row", "col"], "left_anti"), a.meta)
