"""Quadrant tree of a matrix: blocks, levels, sizes, z-order, and a printable dump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.bits import cell_bit, prefix, unmorton
from quadrel.matrix import Matrix
from quadrel.operators.ordering import ordinals


def leaf_masks(m: Matrix) -> DataFrame:
    """(key, mask): the non-empty 2x2 blocks by z-order key, mask 1 to 15."""
    return m.keyed().groupBy(prefix(F.col("key"), 1).alias("key")).agg(F.bit_or(cell_bit(F.col("key"))).alias("mask"))


def to_blocks(m: Matrix) -> DataFrame:
    """(brow, bcol, mask): the non-empty 2x2 blocks; bit 2 * (row % 2) + col % 2."""
    return m.keyed().groupBy(F.shiftright("row", 1).alias("brow"), F.shiftright("col", 1).alias("bcol")).agg(F.bit_or(cell_bit(F.col("key"))).alias("mask"))


def cells_of_masks(masks: DataFrame) -> DataFrame:
    """(row, col) of (key, mask) blocks."""
    bits = masks.select("key", "mask", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b")).where(F.expr("(mask & shiftleft(1L, b)) != 0"))
    row, col = unmorton(F.shiftleft("key", 2).bitwiseOR(F.col("b").cast("long")))
    return bits.select(row.alias("row"), col.alias("col"))


def decode(m: Matrix) -> DataFrame:
    """All ones, by way of the block form and back."""
    return cells_of_masks(leaf_masks(m))


def morton_sorted(m: Matrix) -> DataFrame:
    """(row, col, key) in z-order: range partitions, each sorted."""
    return m.keyed().repartitionByRange("key").sortWithinPartitions("key")


def row_sorted(m: Matrix) -> DataFrame:
    """(row, col) sorted by row, then column: range partitions, each sorted."""
    return m.cells.select("row", "col").repartitionByRange("row", "col").sortWithinPartitions("row", "col")


def nodes(m: Matrix) -> DataFrame:
    """(level, key): non-empty nodes; level 0 is the root, height - 1 the 2x2 blocks."""
    h = m.meta.height
    blocks = m.keyed().select(prefix(F.col("key"), 1).alias("key")).distinct()
    each = blocks.select("key", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("level"))
    up = F.expr(f"shiftright(key, 2 * ({h - 1} - level))")
    return each.select(F.col("level").cast("long").alias("level"), up.alias("key")).distinct()


def nodes_per_level(m: Matrix) -> DataFrame:
    """(level, nodes) of every level that has nodes."""
    return nodes(m).groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))


def _sizes(m: Matrix) -> DataFrame:
    """One row: nodes of the parenthesis tree and leaves.

    The root always stands (one, if the matrix is a grid of squares); each node above the blocks has four children, empty
    ones included; each block counts one more inside.
    """
    last = m.meta.height - 1
    inner, leaf = F.sum(F.when(F.col("level") < last, F.col("nodes"))), F.sum(F.when(F.col("level") == last, F.col("nodes")))
    per = nodes_per_level(m)
    return per.agg((1 + 4 * F.coalesce(inner, F.lit(0)) + F.coalesce(leaf, F.lit(0))).cast("long").alias("nodes"), F.coalesce(leaf, F.lit(0)).cast("long").alias("leaves"))


def node_count(m: Matrix) -> DataFrame:
    """One row: nodes."""
    return _sizes(m).select("nodes")


def nnz(m: Matrix) -> DataFrame:
    """One row: the number of ones."""
    return m.cells.agg(F.count(F.lit(1)).alias("nnz"))


def space_report(m: Matrix) -> DataFrame:
    """One row of raw bit counts: two per node, four per leaf."""
    return _sizes(m).select("nodes", (2 * F.col("nodes")).alias("tree_bits"), "leaves", (4 * F.col("leaves")).alias("leaf_bits"), (2 * F.col("nodes") + 4 * F.col("leaves")).alias("total_bits"))


def info(named: dict[str, Matrix]) -> DataFrame:
    """A row per matrix: n and height (of a square, if it is a grid of squares), nnz, sizes, and thousandths of bits per one and per node."""
    out = None
    for name, m in named.items():
        one = space_report(m).crossJoin(nnz(m)).select(  # one row each
            F.lit(name).alias("name"), F.lit(m.meta.side or m.meta.n).cast("long").alias("n"), F.lit(m.meta.height).cast("long").alias("height"), "nnz", "nodes", "tree_bits", "leaf_bits", "leaves",
            F.expr("CASE WHEN nnz > 0 THEN (1000 * total_bits) div nnz END").alias("millibits_per_one"), F.expr("(1000 * total_bits) div nodes").alias("millibits_per_node"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no matrix")
    return out


def leaf_pair_histogram(m: Matrix) -> DataFrame:
    """(code, cnt): pairs of consecutive leaves in z-order as bytes, the first in the low half; an odd last leaf stands alone."""
    placed = ordinals(leaf_masks(m), "key", "rn")
    pairs = placed.groupBy(F.shiftright("rn", 1).alias("pair")).agg(F.sum(F.when(F.col("rn") % 2 == 0, F.col("mask")).otherwise(16 * F.col("mask"))).alias("code"))
    return pairs.groupBy("code").agg(F.count(F.lit(1)).alias("cnt"))


def verify(m: Matrix, against: DataFrame) -> bool:
    """Whether the ones equal a set of (row, col)."""
    other = against.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct()
    return m.cells.exceptAll(other).isEmpty() and other.exceptAll(m.cells).isEmpty()


#: Leaves a dump may have; it is text for eyes and is built on the driver.
DUMP_LEAVES = 4096


def dump(m: Matrix) -> dict[str, str]:
    """height, parentheses in depth-first order, and leaves (bit 0 first) of a small matrix."""
    masks = {r["key"]: r["mask"] for r in leaf_masks(m).limit(DUMP_LEAVES + 1).collect()}
    if len(masks) > DUMP_LEAVES:
        raise ValueError(f"more than {DUMP_LEAVES} leaves")
    h = m.meta.height
    there = {(level, k >> 2 * (h - 1 - level)) for k in masks for level in range(h)}

    def draw(level: int, key: int) -> str:
        if (level, key) not in there:
            return "()"
        return "(())" if level == h - 1 else "(" + "".join(draw(level + 1, 4 * key + q) for q in range(4)) + ")"

    leaves = " ".join(f"{masks[k]:04b}"[::-1] for k in sorted(masks))
    return {"height": str(h), "tree": draw(0, 0), "leaves": leaves}
