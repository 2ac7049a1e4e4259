"""Sharing of identical quadrants.

Two nodes of a level have the same shape if their four children have the same
shapes.  A shape's representative is its first node in z-order.  Nodes that
repeat a representative become pointers, if their parenthesis string is longer
than a pointer costs; only topology is shared, all leaf masks stay, in z-order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.functions.bits import ceil_log2, prefix
from quadrel.matrix import Matrix, Meta
from quadrel.operators.ordering import ordinals, prefix_sums
from quadrel.operators.product import multiply
from quadrel.operators.tree import DUMP_LEAVES, cells_of_masks
from quadrel.storage import materialise


@dataclass(frozen=True)
class Compressed:
    """nodes: (level, key, rep, size, leaves, pruned) of the nodes not below a pointer.

    Made when asked for: tree, the nodes with the pointers' target_code, and
    masks: (ordinal, masks), the leaves of each square in z-order, and how many
    are ahead of them.
    """

    nodes: DataFrame
    coded: Callable[[], DataFrame]
    ends: Callable[[], DataFrame]
    meta: Meta

    @cached_property
    def tree(self) -> DataFrame:
        return self.coded()

    @cached_property
    def masks(self) -> DataFrame:
        return self.ends()


#: Levels of a square that one task holds whole.
TIER = 9
#: Rows of a few numbers that are broadcast.
SMALL = 200_000


def numbered(df: DataFrame, h: int) -> DataFrame:
    """df with each key's place in z-order from 0 on, as ordinal: a count within its square, and one offset per square."""
    p = prefix(F.col("key"), min(h - 1, TIER)).alias("p")
    count = df.groupBy(p).agg(F.count(F.lit(1)).alias("n"))
    offset = prefix_sums(count, "p", "n", "before").select("p", "before")
    placed = df.select("*", p).repartition("p").withColumn("no", F.row_number().over(Window.partitionBy("p").orderBy("key")))  # at most 4 ** TIER blocks
    return placed.join(offset, "p").select(*df.columns, (F.col("before") + F.col("no") - 1).alias("ordinal"))


def _in_squares(df: DataFrame, h: int, value: Column) -> DataFrame:
    """(p, ordinal, v): each square's values (int) of df's keys, sorted, and how many are ahead of them in z-order."""
    t = str(min(h - 1, TIER))
    each = df.select(_up("key", t).alias("p"), value.alias("v")).repartition("p").groupBy("p").agg(F.sort_array(F.collect_list("v")).alias("v"))  # at most 4 ** TIER blocks
    each = materialise(each.select("p", F.size("v").cast("long").alias("n"), "v"), "squares")
    offset = prefix_sums(each.select("p", "n"), "p", "n", "ordinal").select("p", "ordinal")
    return each.join(offset, "p").select("p", "ordinal", "v")


def _masks_in_squares(blocks: DataFrame, h: int) -> DataFrame:
    """(ordinal, masks) of (key, mask) blocks."""
    rel = _inside("key", str(min(h - 1, TIER))).cast("int")
    placed = _in_squares(blocks, h, F.shiftleft(rel, 4).bitwiseOR(F.col("mask").cast("int")))
    return placed.select("ordinal", F.transform("v", lambda x: x.bitwiseAND(F.lit(15)).cast("tinyint")).alias("masks"))


def _meet(a: Column, b: Column) -> Column:
    """How many levels up two different keys of a square of TIER levels first share a node; exact, as half is no power of two."""
    return (F.floor(F.log2(a.bitwiseXOR(b) + F.lit(0.5)) / 2) + 1).cast("int")


def _up(key: str, d: str) -> Column:
    return F.expr(f"shiftright({key}, cast(2 * ({d}) AS INT))")


def _inside(key: str, d: str) -> Column:
    """A key relative to its ancestor d levels up."""
    return F.expr(f"{key} & (shiftleft(1L, cast(2 * ({d}) AS INT)) - 1)")


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows; for a table of a few numbers a row that has been written."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


@dataclass(frozen=True)
class _Shapes:
    """d counts levels from the blocks up; t: levels of the lower part.

    blocks: (key, alone, mask): the levels up to which a block stands alone in its
    nodes; nodes: (d, key, rep, leaves, size) of all nodes above the blocks but
    those with one block up to t; chains: (d, in, rep) of the latter, by the
    block's key relative to the node; groups: (alone, in, first, repeated, rep,
    top) of blocks alone as far and alike so far: the first of them, up to where
    it repeats others and whom there, and whom all others repeat.
    """

    blocks: DataFrame
    nodes: DataFrame
    chains: DataFrame
    groups: DataFrame
    t: int


def _shapes(m: Matrix) -> _Shapes:
    """All nodes with their representatives.

    A node's shape is the set of its blocks' keys relative to it, known by its
    number of blocks and two xors of hashes; that of a node with one block is
    the key itself.  A task holds squares of TIER levels, so a block meets its
    neighbours in z-order there, and only nodes with more blocks than one are
    gathered.  Nodes above are made of the squares' shapes.  The cells are read
    once, and may repeat.
    """
    h = m.meta.height
    t = min(h - 1, TIER)
    cells = m.keyed().select("key", prefix(F.col("key"), t + 1).alias("p")).repartition("p").select("p", prefix(F.col("key"), 1).alias("key"), F.expr("shiftleft(1, cast(key & 3 AS INT))").alias("bit"))
    near = Window.partitionBy("p").orderBy("key")  # at most 4 ** (TIER + 1) different cells
    # The first cell of each block, with the bits of all of them; the cell ahead is of the block ahead.
    blocks = cells.select("p", "key", F.lag("key").over(near).alias("ahead"), F.bit_or("bit").over(near.rangeBetween(Window.currentRow, Window.currentRow)).alias("mask")).where("ahead IS NULL OR ahead <> key")
    meet = lambda other: F.coalesce(_meet(F.col("key"), other), F.lit(t + 1))
    placed = blocks.select("p", "key", "mask", meet(F.col("ahead")).alias("up"), meet(F.lead("key").over(near)).alias("down")).select("p", "key", "mask", "up", (F.least("up", "down") - 1).alias("alone"))
    # The block itself, and all nodes of the square that it shares.
    each = placed.select("*", F.explode(F.expr(f"if(alone < {t}, concat(array(0), sequence(alone + 1, {t})), array(0))")).alias("d"))
    hashed = lambda k: F.bit_xor(F.xxhash64(_inside("key", "d"), F.lit(k)))
    # A node has as many inner nodes as its blocks are first in: the first is in d, others are first below where they meet the one ahead.
    tier = each.groupBy("p", "d", _up("key", "d").alias("node")).agg(
        F.count(F.lit(1)).alias("leaves"), F.sum(F.least(F.col("up") - 1, F.col("d"))).alias("inner"), hashed(1).alias("x"), hashed(2).alias("y"), F.max("alone").alias("alone"), F.max("mask").alias("mask"))
    tier = materialise(tier.select("d", F.col("node").alias("key"), "leaves", "inner", "x", "y", "alone", F.col("mask").cast("tinyint").alias("mask")), "tier")
    blocks = tier.where("d = 0").select("key", "alone", "mask")
    nodes = tier.where("d >= 1").select("d", "key", "leaves", "inner", "x", "y")
    if h - 1 > t:
        alone = blocks.where(F.col("alone") == t).select(F.lit(t).alias("d"), _up("key", str(t)).alias("key"), F.lit(1).cast("long").alias("leaves"), F.lit(t).cast("long").alias("inner"), _inside("key", str(t)).alias("in"))
        roots = nodes.where(F.col("d") == t).unionByName(alone.select("d", "key", "leaves", "inner", F.xxhash64("in", F.lit(1)).alias("x"), F.xxhash64("in", F.lit(2)).alias("y")))
        above = roots.drop("d").select("*", F.explode(F.sequence(F.lit(t + 1), F.lit(h - 1))).alias("d"))
        mixed = lambda k: F.bit_xor(F.xxhash64(_inside("key", f"d - {t}"), "leaves", "x", "y", F.lit(k)))
        upper = materialise(above.groupBy("d", _up("key", f"d - {t}").alias("node")).agg(
            F.sum("leaves").alias("leaves"), F.sum("inner").alias("inner"), mixed(1).alias("x"), mixed(2).alias("y")).withColumnRenamed("node", "key"), "upper")
        own = upper.select("key", "d", F.explode(F.sequence(F.col("d"), F.lit(h - 1))).alias("e")).groupBy(F.col("e").alias("d"), _up("key", "e - d").alias("node")).agg(F.count(F.lit(1)).alias("own"))
        upper = upper.join(own.withColumnRenamed("node", "key"), ["d", "key"]).withColumn("inner", F.col("inner") + F.col("own"))
        nodes = nodes.unionByName(upper.select("d", "key", "leaves", "inner", "x", "y"))
    # Only shapes that are found again are looked up, by two numbers; most others have no second node.
    nodes = nodes.select("d", "key", "leaves", "inner", F.xxhash64("x", "d", "leaves").alias("x"), "y")
    reps = materialise(nodes.groupBy("x", "y").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y", "rep"), "repeated")
    size = (2 + 8 * F.col("inner") + 2 * F.col("leaves")).alias("size")
    nodes = nodes.select("d", "key", "leaves", size, "x", "y").join(reps, ["x", "y"], "left").select("d", "key", F.coalesce("rep", "key").alias("rep"), "leaves", "size")
    nodes = materialise(nodes, "nodes")
    # Whatever repeats a shape, all below it does too: so a block that isn't the first of its group repeats it as far as it is alone.
    groups = materialise(blocks.where("alone >= 1").groupBy("alone", _inside("key", "alone").alias("in")).agg(F.min("key").alias("first")), "groups")
    links = groups.select("alone", "in", "first", F.explode(F.expr("sequence(1, alone)")).alias("d")).withColumn("low", _inside("in", "d"))
    chains = materialise(links.groupBy("d", F.col("low").alias("in")).agg(F.min(_up("first", "d")).alias("rep")), "chains")
    linked = links.join(chains.withColumnRenamed("in", "low"), ["d", "low"])
    old = F.when(F.col("rep") != _up("first", "d"), F.col("d"))
    groups = materialise(linked.groupBy("alone", "in", "first").agg(F.coalesce(F.max(old), F.lit(0)).alias("repeated"), F.max_by("rep", old).alias("rep"), F.max_by("rep", "d").alias("top")), "chain-groups")
    return _Shapes(blocks, nodes, chains, groups, t)


def subtree_groups(m: Matrix) -> DataFrame:
    """(level, key, rep, size, leaves) of every non-empty node.

    rep: first key of equal shape on the level (0 for blocks, which are all
    alike); size: length of the node's parenthesis string, two for itself, eight
    for each node above the blocks, two for each block; leaves: 2x2 blocks below.
    """
    s, h = _shapes(m), m.meta.height
    level = (F.lit(h - 1) - F.col("d")).cast("long").alias("level")
    one = F.lit(1).cast("long").alias("leaves")
    links = s.blocks.where("alone >= 1").select("key", F.explode(F.expr("sequence(1, alone)")).alias("d")).select("d", _up("key", "d").alias("key"), _inside("key", "d").alias("in"))
    alone = links.join(_small(s.chains), ["d", "in"]).select(level, "key", "rep", (4 + 8 * F.col("d")).cast("long").alias("size"), one)
    ends = s.blocks.select(F.lit(h - 1).cast("long").alias("level"), "key", F.lit(0).cast("long").alias("rep"), F.lit(4).cast("long").alias("size"), one)
    return s.nodes.select(level, "key", "rep", "size", "leaves").unionByName(alone).unionByName(ends)


def _ranked(s: _Shapes, h: int) -> DataFrame:
    """(d, key, alone, at, node, rep, size, leaves, under) of nodes, and of blocks with the nodes where they are alone.

    at, node: the node itself, or the highest of a block's that repeats another
    (its own level, if none does); rep, size and leaves are that node's; under:
    size of the highest node above that repeats another, or null.  Rows that a
    pointer covers whatever the threshold are left out.
    """
    t, repeats = s.t, F.col("rep") != F.col("key")
    # Above the squares, the highest of all repeating ancestors; what repeats another has only such nodes below.
    upper = s.nodes.where(F.col("d") > t)
    again = upper.where(repeats)
    high = again.select("d", "key", F.explode(F.sequence(F.col("d"), F.lit(h - 1))).alias("e")).select("d", "key", "e", _up("key", "e - d").alias("above"))
    high = high.join(again.select(F.col("d").alias("e"), F.col("key").alias("above"), "size"), ["e", "above"]).groupBy("d", "key").agg(F.max_by("size", "e").alias("under"))
    high = materialise(high.select((F.col("d") - 1).alias("d"), F.col("key").alias("parent"), "under"), "repeating")
    upper = upper.withColumn("parent", F.shiftright("key", 2)).join(high, ["d", "parent"], "left").select("d", "key", F.lit(None).cast("int").alias("alone"), F.col("d").alias("at"), F.col("key").alias("node"), "rep", "size", "leaves", "under")
    # In a square, nodes in z-order, larger ones first: what the furthest end so far of a repeating node lies behind is below it.
    # What a block or a node's kind tells goes into one number, and is told apart again when the square is done.
    inner = s.nodes.where(F.col("d") <= t).select(_up("key", f"{t} - d").alias("p"), "key", F.col("d").cast("int").alias("kind"), "rep", "size", "leaves")
    ends = s.blocks.withColumn("in", _inside("key", "alone")).join(_small(s.groups), ["alone", "in"], "left")
    first = F.col("first") == F.col("key")
    ends = ends.select("key", "alone", F.when(first, F.col("repeated")).otherwise(F.col("alone")).alias("at"), F.when(first, F.col("rep")).otherwise(F.col("top")).alias("rep"))
    none = F.lit(None).cast("long")
    ends = ends.select(_up("key", str(t)).alias("p"), "key", F.expr("cast(shiftleft(alone, 5) | shiftleft(at, 10) AS INT)").alias("kind"), F.coalesce("rep", F.lit(0)).alias("rep"), none.alias("size"), none.alias("leaves"))
    square = inner.unionByName(ends).repartition("p").join(_small(high.where(F.col("d") == t).select(F.col("parent"), F.col("under").alias("over"))), F.shiftright("p", 2) == F.col("parent"), "left")
    d = "(kind & 31)"
    start = F.expr(f"shiftleft(key, 2 * {d}) - shiftleft(p, {2 * t})")
    order = Window.partitionBy("p").orderBy(start * 16 + (15 - F.expr(d))).rowsBetween(Window.unboundedPreceding, -1)  # at most 4 ** (TIER + 1) nodes
    end = F.when(F.expr(f"{d} > 0") & repeats, F.expr(f"shiftleft(shiftleft(key + 1, 2 * {d}) - shiftleft(p, {2 * t}), 40) | size"))
    square = square.withColumn("last", F.max(end).over(order))
    below = F.when(F.shiftright("last", 40) > start, F.expr("last & (shiftleft(1L, 40) - 1)"))
    square = square.select(F.expr(d).alias("d"), "key", F.expr(f"if({d} = 0, shiftright(kind, 5) & 31, NULL)").alias("alone"), F.expr(f"if({d} = 0, shiftright(kind, 10), {d})").alias("at"), "rep", "size", "leaves", F.coalesce("over", below).alias("under"))
    square = square.select("d", "key", "alone", "at", _up("key", "if(d = 0, at, 0)").alias("node"), "rep", F.coalesce("size", (4 + 8 * F.col("at")).cast("long")).alias("size"), F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), "under")
    return materialise(upper.unionByName(square).where(F.col("under").isNull() | (F.col("under") <= 4 + 64)), "ranked")


def compress(m: Matrix) -> Compressed:
    """Share identical quadrants; a pointer must save more than it costs (threshold from the number of targets)."""
    h = m.meta.height
    s = _shapes(m)
    ranked = _ranked(s, h)
    repeats = (F.col("at") >= 1) & (F.col("rep") != F.col("node")) & F.col("under").isNull()
    w = ranked.where(repeats).select("at", "rep").distinct().count()
    threshold = 4 + ceil_log2(w - 1)
    points = repeats & (F.col("size") > threshold)
    alive = ranked.where(F.col("under").isNull() | (F.col("under") <= threshold)).withColumn("pruned", points)
    level = (F.lit(h - 1) - F.col("d")).cast("long").alias("level")
    nodes = alive.where("alone IS NULL").select(level, "key", "rep", "size", "leaves", "pruned")
    ends = alive.where("alone IS NOT NULL").select("key", "alone", "at", "rep", "pruned")
    # A block's own nodes from its pointer or itself on; the representatives of those that repeat another but are too small to point are looked up.
    of = F.expr("sequence(if(pruned, at, 0), alone)")
    each = ends.select("key", "at", "rep", "pruned", F.explode(of).alias("d"))
    known = F.when(F.col("d") == 0, F.lit(0).cast("long")).when(F.col("d") == F.col("at"), F.col("rep")).otherwise(_up("key", "d"))
    chain = lambda df, rep: df.select(level, _up("key", "d").alias("key"), rep.alias("rep"), (4 + 8 * F.col("d")).cast("long").alias("size"), F.lit(1).cast("long").alias("leaves"), (F.col("pruned") & (F.col("d") == F.col("at"))).alias("pruned"))
    low = each.where("d >= 1 AND d < at").withColumn("in", _inside("key", "d")).drop("rep").join(_small(s.chains), ["d", "in"])
    rows = nodes.unionByName(chain(each.where("d = 0 OR d >= at"), known)).unionByName(chain(low, F.col("rep")))

    def coded() -> DataFrame:
        # Targets in depth-first order get codes 0, 1, ...; one task per range, not one for all.
        target = ranked.where(points).select((F.lit(h - 1) - F.col("at")).cast("long").alias("level"), "rep").distinct()
        codes = ordinals(target.withColumn("__first", F.expr(f"shiftleft(rep, cast(2 * ({h} - level) AS INT)) * 64L + level")), "__first", "target_code").select("level", "rep", "target_code")
        # Codes meet the pointers only, not all nodes.
        rest = rows.where(~F.col("pruned")).withColumn("target_code", F.lit(None).cast("long"))
        return rows.where("pruned").join(codes, ["level", "rep"]).unionByName(rest).select("level", "key", "rep", "size", "leaves", "pruned", "target_code")

    return Compressed(rows, coded, lambda: _masks_in_squares(s.blocks.select("key", "mask"), h), m.meta)


def compression_stats(c: Compressed) -> DataFrame:
    """One row: pointers, targets, pruned_tree_bits."""
    p = F.col("pruned")
    return c.nodes.where(p | (F.col("level") == 0)).agg(
        F.coalesce(F.sum(p.cast("long")), F.lit(0)).cast("long").alias("pointers"),
        F.count_distinct(F.when(p, F.struct("level", "rep"))).alias("targets"),
        (F.coalesce(F.sum(F.when(F.col("level") == 0, F.col("size"))), F.lit(2)) - F.coalesce(F.sum(F.when(p, F.col("size") - 4)), F.lit(0))).cast("long").alias("pruned_tree_bits"))


def compressed_info(c: Compressed) -> DataFrame:
    """One row: nnz, and the raw bit counts of the pruned tree, the leaves and the pointers."""
    ones = c.masks.select(F.explode("masks").alias("mask")).agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).cast("long").alias("nnz"), F.count(F.lit(1)).alias("leaves"))
    both = compression_stats(c).crossJoin(ones)  # one row each
    return both.select("nnz", F.expr("pruned_tree_bits div 2").alias("nodes"), F.col("pruned_tree_bits").alias("tree_bits"), "leaves", (4 * F.col("leaves")).alias("leaf_bits"), "pointers", "targets")


def dump_compressed(c: Compressed) -> dict[str, str]:
    """The pruned tree's parentheses, and its pointers' target codes in order, of a small matrix."""
    found = c.tree.select("level", "key", "pruned", "target_code").limit(4 * DUMP_LEAVES + 1).collect()
    if len(found) > 4 * DUMP_LEAVES:
        raise ValueError(f"more than {4 * DUMP_LEAVES} nodes")
    h, there = c.meta.height, {(r["level"], r["key"]): r["target_code"] if r["pruned"] else None for r in found}
    codes: list[str] = []

    def draw(level: int, key: int) -> str:
        if (level, key) not in there:
            return "()"
        if there[level, key] is not None:
            codes.append(str(there[level, key]))
            return "(())"
        return "(())" if level == h - 1 else "(" + "".join(draw(level + 1, 4 * key + q) for q in range(4)) + ")"

    return {"tree": draw(0, 0), "pointers": " ".join(codes)}


def pointer_leaf_skips(c: Compressed) -> DataFrame:
    """(level, key, leaf_bits, skipped_bits): leaf bits below each pointer, and below it and all earlier pointers."""
    h = c.meta.height
    p = c.nodes.where("pruned").select("level", "key", (4 * F.col("leaves")).alias("leaf_bits"), F.expr(f"shiftleft(key, cast(2 * ({h} - level) AS INT))").alias("__first"))
    return prefix_sums(p, "__first", "leaf_bits", "skipped_bits", before=False).drop("__first")


def _below(items: DataFrame, targets: DataFrame, h: int) -> DataFrame:
    """Those items (level, key and more) that lie in some target (tl, tk), told without trying all their ancestors."""
    t = min(h - 1, TIER)
    d = F.lit(h - 1) - F.col("level")
    # In a square, in z-order and larger ones first, they lie ahead of the furthest end of a target so far.
    marks = targets.select(F.col("tl").alias("level"), F.col("tk").alias("key"), F.lit(True).alias("target"))
    both = items.withColumn("target", F.lit(False)).unionByName(marks, allowMissingColumns=True).withColumn("d", d).where(F.col("d") <= t).withColumn("p", _up("key", f"{t} - d"))
    order = Window.partitionBy("p").orderBy(F.expr("shiftleft(key, cast(2 * d AS INT))"), F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)  # nodes of one square
    last = F.max(F.when(F.col("target"), F.expr("shiftleft(key + 1, cast(2 * d AS INT))"))).over(order)
    told = both.repartition("p").withColumn("last", last).where(~F.col("target")).withColumn("low", F.coalesce(F.col("last") > F.expr("shiftleft(key, cast(2 * d AS INT))"), F.lit(False)))
    large = targets.where(F.col("tl") < h - 1 - t)
    if large.isEmpty():
        return told.where("low").select(*items.columns)
    # Targets above the squares: by the squares that they hold.
    roots = both.where(~F.col("target")).select("p").distinct().select("p", F.explode(F.sequence(F.lit(t + 1), F.lit(h - 1))).alias("e"))
    roots = roots.select("p", (F.lit(h - 1) - F.col("e")).cast("long").alias("tl"), _up("p", f"e - {t}").alias("tk")).join(large, ["tl", "tk"], "left_semi").select("p").distinct().withColumn("held", F.lit(True))
    upper = items.where(d > t)
    return told.join(roots, "p", "left").where("low OR held").select(*items.columns).unionByName(upper)


def decoded_masks(c: Compressed) -> DataFrame:
    """(key, mask) of all blocks: leaves of the pruned tree, and those that pointers stand for.

    What lies below the targets (leaves and further pointers) is completed
    first, in as many rounds as pointers nest; then each pointer gets its
    target's leaves at once.  Leaf masks follow in z-order, square by square.
    """
    h = c.meta.height
    items = c.nodes.where(F.col("pruned") | (F.col("level") == h - 1)).select("level", "key", "rep", "pruned")
    items = materialise(items, "pruned-tree")
    pointers = items.where("pruned").select(F.col("level").alias("tl"), F.col("rep").alias("tk"), "key")
    targets = materialise(pointers.select("tl", "tk").distinct(), "targets")
    up = _below(items, targets, h).select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("d")).where("d <= level")
    up = up.select((F.col("level") - F.col("d")).alias("tl"), _up("key", "d").alias("tk"), "level", F.col("key").alias("item"), "rep", "pruned")
    below = materialise(up.join(targets, ["tl", "tk"], "left_semi"), "below-targets")
    leaves = [below.where(~F.col("pruned")).select("tl", "tk", "item")]
    inner, of = below.where("pruned"), below.select(F.col("tl").alias("level"), F.col("tk").alias("rep"), F.col("level").alias("l"), F.col("item").alias("i"), F.col("rep").alias("r"), F.col("pruned").alias("more"))
    for _ in range(h):
        if inner.isEmpty():
            break
        moved = F.expr("shiftleft(item, cast(2 * (l - level) AS INT)) | (i & (shiftleft(1L, cast(2 * (l - level) AS INT)) - 1))")
        got = inner.select("tl", "tk", "level", "item", "rep").join(of, ["level", "rep"])
        got = materialise(got.select("tl", "tk", F.col("l").alias("level"), moved.alias("item"), F.col("r").alias("rep"), F.col("more").alias("pruned")), "completed")
        leaves.append(got.where(~F.col("pruned")).select("tl", "tk", "item"))
        inner = got.where("pruned")
    ends = _small(reduce(DataFrame.unionByName, leaves))
    moved = F.expr(f"shiftleft(key, cast(2 * ({h - 1} - tl) AS INT)) | (item & (shiftleft(1L, cast(2 * ({h - 1} - tl) AS INT)) - 1))")
    keys = items.where(~F.col("pruned")).select("key").unionByName(pointers.join(ends, ["tl", "tk"]).select(moved.alias("key")))
    t = min(h - 1, TIER)
    squares = _in_squares(keys, h, _inside("key", str(t)).cast("int"))
    zipped = squares.join(c.masks, "ordinal").select("p", F.inline(F.arrays_zip(F.col("v"), F.col("masks").alias("mask"))))
    return zipped.select(F.shiftleft("p", 2 * t).bitwiseOR(F.col("v").cast("long")).alias("key"), F.col("mask").cast("long").alias("mask"))


def decode_compressed(c: Compressed) -> DataFrame:
    """(row, col) of all ones."""
    return cells_of_masks(decoded_masks(c))


def or_compressed(a: Compressed, b: Compressed) -> Matrix:
    """Ones of either compressed matrix, block by block, as an uncompressed matrix."""
    if a.meta.n != b.meta.n:
        raise ValueError(f"matrices of different size: {a.meta.n} and {b.meta.n}")
    both = decoded_masks(a).unionByName(decoded_masks(b)).groupBy("key").agg(F.bit_or("mask").alias("mask"))
    return Matrix(cells_of_masks(both), a.meta)


def multiply_compressed(a: Compressed, b: Compressed) -> Matrix:
    """Product of two compressed matrices, as an uncompressed one."""
    return multiply(Matrix(decode_compressed(a), a.meta), Matrix(decode_compressed(b), b.meta))
