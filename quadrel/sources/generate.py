"""Made-up matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.matrix import Matrix, Meta
from quadrel.storage import materialise

#: Ones of a block of cells on average, and bars of a histogram.
ONES, BINS = 64, 1024


def random_matrix(spark: SparkSession, n: int, density: float, seed: int = 42, mode: str = "exact") -> Matrix:
    """floor(n * n * density) distinct cells ("exact"), or each cell with that probability ("bernoulli").

    Draws are hashes of counters, so a seed gives the same cells on any cluster.
    The work is in proportion to the ones, or to all cells where over half are ones.
    """
    if not 0 <= density <= 1:
        raise ValueError("density must be from 0 to 1")
    cells = n * n
    if mode == "bernoulli":
        at = _bernoulli(spark, cells, density, seed)
    elif mode == "exact":
        m = math.floor(cells * density)
        few = min(m, cells - m)  # a dense matrix is drawn by its zeros
        tries = few + few // 2 + 64
        while True:
            drawn = spark.range(tries).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, cells))).alias("at")).groupBy("at").agg(F.min("id").alias("id"))
            drawn = materialise(drawn, "drawn")
            if few == 0 or drawn.count() >= few:
                break
            tries *= 2
        at = drawn.where(F.col("id") < _cut(drawn, tries, few)).select("at")
        if few < m:
            at = spark.range(cells).select(F.col("id").alias("at")).join(at, "at", "left_anti")
    else:
        raise ValueError(f"no mode {mode}")
    return Matrix(at.select(F.expr(f"at div {n}").alias("row"), (F.col("at") % n).alias("col")), Meta(n))


def _unit(*of: Column) -> Column:
    """A number above 0, up to 1, drawn from the hash of some columns."""
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)) + 1) / float(1 << 52)


def _bernoulli(spark: SparkSession, cells: int, density: float, seed: int) -> DataFrame:
    """(at): each of 0 .. cells - 1 with probability density.

    Sparse ones are found by the gaps between them, in blocks that hold ONES on
    average; a block draws so many gaps that its end is missed with a
    probability below 1e-20.
    """
    if density > 0.5:
        return spark.range(cells).where(_unit(F.col("id"), F.lit(seed)) <= density).select(F.col("id").alias("at"))
    if density == 0:
        return spark.range(0).select(F.col("id").alias("at"))
    size = max(1, round(ONES / density))
    draws = ONES + 10 * math.isqrt(ONES) + 20
    none = F.array().cast("array<bigint>")
    gap = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: F.floor(F.log(_unit(F.col("id"), k, F.lit(seed))) / math.log1p(-density)).cast("long"))
    put = lambda acc, g: F.struct((acc["at"] + g + 1).alias("at"), F.array_append(acc["out"], acc["at"] + g).alias("out"))
    found = F.aggregate(gap, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), put, lambda acc: acc["out"])
    at = spark.range(-(-cells // size)).select("id", F.explode(found).alias("k")).where(F.col("k") < size).select((F.col("id") * size + F.col("k")).alias("at"))
    return at.where(F.col("at") < cells)


def _cut(drawn: DataFrame, end: int, few: int) -> int:
    """The bound below which few of the distinct ids below end lie; a histogram of BINS bars is narrowed round by round."""
    low, need = 0, few
    if few == 0:
        return 0
    while end - low > 1:
        step = -(-(end - low) // BINS)
        bars = drawn.where((F.col("id") >= low) & (F.col("id") < end)).groupBy(F.expr(f"(id - {low}) div {step}").alias("bar")).count().orderBy("bar").collect()
        for bar, n in bars:
            if need <= n:
                low, end = low + bar * step, min(end, low + (bar + 1) * step)
                break
            need -= n
    return low + 1


def from_dense(spark: SparkSession, rows: list[list[int]]) -> Matrix:
    """The ones of a literal square array."""
    n = len(rows)
    if any(len(r) != n for r in rows):
        raise ValueError("not square")
    df = spark.createDataFrame([(r,) for r in [rows]], "m array<array<int>>")
    at = df.select(F.posexplode("m").alias("row", "r")).select("row", F.posexplode("r").alias("col", "v")).where("v <> 0")
    return Matrix.from_df(at.select("row", "col"), n)
