"""Edge lists as text, matrices and compressed matrices as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.matrix import Matrix, Meta
from quadrel.operators.compress import Compressed
from quadrel.operators.tree import morton_sorted, row_sorted
from quadrel.storage import materialise


def read_edges(spark: SparkSession, path: str, n: int | None = None, expected: int | None = None) -> Matrix:
    """A text file of "row col" lines, white space between.  A malformed line fails the query.

    expected: the number of lines there must be (one job); blank lines don't count.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    ok = F.col("value").rlike(r"^\s*[0-9]+\s+[0-9]+\s*$")
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("long")
    cells = lines.select(F.when(ok, parts[0].cast("long")).otherwise(bad).alias("row"), parts[1].cast("long").alias("col"))
    if expected is not None and (found := cells.count()) != expected:
        raise ValueError(f"{path} has {found} lines, not {expected}")
    return Matrix.from_df(cells, n)


def write_edges(m: Matrix, path: str) -> None:
    """The ones as "row col" lines, sorted by row, then column, from file to file in the order of their names."""
    row_sorted(m).select(F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"))).write.text(path)


def _write_meta(spark: SparkSession, meta: Meta, path: str) -> None:
    spark.range(1).select(F.lit(meta.n).cast("long").alias("n"), F.lit(meta.height).alias("height"), F.lit(meta.side).cast("long").alias("side")).coalesce(1).write.json(f"{path}/meta")


def _read_meta(spark: SparkSession, path: str) -> Meta:
    return Meta(*spark.read.schema("n long, side long").json(f"{path}/meta").head())


def save(m: Matrix, path: str) -> None:
    """Parquet in z-order, so that row-group statistics skip empty quadrants, and metadata beside it."""
    morton_sorted(m).write.parquet(f"{path}/cells")
    _write_meta(m.cells.sparkSession, m.meta, path)


def load(spark: SparkSession, path: str) -> Matrix:
    return Matrix(spark.read.parquet(f"{path}/cells").select("row", "col"), _read_meta(spark, path))


def load_keyed(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, key) of a saved matrix: filters on key reach the scan."""
    return spark.read.parquet(f"{path}/cells")


def save_compressed(c: Compressed, path: str) -> None:
    """Node table by level, leaf masks by square, metadata."""
    # Written first, as ranges are read twice, for their bounds too.
    materialise(c.tree, "tree").repartitionByRange("level", "key").write.partitionBy("level").parquet(f"{path}/tree")
    c.masks.write.parquet(f"{path}/masks")
    _write_meta(c.nodes.sparkSession, c.meta, path)


def load_compressed(spark: SparkSession, path: str) -> Compressed:
    tree = spark.read.schema("key long, rep long, size long, leaves long, pruned boolean, target_code long, level long").parquet(f"{path}/tree")
    nodes = tree.select("level", "key", "rep", "size", "leaves", "pruned")
    return Compressed(nodes, lambda: tree.select(*nodes.columns, "target_code"), lambda: spark.read.parquet(f"{path}/masks"), _read_meta(spark, path))
