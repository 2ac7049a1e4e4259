"""What the operators of this subpackage share: tables, scratch space, bounded samples."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrel.storage import materialise, scratch

__all__ = ["id_bucket", "labelled_sample", "materialise", "measured", "quoted", "scratch", "small_batches", "table", "tidied", "unused", "with_columns"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side of a join that takes so many bytes at most, as measured, is broadcast; beyond it Spark shuffles.
BROADCAST_BYTES = 16 << 20


def measured(df: DataFrame, tag: str) -> DataFrame:
    """df (numbers, structs of numbers and strings), written to the shared folder, with a hint to broadcast it if it is measured to be small.

    A row counts 128 bytes, what a hash table takes, 16 for each value, and its strings.
    """
    kept = materialise(df, tag)
    values = lambda t: sum(values(f.dataType) for f in t.fields) if isinstance(t, StructType) else 1
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in kept.dtypes if t == "string"]
    size = kept.agg(F.sum(sum(text, F.lit(128 + 16 * values(kept.schema))).cast("long"))).head()[0] or 0
    return F.broadcast(kept) if size <= BROADCAST_BYTES else kept


def quoted(name: str) -> str:
    """A column's name as Spark reads it literally, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, k = f"__quadrel_{stem}", 0
        while name.lower() in taken:
            k += 1
            name = f"__quadrel_{stem}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python in batches of at most so many rows, to bound a worker's memory.

    The setting is read when a plan runs, after the operator has returned, so it
    stays lowered for the session; it is never raised.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


def with_columns(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], names: list[str], types: list[str]) -> DataFrame:
    """df with more columns, of these names and types: for each batch, rows gives their values.

    df's columns pass with whatever names they have; rows finds them as c0, c1, ...
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = StructType([*plain.schema.fields, *StructType.fromDDL(", ".join(f"n{i} {t}" for i, t in enumerate(types))).fields])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept.append(batch)
                yield batch

        for values in rows(noted()):
            batch = kept.pop()
            yield pa.RecordBatch.from_arrays([*batch.columns, *values], [*batch.schema.names, *[f"n{i}" for i in range(len(values))]])

    return plain.mapInArrow(run, schema).toDF(*df.columns, *names)


def tidy() -> None:
    """Hand back what a worker no longer uses: it lives on, and would keep its largest size."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, a function for mapInArrow, that tidies up when its task ends."""

    @functools.wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            tidy()

    return run


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0)).cast("int")


#: Bytes of a text (at most) that is learned from: with a number of rows, this bounds what the driver holds.
SAMPLE_BYTES = 1 << 16


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> list[tuple[str, int]]:
    """(text, quality) of at most per_class labelled rows of each class, of up to SAMPLE_BYTES each, the same rows on every run.

    The ids are chosen on the narrow label table by a hash order; only those
    (2 * per_class at most) are then looked up among the documents.
    """
    ids = None
    for value in (0, 1):
        part = (
            labels.where((F.col("quality") == value) & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.min("quality").alias("quality"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        )
        ids = part if ids is None else ids.unionByName(part)
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(ids), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "text").limit(2 * per_class).collect()
    )
    return [(r["text"], int(r["quality"])) for r in rows]
