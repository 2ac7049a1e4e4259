"""Scratch space in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local-mode session (tests) may lack the setting; it then gets a
    temporary folder.  Elsewhere a missing setting is an error, because a
    machine-local folder would not be visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quadrel-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_made: list[str] = []
_hooked = False


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends, or earlier by release()."""
    global _hooked
    if not _hooked:
        _hooked = True
        atexit.register(_at_exit)
    _made.append(f"{shared_root(spark)}/quadrel-{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def mark() -> int:
    """How many paths this process has made so far: release() can go back to here."""
    return len(_made)


def _delete(paths: list[str], jvm, conf) -> int:
    gone = 0
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete what this process wrote to the shared folder since a mark; call it once results no longer read it."""
    paths = _made[since:]
    del _made[since:]
    return _delete(paths, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())


def _at_exit() -> None:
    """What is left goes when the driver ends, as no result can be read any more."""
    from pyspark import SparkContext

    if _made and SparkContext._jvm is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            context = SparkContext._active_spark_context
            jvm = SparkContext._jvm
            _delete(_made, jvm, context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration())


def materialise(df: DataFrame, tag: str, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """Write df to the shared folder, to path if given, and read it back: cuts lineage, survives lost executors."""
    path = path or scratch(df.sparkSession, tag)
    with _shuffles_go(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """A write in here deletes its shuffle files when it is done; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
