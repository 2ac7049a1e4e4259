"""The catalogue's queries against their SQL where keys go beyond one square of SPACE rows."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from quadrel.plans import catalog

BEYOND = ["node_count", "nodes_per_level", "space_report", "subtree_groups", "subtree_groups_wide", "info", "info_wide"]


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """lineitem, orders and customer with keys in several squares, some shapes repeated from square to square."""
    r, path, db = random.Random(3), tmp_path_factory.mktemp("far"), duckdb.connect()
    rows = [(r.randrange(300), r.randrange(200), r.randrange(60)) for _ in range(150)]
    rows = [(o + i * catalog.SPACE * 3, p + i * catalog.SPACE, s + i * catalog.SPACE // 2) for i in range(4) for o, p, s in rows[: 150 - i]]
    values = lambda rows: ", ".join(map(str, rows))
    made = {
        "lineitem": f"SELECT CAST(o AS BIGINT) AS l_orderkey, CAST(p AS BIGINT) AS l_partkey, CAST(s AS BIGINT) AS l_suppkey, 'R' AS l_returnflag, CAST(46 AS DOUBLE) AS l_quantity FROM (VALUES {values(rows)}) AS t(o, p, s)",
        "orders": f"SELECT CAST(o AS BIGINT) AS o_orderkey, CAST(o // 2 AS BIGINT) AS o_custkey FROM (VALUES {values(sorted({x[:1] for x in rows})).replace(',)', ')')}) AS t(o)",
        "customer": f"SELECT CAST(c AS BIGINT) AS c_custkey, CAST(c % 25 AS INTEGER) AS c_nationkey FROM (VALUES {values(sorted({(x[0] // 2, 0) for x in rows}))}) AS t(c, z)",
    }
    for name, sql in made.items():
        db.execute(f"COPY ({sql}) TO '{path}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return str(path), db


@pytest.mark.parametrize("name", BEYOND)
def test_beyond_one_square(spark, far, name):
    path, db = far
    df = entry.queries()[name](spark, path)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    want = sorted(map(repr, db.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()))
    assert got == want


#: compress_wide and what is made of it; the SQL of the statistics holds for one square only.
COMPRESSED = ["compress_wide", "pointer_leaf_skips_wide", "decode_compressed_wide", "save_load_compressed_wide", "boolean_or_compressed_wide", "multiply_compressed_wide"]


@pytest.mark.parametrize("name", COMPRESSED)
def test_compressed_beyond_one_square(spark, far, name):
    test_beyond_one_square(spark, far, name)


def test_lone_blocks_are_written_once(spark, monkeypatch):
    """Compression writes few rows for each block, not one for each node above it."""
    from quadrel.matrix import Matrix
    from quadrel.operators import compress, ordering

    tags = {}

    def counted(df, tag, *rest, write=compress.materialise, **more):
        out = write(df, tag, *rest, **more)
        tags[tag] = tags.get(tag, 0) + out.count()
        return out

    for module in (compress, ordering):
        monkeypatch.setattr(module, "materialise", counted)
    cells = [(128 * i, 128 * j) for i in range(16) for j in range(16)]
    c = compress.compress(Matrix.from_df(spark.createDataFrame(cells, "row long, col long"), catalog.SPACE))
    assert compress.compression_stats(c).head()["pointers"] > 0
    assert sum(tags.values()) < 5 * len(cells), tags


def test_compressed_queries_go_by_squares(spark, far, monkeypatch):
    """Decoding reads the table once, without writing its cells first, and leaf masks are one row for each square."""
    path, db = far
    monkeypatch.setattr(catalog, "materialise", None)
    test_beyond_one_square(spark, far, "decode_compressed_wide")
    squares, cells = db.execute("SELECT count(DISTINCT (l_orderkey // 1024, l_partkey // 1024)), count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem").fetchone()
    masks = catalog._compressed(spark, path, "op").masks
    assert masks.count() == squares < cells
    assert masks.selectExpr("explode(masks) AS m").selectExpr("sum(bit_count(m))").head()[0] == cells


def test_written_tables_leave_no_shuffle_files(spark):
    """A table that is written keeps its rows only, though its plan is still held."""
    import time

    from pyspark.sql import functions as F
    from quadrel.storage import materialise

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {x for x in found.split() if "/shuffle_" in x}

    before = files()
    df = spark.range(10_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(setting, None)
    assert materialise(df, "counts").count() == 5000 and spark.conf.get(setting, None) == had
    kept = spark.read.parquet(*materialise(df, "again").inputFiles())
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and kept.count() == 5000


def test_only_repeated_shapes_are_looked_up(spark, monkeypatch):
    """Shapes that a single node has meet no other node."""
    from quadrel.matrix import Matrix
    from quadrel.operators import compress

    seen = {}
    monkeypatch.setattr(compress, "materialise", lambda df, tag, write=compress.materialise: seen.setdefault(tag, write(df, tag)))
    cells = [(8 * i + 2 * (i & 1), 8 * i + 2 * j) for i in range(12) for j in range(2)]
    compress.subtree_groups(Matrix.from_df(spark.createDataFrame(cells, "row long, col long"), catalog.SPACE))
    assert 0 < seen["repeated"].count() < seen["nodes"].select("d", "rep").distinct().count()


def test_saved_matrix_stands_alone(spark, far, monkeypatch):
    """Once a compressed matrix is saved, only its file is left."""
    from quadrel import storage

    since, left = storage.mark(), []
    monkeypatch.setattr(catalog.comp, "decode_compressed", lambda c: left.extend(storage._made[since:]) or c.nodes)
    assert catalog.QUERIES["save_load_compressed_wide"](spark, far[0]).count() > 0
    assert len(left) == 1
