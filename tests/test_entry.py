"""The entry points hold with and without the optional parts."""

import glob
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = ["multiply", "multiply_blocked", "boolean_or", "to_blocks", "nodes_per_level", "leaf_pair_histogram", "compress", "product_flops", "info", "boolean_or_compressed", "row_sorted", "edges_sorted", "logs", "random_matrix_facts", "random_matrix_bernoulli_facts", "dump"]


def test_flagship(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    assert entry.entry(spark).count() == 307


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    want = sorted(map(repr, db.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()))
    assert got == want


def test_without_optional_parts(monkeypatch):
    monkeypatch.setattr(entry, "_has", lambda module: False)
    assert "multiply" in entry.queries() and "pipeline" not in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert not any(n.startswith("op") for n in entry.queries())
    assert "quadrel.storage" in sys.modules


WIDE = ["multiply_salted", "multiply_blocked", "multiply_compressed", "product_flops", "boolean_or", "boolean_or_blocked", "info", "subtree_groups", "compress", "compression_stats", "compressed_info", "pointer_leaf_skips", "decode_compressed", "save_load_compressed"]


@pytest.mark.parametrize("name", WIDE)
def test_whole_tables_against_sql(spark, name):
    """Each operator whose other query is filtered has one on all of lineitem."""
    assert "l_returnflag" not in entry.oracle_sql()[f"{name}_wide"]
    test_against_sql(spark, f"{name}_wide")
