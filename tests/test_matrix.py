"""The matrix engine against brute force, fixtures and edge cases."""

import itertools
import random

import pytest

from quadrel.functions.bits import ceil_log2, mask_mul
from quadrel.matrix import Matrix
from quadrel.operators import compress as comp
from quadrel.operators import product, tree
from quadrel.sources import files, generate

# Two literal 16 x 16 matrices.
F1 = [(0, 1), (0, 2), (0, 3), (0, 12), (0, 14), (2, 3), (4, 4), (8, 4), (8, 8), (8, 10), (8, 11), (9, 6), (9, 9), (9, 10), (9, 11), (10, 10), (12, 13)]
F2 = [(0, 1), (0, 2), (0, 3), (0, 12), (0, 14), (2, 3), (4, 4), (8, 4), (8, 6), (8, 9), (8, 10), (8, 11), (10, 11), (12, 12)]


def made(spark, cells, n=None):
    return Matrix.from_df(spark.createDataFrame(cells, "row long, col long"), n)


def ones(df):
    return sorted((r["row"], r["col"]) for r in df.collect())


def times(a, b):
    return sorted({(i, j) for i, k in a for k2, j in b if k == k2})


def rand(n, p, seed):
    r = random.Random(seed)
    return [(i, j) for i in range(n) for j in range(n) if r.random() < p]


@pytest.mark.parametrize("cells, leaves", [
    (F1, "0100 1100 0100 1000 1000 1000 1000 0010 1001 1111 1000 0100"),
    (F2, "0100 1100 0100 1000 1000 1000 1000 1000 0100 1100 0100 1000"),
])
def test_fixture(spark, cells, leaves):
    m = made(spark, cells, 16)
    got = tree.space_report(m).head()
    assert (got["nodes"], got["tree_bits"], got["leaves"], got["leaf_bits"]) == (57, 114, 12, 48)
    text = tree.dump(m)
    assert text["leaves"] == leaves and text["height"] == "4" and len(text["tree"]) == 114
    assert ones(tree.decode(m)) == sorted(cells)
    c = comp.compress(m)
    assert tuple(comp.compression_stats(c).head()) == (2, 2, 66)
    assert ones(comp.decode_compressed(c)) == sorted(cells)
    drawn = comp.dump_compressed(c)
    assert drawn["tree"] == "((((())(())()(()))()()((())()()()))(()((())(())()())()())(())(()))" and sorted(drawn["pointers"].split()) == ["0", "1"]
    got = comp.compressed_info(c).head()
    assert (got["nnz"], got["nodes"], got["tree_bits"], got["leaf_bits"], got["pointers"]) == (len(cells), 33, 66, 48, 2)


def test_release(spark):
    from quadrel import storage

    kept = storage.materialise(spark.range(3).toDF("x"), "release")
    assert kept.count() == 3
    begun = storage.mark()
    other = storage.materialise(spark.range(2).toDF("x"), "release")
    assert other.count() == 2 and storage.release(spark, begun) == 1 and kept.count() == 3
    assert storage.release(spark) >= 1 and storage.release(spark) == 0


def test_products_agree(spark):
    a, b = rand(24, 0.08, 1), rand(24, 0.08, 2)
    ma, mb = made(spark, a, 24), made(spark, b, 24)
    want = times(a, b)
    assert ones(product.multiply(ma, mb).cells) == want
    assert ones(product.multiply(ma, mb, salts=3).cells) == want
    assert ones(product.multiply_blocked(ma, mb).cells) == want
    assert ones(comp.multiply_compressed(comp.compress(ma), comp.compress(mb)).cells) == want
    assert product.product_flops(ma, mb).head()[0] == sum(k == k2 for _, k in a for k2, _ in b)


def test_algebra(spark):
    a, b, c = (made(spark, rand(16, 0.1, s), 16) for s in (3, 4, 5))
    eye = made(spark, [(i, i) for i in range(16)], 16)
    mul = product.multiply
    assert ones(mul(mul(a, b), c).cells) == ones(mul(a, mul(b, c)).cells)
    assert ones(mul(a, product.boolean_or(b, c)).cells) == ones(product.boolean_or(mul(a, b), mul(a, c)).cells)
    assert ones(mul(a, eye).cells) == ones(a.cells)
    assert ones(mul(a, b).transpose().cells) == ones(mul(b.transpose(), a.transpose()).cells)
    assert set(ones(product.boolean_and(a, b).cells)) == set(ones(a.cells)) & set(ones(b.cells))
    assert set(ones(product.boolean_minus(a, b).cells)) == set(ones(a.cells)) - set(ones(b.cells))


def test_compressed_round_trips(spark):
    for seed, n, p in ((7, 64, 0.02), (8, 40, 0.3)):
        cells = rand(n, p, seed) + [(i, (3 * i) % n) for i in range(n)]
        m = made(spark, cells, n)
        c = comp.compress(m)
        assert ones(comp.decode_compressed(c)) == sorted(set(cells))
    regular = [(8 * i + x, 8 * j + y) for i in range(4) for j in range(4) for x, y in ((0, 0), (5, 2), (7, 7))]
    c = comp.compress(made(spark, regular, 32))
    assert comp.compression_stats(c).head()["pointers"] > 0
    assert ones(comp.decode_compressed(c)) == sorted(regular)
    skips = comp.pointer_leaf_skips(c).orderBy("skipped_bits").collect()
    assert [r["skipped_bits"] for r in skips] == list(itertools.accumulate(r["leaf_bits"] for r in skips))


def test_masks(spark):
    def slow(a, b):
        bit = lambda m, i, j: m >> (2 * i + j) & 1
        return sum((bit(a, i, 0) & bit(b, 0, j) | bit(a, i, 1) & bit(b, 1, j)) << (2 * i + j) for i in (0, 1) for j in (0, 1))

    df = spark.createDataFrame([(a, b) for a in range(16) for b in range(16)], "a long, b long")
    assert all(r["c"] == slow(r["a"], r["b"]) for r in df.select("a", "b", mask_mul(df.a, df.b).alias("c")).collect())


@pytest.mark.parametrize("cells, n, want_n, height, nnz, nodes", [
    ([], 4, 4, 2, 0, 1), ([(0, 0)], 1, 1, 1, 1, 2), ([(0, 1), (1, 0)], None, 2, 1, 2, 2), ([(0, 0), (4, 4)], None, 5, 3, 2, None), ([(1, 1), (1, 1)], None, 2, 1, 1, 2),
])
def test_edges(spark, cells, n, want_n, height, nnz, nodes):
    m = made(spark, cells, n)
    assert (m.meta.n, m.meta.height) == (want_n, height)
    assert tree.nnz(m).head()[0] == nnz
    if nodes is not None:
        assert tree.node_count(m).head()[0] == nodes
    assert ones(tree.decode(m)) == sorted(set(cells))
    assert ones(comp.decode_compressed(comp.compress(m))) == sorted(set(cells))


def test_rejects(spark):
    with pytest.raises(ValueError):
        product.multiply(made(spark, [(0, 0)], 4), made(spark, [(0, 0)], 8))
    with pytest.raises(Exception, match="outside"):
        made(spark, [(-1, 0)], 4).cells.collect()
    with pytest.raises(ValueError):
        made(spark, [(1 << 31, 0)])
    assert ones(product.multiply(made(spark, [(0, 1)], 4), made(spark, [(0, 0)], 4)).cells) == []
    assert ceil_log2(1) == 0 and ceil_log2(5) == 3 and ceil_log2(8) == 3


def test_histogram(spark):
    cells = rand(20, 0.1, 9)
    m = made(spark, cells, 20)
    leaves = [int(x[::-1], 2) for x in tree.dump(m)["leaves"].split()]
    want = {}
    for i in range(0, len(leaves), 2):
        code = leaves[i] + (16 * leaves[i + 1] if i + 1 < len(leaves) else 0)
        want[code] = want.get(code, 0) + 1
    assert {r["code"]: r["cnt"] for r in tree.leaf_pair_histogram(m).collect()} == want


def test_files(spark, tmp_path):
    path = tmp_path / "edges"
    path.write_text("0 1\n3   2\n\n1\t1\n")
    m = files.read_edges(spark, f"file://{path}", expected=3)
    assert m.meta.n == 4 and ones(m.cells) == [(0, 1), (1, 1), (3, 2)]
    with pytest.raises(ValueError):
        files.read_edges(spark, f"file://{path}", expected=4)
    (tmp_path / "bad").write_text("0 1\nx 2\n")
    with pytest.raises(Exception, match="malformed"):
        files.read_edges(spark, f"file://{tmp_path}/bad", n=4).cells.collect()
    files.save(m, f"file://{tmp_path}/m")
    back = files.load(spark, f"file://{tmp_path}/m")
    assert back.meta == m.meta and tree.verify(back, spark.createDataFrame([(0, 1), (1, 1), (3, 2)], "row long, col long"))
    c = comp.compress(made(spark, F1, 16))
    files.save_compressed(c, f"file://{tmp_path}/c")
    assert ones(comp.decode_compressed(files.load_compressed(spark, f"file://{tmp_path}/c"))) == sorted(F1)


def test_generators(spark):
    for n, p in ((50, 0.1), (20, 0.9), (8, 0), (8, 1)):
        got = ones(generate.random_matrix(spark, n, p, 7).cells)
        assert len(got) == len(set(got)) == int(n * n * p) and got == ones(generate.random_matrix(spark, n, p, 7).cells)
    some = generate.random_matrix(spark, 300, 0.01, 49, mode="bernoulli").cells.count()
    assert 700 < some < 1100
    assert ones(generate.from_dense(spark, [[0, 1], [1, 0]]).cells) == [(0, 1), (1, 0)]


def test_cli(spark, tmp_path, capsys):
    from quadrel import cli

    path = tmp_path / "a"
    path.write_text("".join(f"{r} {c}\n" for r, c in F1))
    a = f"file://{path}"
    assert cli.main(["build", a, "16", "17"]) == 0
    assert cli.main(["compress", f"{a}.qm"]) == 0
    assert cli.main(["cinfo", f"{a}.qmc"]) == 0
    assert cli.main(["info", f"{a}.qm"]) == 0
    assert cli.main(["multiply", f"{a}.qm", f"{a}.qm"]) == 0
    assert cli.main(["cmultiply", f"{a}.qmc", f"{a}.qmc"]) == 0
    assert ones(files.load(spark, f"{a}.qm.mul").cells) == ones(files.load(spark, f"{a}.qmc.mul").cells) == times(F1, F1)
    assert "17 ones" in capsys.readouterr().out


def test_compressed_union(spark):
    a, b = rand(40, 0.05, 11), rand(40, 0.05, 12)
    got = comp.or_compressed(comp.compress(made(spark, a, 40)), comp.compress(made(spark, b, 40)))
    assert ones(got.cells) == sorted(set(a) | set(b)) and got.meta.n == 40
    with pytest.raises(ValueError):
        comp.or_compressed(comp.compress(made(spark, a, 40)), comp.compress(made(spark, b, 41)))
    assert ones(comp.or_compressed(comp.compress(made(spark, a, 40)), comp.compress(made(spark, [], 40))).cells) == sorted(set(a))


def test_edge_lists_are_sorted(spark, tmp_path):
    cells = rand(60, 0.2, 13)
    files.write_edges(made(spark, random.Random(1).sample(cells, len(cells)), 60), f"file://{tmp_path}/x")
    lines = [tuple(map(int, x.split())) for f in sorted((tmp_path / "x").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == sorted(cells)


def test_logarithms():
    from quadrel.functions.bits import floor_log2

    for x in [*range(2, 3000), 2**61 - 1, 2**61, 2**61 + 1]:
        assert 2 ** floor_log2(x) <= x < 2 ** (floor_log2(x) + 1) and 2 ** (ceil_log2(x) - 1) < x <= 2 ** ceil_log2(x)
    assert [f(x) for f in (ceil_log2, floor_log2) for x in (0, 1)] == [0] * 4


def test_random_matrices_by_the_first_draws(spark):
    """An exact matrix holds the cells that were drawn first."""
    import math

    for n, p in ((30, 0.2), (30, 0.85), (5, 0.0), (3, 1.0)):
        got = ones(generate.random_matrix(spark, n, p).cells)
        assert len(got) == len(set(got)) == math.floor(n * n * p) and all(0 <= i < n > j >= 0 for i, j in got)
    drawn = spark.createDataFrame([(x, 7 * x) for x in range(0, 9000, 3)], "id long, at long")
    assert generate._cut(drawn, 9000, 1234) == 3 * 1233 + 1
    many = [len(ones(generate.random_matrix(spark, 200, 0.03, seed, mode="bernoulli").cells)) for seed in range(4)]
    assert len(set(many)) > 1 and all(abs(x - 1200) < 6 * (1200 * 0.97) ** 0.5 for x in many)


def test_key_code_is_small_enough_to_compile(spark):
    """The JVM only interprets methods beyond 8,000 bytes; the leaf masks' code had 16,858."""
    import contextlib
    import io
    import re

    m = Matrix.from_df(spark.createDataFrame([(0, 0), (1, 5), (700, 9)], "row long, col long"), 1 << 18)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            comp.numbered(tree.leaf_masks(m), 18).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue()))) < 8000
