"""Command line: python -m quadrel.cli build|compress|info|cinfo|multiply|cmultiply|generate ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quadrel.operators import compress as comp
from quadrel.operators import product, tree
from quadrel.sources import files, generate


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="quadrel")
    sub = top.add_subparsers(dest="what", required=True)
    p = sub.add_parser("build", help="text edge lists to saved matrices: <text> <n> <lines> ...")
    p.add_argument("args", nargs="+")
    for name, text in (("compress", "saved matrices to compressed ones"), ("info", "sizes of saved matrices"), ("cinfo", "sizes of compressed matrices")):
        sub.add_parser(name, help=text).add_argument("paths", nargs="+")
    for name in ("multiply", "cmultiply"):
        p = sub.add_parser(name, help="product of two saved (compressed) matrices, to <a>.mul")
        p.add_argument("a")
        p.add_argument("b")
    p = sub.add_parser("generate", help="random matrices as text")
    p.add_argument("size", type=int)
    p.add_argument("density", type=float)
    p.add_argument("amount", type=int)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("seed", nargs="?", type=int, default=42)
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("quadrel").getOrCreate()
    if a.what == "build":
        if len(a.args) % 3:
            top.error("build takes groups of <text> <n> <lines>")
        for path, n, m in zip(a.args[::3], a.args[1::3], a.args[2::3], strict=True):
            found = files.read_edges(spark, path, int(n), int(m))
            files.save(found, f"{path}.qm")
            print(f"{path}.qm: {tree.nnz(files.load(spark, f'{path}.qm')).head()[0]} ones")
    elif a.what == "compress":
        for path in a.paths:
            files.save_compressed(comp.compress(files.load(spark, path)), f"{path}c")
            print(f"{path}c")
    elif a.what == "info":
        tree.info({path: files.load(spark, path) for path in a.paths}).show(len(a.paths), False)
    elif a.what == "cinfo":
        for path in a.paths:
            print(path, comp.compressed_info(files.load_compressed(spark, path)).head().asDict())
    elif a.what == "multiply":
        files.save(product.multiply(files.load(spark, a.a), files.load(spark, a.b)), f"{a.a}.mul")
    elif a.what == "cmultiply":
        files.save(comp.multiply_compressed(files.load_compressed(spark, a.a), files.load_compressed(spark, a.b)), f"{a.a}.mul")
    else:
        for i in range(a.amount):
            files.write_edges(generate.random_matrix(spark, a.size, a.density, a.seed + i), f"{a.path}/rand_matrix-{a.density:g}-{i}-txt")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
