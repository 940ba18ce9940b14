"""Sparse matrices as tables: products, accumulation of information, block assembly, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, value) of a times b: one equi-join on the inner index and a grouped sum."""
    one = a.select("row", F.col("col").alias("_k"), F.col("value").alias("_a"))
    two = b.select(F.col("row").alias("_k"), "col", F.col("value").alias("_b"))
    return one.join(two, "_k").groupBy("row", "col").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """(row, value) of a times the vector (col, value)."""
    v = x.select("col", F.col("value").alias("_x"))
    return a.join(v, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("_x")).alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def add(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("row", "col", "value")
    for p in parts[1:]:
        out = out.unionByName(p.select("row", "col", "value"))
    return out.groupBy("row", "col").agg(F.sum("value").alias("value"))


def information_matrix(design: DataFrame, precision: DataFrame) -> DataFrame:
    """(i, j, value) of J'QJ, from design (row, col, value) and a diagonal precision (row, q).

    A design row has few entries, so its outer product is made in the row: the
    entries are collected per observation (an observation's rows are bounded by
    the model's elements), and only sums per parameter pair are shuffled.
    """
    rows = design.groupBy("row").agg(F.collect_list(F.struct("col", "value")).alias("e")).join(precision, "row")
    pairs = rows.select("q", F.explode("e").alias("a"), "e").select("q", "a", F.explode("e").alias("b"))
    return pairs.groupBy(F.col("a.col").alias("i"), F.col("b.col").alias("j")).agg(F.sum(F.col("a.value") * F.col("q") * F.col("b.value")).alias("value"))


def information_vector(design: DataFrame, precision: DataFrame, residual: DataFrame) -> DataFrame:
    """(i, value) of J'Q(y - offset), from residual (row, r)."""
    rows = design.join(precision, "row").join(residual, "row")
    return rows.groupBy(F.col("col").alias("i")).agg(F.sum(F.col("value") * F.col("q") * F.col("r")).alias("value"))


def beside(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Designs side by side: each part is (design, number of its columns)."""
    out, at = None, 0
    for design, columns in parts:
        moved = design.select("row", (F.col("col") + F.lit(at)).cast("bigint").alias("col"), "value")
        out = moved if out is None else out.unionByName(moved)
        at += columns
    return out


def block_diagonal(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Square matrices along the diagonal."""
    out, at = None, 0
    for m, size in parts:
        moved = m.select((F.col("row") + F.lit(at)).cast("bigint").alias("row"), (F.col("col") + F.lit(at)).cast("bigint").alias("col"), "value")
        out = moved if out is None else out.unionByName(moved)
        at += size
    return out


def kronecker(a: DataFrame, b: DataFrame, b_columns: int) -> DataFrame:
    """Row-wise Kronecker product of two designs of the same observations: column = a.col * columns of b + b.col."""
    one = a.select("row", F.col("col").alias("_a"), F.col("value").alias("_x"))
    two = b.select("row", F.col("col").alias("_b"), F.col("value").alias("_y"))
    return one.join(two, "row").select("row", (F.col("_a") * b_columns + F.col("_b")).cast("bigint").alias("col"), (F.col("_x") * F.col("_y")).alias("value"))


def expected(design: DataFrame, state: DataFrame) -> DataFrame:
    """(row, value): what a state (col, value) predicts."""
    return spmv(design, state)


def deviation(design: DataFrame, std: DataFrame) -> DataFrame:
    """(row, value): sqrt of the sum of (entry * std)^2, for independent parameters."""
    s = std.select("col", F.col("value").alias("_s"))
    return design.join(s, "col").groupBy("row").agg(F.sqrt(F.sum(F.col("value") * F.col("value") * F.col("_s") * F.col("_s"))).alias("value"))


def same_pattern(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of a's sparsity pattern that b's lacks (empty: a fits into b)."""
    return a.select("row", "col").join(b.select("row", "col"), ["row", "col"], "left_anti")
