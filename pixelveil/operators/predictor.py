"""Least-squares prediction of pixels from their neighbours, one coefficient vector per image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelveil.functions.tables import stored, with_import_path

from .neighbourhood import names, neighbours, with_scalars

#: Pivots below this share of the trace make an image unsolvable.
TINY = 1e-10


def gram(near: DataFrame, p: int = 3) -> DataFrame:
    """``(img, rows, g, b)`` from neighbour rows: the last row, packed lower triangle of the sums x_i x_j, and the sums x_i v.

    Partial sums are made before the shuffle, which carries one row per image and task.
    """
    x = names(p)
    exact = dict(near.dtypes)["v"] in ("bigint", "int", "smallint")
    total = lambda c: F.sum(c.cast("bigint" if exact else "double"))
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    sums = near.groupBy("img").agg(F.max("r").alias("rows"), *[total(F.col(x[i]) * F.col(x[j])).alias(f"g{i}_{j}") for i, j in pairs], *[total(F.col(a) * F.col("v")).alias(f"b{i}") for i, a in enumerate(x)])
    return sums.select("img", "rows", F.array(*[f"g{i}_{j}" for i, j in pairs]).alias("g"), F.array(*[f"b{i}" for i in range(len(x))]).alias("b"))


def gram_cells(packed: DataFrame, p: int = 3) -> DataFrame:
    """``(img, i, j, g)``: the packed triangle by place, j up to i; and j = p*p - 1 for the cross terms."""
    n = p * p - 1
    size = n * (n + 1) // 2
    cells = packed.select("img", F.posexplode(F.concat("g", "b")).alias("at", "g"))
    i = F.when(F.col("at") < size, F.floor((F.sqrt(F.col("at") * 8 + 1) - 1) / 2)).otherwise(F.col("at") - size).cast("int")
    j = F.when(F.col("at") < size, F.col("at") - F.floor(F.col("i") * (F.col("i") + 1) / 2)).otherwise(n).cast("int")
    return cells.withColumn("i", i).select("img", "i", j.alias("j"), "g")


def solve(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of many symmetric systems by elimination; rows of NaN where a pivot is tiny."""
    n = b.shape[1]
    a = np.concatenate([g, b[:, :, None]], 2)
    least = TINY * np.trace(g, axis1=1, axis2=2)
    good = np.ones(len(a), bool)
    for k in range(n):
        pivot = a[:, k, k]
        good &= (pivot > 0) & (pivot >= least)
        a[:, k] /= np.where(good, pivot, 1.0)[:, None]
        factor = a[:, :, k].copy()
        factor[:, k] = 0
        a -= factor[:, :, None] * a[:, None, k]
    out = a[:, :, n]
    out[~good] = np.nan
    return out


def unpack(packed: np.ndarray, n: int) -> np.ndarray:
    full = np.zeros((len(packed), n, n))
    i, j = np.tril_indices(n)
    full[:, i, j] = packed
    full[:, j, i] = packed
    return full


def coefficients(packed: DataFrame, p: int = 3) -> DataFrame:
    """``(img, rows, k)``: the last row and the coefficient array, which is null for an unsolvable image."""
    n = p * p - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            k = solve(unpack(np.array(d["g"].tolist(), float).reshape(len(d), -1), n), np.array(d["b"].tolist(), float).reshape(len(d), n))
            yield pd.DataFrame({"img": d["img"], "rows": d["rows"], "k": [None if np.isnan(x).any() else x.tolist() for x in k]})

    with_import_path(packed.sparkSession)
    return packed.mapInPandas(run, "img bigint, rows bigint, k array<double>")


def coefficients_in_sql(packed: DataFrame, p: int = 3) -> DataFrame:
    """``coefficients`` by elimination in array functions, for all images in the JVM: no Python is needed.

    The system of n unknowns is one array of n rows of n + 1, and each step makes the next array; a pivot that is not at least
    ``TINY`` of the trace is null, and so are all coefficients then.
    """
    n = p * p - 1
    at = f"if(i div {n + 1} >= i % {n + 1}, (i div {n + 1}) * (i div {n + 1} + 1) div 2 + i % {n + 1}, (i % {n + 1}) * (i % {n + 1} + 1) div 2 + i div {n + 1})"
    whole = packed.select("img", "rows", F.expr(f"transform(sequence(0, {n * (n + 1) - 1}), i -> cast(if(i % {n + 1} = {n}, b[i div {n + 1}], g[if(i % {n + 1} = {n}, 0, {at})]) as double))").alias("m"))
    whole = whole.withColumn("least", F.expr(f"aggregate(sequence(0, {n - 1}), 0D, (s, i) -> s + m[i * {n + 2}]) * {TINY}D"))
    pivot = f"if(m[k * {n + 2}] > 0 and m[k * {n + 2}] >= least, m[k * {n + 2}], cast(null as double))"
    step = f"transform(m, (x, i) -> if(i div {n + 1} = k, x / pivot, x - m[(i div {n + 1}) * {n + 1} + k] * (m[k * {n + 1} + i % {n + 1}] / pivot)))"
    solved = whole.select("img", "rows", F.expr(f"aggregate(sequence(0, {n - 1}), m, (m, k) -> transform(array({pivot}), pivot -> {step})[0])").alias("m"))
    k = F.expr(f"transform(sequence(0, {n - 1}), i -> m[i * {n + 1} + {n}])")
    return solved.select("img", "rows", F.when(F.forall(k, lambda x: x.isNotNull()), k).alias("k"))


def predicted(p: int = 3):
    """The sum of k_i x_i, with ``k`` and the neighbours as columns."""
    return sum((F.col("k")[i] * F.col(x) for i, x in enumerate(names(p))), F.lit(0.0))


def residual(near: DataFrame, coefs: DataFrame, p: int = 3) -> DataFrame:
    """``near`` with ``k`` and the prediction error ``e``; null where the image is unsolvable."""
    return with_scalars(near, coefs).withColumn("e", F.col("v") - predicted(p))


def me_mask(px: DataFrame, p: int = 3, border: str = "zero") -> DataFrame:
    """``(img, r, c, v, e, m)``: prediction error mask abs(e) / max(abs(e)); null where unsolvable or flat."""
    near = neighbours(px, p, border)
    err = stored(residual(near, coefficients(gram(near, p), p), p).select("img", "r", "c", "v", "e"), "errors")
    top = err.groupBy("img").agg(F.max("r").alias("rows"), F.max(F.abs("e")).alias("top"))
    return with_scalars(err, top).select("img", "r", "c", "v", "e", (F.abs("e") / F.nullif(F.col("top"), F.lit(0.0))).alias("m"))
