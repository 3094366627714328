"""Embedding a signal at a given PSNR, and blind detection by normalised correlation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelveil.functions.pixel import clamp, exact_sum, gray, nvf, signal_value, target_rms, to_byte, visible
from pixelveil.functions.tables import stored

from .neighbourhood import moments, names, neighbours, with_scalars
from .predictor import coefficients, gram, predicted, residual

Mask = str | Callable[[DataFrame, int, str], DataFrame]


def _custom(px: DataFrame, mask: Mask, p: int, border: str) -> DataFrame:
    """``px`` with ``m`` of a function that gives (img, r, c, m)."""
    if not callable(mask):
        raise ValueError("mask must be ME, NVF or a function")
    return px.join(mask(px, p, border).select("img", "r", "c", "m"), ["img", "r", "c"])


def size_mismatches(px: DataFrame, signal: DataFrame) -> DataFrame:
    """``(img, rows, cols, signal_rows, signal_cols)`` of images whose size isn't the signal's; empty if all fit."""
    h, w = signal.agg(F.max("r") + 1, F.max("c") + 1).first()
    size = px.groupBy("img").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    return size.withColumn("signal_rows", F.lit(h or 0).cast("bigint")).withColumn("signal_cols", F.lit(w or 0).cast("bigint")).where("rows <> signal_rows or cols <> signal_cols")


def _with_signal(df: DataFrame, px: DataFrame, signal: DataFrame | None) -> DataFrame:
    """Joined by place; without a table, the deterministic signal is computed in place. Fails for images of another size."""
    if signal is None:
        return df.withColumn("w", signal_value(F.col("r"), F.col("c")))
    wrong = size_mismatches(px, signal).first()
    if wrong:
        raise ValueError(f"image {wrong.img} has {wrong.rows} x {wrong.cols} pixels, the signal {wrong.signal_rows} x {wrong.signal_cols}")
    return df.join(signal.select("r", "c", "w"), ["r", "c"])


def strengthened(px: DataFrame, signal: DataFrame | None, mask: Mask, p: int, psnr: float, border: str) -> DataFrame:
    """``px`` with ``u`` (mask times signal) and ``strength``, its scale, which is null where nothing can be embedded.

    Neighbourhoods are made for the normal equations and for the errors; these are stored once, and one aggregate of them
    gives the largest error and the power, from which the strength follows.
    """
    columns = px.columns
    if mask == "ME":
        near = neighbours(px, p, border)
        raw = residual(near, coefficients(gram(near, p), p), p).select(*columns, F.abs("e").alias("m"))
    elif mask == "NVF":
        raw = moments(px, p, border).select(*columns, nvf(F.col("total"), F.col("squares"), p).alias("m"))
    else:
        raw = _custom(px, mask, p, border)
    raw = stored(_with_signal(raw, px, signal).select(*columns, "m", (F.col("m") * F.col("w")).alias("u")), "masks")
    top = F.nullif(F.max("m"), F.lit(0.0)) if mask == "ME" else F.lit(1.0)
    scale = raw.groupBy("img").agg(F.max("r").alias("rows"), top.alias("top"), F.sqrt(F.nullif(exact_sum(F.col("u") * F.col("u")) / F.count("*"), F.lit(0.0))).alias("rms"))
    scale = scale.select("img", "rows", "top", (F.lit(target_rms(psnr)) * F.col("top") / F.col("rms")).alias("strength"))
    return with_scalars(raw, scale).select(*columns, (F.col("u") / F.col("top")).alias("u"), "strength")


def embed(px: DataFrame, signal: DataFrame | None = None, mask: Mask = "ME", p: int = 3, psnr: float = 40.0, border: str = "zero", quantize: bool = True) -> DataFrame:
    """``(img, r, c, y, strength)``: marked pixels, whole numbers if ``quantize``; unsolvable or flat images pass unchanged."""
    s = strengthened(px, signal, mask, p, psnr, border)
    added = F.col("v") + F.coalesce(F.col("strength") * F.col("u"), F.lit(0.0))
    return s.select("img", "r", "c", (to_byte(added) if quantize else clamp(added)).alias("y"), "strength")


def gray_plane(rgb: DataFrame) -> DataFrame:
    """``(img, r, c, v)`` from red, green, blue and, if there is one, alpha: pixels with alpha 0 are black."""
    return with_gray(rgb).select("img", "r", "c", "v")


def with_gray(rgb: DataFrame) -> DataFrame:
    of = (lambda c: visible(F.col(c), F.col("alpha"))) if "alpha" in rgb.columns else F.col
    colours = [of(c).alias(c) for c in ("red", "green", "blue")]
    return rgb.select("img", "r", "c", *colours, *(["alpha"] if "alpha" in rgb.columns else [])).withColumn("v", gray(F.col("red"), F.col("green"), F.col("blue")))


def embed_rgb(rgb: DataFrame, signal: DataFrame | None = None, mask: Mask = "ME", p: int = 3, psnr: float = 40.0, border: str = "zero", quantize: bool = True) -> DataFrame:
    """``(img, r, c, red, green, blue[, alpha], strength)``: the change of the gray plane added to every channel."""
    s = strengthened(with_gray(rgb), signal, mask, p, psnr, border)
    change: Column = F.coalesce(F.col("strength") * F.col("u"), F.lit(0.0))
    put = to_byte if quantize else clamp
    marked = [put(F.col(c) + change).alias(c) for c in ("red", "green", "blue")]
    return s.select("img", "r", "c", *marked, *(["alpha"] if "alpha" in rgb.columns else []), "strength")


def detect(px: DataFrame, signal: DataFrame | None = None, mask: Mask = "ME", p: int = 3, border: str = "zero") -> DataFrame:
    """``(img, correlation)`` of images with pixels ``v``: 0 where an image is unsolvable or a norm is 0.

    Sums are exact, so no partitioning changes a score. The score doesn't change with the scale of the mask, so the largest error isn't looked for. Coefficients and masked
    signals are stored once.
    """
    near = neighbours(px, p, border)
    coefs = stored(coefficients(gram(near, p), p), "coefficients")
    z = residual(near, coefs, p)
    x = names(p)
    if mask == "ME":
        z = z.withColumn("m", F.abs("e"))
    elif mask == "NVF":
        z = z.withColumn("m", nvf(sum((F.col(c) for c in x), F.col("v")), sum((F.col(c) * F.col(c) for c in x), F.col("v") * F.col("v")), p))
    else:
        z = _custom(z, lambda *_: mask(px, p, border), p, border) if callable(mask) else _custom(z, mask, p, border)
    u = _with_signal(z.select("img", "r", "c", "m", F.col("e").alias("ez")), px, signal)
    u = stored(u.select("img", "r", "c", "ez", (F.coalesce(F.col("m"), F.lit(0.0)) * F.col("w")).alias("v")), "masked")
    e = with_scalars(neighbours(u, p, border), coefs).withColumn("eu", F.col("v") - predicted(p))
    sums = e.groupBy("img").agg(exact_sum(F.col("ez") * F.col("eu")).alias("dot"), exact_sum(F.col("ez") * F.col("ez")).alias("z"), exact_sum(F.col("eu") * F.col("eu")).alias("u"))
    return sums.select("img", F.coalesce(F.col("dot") / F.nullif(F.sqrt(F.col("z") * F.col("u")), F.lit(0.0)), F.lit(0.0)).alias("correlation"))


def psnr(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(img, psnr)`` between pixels ``v`` and ``y``; null for identical images."""
    both = before.select("img", "r", "c", "v").join(after.select("img", "r", "c", "y"), ["img", "r", "c"])
    d = F.col("y") - F.col("v")
    return both.groupBy("img").agg((F.log10(F.lit(65025.0) / F.nullif(F.avg(d * d), F.lit(0.0))) * 10.0).alias("psnr"))
