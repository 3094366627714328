"""Two-dimensional neighbourhoods of pixel relations (img, r, c, v), by nested row windows and without a join.

A window over each row shifts pixels left and right, then one over each column shifts the results up and down.
Partitions are single rows or columns of an image, so a large image is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelveil.functions.pixel import nvf
from pixelveil.functions.tables import small_or_not, stored

WINDOWS, BORDERS = (3, 5, 7, 9), ("zero", "edge")


def check(p: int, border: str) -> int:
    """The reach of a p x p window; fails for other sizes and borders than the known ones."""
    if p not in WINDOWS:
        raise ValueError(f"p must be one of {WINDOWS}")
    if border not in BORDERS:
        raise ValueError(f"border must be one of {BORDERS}")
    return p // 2


def _shift(column: str, d: int, over, whole, border: str) -> Column:
    """The value ``d`` places on; beyond the border 0, or the border's own value."""
    if not d:
        return F.col(column)
    moved = F.lead(column, d).over(over) if d > 0 else F.lag(column, -d).over(over)
    if border == "zero":
        return F.coalesce(moved, F.lit(0))
    return F.coalesce(moved, (F.last if d > 0 else F.first)(column).over(whole))


def _windows(line: str, along: str):
    over = Window.partitionBy("img", line).orderBy(along)
    return over, over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def names(p: int) -> list[str]:
    """Neighbour columns in row order, without the centre."""
    return [f"x{i}" for i in range(p * p - 1)]


def neighbours(px: DataFrame, p: int = 3, border: str = "zero", value: str = "v") -> DataFrame:
    """``px`` with its p*p - 1 neighbours ``x0..`` in row order. The grid must be dense and start at 0."""
    pad = check(p, border)
    across, row = _windows("r", "c")
    down, column = _windows("c", "r")
    reach = range(-pad, pad + 1)
    out = px.select("*", *[_shift(value, d, across, row, border).alias(f"h{d + pad}") for d in reach])
    cells = [(dr, dc) for dr in reach for dc in reach if dr or dc]
    shifted = [_shift(f"h{dc + pad}", dr, down, column, border).alias(n) for n, (dr, dc) in zip(names(p), cells, strict=True)]
    return out.select(*px.columns, *shifted)


def moments(px: DataFrame, p: int = 3, border: str = "zero") -> DataFrame:
    """``px`` with ``total`` and ``squares``: sum and sum of squares of v over the window, centre included."""
    pad = check(p, border)
    across, row = _windows("r", "c")
    down, column = _windows("c", "r")
    both = px.select("*", F.col("v").alias("a__"), (F.col("v") * F.col("v")).alias("b__"))
    if border == "zero":
        add = lambda col, over, whole: F.sum(col).over(over.rowsBetween(-pad, pad))
    else:
        add = lambda col, over, whole: sum((_shift(col, d, over, whole, border) for d in range(-pad, pad + 1)), F.lit(0))
    both = both.select(*px.columns, add("a__", across, row).alias("a__"), add("b__", across, row).alias("b__"))
    return both.select(*px.columns, add("a__", down, column).alias("total"), add("b__", down, column).alias("squares"))


def nvf_mask(px: DataFrame, p: int = 3, border: str = "zero") -> DataFrame:
    """``(img, r, c, m)``: the noise visibility mask."""
    return moments(px, p, border).select("img", "r", "c", nvf(F.col("total"), F.col("squares"), p).alias("m"))


#: Rows of an image that meet its scalars in one key of a join, and image numbers that may be broadcast.
BAND, MOST_BROADCAST = 64, 1_000_000


def with_scalars(px: DataFrame, scalars: DataFrame) -> DataFrame:
    """Pixels with the columns of one row per image ``(img, rows, ...)``, where ``rows`` is the image's last row.

    The key is (img, band of rows), so the pixels of one large image are spread over tasks, whatever join Spark takes. Every image has
    its row, but the join is a left one, as Spark broadcasts the side whose file is small, and that of many flat pixels is: only the
    scalars may be broadcast. Filters on them that nulls don't pass would make it an inner join again.
    """
    bands = scalars.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("rows") / BAND))).alias("band__")).drop("rows")
    sound = px.where(F.col("img").isNotNull() & (F.col("r") >= 0))
    return sound.withColumn("band__", F.floor(F.col("r") / BAND)).join(bands, ["img", "band__"], "left").drop("band__")


def sparse_images(px: DataFrame) -> DataFrame:
    """Images whose grid has holes or repeated places, on which row windows would be wrong; empty if all are sound."""
    per = px.groupBy("img").agg(F.count("*").alias("n"), ((F.max("r") + 1) * (F.max("c") + 1)).alias("cells"), F.min("r").alias("r0"), F.min("c").alias("c0"))
    return per.where("n <> cells or r0 <> 0 or c0 <> 0").select("img", "n", "cells")


def neighbours_by_join(px: DataFrame, p: int = 3, border: str = "zero", value: str = "v") -> DataFrame:
    """``neighbours`` of grids with holes, by equal places: a missing neighbour is 0, also where a border is its own neighbour.

    Every pixel goes to all places that see it, and one aggregate by place gathers what came; of repeated places one stays. With
    ``edge``, a pixel of the border, the last row or column that an image has, also goes where a window reaches beyond it.
    """
    pad = check(p, border)
    size = px.groupBy("img").agg(F.max("r").alias("rows"), F.max("r").alias("last_r"), F.max("c").alias("last_c"))
    both = with_scalars(px.select("img", "r", "c", value), size)
    within = lambda at, last: (F.col(at) >= 0) & (F.col(at) <= F.coalesce(last, at))  # noqa: E731  nulls pass, as with_scalars asks

    def seen_from(x: str) -> Column:
        """(place, offset) of the lines from which this line is seen ``offset`` on."""
        here, last = F.col(x), F.col(f"last_{x}")
        plain = [F.struct((here - d).alias("at"), F.lit(d).alias("d")) for d in range(-pad, pad + 1)]
        if border == "zero":
            return F.array(*plain)
        beyond = [F.when(here == last, F.struct((last - i).alias("at"), F.lit(d).alias("d"))) for d in range(1, pad + 1) for i in range(d)]
        beyond += [F.when(here == 0, F.struct(F.lit(i).cast("bigint").alias("at"), F.lit(-d).alias("d"))) for d in range(1, pad + 1) for i in range(d)]
        return F.filter(F.array(*plain, *beyond), lambda t: t.isNotNull())

    sent = both.select("img", F.explode(seen_from("r")).alias("y"), F.col("c"), "last_c", F.col(value).alias("x__"), F.col("last_r"))
    sent = sent.where(within("y.at", "last_r")).select("img", F.col("y.at").alias("r"), F.col("y.d").alias("dr"), F.explode(seen_from("c")).alias("z"), "last_c", "x__")
    sent = sent.where(within("z.at", "last_c")).select("img", "r", F.col("z.at").alias("c"), (F.col("dr") * p + F.col("z.d")).alias("k"), "x__")
    cells = [(dr, dc) for dr in range(-pad, pad + 1) for dc in range(-pad, pad + 1) if dr or dc]
    own = F.max(F.when(F.col("k") == 0, F.col("x__")))
    met = sent.groupBy("img", "r", "c").agg(own.alias(value), *[F.coalesce(F.max(F.when(F.col("k") == dr * p + dc, F.col("x__"))), F.lit(0)).alias(n) for n, (dr, dc) in zip(names(p), cells, strict=True)])
    return met.where(F.col(value).isNotNull())


def neighbours_of_any(px: DataFrame, p: int = 3, border: str = "zero") -> DataFrame:
    """``neighbours`` of (img, r, c, v), by windows for dense images and by equal places for those with holes, after a check of which is which."""
    sparse = stored(sparse_images(px).select("img"), "sparse")
    sparse = small_or_not(sparse, sparse.count(), MOST_BROADCAST)
    dense = neighbours(px.join(sparse, "img", "left_anti").select("img", "r", "c", "v"), p, border)
    return dense.unionByName(neighbours_by_join(px.join(sparse, "img", "left_semi"), p, border).select(dense.columns))
