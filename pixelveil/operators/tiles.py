"""Neighbourhoods of planes of any size by tiles with a halo.

A plane is cut into tiles of bounded size. Every tile also gets the lines around it that its windows reach, so pixels near a
tile's border go to the tiles beside it too, and one shuffle brings each tile together; no line of an image is sorted as
a whole. A tile is one row, with its pixels as an array in row order. Kernels take the tiles of an Arrow batch, many
small ones of one shape at a time, and what belongs to an image meets its tiles, not its pixels.

A tile's missing lines are beyond the image's border, as the grid is dense, which is checked tile by tile and for whole images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pixelveil.functions.pixel import SEED, exact_sum, target_rms
from pixelveil.functions.runs import whole_runs
from pixelveil.functions.tables import stored, with_import_path

from .marking import with_gray
from .neighbourhood import WINDOWS, check, names, with_scalars
from .predictor import solve, unpack

#: Rows and columns of a tile, pixels that a kernel takes at a time, and images whose sums a task holds.
SIDE, PIXELS, IMAGES = 256, 1 << 17, 256
TILE = "img bigint, r bigint, c bigint, h bigint, w bigint, up bigint, down bigint, left bigint, right bigint, v array<double>"


def _record(schema: T.StructType, columns: list) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def tiles(px: DataFrame, reach: int, value: str = "v", side: int = SIDE, also: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of ``(img, r, c, value)``: the first own row and column, own size, lines of halo that are there, and all pixels.

    Columns of ``also`` come as arrays like that of the values. ``r`` and ``c`` start at 0. Fails for a tile with holes or repeated places; ``sound`` finds missing tiles.
    """
    if side < 2 * reach or side < 1:
        raise ValueError("a tile must be at least twice as large as its halo")
    with_import_path(px.sparkSession)

    def beside(x: str) -> Column:
        at = F.floor(F.col(x) / side)
        place = F.col(x) - at * side
        near = [F.when((place < reach) & (at > 0), at - 1), F.when(place >= side - reach, at + 1)] if reach else []
        return F.filter(F.array(at, *near), lambda t: t.isNotNull())

    rows = px.select("img", "r", "c", F.col(value).cast("double").alias("v"), *[F.col(x).cast("double").alias(x) for x in also], F.explode(beside("r")).alias("tr"))
    rows = rows.select("img", "tr", F.explode(beside("c")).alias("tc"), "r", "c", "v", *also)
    rows = rows.repartition("img", "tr", "tc").sortWithinPartitions("img", "tr", "tc", "r", "c")
    schema = T.StructType.fromDDL(", ".join([TILE, *(f"`{x}` array<double>" for x in also)]))

    def packed(x: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        img, tr, tc, r, c, v, *more = x
        sizes = np.diff(np.append(starts, len(v)))
        span = [(np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)) for y in (r, c)]
        (r0, r1), (c0, c1) = span
        wide = c1 - c0 + 1
        here = np.arange(len(v)) - np.repeat(starts, sizes)
        full = (sizes == (r1 - r0 + 1) * wide) & np.logical_and.reduceat((r - np.repeat(r0, sizes)) * np.repeat(wide, sizes) + c - np.repeat(c0, sizes) == here, starts)
        img, top, first = img[starts], tr[starts] * side, tc[starts] * side
        own = [np.clip(top, r0, r1 + 1), np.clip(top + side, r0, r1 + 1), np.clip(first, c0, c1 + 1), np.clip(first + side, c0, c1 + 1)]
        real = (own[1] > own[0]) & (own[3] > own[2])  # else all of it is the halo of a tile beyond the image
        bad = ~full | real & ((own[0] != top) | (own[2] != first))
        if bad.any():
            i = int(np.flatnonzero(bad)[0])
            raise ValueError(f"the grid of image {img[i]} has holes or repeated places near row {top[i]}, column {first[i]}")
        keep = np.repeat(real, sizes)
        columns = [img, top, first, own[1] - own[0], own[3] - own[2], own[0] - r0, r1 + 1 - own[1], own[2] - c0, c1 + 1 - own[3]]
        if real.any():
            yield _record(schema, [*(pa.array(y[real]) for y in columns), *(_lists(y[keep], sizes[real]) for y in (v, *more))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, starts in whole_runs(batches, 3):
            yield from packed(x, starts)

    return rows.mapInArrow(run, schema)


def sound(made: DataFrame) -> DataFrame:
    """Stored tiles; fails if an image's tiles don't fill its rectangle."""
    per = made.groupBy("img").agg(F.sum(F.col("h") * F.col("w")).alias("n"), (F.max(F.col("r") + F.col("h")) * F.max(F.col("c") + F.col("w"))).alias("cells"))
    bad = per.where("n <> cells").first()
    if bad:
        raise ValueError(f"image {bad.img} has {bad.n} of {bad.cells} pixels")
    return made


def tiled(px: DataFrame, reach: int, side: int = SIDE, also: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of sound images, stored, as several steps read them."""
    return sound(stored(tiles(px, reach, "v", side, also), "tiles"))


class Shape:
    """Tiles of one shape as a stack (k, rows, columns) that reaches ``reach`` lines beyond their own pixels, the border filled in."""

    def __init__(self, at: np.ndarray, meta: np.ndarray, stack: np.ndarray, reach: int, border: str):
        self.at, self.img, self.r, self.c = at, meta[at, 0], meta[at, 1], meta[at, 2]
        self.h, self.w, up, down, left, right = (int(x) for x in meta[at[0], 3:])
        cut = [max(0, x - reach) for x in (up, down, left, right)]
        stack = stack[:, cut[0] : stack.shape[1] - cut[1], cut[2] : stack.shape[2] - cut[3]]
        self.inside = [reach - min(x, reach) for x in (up, down, left, right)]  # lines beyond the image
        self.x = np.pad(stack, ((0, 0), (self.inside[0], self.inside[1]), (self.inside[2], self.inside[3])), mode="edge" if border == "edge" else "constant")
        self.reach = reach

    def own(self) -> np.ndarray:
        return self.x[:, self.reach : self.reach + self.h, self.reach : self.reach + self.w]

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """img, r and c of every own pixel."""
        n = self.h * self.w
        r, c = np.divmod(np.arange(n), self.w)
        return np.repeat(self.img, n), (self.r[:, None] + r).ravel(), (self.c[:, None] + c).ravel()


def shapes(b: pa.RecordBatch, reach: int, border: str) -> Iterator[Shape]:
    """The tiles of a batch whose first columns are ``TILE``, by shape, at most about ``PIXELS`` pixels at a time."""
    meta = np.stack([b.column(i).to_numpy() for i in range(9)], 1)
    v = b.column(9)
    places, flat = v.offsets.to_numpy(), v.values.to_numpy()
    kinds, of = np.unique(meta[:, 3:], axis=0, return_inverse=True)
    for k, (h, w, up, down, left, right) in enumerate(kinds.tolist()):
        at = np.flatnonzero(of.ravel() == k)
        high, wide = up + h + down, left + w + right
        step = max(1, PIXELS // (high * wide))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            yield Shape(some, meta, np.stack([flat[places[j] : places[j + 1]].reshape(high, wide) for j in some]), reach, border)


def _kernel(made: DataFrame, out: str, run: Callable[[pa.RecordBatch], Iterator[list]]) -> DataFrame:
    with_import_path(made.sparkSession)
    schema = T.StructType.fromDDL(out)

    def batches(every: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in every:
            if b.num_rows:
                for columns in run(b):
                    yield _record(schema, columns)

    return made.mapInArrow(batches, schema)


def window_sums(x: np.ndarray, p: int, spare: int) -> np.ndarray:
    """Sums over p x p windows of a stack that reaches ``spare`` lines further than its own pixels, by an integral image: the cost doesn't grow with p."""
    table = np.pad(x, ((0, 0), (1, 0), (1, 0))).cumsum(1).cumsum(2)
    cut = spare - p // 2
    n, m = x.shape[1] - 2 * spare, x.shape[2] - 2 * spare
    a, b = slice(cut, cut + n), slice(cut + p, cut + p + n)
    c, d = slice(cut, cut + m), slice(cut + p, cut + p + m)
    return table[:, b, d] - table[:, a, d] - table[:, b, c] + table[:, a, c]


def _number(px: DataFrame) -> str:
    return "bigint" if dict(px.dtypes)["v"] in ("tinyint", "smallint", "int", "bigint") else "double"


def moments(px: DataFrame, windows: tuple[int, ...] = WINDOWS, border: str = "zero", side: int = SIDE) -> DataFrame:
    """``(img, r, c, p, total, squares)``: window sums of v and its squares for several windows from one pass; whole numbers stay exact."""
    reach, kind = max(check(p, border) for p in windows), _number(px)
    as_kind = (lambda x: x.astype(np.int64)) if kind == "bigint" else (lambda x: x)

    def run(b: pa.RecordBatch) -> Iterator[list]:
        for s in shapes(b, reach, border):
            places, x = s.places(), s.x
            x = x if kind == "double" else x.astype(np.int64)
            for p in windows:
                total, squares = window_sums(x, p, reach), window_sums(x * x, p, reach)
                yield [*places, np.full(total.size, p, np.int32), as_kind(total).ravel(), as_kind(squares).ravel()]

    return _kernel(tiled(px, reach, side), f"img bigint, r bigint, c bigint, p int, total {kind}, squares {kind}", run)


def _near(s: Shape, p: int, over: np.ndarray | None = None, reach: int | None = None) -> np.ndarray:
    """The p*p shifts of the own pixels (k, p*p, n), centre included."""
    x, reach = (s.x, s.reach) if over is None else (over, reach)
    cut = reach - p // 2
    h, w = x.shape[1] - 2 * reach, x.shape[2] - 2 * reach
    return np.stack([x[:, cut + i : cut + i + h, cut + j : cut + j + w].reshape(len(x), -1) for i in range(p) for j in range(p)], 1)


def neighbours(px: DataFrame, p: int = 3, border: str = "zero", side: int = SIDE) -> DataFrame:
    """``(img, r, c, v, x0, ...)``: every pixel with its neighbours in row order, as the window form gives them."""
    reach, kind = check(p, border), _number(px)
    number = np.int64 if kind == "bigint" else float

    def run(b: pa.RecordBatch) -> Iterator[list]:
        for s in shapes(b, reach, border):
            near = _near(s, p).astype(number)
            mid = p * p // 2
            yield [*s.places(), near[:, mid].ravel(), *(near[:, i].ravel() for i in range(p * p) if i != mid)]

    out = f"img bigint, r bigint, c bigint, v {kind}, " + ", ".join(f"{x} {kind}" for x in names(p))
    return _kernel(tiled(px, reach, side), out, run)


def gram(made: DataFrame, p: int = 3, border: str = "zero") -> DataFrame:
    """``(img, rows, g, b)`` of tiles: the last row, the packed lower triangle of the sums x_i x_j, and the sums x_i v.

    A tile's neighbours are one matrix, whose product with itself holds all sums; a task adds those of an image, and one row per
    image and task is shuffled, in which the arrays are added.
    """
    with_import_path(made.sparkSession)
    reach, mid = check(p, border), p * p // 2
    rest = [i for i in range(p * p) if i != mid]
    low = np.tril_indices(p * p - 1)
    schema = T.StructType.fromDDL("img bigint, rows bigint, g array<double>, b array<double>")

    def put(held: dict) -> pa.RecordBatch:
        k = list(held)
        full = np.stack([held[i][1] for i in k])
        inner = full[:, rest][:, :, rest]
        g, b = inner[:, low[0], low[1]], full[:, rest, mid]
        return _record(schema, [k, [held[i][0] for i in k], _lists(g.ravel(), np.full(len(k), g.shape[1])), _lists(b.ravel(), np.full(len(k), b.shape[1]))])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for s in shapes(batch, reach, border):
                near = _near(s, p)
                product = near @ near.transpose(0, 2, 1)
                for i, img in enumerate(s.img.tolist()):
                    last = int(s.r[i]) + s.h - 1
                    if img in held:
                        held[img] = [max(held[img][0], last), held[img][1] + product[i]]
                    else:
                        if len(held) == IMAGES:
                            yield put(held)
                            held = {}
                        held[img] = [last, product[i]]
        if held:
            yield put(held)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, g, b = None, 0, None, None
        for batch in batches:
            img, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            gs, bs = (batch.column(i).flatten().to_numpy().reshape(len(img), -1) for i in (2, 3))
            out = []
            for i, k in enumerate(img.tolist()):
                if k == now:
                    last, g, b = max(last, int(rows[i])), g + gs[i], b + bs[i]
                    continue
                if now is not None:
                    out.append((now, last, g, b))
                now, last, g, b = k, int(rows[i]), gs[i], bs[i]
            if out:
                yield _record(schema, [list(x) for x in zip(*out, strict=True)])
        if now is not None:
            yield _record(schema, [[now], [last], [g], [b]])

    return made.mapInArrow(parts, schema).repartition("img").sortWithinPartitions("img").mapInArrow(added, schema)


def fitted(made: DataFrame, p: int = 3, border: str = "zero") -> DataFrame:
    """``(img, rows, k)``, stored: coefficients of each image, null where it is unsolvable."""
    n = p * p - 1

    def run(b: pa.RecordBatch) -> Iterator[list]:
        g, v = (b.column(i).flatten().to_numpy().reshape(b.num_rows, -1) for i in (2, 3))
        k = solve(unpack(g, n), v.copy())
        yield [b.column(0), b.column(1), [None if np.isnan(x).any() else x for x in k]]

    return stored(_kernel(gram(made, p, border), "img bigint, rows bigint, k array<double>", run), "coefficients")


def signal_block(r: np.ndarray, c: np.ndarray, h: int, w: int, seed: int = SEED) -> np.ndarray:
    """The deterministic signal of blocks that begin at ``r`` and ``c``, as a stack; places before the plane's begin don't matter."""
    y = (r[:, None] + np.arange(h))[:, :, None]
    x = (c[:, None] + np.arange(w))[:, None, :]
    a = (y * 7919 + x * 104729 + seed) % 2147483647 * 48271 % 2147483647
    b = (y * 15485863 + x * 32452843 + 17) % 2147483647 * 16807 % 2147483647
    return np.sqrt(-2 * np.log((a + 1) / 2147483648.0)) * np.cos(b * 6.283185307179586 / 2147483647.0)


def _errors(near: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Prediction errors (tiles, n) from shifts and each tile's coefficients."""
    mid = near.shape[1] // 2
    return near[:, mid] - np.einsum("ti,tin->tn", np.insert(k, mid, 0.0, axis=1), near)


def _nvf(x: np.ndarray, p: int, spare: int) -> np.ndarray:
    n = p * p
    s, q = window_sums(x, p, spare), window_sums(x * x, p, spare)
    var = np.maximum((q * n - s * s) / float(n * n), 0)
    return var / (var + 1.0)


def _coefficients(b: pa.RecordBatch, column: int, s: Shape, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Each tile's coefficients, zeros where there are none, and where there are."""
    k = [b.column(column)[int(i)].as_py() for i in s.at]
    return np.array([x or [0.0] * (p * p - 1) for x in k]), np.array([x is not None for x in k])


def _with_signal(made: DataFrame, signal: DataFrame | None, reach: int, side: int) -> DataFrame:
    """Tiles with ``signal``, the array of the signal's tile at their place, or null for the deterministic one."""
    if signal is None:
        return made.withColumn("signal", F.lit(None).cast("array<double>"))
    own = tiled(signal.select(F.lit(0).cast("bigint").alias("img"), "r", "c", F.col("w").alias("v")), reach, side)
    size = own.agg(F.max(F.col("r") + F.col("h")), F.max(F.col("c") + F.col("w"))).first()
    wrong = made.groupBy("img").agg(F.max(F.col("r") + F.col("h")).alias("rows"), F.max(F.col("c") + F.col("w")).alias("cols")).where((F.col("rows") != F.lit(size[0])) | (F.col("cols") != F.lit(size[1]))).first()
    if wrong:
        raise ValueError(f"image {wrong.img} has {wrong.rows} x {wrong.cols} pixels, the signal {size[0]} x {size[1]}")
    return made.join(own.select("r", "c", F.col("v").alias("signal")), ["r", "c"])


def _signal(b: pa.RecordBatch, column: int, s: Shape, reach: int) -> np.ndarray:
    """The signal of a shape's tiles and ``reach`` lines around; beyond the plane it is anything."""
    column_ = b.column(column)
    if column_.null_count:
        return signal_block(s.r - reach, s.c - reach, s.h + 2 * reach, s.w + 2 * reach)
    there = [reach - x for x in s.inside]
    high, wide = s.h + there[0] + there[1], s.w + there[2] + there[3]
    w = np.stack([column_[int(i)].values.to_numpy().reshape(high, wide) for i in s.at])
    return np.pad(w, ((0, 0), (s.inside[0], s.inside[1]), (s.inside[2], s.inside[3])))


def _columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[f.name for f in T.StructType.fromDDL(TILE).fields], *more)


def _marked(px: DataFrame, signal: DataFrame | None, mask: str, p: int, psnr: float, border: str, quantize: bool, side: int, colours: tuple[str, ...], kept: tuple[str, ...]) -> DataFrame:
    """``(img, r, c, *colours, *kept, strength)``: the change that the plane ``v`` gives, added to each column of ``colours``."""
    if mask not in ("ME", "NVF"):
        raise ValueError("mask must be ME or NVF")
    reach, goal = check(p, border), target_rms(psnr)
    also = tuple(x for x in (*colours, *kept) if x != "v")
    made = tiled(px, reach, side, also)
    more = _with_signal(made, signal, reach, side)
    more = with_scalars(more, fitted(made, p, border)) if mask == "ME" else more.withColumn("k", F.lit(None).cast("array<double>"))
    columns = [x if x in also else "v" for x in (*colours, *kept)]

    def own(b: pa.RecordBatch, column: int, s: Shape) -> np.ndarray:
        """Another column's own pixels, without the halo that is there."""
        there = [reach - x for x in s.inside]
        stack = np.stack([b.column(column)[int(i)].values.to_numpy() for i in s.at]).reshape(len(s.at), there[0] + s.h + there[1], there[2] + s.w + there[3])
        return stack[:, there[0] : there[0] + s.h, there[2] : there[2] + s.w]

    def masks(b: pa.RecordBatch) -> Iterator[list]:
        for s in shapes(b, reach, border):
            if mask == "ME":
                k, solved = _coefficients(b, 11, s, p)
                m = np.where(solved[:, None], np.abs(_errors(_near(s, p), k)), 0.0)
            else:
                m = _nvf(s.x, p, reach).reshape(len(s.at), -1)
            w = _signal(b, 10, s, reach)[:, reach : reach + s.h, reach : reach + s.w].reshape(len(s.at), -1)
            u, n = m * w, np.full(len(s.at), s.h * s.w)
            values = [s.own() if x == "v" else own(b, 12 + also.index(x), s) for x in columns]
            yield [s.img, s.r, s.c, n // s.h, n, m.max(1), (u * u).sum(1), _lists(u.ravel(), n), *(_lists(x.ravel(), n) for x in values)]

    arrays = [f"y{i}" for i in range(len(columns))]
    out = "img bigint, r bigint, c bigint, w bigint, n bigint, top double, power double, u array<double>, " + ", ".join(f"{x} array<double>" for x in arrays)
    raw = stored(_kernel(_columns(more, "signal", "k", *also), out, masks), "masks")
    scale = raw.groupBy("img").agg(F.max("r").alias("rows"), (F.nullif(F.max("top"), F.lit(0.0)) if mask == "ME" else F.lit(1.0)).alias("most"), F.sqrt(F.nullif(exact_sum(F.col("power")), F.lit(0.0)) / F.sum("n")).alias("rms"))
    scale = scale.select("img", "rows", "most", (F.lit(goal) * F.col("most") / F.col("rms")).alias("strength"))
    ready = with_scalars(raw.select("img", "r", "c", "w", "u", *arrays), scale).select("img", "r", "c", "w", "most", "strength", "u", *arrays)

    def mark(b: pa.RecordBatch) -> Iterator[list]:
        for i in range(b.num_rows):
            img, r0, c0, w, most, strength = (b.column(j)[i].as_py() for j in range(6))
            u, *values = (b.column(j)[i].values.to_numpy() for j in range(6, b.num_columns))
            change = strength * (u / most) if strength is not None else np.zeros(len(u))
            marked = [np.clip(x + change, 0, 255) for x in values[: len(colours)]]
            r, c = np.divmod(np.arange(len(u)), w)
            yield [np.full(len(u), img), r + r0, c + c0, *(np.floor(y).astype(np.int64) if quantize else y for y in marked), *values[len(colours) :], pa.array([strength] * len(u), pa.float64())]

    kind = "bigint" if quantize else "double"
    return _kernel(ready, ", ".join(["img bigint, r bigint, c bigint", *(f"`{x}` {kind}" for x in colours), *(f"`{x}` double" for x in kept), "strength double"]), mark)


def embed(px: DataFrame, signal: DataFrame | None = None, mask: str = "ME", p: int = 3, psnr: float = 40.0, border: str = "zero", quantize: bool = True, side: int = SIDE) -> DataFrame:
    """``(img, r, c, y, strength)`` as the window form gives it; unsolvable or flat images pass unchanged.

    Tiles are made once. Masks times signal are stored by tile, with each tile's largest error and power, from which an image's
    strength follows; the power is added exactly, so no order of tiles changes a result.
    """
    return _marked(px, signal, mask, p, psnr, border, quantize, side, ("v",), ()).withColumnRenamed("v", "y")


def embed_rgb(rgb: DataFrame, signal: DataFrame | None = None, mask: str = "ME", p: int = 3, psnr: float = 40.0, border: str = "zero", quantize: bool = True, side: int = SIDE) -> DataFrame:
    """``(img, r, c, red, green, blue[, alpha], strength)``: the change of the gray plane added to every channel; the tiles carry the channels."""
    colours, alpha = ("red", "green", "blue"), tuple(x for x in ("alpha",) if x in rgb.columns)
    out = _marked(with_gray(rgb), signal, mask, p, psnr, border, quantize, side, colours, alpha)
    return out.withColumns({x: F.col(x).cast(dict(rgb.dtypes)[x]) for x in alpha})


def detect(px: DataFrame, signal: DataFrame | None = None, mask: str = "ME", p: int = 3, border: str = "zero", side: int = SIDE) -> DataFrame:
    """``(img, correlation)`` of images with pixels ``v``: 0 where an image is unsolvable or a norm is 0.

    Halos are twice as wide as a window reaches, so that a tile knows the masked signal around it too and tiles are shuffled once. Each
    tile gives three sums, which are added exactly.
    """
    if mask not in ("ME", "NVF"):
        raise ValueError("mask must be ME or NVF")
    pad = check(p, border)
    made = tiled(px, 2 * pad, side)
    ready = with_scalars(_with_signal(made, signal, pad, side), fitted(made, p, border))

    def beyond(u: np.ndarray, lines: list[int]) -> np.ndarray:
        """The masked signal with what lies beyond the image as the border says."""
        up, down, left, right = lines
        inner = u[:, up : u.shape[1] - down, left : u.shape[2] - right]
        return np.pad(inner, ((0, 0), (up, down), (left, right)), mode="edge" if border == "edge" else "constant")

    def sums(b: pa.RecordBatch) -> Iterator[list]:
        for s in shapes(b, 2 * pad, border):
            k, solved = _coefficients(b, 11, s, p)
            high, wide = s.h + 2 * pad, s.w + 2 * pad
            e = _errors(_near(s, p, s.x, pad), k).reshape(len(s.at), high, wide)
            m = np.abs(e) if mask == "ME" else _nvf(s.x, p, pad)
            lines = [max(0, x - pad) for x in s.inside]
            u = beyond(m * _signal_of(b, s), lines)
            ez = e[:, pad : pad + s.h, pad : pad + s.w].reshape(len(s.at), -1)
            eu = _errors(_near(s, p, u, pad), k)
            some = np.where(solved, 1.0, 0.0)
            yield [s.img, (ez * eu).sum(1) * some, (ez * ez).sum(1) * some, (eu * eu).sum(1) * some]

    def _signal_of(b: pa.RecordBatch, s: Shape) -> np.ndarray:
        near = Shape.__new__(Shape)
        near.__dict__ = s.__dict__ | {"inside": [max(0, x - pad) for x in s.inside]}
        return _signal(b, 10, near, pad)

    parts = _kernel(_columns(ready, "signal", "k"), "img bigint, dot double, z double, u double", sums)
    total = parts.groupBy("img").agg(*[exact_sum(F.col(c)).alias(c) for c in ("dot", "z", "u")])
    return total.select("img", F.coalesce(F.col("dot") / F.nullif(F.sqrt(F.col("z") * F.col("u")), F.lit(0.0)), F.lit(0.0)).alias("correlation"))
