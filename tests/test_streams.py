"""Stateful frame numbers, packets of streams, frames as batches, systems solved in SQL, grids with holes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelveil.operators import neighbourhood, predictor
from pixelveil.streaming import frames as video


def test_numbers_go_on_after_a_restart(spark, tmp_path):
    rows = [(i % 3, (i * 37) % 101) for i in range(101)]
    schema = "stream_id bigint, at bigint"
    for low, high in ((0, 40), (40, 41), (41, 101)):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = video.numbered_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "at")
        video.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    batch = sorted(map(tuple, video.numbered(spark.createDataFrame(rows, schema), "at").collect()))
    assert got == batch and len(got) == 101


def test_streamed_packets_drop_what_is_rejected(spark, tmp_path):
    packets = spark.createDataFrame([(s, i % 3, i % 4 != 0, i) for s in range(3) for i in range(30)], "source int, stream_index int, accepted boolean, id int")
    streams = spark.createDataFrame([(s, i, "video" if i >= s else "audio") for s in range(3) for i in range(3)], "source int, stream_index int, type string")
    packets.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = video.video_packets(spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in")), streams)
    video.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.source, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(s, i) for s in range(3) for i in range(30) if i % 4 and i % 3 == s}


def test_frames_of_many_sizes_make_the_round_trip(spark):
    sizes = {0: (1, 1), 1: (7, 3), 2: (400, 301), 3: (8, 8), 4: (8, 8)}
    px = spark.createDataFrame([(f % 2, f, h, w) for f, (h, w) in sizes.items()], "stream_id bigint, frame_no bigint, h bigint, w bigint")
    px = px.select("stream_id", "frame_no", "w", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("i"))
    px = px.select("stream_id", "frame_no", F.floor(F.col("i") / F.col("w")).alias("r"), (F.col("i") % F.col("w")).alias("c"), (F.col("i") * 31 % 251).alias("v")).repartition(7)
    made = video.pixels_to_frames(px)
    for r in made.collect():
        h, w = sizes[r.frame_no]
        assert (r.height, r.width, r.linesize, len(r.y), len(r.u)) == (h, w, w, h * w, -(-h // 2) * -(-w // 2))
    assert video.frames_to_pixels(made).exceptAll(px).count() == 0 and video.frames_to_pixels(made).count() == px.count()
    with pytest.raises(Exception, match="holes or repeated"):
        video.pixels_to_frames(px.where("not (frame_no = 3 and r = 2 and c = 2)")).collect()
    assert video.frames_to_pixels(video.pixels_to_frames(px.limit(0))).count() == 0


@pytest.mark.parametrize("p", [3, 5])
def test_systems_solved_in_sql_equal_numpy(spark, p):
    rng, n = np.random.default_rng(p), p * p - 1
    rows = []
    for i in range(6):
        x = rng.normal(0, 1, (n, 200))
        if i == 5:
            x[1] = x[0]  # singular
        g = x @ x.T
        rows.append((i, 9, g[np.tril_indices(n)].tolist(), rng.normal(0, 1, n).tolist()))
    rows.append((6, 9, [0.0] * len(rows[0][2]), [0.0] * n))
    d = spark.createDataFrame(rows, "img bigint, rows bigint, g array<double>, b array<double>")
    a = {r.img: r.k for r in predictor.coefficients(d, p).collect()}
    made = predictor.coefficients_in_sql(d, p)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    for r in made.collect():
        assert (r.k is None) == (a[r.img] is None) == (r.img >= 5)
        assert r.k is None or np.allclose(r.k, a[r.img], atol=1e-9)


@pytest.mark.parametrize("border", ["zero", "edge"])
@pytest.mark.parametrize("p", [3, 5])
def test_neighbours_by_join_equal_windows_and_fill_holes(spark, p, border):
    px = spark.range(9 * 7).select(F.lit(1).cast("bigint").alias("img"), F.floor(F.col("id") / 7).alias("r"), (F.col("id") % 7).alias("c"), (F.col("id") * 13 % 97).alias("v"))
    dense = neighbourhood.neighbours(px, p, border)
    assert neighbourhood.neighbours_by_join(px, p, border).select(dense.columns).exceptAll(dense).count() == 0
    holes = px.where("not (r = 4 and c = 3) and not (r = 0 and c = 6)").union(px.withColumn("img", F.lit(2).cast("bigint")))
    got = {(r.img, r.r, r.c): r for r in neighbourhood.neighbours_of_any(holes, p, border).collect()}
    v = {(r.r, r.c): r.v for r in holes.where("img = 1").collect()}
    pad = p // 2
    cells = [(dr, dc) for dr in range(-pad, pad + 1) for dc in range(-pad, pad + 1) if dr or dc]
    assert len(got) == 63 + 61
    for (r, c), own in v.items():
        clamp = (lambda x, top: max(0, min(top, x))) if border == "edge" else (lambda x, top: x)
        want = [v.get((clamp(r + dr, 8), clamp(c + dc, 6)), 0) for dr, dc in cells]
        assert got[1, r, c].v == own and [got[1, r, c][x] for x in neighbourhood.names(p)] == want
