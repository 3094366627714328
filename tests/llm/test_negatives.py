"""Hard negatives by radix selection against plain sorting."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelveil.llm import negatives, oracles, queries

ROWS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=5):
    """Rows as (vec_id, ints, label), each by itself."""
    width = max((len(v) for _, v, _ in rows), default=0)
    m = np.array([list(v) + [0] * (width - len(v)) for _, v, _ in rows], object).reshape(len(rows), width)
    out = []
    for i, (a, _, label) in enumerate(rows):
        if a % 100:
            continue
        s = [int(sum(m[i] * m[j])) for j in range(len(rows))]
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-s[j], rows[j][0]))
        for p in [j for j in order if rows[j][2] == label][:k]:
            some = [j for j in order if rows[j][2] != label and 80 * s[p] <= 100 * s[j] <= 100 * s[p]][:k]
            out += [(a, rows[p][0], r + 1, rows[j][0], s[p], s[j]) for r, j in enumerate(some)]
    return sorted(out)


def table(n, seed, width=6, ties=True):
    r = np.random.default_rng(seed)
    v = r.normal(0, 0.3, (n, width)).astype(np.float32)
    if ties:
        v[: n // 3] = v[0]  # one vector is a third of all
        v[n // 3 : n // 2] = np.round(v[n // 3 : n // 2])
    return [(int(i) * 5, [float(x) for x in v[i]], int(r.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("anchors", [3, 4096])
def test_negatives_equal_sorting(spark, anchors, monkeypatch):
    monkeypatch.setattr(negatives, "FEW", 4)
    rows = table(240, 1) + [(100, [0.5] * 6, 1), (100, [0.5] * 6, 1), (300, [], 2), (405, [0.25, -1.0], 0)]
    bad = [(None, [1.0] * 6, 1), (500, None, 1), (600, [1.0, None], 1), (700, [float("nan")], 1), (800, [float("inf")], 0), (900, [1.0], None)]
    d = spark.createDataFrame(rows + bad, ROWS).withColumn("row", F.lit("clash")).withColumn("v", F.lit("clash")).repartition(5)
    got = negatives.mine(negatives.prepared(d), F.col("vec_id") % 100 == 0, anchors_a_round=anchors)
    whole = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], label) for i, v, label in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute(whole)


def test_large_scores_stay_exact(spark):
    rows = [(i, [float(2**21 + i), float(i * 1000)], i // 10 % 3 % 2) for i in range(0, 300, 10)]
    got = negatives.mine(negatives.prepared(spark.createDataFrame(rows, ROWS)), F.col("vec_id") % 100 == 0)
    whole = [(i, [int(256 * np.float64(np.float32(x))) for x in v], label) for i, v, label in rows]
    want = brute(whole)
    assert max(abs(x[4]) for x in want) > 2**53 and sorted(tuple(r) for r in got.collect()) == want


def test_nothing_to_mine(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [], 1), (200, [], 1)]):
        d = negatives.prepared(spark.createDataFrame(rows, ROWS))
        assert negatives.mine(d, F.col("vec_id") % 100 == 0).collect() == []
    zero = [(100, [], 1), (101, [], 1), (102, [], 2)]
    got = negatives.mine(negatives.prepared(spark.createDataFrame(zero, ROWS)), F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in got] == [(100, 101, 1, 102, 0, 0)]


def test_op12_equals_sql(spark, tmp_path):
    rows = table(900, 4, ties=False) + [(7000, None, 1), (None, [1.0] * 6, 1)]
    spark.createDataFrame(rows, ROWS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_negatives(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(oracles.OP12)
    names = [x[0] for x in want.description]
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(want.fetchall())
