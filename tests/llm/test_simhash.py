"""SimHash near duplicates against all pairs, and the covering code itself."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelveil.llm import queries, simhash

DOCS = "doc_id bigint, text string"


def plain(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """By comparing all pairs of distinct fingerprints."""
    ids = {}
    for i, f in rows:
        ids[f] = min(i, ids.get(f, i))
    fps = sorted(ids)
    x = np.array(fps, np.uint64)
    top = list(range(len(x)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2):
            a, b = sorted((find(i), find(int(j))), key=lambda k: ids[fps[k]])
            top[b] = a
    return {f: ids[fps[find(i)]] for i, f in enumerate(fps)}


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def texts(seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(300)}" for _ in range(400)]
    out = [" ".join(base)] * 5 + ["", None, " \t\n", "one", "One two", "one TWO", "É\x85x y\x0bz", "a b c " * 20_000]
    for i in range(120):  # near copies, a word or two apart
        w = base[:]
        for _ in range(1 + i % 2):
            w[r.randrange(len(w))] = f"x{i}"
        out.append(" ".join(w))
    return out + [" ".join(f"v{r.randrange(5000)}" for _ in range(r.randrange(1, 60))) for _ in range(200)]


@pytest.mark.parametrize("cell", [8, 4096])
def test_components_equal_all_pairs(spark, cell):
    rows = [(3 * i + 1, t) for i, t in enumerate(texts(2))] + [(0, "one"), (0, "one")]
    d = spark.createDataFrame(rows + [(None, "one")], DOCS).withColumn("fp", F.lit("clash")).withColumn("Fingerprint", F.lit("clash")).repartition(4)
    got = simhash.near_duplicates(d, cell=cell).select("doc_id", simhash.as_hex().alias("hex"), "component_id").collect()
    want = components([(i, plain(t)) for i, t in rows])
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, (f"{plain(t):016x}", want[plain(t)]))
    assert len(got) == len(rows) + 1 and len(set(want.values())) < len(want)
    for r in got:
        assert (r.hex, r.component_id) == (by_id[r.doc_id] if r.doc_id is not None else (f"{plain('one'):016x}", None))


@pytest.mark.parametrize("cell", [16, 4096])
def test_links_of_dense_fingerprints(spark, cell):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = {c ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) & (1 << 64) - 1 for c in centres for _ in range(150)}
    fps = {f & (1 << 64) - 1 for f in fps}
    links = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"), cell=cell).collect()
    want = components([(f, f) for f in fps])
    top = {f: f for f in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = a & (1 << 64) - 1, b & (1 << 64) - 1
        assert (a ^ b).bit_count() <= 64 and want[a] == want[b]
        x, y = sorted((find(a), find(b)))
        top[y] = x
    assert {f: find(f) for f in fps} == want


def test_every_half_has_a_home_and_partners_meet_there(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)] + [0]
    pairs = [(x, x ^ (1 << i) ^ (1 << j)) for x in base for i, j in [(r.randrange(64), r.randrange(64)) for _ in range(6)]]
    every = sorted({f for p in pairs for f in p})
    at, homes = {}, {}
    for x in simhash.anchored(spark.createDataFrame([(signed(f),) for f in every], "fp bigint")).collect():
        f = x.fp & (1 << 64) - 1
        at.setdefault(f, set()).add(x.anchor)
        if x.home:
            homes.setdefault(f, set()).add(x.anchor)
        half, word = divmod(x.anchor, 1 << 31)
        assert ((f >> 32 * half & (1 << 31) - 1) ^ word).bit_count() <= (1 if x.home else 2)
        assert all((word & m).bit_count() % 2 == 0 for m in simhash.CHECKS)
    assert all(len(homes[f]) == 2 and len(at[f]) in (2, 17, 32) for f in every)
    assert all(homes[a] & at[b] and homes[b] & at[a] for a, b in pairs)


def test_op13_on_the_smallest_tables(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = components([(i, plain(t)) for i, t in rows])
    got = queries.op13_simhash(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{plain(t):016x}", want[plain(t)]) for i, t in rows)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_simhash(spark, str(tmp_path)).count() == 0
