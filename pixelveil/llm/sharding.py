"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions alone.

Rows are numbered without a global sort: by the bucket of a checksum, then by id within it. A permutation of the numbers is a
Feistel network over a grid just large enough for them; numbers that fall outside the rows walk the cycle until
they are inside. The permuted number alone gives shard and slot, so a row's place can be computed.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_or_not, stored

#: Pairs of rounds; least number of buckets, and rows of a bucket at most on average beyond it.
ROUNDS, BUCKETS, BUCKET_ROWS = 6, 1024, 1_000_000
#: Buckets whose first numbers may be broadcast (16 bytes each).
MOST_BROADCAST = 2_000_000
#: Modulus and factors of a round's mixing; products of numbers below the modulus fit a long.
MODULUS, FACTORS = (1 << 31) - 1, (1_597_334_677, 1_103_515_245)


def grid(n: int) -> tuple[int, int]:
    """Sides of the least nearly square grid with at least ``n`` cells; fewer than one side's length are unused."""
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def key(seed: int, turn: int) -> int:
    """A round's key, below the modulus; it differs with seed and turn."""
    return (seed * 2_654_435_761 + (turn + 1) * 805_459_861) % MODULUS


def buckets_for(n: int) -> int:
    return max(BUCKETS, -(-n // BUCKET_ROWS))


def _mix(c: Column, seed: int, turn: int, side: int) -> Column:
    """A number below ``side`` from one below the modulus: products and shifts by turns, which any SQL can compute."""
    long = lambda x: F.lit(x).cast("bigint")
    first = F.pmod(c * long(FACTORS[0]) + long(key(seed, turn)), long(MODULUS))
    second = F.pmod(first.bitwiseXOR(F.shiftright(first, 15)) * long(FACTORS[1]) + long(key(seed, turn)), long(MODULUS))
    return F.pmod(second.bitwiseXOR(F.shiftright(second, 13)), long(side))


def feistel(c: Column, n: int, seed: int) -> Column:
    """One application of the network to numbers of the grid of ``n`` cells."""
    a, b = grid(n)
    pair = F.struct(F.floor(c / b).cast("bigint").alias("l"), F.pmod(c, F.lit(b).cast("bigint")).alias("r"))
    # Each round is a lambda's argument, so that no expression is copied. A lambda of two arguments would get the index too.
    turn = lambda k: lambda p: F.struct(F.pmod(p["l"] + _mix(p["r"], seed, 2 * k, a), F.lit(a).cast("bigint")).alias("l"), p["r"].alias("r"))
    back = lambda k: lambda p: F.struct(p["l"].alias("l"), F.pmod(p["r"] + _mix(p["l"], seed, 2 * k + 1, b), F.lit(b).cast("bigint")).alias("r"))
    at = F.array(pair)
    for k in range(ROUNDS):
        at = F.transform(F.transform(at, turn(k)), back(k))
    return F.transform(at, lambda p: p["l"] * b + p["r"])[0]


def permuted(c: Column, n: int, seed: int) -> Column:
    """The number's image under a permutation of 0 to n - 1.

    The walk is at most as long as the grid has unused cells plus one, and only the few numbers outside take steps.
    """
    a, b = grid(n)
    spare = a * b - n
    once = F.transform(F.array(c), lambda x: feistel(x, n, seed))
    walk = lambda x: F.when(x < n, x).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(spare)), x, lambda y, _: F.when(y < n, y).otherwise(feistel(y, n, seed))))
    return F.transform(once, walk)[0] if spare else once[0]


def numbered(df: DataFrame, keys: list[str], name: str = "row_number", buckets: int = BUCKETS) -> DataFrame:
    """Rows with a number from 0 without gaps, which depends on the rows alone and not on their partitions.

    Equal rows get neighbouring numbers in any order, and share a bucket. ``df`` is evaluated twice; store it before.
    Nulls come first in their bucket; an empty table gives no rows.
    """
    spot = F.pmod(F.crc32(F.encode(F.concat_ws("|", *keys), "UTF-8")), F.lit(buckets).cast("bigint")).alias("bucket__")
    counts = df.groupBy(spot).agg(F.count("*").alias("n"))
    # One row per bucket meets here.
    first = counts.select("bucket__", (F.sum("n").over(Window.orderBy("bucket__")) - F.col("n")).alias("first__"))
    order = Window.partitionBy("bucket__").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    out = df.select("*", spot).withColumn(name, F.row_number().over(order).cast("bigint") - 1)
    return out.join(small_or_not(first, buckets, MOST_BROADCAST), "bucket__").withColumn(name, F.col(name) + F.col("first__")).drop("bucket__", "first__")


def shard(docs: DataFrame, shards: int = 40, seed: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, row_number, position, law, shard, slot, grown_shard`` for every row.

    The law is ``rows``: shards' counts are at most one apart, and slots run from 0 without gaps. ``size`` is the
    text's UTF-8 bytes plus 16; a null text counts as empty, with checksum 0. Rows with null or repeated ids are
    numbered like others, by id, size and checksum. An empty table gives no rows. Other columns play no part. The
    place of a row doesn't depend on partitions, and a hot source or text makes no shard larger.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    b = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 16).cast("bigint").alias("size"), F.crc32(b).alias("text_crc32")), "rows")
    n = rows.count()
    out = numbered(rows, ["doc_id", "size", "text_crc32"], buckets=buckets_for(n)).withColumn("position", permuted(F.col("row_number"), max(n, 1), seed))
    return out.withColumn("law", F.lit("rows")).withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("position") / shards).cast("bigint")).withColumn("grown_shard", F.lit(None).cast("int"))
