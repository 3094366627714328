"""Exact n-gram Jaccard join by a token-group matrix.

Similar documents are put into groups, and for each group the union of its members' tokens (shingles) is kept.
A query's overlap with a union bounds its overlap with every member, so only groups that reach the threshold are
opened and compared member by member.

1. One pass hashes every text's shingle set and counts tokens that different texts of a task share. The frequent ones
   come last in the global token order; any order is right, this one keeps boilerplate out of prefixes.
2. Equal texts count once a task, then once. A set of n tokens has ceil(3n/4) of them in common with any partner, so sets that link share SHARED tokens (or
   as many as that) of their prefixes in this order. Tokens in the prefix of one set only are dropped, then sets
   with too few others, and so on. Which sets share a token is found by a window over the token; the frequent tokens,
   which are shared as it is, needn't meet for that and are spread, so no token's rows are many. Where rows join by token, a
   token of many rows is dealt over parts on both sides.
3. The remaining sets are put into groups by their least token, in blocks of bounded size: linked sets join, and a
   set of which much is in a group's first set joins that group without a link. The first sets of all groups are
   grouped again by the least token in other orders, until what shares a token fits a block.
4. The matrix of (token, group) rows meets the sets' prefix tokens; each (query, group) pair is bounded. Of two groups
   the smaller one's sets ask, so few sets near a group of thousands ask it once each. Within a group, every set that
   isn't linked to its largest part asks. Groups that are asked are opened in blocks of members: an index of the
   block's tokens gives the overlap with the union, and where that allows a link, the overlap with every member.
   Queries are dealt in blocks too, so no task holds or reads more than a block of each.
5. Star contraction joins the linked parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHINGLE, make_rows, rows_from, shingle_sets, small_or_not, stored, with_import_path
from .graph import components

#: Sets that are grouped together, and members and queries of a group that meet in one task.
BLOCK, OPEN = 256, 128
#: Tokens that texts share within SEEN tokens of a task are put last, at most MOST_FREQUENT of them: they only steer the order.
SEEN, MOST_FREQUENT = 1_200_000, 1_000_000
#: Rows of one token that meet in a task of a join by token, on either side; a token with more is dealt over parts. Beyond SPREAD * MOST_SPREAD
#: rows in all it grows with them, so at most MOST_SPREAD tokens are dealt and their table, which is broadcast, is bounded.
SPREAD, MOST_SPREAD = 4096, 500_000
#: Tokens that the prefixes of linked sets share at least, and turns in which sets and tokens without partners are dropped.
SHARED, TURNS = 4, 2
#: Percentage of similarity to a group's first set at which a set joins it without a link; any value gives the same links.
NEAR = 40
#: Rows of a table of set ids that may be broadcast (8 bytes each).
MOST_BROADCAST = 2_000_000
#: Odd factors that give other orders of the tokens; the least token of each order is a grouping key.
_TURNED = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF) for i in range(3)]


def _signed(h: np.ndarray) -> np.ndarray:
    """As Spark's longs; the order changes."""
    return h.view(np.int64)


def _sid(h: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64)) if len(h) else 0


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, sid) per row, and with n -1 (token, count) for tokens of several texts of about ``SEEN`` tokens in a row."""

    def make():
        held: dict[int, np.ndarray] = {}

        def shared():
            tokens, counts = np.unique(np.concatenate([*held.values(), np.empty(0, np.uint64)]), return_counts=True)
            held.clear()
            return _signed(tokens[counts > 1]), counts[counts > 1]

        def rows(ids, sizes, sids, full):
            tokens, counts = shared() if full else (np.empty(0, np.int64), np.empty(0, np.int64))
            k = len(tokens)
            return [pa.concat_arrays([ids, pa.nulls(k, pa.int64())]), *(pa.array(np.concatenate(x)) for x in ((sizes, np.full(k, -1, np.int32)), (sids, tokens), (np.zeros(len(sids), np.int64), counts)))]

        def f(ids, texts):
            sets = shingle_sets(texts, width)
            sids = [_sid(h) for h in sets]
            held.update(zip(sids, sets, strict=True))
            return rows(ids, np.array([len(h) for h in sets], np.int32), np.array(sids, np.int64), sum(map(len, held.values())) > SEEN)

        f.end = lambda: rows(pa.nulls(0, pa.int64()), np.empty(0, np.int32), np.empty(0, np.int64), True)
        return f

    return make_rows(docs, "doc_id bigint, n int, sid bigint, seen bigint", make, arrow=True)


def _frequent(seen: DataFrame) -> np.ndarray:
    """The tokens of (sid, seen) rows that are seen most, at most ``MOST_FREQUENT``, the most frequent last.

    A histogram over eighths of powers of two sets the least number of times, and of the step that doesn't fit as a whole the share of
    its tokens that does, by a hash; no sort meets in one task.
    """
    total = stored(seen.groupBy("sid").agg(F.sum("seen").alias("seen")), "frequent")
    step = F.floor(F.log2("seen") * 8).cast("int")
    low, share, n = 1 << 30, 1000, 0
    for r in sorted(total.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # a few hundred rows
        low, n = r.step, n + r["count"]
        if n > MOST_FREQUENT:
            share = 1000 * (MOST_FREQUENT - n + r["count"]) // r["count"]
            break
    t = total.where((step > low) | (step == low) & (F.pmod(F.xxhash64("sid"), F.lit(1000)) < share)).toArrow()
    tokens, times = t["sid"].to_numpy(), t["seen"].to_numpy()
    return tokens[np.lexsort((tokens, times))].view(np.uint64).copy()


class _Order:
    """The global token order: by hash, but the frequent tokens last, the most frequent of all at the end."""

    def __init__(self, frequent: np.ndarray):
        self.place = np.argsort(frequent, kind="stable").astype(np.int32)
        self.sorted = frequent[self.place]

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, int]:
        """The tokens in order, and how many of them aren't frequent."""
        if not len(self.sorted) or not len(h):
            return h, len(h)
        at = np.searchsorted(self.sorted, h)
        at[at == len(self.sorted)] = 0
        hot = self.sorted[at] == h
        last = h[hot]
        return np.concatenate([h[~hot], last[np.argsort(self.place[at[hot]], kind="stable")]]), len(h) - len(last)


def _postings(docs: DataFrame, width: int, frequent) -> DataFrame:
    """Prefix tokens: (key, sid, n, short, token): short if the token is in the prefix that a partner at least as large needs.

    The key is the token, and ``token`` null; of a frequent token, ``token`` is it and the key a mix of it and the set.
    A task gives each different text once.
    """

    def make():
        order, given = _Order(frequent.value), set()

        def f(texts):
            tokens, sids, ns, shorts, hots = [], [], [], [], []
            for h in shingle_sets(texts, width):
                n, sid = len(h), _sid(h)
                if n and sid not in given:
                    given.add(sid)
                    k, short = min(n, n - (3 * n + 3) // 4 + SHARED), n - (6 * n + 6) // 7 + SHARED
                    ordered, cold = order(h)
                    tokens.append(ordered[:k])
                    sids.append(np.full(k, sid, np.int64))
                    ns.append(np.full(k, n, np.int32))
                    shorts.append(np.arange(k) < short)
                    hots.append(np.arange(k) >= cold)
            if not tokens:
                return [[], [], [], [], []]
            tokens, sids, ns, shorts, hots = (np.concatenate(x) for x in (tokens, sids, ns, shorts, hots))
            keys = np.where(hots, (tokens ^ sids.view(np.uint64)) * _TURNED[0], tokens)
            return [pa.array(_signed(keys)), pa.array(sids), pa.array(ns), pa.array(shorts), pa.array(_signed(tokens), mask=~hots)]

        return f

    return make_rows(docs, "key bigint, sid bigint, n int, short boolean, token bigint", make, arrow=True)


def _sets(docs: DataFrame, width: int, frequent) -> DataFrame:
    """(sid, n, keys, tokens) of the rows (doc_id, sid, text); a row whose text has another sid gives none."""

    def make():
        order = _Order(frequent.value)

        def f(ids, wanted, texts):
            rows = []
            for w, h in zip(wanted.to_pylist(), shingle_sets(texts, width), strict=True):
                if _sid(h) == w:
                    o, _ = order(h)
                    rows.append((w, len(h), [int(_signed(o[:1])[0])] + [int(_signed((h * m).min(keepdims=True))[0]) for m in _TURNED], np.sort(_signed(h))))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

        return f

    return make_rows(docs, "sid bigint, n int, keys array<bigint>, tokens array<bigint>", make, arrow=True)


def _linked(a: np.ndarray, b: np.ndarray, both: int, percent: int) -> bool:
    return 100 * both >= percent * (len(a) + len(b) - both)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Group:
    """Linked sets with the union of their tokens."""

    def __init__(self, leader: int, tokens: np.ndarray):
        self.leader, self.members, self.union = leader, [tokens], tokens

    def open(self, x: np.ndarray, percent: int) -> bool:
        """Whether ``x`` links to a member; members are compared only if the overlap with the union allows one."""
        if 100 * _common(x, self.union) < percent * len(x):
            return False
        small, large = percent * len(x), 100 * len(x)
        return any(small <= 100 * len(m) and percent * len(m) <= large and _linked(x, m, _common(x, m), percent) for m in self.members)

    def add(self, other: Group) -> None:
        self.leader = min(self.leader, other.leader)
        self.members += other.members
        self.union = np.union1d(self.union, other.union)


def close(sets: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int, int]]:
    """(sid, leader, first) of every set of a block: closed under links; ``first`` is the leader that the leader is near to."""
    groups: list[Group] = []
    mine: list[tuple[int, Group]] = []
    for sid, tokens in sets:
        new = Group(sid, tokens)
        hit = [g for g in groups if g.open(tokens, percent)]
        if hit:
            first = hit[0]
            for g in hit[1:]:
                first.add(g)
                groups.remove(g)
                mine = [(s, first if h is g else h) for s, h in mine]
            first.add(new)
            new = first
        else:
            groups.append(new)
        mine.append((sid, new))
    tokens, firsts, near = dict(sets), [], {}
    for leader in sorted(g.leader for g in groups):
        x = tokens[leader]
        near[leader] = next((f for f in firsts if _linked(x, tokens[f], _common(x, tokens[f]), NEAR)), leader)
        if near[leader] == leader:
            firsts.append(leader)
    return [(s, g.leader, near[g.leader]) for s, g in mine]


class Block:
    """Members of a group with an index of their tokens."""

    def __init__(self, parts: list[int], members: list[np.ndarray]):
        self.parts, self.sizes = np.array(parts, np.int64), np.array([len(m) for m in members])
        tokens = np.concatenate(members)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], np.repeat(np.arange(len(members)), self.sizes)[order]

    def open(self, x: np.ndarray, percent: int) -> np.ndarray:
        """The parts with a member that ``x`` links to; members are compared only if the overlap with the union allows one."""
        low, high = np.searchsorted(self.tokens, x, "left"), np.searchsorted(self.tokens, x, "right")
        n = high - low
        if 100 * np.count_nonzero(n) < percent * len(x):
            return self.parts[:0]
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        both = np.bincount(self.owners[at], minlength=len(self.parts))
        return np.unique(self.parts[100 * both >= percent * (len(x) + self.sizes - both)])


def by_group(df: DataFrame, keys: int, out: str, make: Callable[[], Callable[[Iterator[list]], Iterator[tuple]]]) -> DataFrame:
    """Stream runs of equal leading ``keys`` of partitioned and sorted rows through a function; nothing is held but what it holds.

    Array columns come as numpy arrays.
    """
    with_import_path(df.sparkSession)
    schema = T.StructType.fromDDL(out)

    def rows(batches):
        for b in batches:
            cols = [[None if v is None else np.asarray(v.values) for v in c] if pa.types.is_list(c.type) else c.to_pylist() for c in b.columns]
            yield from zip(*cols, strict=True)

    def run(batches):
        from itertools import groupby

        f, buffer = make(), []
        for _, group in groupby(rows(batches), key=lambda r: r[:keys]):
            for x in f(group):
                buffer.append(x)
                if len(buffer) >= 5000:
                    yield rows_from(schema, [list(c) for c in zip(*buffer, strict=True)])
                    buffer = []
        if buffer:
            yield rows_from(schema, [list(c) for c in zip(*buffer, strict=True)])

    return df.mapInArrow(run, schema)


def _needed(n: str):
    """Tokens that the prefix of a set of ``n`` shares with that of a linked set, at least."""
    return F.least(F.lit(SHARED), F.ceil(F.col(n) * 3 / 4))


def _blocks(counts: DataFrame, key: str, size: int) -> DataFrame:
    return counts.select(key, F.ceil(F.col("count") / size).cast("int").alias("blocks"))


def _wide(postings: DataFrame, most: int) -> DataFrame | None:
    """(token, lefts): the tokens of more than ``most`` rows, of which there are few, and over how many parts each is dealt."""
    counts = postings.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > most)
    wide = stored(counts.select("token", F.ceil(F.col("k") / most).cast("int").alias("lefts")), "wide")
    return wide if wide.count() else None


def _dealt(rows: DataFrame, wide: DataFrame, by: str | None, own: str, part: str, copies: tuple[str, str] | None) -> DataFrame:
    """``rows`` with the number ``part`` of ``own`` parts that ``by`` puts a row in, once for each part of the other side."""
    parts = lambda n: F.coalesce(n, F.lit(1))
    new = [F.pmod(F.xxhash64(by), parts(own)).cast("int").alias(part)] if by else []
    new += [F.explode(F.sequence(F.lit(0), parts(copies[0]) - 1)).alias(copies[1])] if copies else []
    return rows.join(F.broadcast(wide), "token", "left").select(*rows.columns, *new)


def _meet(left: DataFrame, right: DataFrame, wide: DataFrame | None, by: str | None = None) -> DataFrame:
    """``left`` joined with ``right`` by token. Rows of a wide token are dealt by set on the left, and on the right by ``by`` (if null,
    a token has one row there); every part meets a copy of every part of the other side, so no key holds more than a part of each."""
    if wide is None:
        return left.join(right, "token")
    left = _dealt(left, wide, "sid", "lefts", "l", ("rights", "r") if by else None)
    return left.join(_dealt(right, wide, by, "rights", "r", ("lefts", "l")), ["token", "l", *(["r"] if by else [])]).drop("l", "r")


def _groups(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(sid, part, group): parts of linked sets and groups of similar parts, until every key's groups fit one block."""
    base, leaders, turns = sets.select("sid", F.col("sid").alias("part"), F.col("sid").alias("group")), sets, len(_TURNED) + 1
    for turn in range(3 * turns):
        key = "key"
        leaders = leaders.withColumn(key, F.col("keys")[turn % turns])
        counts = stored(leaders.groupBy(key).count().where("count > 1"), "counts")
        n, most = counts.agg(F.count("*"), F.max("count")).first()
        if turn >= turns and (most or 0) <= block:
            break
        if not n:
            continue
        keyed = leaders.join(small_or_not(_blocks(counts, key, block), n, MOST_BROADCAST), key).select(key, F.pmod("sid", "blocks").alias("block"), "sid", "tokens")
        keyed = keyed.repartition(key, "block").sortWithinPartitions(key, "block", "sid")
        moves = by_group(keyed, 2, "old bigint, leader bigint, first bigint", lambda: lambda rows: close([(r[2], r[3]) for r in rows], percent))
        moves = stored(moves.where("old <> first"), "moves")
        moved = moves.count()
        if moved:
            base = base.join(small_or_not(moves, moved, MOST_BROADCAST), F.col("group") == F.col("old"), "left")
            part = F.when(F.col("part") == F.col("old"), F.col("leader")).otherwise(F.col("part"))
            base = stored(base.select("sid", part.alias("part"), F.coalesce("first", "group").alias("group")), "groups")
            leaders = leaders.join(small_or_not(moves.select(F.col("old").alias("sid")), moved, MOST_BROADCAST), "sid", "left_anti")
    return stored(base, "groups")


def _sized(df: DataFrame, what: str) -> DataFrame:
    """A stored table of one row per group, which may be broadcast if it is small: rows of a large group then don't meet."""
    df = stored(df, what)
    return small_or_not(df, df.count(), MOST_BROADCAST // 4)


def _within(comp: DataFrame) -> DataFrame:
    """(sid, own, group): sets that ask their own group: those outside its largest part."""
    parts = comp.groupBy("group", "part").agg(F.count("*").alias("size"))
    most = parts.groupBy("group").agg(F.max(F.struct("size", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    return comp.join(_sized(most.select("group", F.col("most.part").alias("largest")), "largest"), "group").where("part <> largest").select("sid", F.col("part").alias("own"), "group")


def _open(sets: DataFrame, comp: DataFrame, queries: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): parts joined by a link, from (sid, own, group) queries. Every block of members meets every block of queries."""
    askers = _blocks(queries.groupBy("group").count(), "group", block).withColumnRenamed("blocks", "askers")
    size = _sized(_blocks(comp.groupBy("group").count(), "group", block).join(askers, "group"), "blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = comp.join(size, "group").select("group", F.pmod("sid", "blocks").alias("block"), each("askers").alias("asker"), F.lit(0).alias("query"), "sid", F.col("part").alias("own"))
    asked = queries.join(size, "group").select("group", each("blocks").alias("block"), F.pmod(F.xxhash64("sid"), F.col("askers")).cast("int").alias("asker"), F.lit(1).alias("query"), "sid", "own")
    rows = members.withColumn("block", F.col("block").cast("int")).union(asked).join(sets.select("sid", "tokens"), "sid").select("group", "block", "asker", "query", "sid", "own", "tokens")
    rows = rows.repartition("group", "block", "asker").sortWithinPartitions("group", "block", "asker", "query", "sid")

    def make():
        def f(rows):
            parts, held, index, found = [], [], None, set()
            for _, _, _, query, _, own, tokens in rows:
                if not query:
                    parts.append(own)
                    held.append(tokens)
                elif held:
                    if index is None:
                        index = Block(parts, held)
                    for part in index.open(tokens, percent).tolist():
                        pair = (min(own, part), max(own, part))
                        if own != part and pair not in found:
                            found.add(pair)
                            yield pair

        return f

    return by_group(rows, 3, "a bigint, b bigint", make)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = 75, block: int = BLOCK, open_block: int = OPEN, spread: int = SPREAD) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Two texts link when 100 * |A and B| >= ``percent`` * |A or B| over their sets of ``width``-word shingles; the
    component id is the least id reachable by links. ``percent`` is 75 or more, for which the prefixes are made.
    A null or empty text, or one without words, has an empty set and links with nothing: it is its own component.
    A text of fewer words than ``width`` is one shingle. A row with a null id has a null component and isn't used
    to link others. Equal texts, and repeated rows, share a component. An empty table gives no rows. Other columns
    of ``docs`` play no part. Sets are compared by 64-bit hashes of their shingles.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    both = stored(_signatures(base, width), "signatures")
    rows = both.where("n >= 0").select("doc_id", "n", "sid")
    shared = spark.sparkContext.broadcast(_frequent(both.where("n < 0").select("sid", "seen")))

    # A frequent token's rows are spread by set.
    by_token = Window.partitionBy("key", "token")
    every = _postings(base.where("doc_id is not null").select("text"), width, shared)
    found = every.select("*", F.min("sid").over(by_token).alias("lo"), F.max("sid").over(by_token).alias("hi"), F.max("short").over(by_token).alias("any"))
    found = found.where("token is not null or lo <> hi and any")
    once = found.select("key", "token", "sid", "n", "short").distinct()  # rows of one token and set are together already
    postings = stored(once.select(F.coalesce("token", "key").alias("token"), "sid", "n", "short"), "postings")
    most = max(spread, postings.count() // MOST_SPREAD)
    wide = _wide(postings, most)

    for _ in range(TURNS):
        enough = postings.groupBy("sid").agg(F.count("*").alias("k"), F.min("n").alias("n")).where(_needed("n") <= F.col("k")).select("sid")
        left = postings.join(enough, "sid")
        again = left.groupBy("token").agg(F.count("*").alias("k"), F.max("short").alias("any")).where("k > 1 and any").select("token")
        postings = stored(_meet(left, again, wide).select("token", "sid", "n", "short"), "postings")

    active = stored(postings.select("sid").distinct().join(rows.where("doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "sid"), "active")
    texts = base.join(small_or_not(active, active.count(), MOST_BROADCAST), "doc_id").select("doc_id", "sid", "text")
    sets = stored(_sets(texts, width, shared), "sets")
    if sets.groupBy("sid").count().where("count > 1").limit(1).count():  # repeated rows
        sets = stored(sets.dropDuplicates(["sid"]), "sets")

    comp = _groups(sets, percent, block)
    sizes = _sized(comp.groupBy("group").agg(F.count("*").alias("size")), "sizes")
    matrix = postings.join(comp.join(sizes, "group").select("sid", "part", F.col("group").alias("home"), "size"), "sid")
    row = matrix.groupBy("token", "home").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("short").alias("any"), F.max("size").alias("large"))
    row = row.select("token", F.col("home").alias("group"), "least", "most", "any", "large")
    if wide is not None:
        row = stored(row, "matrix")
        groups = row.join(F.broadcast(wide), "token").groupBy("token").agg(F.ceil(F.count("*") / most).cast("int").alias("rights"))
        wide = stored(wide.join(groups, "token"), "wide")
    probe = _meet(matrix, row, wide, "group")
    probe = probe.where(f"(size < large or size = large and home < group) and (short or any) and {percent} * n <= 100 * most and {percent} * least <= 100 * n")
    bound = probe.groupBy("sid", F.col("part").alias("own"), "group").agg(F.count("*").alias("k"), F.min("n").alias("n")).where(_needed("n") <= F.col("k"))
    queries = stored(bound.select("sid", "own", "group").union(_within(comp)), "queries")
    joined = components(stored(_open(sets, comp, queries, percent, open_block).distinct(), "joined"))

    root = comp.join(joined, comp.part == joined.node, "left").select("sid", F.coalesce("root", "part").alias("root"))
    least = rows.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("low")).join(root, "sid", "left")
    tops = least.where("root is not null").groupBy("root").agg(F.min("low").alias("top"))
    top = least.join(tops, "root", "left").select("sid", F.coalesce("top", "low").alias("component"))
    out = rows.join(top, "sid", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))).alias("component_id"))
