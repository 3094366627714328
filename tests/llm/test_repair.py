"""Conversation repair against an exhaustive search, and the machines themselves."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from pixelveil.llm import oracles, queries, repair

ROWS = "conv_id bigint, turn bigint, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows):
    """Cost, audit and turns by trying all edits, at most two insertions before each row and at the end."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    kinds = faults(rows)
    for edits in itertools.product(*[["D"] if k in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for k in kinds]):
        for puts in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, turns = 2 * sum(map(len, puts)), "", []
            for i, put in enumerate(puts):
                turns += [({"u": "user", "a": "assistant"}[x], "") for x in put]
                audit += "I" * len(put)
                if i < len(rows):
                    e = edits[i]
                    cost += {"D": 3, "K": 0}.get(e, 2) + (e != "D" and kinds[i] == "truncated")
                    audit += e[0]
                    turns += [] if e == "D" else [({"K": rows[i][2], "Ru": "user", "Ra": "assistant"}[e], rows[i][3])]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, turns
    return best


def conversations(n, most, seed):
    r = random.Random(seed)
    texts = ["A text.", "Why?", "no end", "", " \t", None, "x!  \n", "A text."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(conv, r.choice([None, t, t, t, r.randrange(3)]), r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"{r.random()}.") for conv in range(n) for t in range(r.randrange(1, most))]


def test_the_search_finds_the_cheapest_and_least_edits(spark):
    rows = conversations(40, 4, 3) + [(None, 0, "user", "a."), (None, None, "assistant", "b."), (900, 1, "user", "x.")]
    turns, audit, fixed = repair.repair(repair.damage(spark.createDataFrame(rows, ROWS).repartition(3)))
    found = {r.conv: r for r in audit.collect()}
    after = {}
    for r in fixed.orderBy("conv", "seq", "place").collect():
        after.setdefault(r.conv, []).append((r.role, r.text))
    for conv in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv])
        key = " " if conv is None else str(conv)
        if not own:
            assert key not in found
            continue
        cost, label, out = searched(own)
        kinds = faults(own)
        assert (found[key].cost, found[key].audit, after.get(key, [])) == (cost, label, out)
        assert [found[key][x] for x in ("blank", "duplicate", "truncated")] == [kinds.count(x) for x in ("blank", "duplicate", "truncated")]


def test_op11_equals_sql_on_odd_rows(spark, tmp_path):
    long = [(7000, i, ("user", "assistant", "tool")[i % 3 if i % 50 == 0 else i % 2], f"row {i}" + ".!? "[i % 4]) for i in range(3000)]
    rows = conversations(400, 12, 5) + [(None, None, None, None), (None, 3, "user", "x " * 50_000), (8000, None, "user", "a."), (8000, None, "user", "a.")] + long
    frame = spark.createDataFrame(rows, ROWS)
    frame.selectExpr("*", "'clash' as seq", "'clash' as conv", "0 as cost").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(oracles.OP11)
    names = [x[0] for x in want.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(names).collect()))) == sorted(map(repr, want.fetchall()))


def test_empty_tables_and_blank_conversations(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op11_repair(spark, f"{tmp_path}/none").count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    blank = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 1)
    spark.createDataFrame([(dropped, 0, "user", "a."), (blank, 0, "user", "a.")], ROWS).write.parquet(f"{tmp_path}/some/conversations.parquet")
    got = {r.conv_id: r for r in queries.op11_repair(spark, f"{tmp_path}/some").collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (got[dropped].cost, got[dropped].audit, got[dropped].repaired_sha256, got[dropped].gaps) == (0, "", nothing, 0)
    assert (got[blank].cost, got[blank].audit, got[blank].repaired_sha256, got[blank].blank) == (3, "D", nothing, 1)


@pytest.mark.parametrize("symbols", ["", "I", "M", "IMIM", "EIM", "A" * 50, "J", "LP" * 2000])
def test_paths_cost_what_they_say(symbols):
    cost, path = repair.shortest(symbols)
    assert len([x for x, _ in path if x != "I"]) == len(symbols)
    assert re.fullmatch("(s?(ua)+)?", "".join(x for _, x in path))
    price = {"I": 2, "D": 3, "R": 2, "K": 0}
    rows = iter(symbols)
    total = 0
    for label, _ in path:
        total += price[label]
        if label != "I":
            total += label != "D" and (ord(next(rows)) - 65) % 4 == 3 if label != "D" else bool(next(rows)) and 0
    assert total == cost
