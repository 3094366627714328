"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by weighted finite-state composition.

Three machines are composed. The input acceptor is the chain of a conversation's rows, each one symbol: the class of its
role's initial and its first fault. The edit transducer keeps, reroles, deletes or inserts, with a label and a cost each;
it counts insertions in a row, so the composition has no cycle. The grammar acceptor takes role initials ``(s?(ua)+)?``.
States (row, insertions, grammar state) are only made as the search reaches them, in topological order from the end, with
weights (cost, labels) in lexicographic order: a state keeps its least cost and the least label that leads on at that cost, so
the least label string is read off from the start. The vector of a row depends on the symbol and on the differences of
the next row's costs alone, so equal steps are made once.

Rows are sorted by ranges of (conversation, turn) and numbered in place, so no conversation is gathered with its texts. What
meets in one task is one byte a row of a conversation, the size of its label string. Edits go back to the rows by number.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_from, stored, with_import_path

#: Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: By grammar state (nothing yet, after s, after u, after a) the initials it takes, and the state then.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: A third insertion in a row would come back to a grammar state at a higher cost.
MOST_INSERTS = 2
NAMES = {"u": "user", "a": "assistant"}
#: Initials by class, and faults by number; a symbol is a letter, A for class 0 and fault 0.
INITIALS, FAULTS = " sua", ("", "blank", "duplicate", "truncated")
_LEGAL = {"su", "ua", "au"}
#: Symbols in a piece, and edits in a batch.
PIECE = 1 << 16


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the test damage that crc32 of ``conv_id:turn`` modulo 20 picks.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user. A null role or
    text, and a null id or turn in the checksum's text, is one space; ids and turns stay null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    some = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return some.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _symbol(role: Column, text: Column) -> Column:
    initial = F.when(role.startswith("s"), 1).when(role.startswith("u"), 2).when(role.startswith("a"), 3).otherwise(0)
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3)
    return F.char(F.lit(65) + initial * 4 + fault)


def conv_key(conv_id: str = "conv_id") -> Column:
    """A conversation's name: its id as text; rows with a null id are one conversation, a space."""
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(" "))


def ordered(rows: DataFrame) -> DataFrame:
    """``(conv, seq, turn, role, text, symbol, same)``: rows stored in order of conversation, turn (nulls first), role and text.

    ``seq`` rises in that order. ``same`` is a digest of role and text. Null roles and texts become one space.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    r = rows.select(conv_key().alias("conv"), "turn", space("role").alias("role"), space("text").alias("text"))
    dealt = r.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    same = F.unhex(F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary")))
    return stored(dealt.withColumn("seq", F.monotonically_increasing_id()).withColumn("symbol", _symbol(F.col("role"), F.col("text"))).withColumn("same", same), "turns")


def _pieces(rows: DataFrame) -> DataFrame:
    """``(conv, seq, symbols)``: runs of a conversation's rows whose numbers follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, seq, symbol = (b.column(i).to_pylist() for i in range(3))
            cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1] or seq[i] != seq[i - 1] + 1), len(conv)]
            cuts = [x for a, z in zip(cuts, cuts[1:], strict=False) for x in range(a, z, PIECE)] + [len(conv)]
            runs = list(zip(cuts, cuts[1:], strict=False))
            yield rows_from(schema, [[conv[a] for a, _ in runs], [seq[a] for a, _ in runs], ["".join(symbol[a:z]) for a, z in runs]])

    schema = T.StructType.fromDDL("conv string, seq bigint, symbols string")
    return rows.select("conv", "seq", "symbol").mapInArrow(run, schema)


def arcs(symbol: str | None, inserted: int, state: int) -> Iterator[tuple[str, int, str, bool, int]]:
    """The composed machine's arcs from one state: label, cost, initial put out, whether the symbol is taken, grammar state."""
    takes = GRAMMAR[state]
    if inserted < MOST_INSERTS:
        yield from (("I", INSERT, x, False, takes[x]) for x in NAMES if x in takes)
    if symbol is None:
        return
    kind, fault = divmod(ord(symbol) - 65, 4)
    yield "D", DELETE, "", True, state
    if FAULTS[fault] not in ("blank", "duplicate"):
        more = TRUNCATED if FAULTS[fault] == "truncated" else 0
        if INITIALS[kind] in takes:
            yield "K", more, INITIALS[kind], True, takes[INITIALS[kind]]
        yield from (("R", REROLE + more, x, True, takes[x]) for x in NAMES if x in takes)


@lru_cache(maxsize=65536)
def _step(symbol: str | None, after: tuple[int, ...] | None) -> tuple[int, tuple[int, ...], dict]:
    """One row's states from the costs ``after`` it: the least cost, what each grammar state costs beyond it, and the best arc of each state."""
    cost: dict[tuple[int, int], float] = {}
    best: dict[tuple[int, int], tuple] = {}
    for inserted in range(MOST_INSERTS, -1, -1):
        for state in range(len(GRAMMAR)):
            ways = [(0, "", "", True, state)] if symbol is None and state in FINAL else []
            for label, price, initial, takes, to in arcs(symbol, inserted, state):
                rest = after[to] if takes else cost[inserted + 1, to]
                ways.append((price + rest, label, initial, takes, to))
            ways = [w for w in ways if w[0] < float("inf")]
            cost[inserted, state] = min(ways)[0] if ways else float("inf")
            if ways:
                best[inserted, state] = min(ways)
    least = min(cost[0, s] for s in range(len(GRAMMAR)))
    return least, tuple(cost[0, s] - least for s in range(len(GRAMMAR))), best


def shortest(symbols: str) -> tuple[int, list[tuple[str, str]]]:
    """The least cost of a conversation's symbols, and the (label, initial) arcs of the least label string at that cost."""
    total, vector, best = _step(None, None)
    tables = [best]
    for x in reversed(symbols):
        more, vector, best = _step(x, vector)
        total += more
        tables.append(best)
    cost, path, state = total + vector[0], [], 0
    for table in reversed(tables):
        inserted, takes = 0, False
        while not takes:
            _, label, initial, takes, state = table[inserted, state]
            inserted += 1
            if label:
                path.append((label, initial))
    return int(cost), path


def _marked(pieces: list[tuple[int, str]], repeats: list[int]) -> str:
    """The symbols of a conversation's sorted pieces, rows with the numbers ``repeats`` marked as duplicates unless blank."""
    starts, out = [s for s, _ in pieces], [bytearray(x, "ascii") for _, x in pieces]
    for seq in repeats:
        k = bisect_right(starts, seq) - 1
        at = seq - starts[k]
        if (fault := (out[k][at] - 65) % 4) != 1:
            out[k][at] += 2 - fault
    return b"".join(out).decode("ascii")


def audits(rows: DataFrame) -> DataFrame:
    """``(conv, pieces, blank, duplicate, truncated, illegal, cost, audit, roles)`` of stored, ordered rows, one row per conversation.

    ``audit`` has the edits' initials, ``roles`` the initials they put out, a space for a deletion. A row counts by its first
    fault. ``illegal`` counts neighbours whose initials aren't su, ua or au.
    """
    first = rows.groupBy("conv", "same").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").select("conv", "same", "first")
    repeats = rows.select("conv", "same", "seq").join(first, ["conv", "same"]).where("seq > first").select("conv", "seq", F.lit(None).cast("string").alias("symbols"))
    every = _pieces(rows).union(repeats).groupBy("conv").agg(F.collect_list(F.struct("seq", "symbols")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pieces = sorted((p["seq"], p["symbols"]) for p in parts if p["symbols"] is not None)
                symbols = _marked(pieces, [p["seq"] for p in parts if p["symbols"] is None])
                faults = [(ord(x) - 65) % 4 for x in symbols]
                initials = [INITIALS[(ord(x) - 65) // 4] for x in symbols]
                cost, path = shortest(symbols)
                row = [conv, [{"seq": s, "n": len(x)} for s, x in pieces], faults.count(1), faults.count(2), faults.count(3)]
                row += [sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:], strict=False)), cost, "".join(x for x, _ in path), "".join(x or " " for _, x in path)]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield rows_from(schema, out)

    schema = T.StructType.fromDDL("conv string, pieces array<struct<seq: bigint, n: bigint>>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, roles string")
    return every.mapInArrow(run, schema)


def _edits(audit: DataFrame) -> DataFrame:
    """``(seq, edit, initial, before, behind)`` for every row: its edit and the initial put out, and those inserted before it and, at the end, behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pieces, audit, roles in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seqs = (s for p in pieces for s in range(p["seq"], p["seq"] + p["n"]))
                out: list[list] = []
                before = ""
                for label, initial in zip(audit, roles, strict=True):
                    if label == "I":
                        before += initial
                        continue
                    if len(out) == PIECE:
                        yield rows_from(schema, list(zip(*out, strict=True)))
                        out = []
                    out.append([next(seqs), label, initial, before, ""])
                    before = ""
                if out:
                    out[-1][-1] = before
                    yield rows_from(schema, list(zip(*out, strict=True)))

    schema = T.StructType.fromDDL("seq bigint, edit string, initial string, before string, behind string")
    return audit.select("pieces", "audit", "roles").mapInArrow(run, schema)


def repaired(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """``(conv, seq, place, edit, role, text)`` of the turns after the edits, in order of ``seq`` and ``place``.

    Inserted turns have an empty text and edit I, and the number of the row before which, or at the end behind which, they come.
    """
    name = lambda x: F.when(x == "u", NAMES["u"]).otherwise(NAMES["a"])
    put = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(F.lit("I").alias("edit"), name(x).alias("role"), F.lit("").alias("text")))
    role = F.when(F.col("edit") == "R", name(F.col("initial"))).otherwise(F.col("role"))
    own = F.filter(F.array(F.struct(F.col("edit").alias("edit"), role.alias("role"), F.col("text").alias("text"))), lambda x: x["edit"] != "D")
    both = rows.select("conv", "seq", "role", "text").join(_edits(audit).hint("merge"), "seq")  # label strings pack well: their table's size says little of the rows
    return both.select("conv", "seq", F.posexplode(F.concat(put("before"), own, put("behind"))).alias("place", "t")).select("conv", "seq", "place", "t.edit", "t.role", "t.text")


def digests(turns: DataFrame) -> DataFrame:
    """``(conv, sha256)`` of each conversation's ``role:text``, joined by line feeds; texts stream through, none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            done: list[tuple[str, str]] = []
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield rows_from(schema, [[x for x, _ in done], [x for _, x in done]])
        if now is not None:
            yield rows_from(schema, [[now], [sha.hexdigest()]])

    schema = T.StructType.fromDDL("conv string, sha256 string")
    return turns.repartition("conv").sortWithinPartitions("conv", "seq", "place").select("conv", "role", "text").mapInArrow(run, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ordered rows, the audit of each conversation and its repaired turns, of rows ``(conv_id, turn, role, text)``.

    Other columns play no part. Rows with a null id make one conversation, null turns come first, null roles and texts are one
    space; rows of one turn are ordered by role and text, and equal rows are duplicates of the first. A role counts by its first
    character, s, u or a; others, and an empty role, fit nowhere and are reroled or deleted. Texts may be of any length. A conversation
    of blank rows alone has an audit of deletions and no turns; an empty table gives empty tables.
    """
    with_import_path(rows.sparkSession)
    turns = ordered(rows)
    audit = stored(audits(turns), "audits")
    return turns, audit, repaired(turns, audit)
