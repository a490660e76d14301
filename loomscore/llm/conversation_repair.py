"""Cheapest repair of conversations to ``s?(ua)+`` or nothing, by a recursive DuckDB query in hash-partitioned batches.

A conversation's rows are taken by turn (nulls first; ties by role, then by
the md5 of the text).  Spark deals them by a hash of conversation and block of
``BLOCK`` turns and sorts them there; a task hands batches of them to DuckDB,
whose recursive query goes one row further with each recursion, for all
conversations of the batch at once, and keeps for each grammar state the least
cost and, of its audits, the ASCII-least.  A batch's part of a conversation (a
piece, of at most ``PIECE`` rows) is solved from each of the four states that
it may begin in, so pieces can be put together afterwards, by a second
recursive query that goes one piece further with each recursion.  Therefore a
conversation of any length is the work of many tasks, and a batch is bounded
whatever its rows.  The least audit may be kept state by state: two prefixes
that end in one state at one cost are never one the beginning of the other,
as what follows would be inserts, which cost.

Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may
end.  What a Rerole or an Insert makes follows from the state: after u an
assistant, else a user.

Results at the edges: a null role or text counts as one space; null
conversation ids are one conversation; rows with equal turn, role and text are
duplicates but for the first; whole texts count, whatever their length; other
columns are ignored, so their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: 2 to the power of BLOCK turn numbers are dealt together.
BLOCK = 5
#: Rows of a piece: the depth of a recursion.
PIECE = 32
SPACE = " \t\n\x0b\x0c\r"
#: Initials that may follow each other.
LEGAL = ("su", "ua", "au")


def following(state: int) -> int:
    return 3 if state == 2 else 2


def steps() -> list[tuple[str, int, str, int, int]]:
    """(kind, state, edits, state after, cost) of a row with the inserts before it.

    Kinds: s, u, a, o (another initial), in upper case if truncated; x if the
    row has to go.  Three inserts would come back to a state they passed.
    """
    out = []
    for state in range(4):
        at, letters, cost = state, "", 0
        for _ in range(3):
            for kind in "xsuaoSUAO":
                out.append((kind, state, f"{letters}D", at, cost + DELETE))
                if kind == "x":
                    continue
                more = cost + TRUNCATED * kind.isupper()
                out.append((kind, state, f"{letters}R", following(at), more + REROLE))
                if (kind.lower() == "s" and at == 0) or (kind.lower() == "u" and at != 2) or (kind.lower() == "a" and at == 2):
                    out.append((kind, state, f"{letters}K", {"s": 1, "u": 2, "a": 3}[kind.lower()], more))
            at, letters, cost = following(at), letters + "I", cost + INSERT
    return out


#: One turn further for all pieces of a batch.
TURNS = f"""
WITH RECURSIVE steps(kind, state, edits, goes, price) AS (VALUES {", ".join(map(str, steps()))}),
best(piece, n, start, state, cost, audit) AS (
  SELECT piece, 0::BIGINT, s::INT, s::INT, 0::BIGINT, '' FROM (SELECT DISTINCT piece FROM turns), range(4) r(s)
  UNION ALL
  SELECT piece, n + 1, start, goes, min(c), arg_min(a, (c, a)) FROM (
    SELECT b.piece, b.n, b.start, s.goes, b.cost + s.price AS c, b.audit || s.edits AS a
    FROM best b JOIN turns t ON t.piece = b.piece AND t.n = b.n JOIN steps s ON s.kind = t.kind AND s.state = b.state)
  GROUP BY piece, n, start, goes)
SELECT b.piece, b.start, b.state, b.cost, b.audit FROM best b JOIN (SELECT piece, max(n) + 1 AS n FROM turns GROUP BY piece) e USING (piece, n)
"""
#: One piece further for all conversations of a batch.
PIECES = """
WITH RECURSIVE best(conv, n, start, state, cost, audit) AS (
  SELECT conv, n, start, state, cost, audit FROM pieces WHERE n = 0
  UNION ALL
  SELECT conv, n, start, state, min(c), arg_min(a, (c, a)) FROM (
    SELECT p.conv, p.n, b.start, p.state, b.cost + p.cost AS c, b.audit || p.audit AS a FROM best b JOIN pieces p ON p.conv = b.conv AND p.n = b.n + 1 AND p.start = b.state)
  GROUP BY conv, n, start, state)
SELECT b.conv, b.start, b.state, b.cost, b.audit FROM best b JOIN (SELECT conv, max(n) AS n FROM pieces GROUP BY conv) e USING (conv, n) ORDER BY conv
"""


@cache
def database() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})


def solved(query: str, **tables: pa.Table) -> pa.Table:
    con = database()
    for name, table in tables.items():
        con.register(name, table)
    try:
        return con.sql(query).to_arrow_table()
    finally:
        for name in tables:
            con.unregister(name)


def runs(*columns: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The number of the run of equal rows (nulls are equal) that each place is in."""
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        codes = pc.dictionary_encode(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, null_encoding="encode").indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    return np.concatenate([[0], np.cumsum(new)])[: len(columns[0])]


def begin(run: np.ndarray) -> np.ndarray:
    """Where each run begins."""
    return np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])[: len(run)])


def within(run: np.ndarray) -> np.ndarray:
    """Each place's distance from the beginning of its run."""
    begins = begin(run)
    return np.arange(len(run)) - np.repeat(begins, np.diff([*begins, len(run)]))


def faults(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, h, initial, fault) of each row; fault: blank, duplicate, truncated or null; h: the text's md5."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    rows = plain(df, conv_id, turn, role, text).select("conv_id", "turn", "role", F.md5("text").alias("h"), last.alias("last"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "h").orderBy("turn")) > 1
    fault = F.when(F.col("last") == "", "blank").when(F.col("earlier"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return rows.withColumn("earlier", earlier).select("conv_id", "turn", "role", "h", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def plain(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))))


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, block, kind, initial) to pieces: (conv_id, block, part, first, last, illegal, start, state, cost, audit)."""
    part = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, block, kind, initial = batch.columns
        run = runs(conv, block)
        n = within(run)
        piece = np.cumsum(np.concatenate([[0], (run[1:] != run[:-1]) | (n[1:] % PIECE == 0)]))
        begins = begin(piece)
        ends = np.append(begins[1:], batch.num_rows) - 1
        marks = initial.to_pylist()
        wrong = np.array([a + b not in LEGAL for a, b in zip(marks, marks[1:], strict=False)] + [False])
        wrong[ends] = False  # those between pieces are counted when these are put together
        before = np.concatenate([[0], np.cumsum(wrong)])
        out = solved(TURNS, turns=pa.table({"piece": piece, "n": n % PIECE, "kind": kind}))
        at = out.column("piece").to_numpy()
        first, last = pa.array(begins[at]), pa.array(ends[at])
        columns = [conv.take(first), block.take(first), pa.array(part + at), initial.take(first), initial.take(last), pa.array((before[ends + 1] - before[begins])[at])]
        yield from pa.table([*columns, *(out.column(c) for c in ("start", "state", "cost", "audit"))], PIECE_NAMES).to_batches()
        part += len(begins)


PIECE_NAMES = ["conv_id", "block", "part", "first", "last", "illegal", "start", "state", "cost", "audit"]


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to conversations: (conv_id, illegal, cost, audit).

    What is held from one batch to the next is one conversation, put together as far as it came, and its last piece.
    """
    held: pa.Table | None = None

    def joined(rows: pa.Table) -> pa.Table:
        conv = runs(rows.column("conv_id"))
        piece = runs(rows.column("conv_id"), rows.column("block"), rows.column("part"))
        begins = begin(conv)
        n = piece - piece[begins][conv]
        numbers = {"conv": conv, "n": n} | {c: rows.column(c) for c in ("start", "state", "cost", "audit")}
        found = solved(PIECES, pieces=pa.table(numbers))
        # one row a piece for its initials
        one = begin(piece)
        heads = rows.select(["first", "last", "illegal"]).take(pa.array(one))
        first, last, of = heads.column("first").to_pylist(), heads.column("last").to_pylist(), conv[one]
        wrong = heads.column("illegal").to_numpy().astype(np.int64)
        wrong[1:] += np.array([of[k] == of[k + 1] and last[k] + first[k + 1] not in LEGAL for k in range(len(of) - 1)], np.int64)
        at = found.column("conv").to_numpy()
        firsts = begin(of)
        lasts = np.append(firsts[1:], len(of)) - 1
        columns = [rows.column("conv_id").take(pa.array(begins[at])), rows.column("block").take(pa.array(begins[at])), pa.array(np.zeros(len(at), np.int64) - 1)]
        columns += [pa.array([first[k] for k in firsts[at]], pa.string()), pa.array([last[k] for k in lasts[at]], pa.string()), pa.array(np.add.reduceat(wrong, firsts)[at])]
        return pa.table([*columns, *(found.column(c) for c in ("start", "state", "cost", "audit"))], PIECE_NAMES)

    def ended(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        conv = runs(rows.column("conv_id"))
        begins = begin(conv)
        for k, start, state, cost, audit in zip(conv.tolist(), *(rows.column(c).to_pylist() for c in ("start", "state", "cost", "audit")), strict=True):
            if start == 0:
                more = {0: 0, 1: 2, 2: 1, 3: 0}[state]
                best[k] = min(best.get(k, (cost + 99, "")), (cost + INSERT * more, audit + "I" * more))
        columns = [rows.column("conv_id").take(pa.array(begins)), rows.column("illegal").take(pa.array(begins)), pa.array([best[k][0] for k in range(len(begins))], pa.int64()), pa.array([best[k][1] for k in range(len(begins))], pa.string())]
        yield from pa.table(columns, ["conv_id", "illegal", "cost", "audit"]).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows.cast(held.schema)]) if held is not None else rows
        piece = runs(*(rows.column(c) for c in ("conv_id", "block", "part")))
        cut = int(np.searchsorted(piece, piece[-1]))  # the last piece may go on in the next batch
        held = rows.slice(cut)
        if cut:
            done = joined(rows.slice(0, cut)).cast(rows.schema)
            conv = runs(pa.concat_tables([done.select(["conv_id"]), held.select(["conv_id"]).slice(0, 1)]).column(0))
            cut = int(np.searchsorted(conv, conv[-1]))
            yield from ended(done.slice(0, cut))
            held = pa.concat_tables([done.slice(cut), held])
        held = held.combine_chunks()
    if held is not None:
        yield from ended(joined(held))


def audits(found: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of each conversation of ``faults``' rows."""
    kind_type = found.schema["conv_id"].dataType
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o"))
    kind = F.when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    rows = found.select("conv_id", F.shiftright("turn", BLOCK).alias("block"), "turn", "role", "h", F.col("fault").eqNullSafe("duplicate").alias("again"), kind.alias("kind"), "initial")
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "h", "again")
    fields = [("block", T.LongType()), ("part", T.LongType()), ("first", T.StringType()), ("last", T.StringType()), ("illegal", T.LongType())]
    fields += [("start", T.IntegerType()), ("state", T.IntegerType()), ("cost", T.LongType()), ("audit", T.StringType())]
    schema = T.StructType([T.StructField("conv_id", kind_type), *(T.StructField(n, t) for n, t in fields)])
    out = T.StructType([T.StructField("conv_id", kind_type), T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    pieces = dealt.select("conv_id", "block", "kind", "initial").mapInArrow(cast_to(piece_rows, schema), schema)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(cast_to(put_together, out), out)


def cast_to(f, schema: T.StructType):
    """``f`` with its batches in the types that Spark expects."""
    target = pa.schema([pa.field(x.name, to_arrow_type(x.dataType)) for x in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in f(batches):
            yield from pa.Table.from_batches([b]).cast(target).to_batches()

    return run


def repaired(df: DataFrame, audited: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, edit, turn, role, text): every row with its edit, and those inserted; the deleted ones have no place.

    A task's rows stand by conversation and in order.  One streaming pass, with one audit and one batch in hand.
    """
    rows = plain(df, conv_id, turn, role, text).select("conv_id", F.lit(1).alias("what"), "turn", "role", F.md5("text").alias("h"), "text")
    heads = audited.select("conv_id", F.lit(0).alias("what"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("h"), F.col("audit").alias("text"))
    both = heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "what", "turn", "role", "h").select("conv_id", "what", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    arrow = pa.schema([pa.field(x.name, to_arrow_type(x.dataType)) for x in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, 0, 0
        out: list[tuple] = []

        def inserts() -> None:
            nonlocal at, state, place
            while audit[at : at + 1] == "I":
                state = following(state)
                out.append((conv, place, "I", None, "user" if state == 2 else "assistant", ""))
                at, place = at + 1, place + 1

        for batch in batches:
            for c, what, n, r, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if what == 0:
                    inserts()  # those at the end of the conversation before
                    conv, audit, at, state, place = c, t, 0, 0, 0
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "D":
                    out.append((conv, None, "D", n, r, t))
                    continue
                if edit == "R":
                    state = following(state)
                    r = "user" if state == 2 else "assistant"
                else:
                    state = {"s": 1, "u": 2, "a": 3}[r[0]]
                out.append((conv, place, edit, n, r, t))
                place += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out.clear()
        inserts()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return both.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256): of the ``role:text`` lines that stay, for ``repaired``'s rows as it returned them (by conversation and in order)."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("sha256", T.StringType())])
    arrow = pa.schema([pa.field(x.name, to_arrow_type(x.dataType)) for x in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None  # the conversation (in a tuple, as it may be null) and its digest so far

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], arrow[0].type), pa.array([h for _, h in done], arrow[1].type)], schema=arrow)

        for batch in batches:
            done: list[tuple] = []
            for c, place, r, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text")), strict=True):
                if now != (c,):
                    if now:
                        done.append((now[0], held.hexdigest()))
                    now, held = (c,), hashlib.sha256()
                if place is not None:
                    held.update(f"{chr(10) if place else ''}{r}:{t}".encode())
            if done:
                yield batch_of(done)
        if now:
            yield batch_of([(now[0], held.hexdigest())])

    return rows.mapInArrow(run, schema)


def summary(found: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated): counts of ``faults``' rows; gaps: turn numbers that are missing between the first and the last."""
    wide = F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("kinds")
    by_turn = found.groupBy("conv_id", "turn").agg(*(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")))
    whole = by_turn.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("kinds"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    return whole.select("conv_id", F.coalesce(wide, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated")
