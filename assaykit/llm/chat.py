"""Chat formatting by minimum-cost role repair.

A conversation is read as a word over roles. A legal one has an optional system message, then
user and assistant in turn, and ends with the assistant. Dynamic programming over that automaton
finds the cheapest repair: keep a turn, merge it into the message before, give it another role, or
insert an empty message before it. Steps are (min, +) matrices over the automaton's states, and
products of matrices associate: so a conversation is cut into segments of bounded length wherever
it lies, and each segment gives its matrix. The matrices of a conversation of many segments are
multiplied in groups, level by level, so no task holds more than a group of them; a pass over the
last level picks the states between its groups, each level down picks those inside, and segments
are repaired on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import Tables

ROLES = ("system", "user", "assistant")
#: Legal next roles by state: start, after system, after user, after assistant.
NEXT = ((0, 1), (1,), (2,), (1,))
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
#: Turns of a segment, and matrices of a group.
SEGMENT, GROUP = 512, 256
FAR = float("inf")
END = "<|end|>\n"


def moves(role: int) -> list[tuple[int, int, float, str, int]]:
    """(state, new state, cost, action, inserted role or -1) for a turn of this role (3: unknown), in order of preference."""
    out = []
    for state in range(4):
        for new in range(3):
            change = 0.0 if new == role else RELABEL
            name = "keep" if new == role else "relabel"
            if new in NEXT[state]:
                out.append((state, new + 1, change, name, -1))
            if state == new + 1:
                out.append((state, new + 1, change + MERGE, "merge" if new == role else "relabel_merge", -1))
            for extra in NEXT[state]:
                if new in NEXT[extra + 1]:
                    out.append((state, new + 1, change + INSERT, "insert" if new == role else "relabel_insert", extra))
    return out


MOVES = [moves(r) for r in range(4)]


def code(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else 3


def forward(roles: list[int], entry: int) -> list[list[tuple[float, tuple | None]]]:
    """For each turn and state the least cost from this entry state and the move that gives it."""
    row: list[tuple[float, tuple | None]] = [(0.0 if s == entry else FAR, None) for s in range(4)]
    rows = [row]
    for role in roles:
        new: list[tuple[float, tuple | None]] = [(FAR, None)] * 4
        for m in MOVES[role]:
            c = row[m[0]][0] + m[2]
            if c < new[m[1]][0]:
                new[m[1]] = (c, m)
        rows.append(row := new)
    return rows


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each key, from batches in key order."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if rows and row[:keys] != rows[0][:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    size = 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row if isinstance(x, str)) + 64
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of every segment: least costs from each entry to each exit state."""
    schema = pa.schema([("_conv", pa.int64()), ("_seg", pa.int64()), ("_cost", pa.list_(pa.float64()))])
    yield from batched(((g[0][0], g[0][1], [c for s in range(4) for c, _ in forward([code(r[3]) for r in g], s)[-1]]) for g in groups(batches, 2)), schema)


def chained(cost: list[float], back: list[list[int]] | None, m: list[float]) -> list[float]:
    """Least costs after one more matrix; ``back`` notes the states they come from."""
    step = [min((cost[s] + m[4 * s + t], s) for s in range(4)) for t in range(4)]
    if back is not None:
        back.append([s for _, s in step])
    return [c for c, _ in step]


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of the matrices of every group (_conv, _up, _seg, _cost), named by the group's number."""
    schema = pa.schema([("_conv", pa.int64()), ("_seg", pa.int64()), ("_cost", pa.list_(pa.float64()))])

    def rows() -> Iterator[tuple]:
        for g in groups(batches, 2):
            out = []
            for entry in range(4):
                cost = [0.0 if s == entry else FAR for s in range(4)]
                for _, _, _, m in g:
                    cost = chained(cost, None, m)
                out += cost
            yield g[0][0], g[0][1], out

    yield from batched(rows(), schema)


STATES = "_conv long, _seg long, _entry int, _exit int, _last boolean, _total double"
STATE = pa.schema([("_conv", pa.int64()), ("_seg", pa.int64()), ("_entry", pa.int32()), ("_exit", pa.int32()), ("_last", pa.bool_()), ("_total", pa.float64())])


def inside(g: list[tuple], entry: int, leave: int | None, last: bool, total: float | None) -> list[tuple]:
    """Entry and exit state of every matrix (key, number, matrix) of a group on the cheapest path from ``entry`` to ``leave``."""
    cost, back = [0.0 if s == entry else FAR for s in range(4)], []
    for _, _, m in g:
        cost = chained(cost, back, m)
    if leave is None:
        # a conversation that ends with the user gets an empty answer, one that ends with the system both
        tail = [FAR, 2 * INSERT, INSERT, 0.0]
        total, leave = min((cost[s] + tail[s], s) for s in range(4))
    out = []
    for i in range(len(g) - 1, -1, -1):
        out.append((g[i][0], g[i][1], back[i][leave], leave, last and i == len(g) - 1, total))
        leave = back[i][leave]
    return out


def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of the last level (_conv, _seg, _cost), and the conversation's cost."""
    yield from batched((x for g in groups(batches, 1) for x in inside(g, 0, None, True, None)), STATE)


def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States inside the groups (_conv, _up, _seg, _cost, _entry, _exit, _last, _total) of a level."""
    yield from batched((x for g in groups(batches, 2) for x in inside([(r[0], r[2], r[3]) for r in g], *g[0][4:8])), STATE)


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per turn: its action, its role, and its part of the rendered conversation."""
    schema = pa.schema([("conv", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("cost", pa.float64()), ("total_cost", pa.float64()), ("rendered", pa.string())])

    def rows() -> Iterator[tuple]:
        for g in groups(batches, 2):
            entry, state, last, total = g[0][6:10]
            table = forward([code(r[3]) for r in g], entry)
            path = []
            for i in range(len(g), 0, -1):
                m = table[i][state][1]
                path.append(m)
                state = m[0]
            for i, (r, m) in enumerate(zip(g, reversed(path))):
                text, role = r[4] or "", ROLES[m[1] - 1]
                if "merge" in m[3]:
                    out = "\n" + text
                else:
                    out = (END if m[0] else "") + (f"<|{ROLES[m[4]]}|>\n{END}" if m[4] >= 0 else "") + f"<|{role}|>\n{text}"
                if last and i == len(g) - 1:
                    out += END + {1: f"<|user|>\n{END}<|assistant|>\n{END}", 2: f"<|assistant|>\n{END}", 3: ""}[m[1]]
                yield r[0], r[2], r[5], r[3], role, m[3], ROLES[m[4]] if m[4] >= 0 else None, m[2], total, out

    yield from batched(rows(), schema)


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id (named as ``conv``), seq (order within the table), turn, role, new_role,
    action, inserted, cost, total_cost (of the conversation) and rendered.

    The renderings of a conversation's turns, in order of seq, make the formatted conversation.
    Turns are taken in order of turn (null last), then role and text; equal rows are turns of their
    own. Null roles and roles outside ROLES must be relabelled; null texts are empty. Rows with a
    null conversation are one conversation. Ties between repairs go to keep, merge, insert in the
    order of ``moves``. An empty table gives an empty result. Other columns are not read.
    """
    rows = df.select(F.col(f"`{conv}`").cast("long").alias("_conv"), F.col(f"`{turn}`").cast("long").alias("_turn"), F.col(f"`{role}`").cast("string").alias("_role"), F.col(f"`{text}`").cast("string").alias("_text"))
    order = [F.col("_conv").asc_nulls_last(), F.col("_turn").asc_nulls_last(), F.col("_role").asc_nulls_last(), F.col("_text").asc_nulls_last()]
    # equal rows may part at a border, as they are interchangeable: the last key deals them out
    placed = rows.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange(*order, "_own").sortWithinPartitions(*order).drop("_own")
    tables = Tables(df.sparkSession)
    table = tables.save(placed.withColumn("_pos", F.monotonically_increasing_id()).select("_conv", F.floor(F.col("_pos") / SEGMENT).alias("_seg"), "_pos", "_role", "_text", "_turn"), "chat-turns")
    by = lambda d, *keys: d.repartition(*keys).sortWithinPartitions(*keys, *[k for k in ("_seg", "_pos") if k in d.columns and k not in keys])
    matrix = "_conv long, _seg long, _cost array<double>"
    up = F.floor(F.col("_seg") / GROUP).alias("_up")
    levels = [tables.save(by(table.drop("_text", "_turn"), "_conv", "_seg").mapInArrow(sums, matrix), "chat-costs")]
    while (levels[-1].groupBy("_conv").count().agg(F.max("count")).first()[0] or 0) > GROUP:
        levels.append(tables.save(by(levels[-1].select("_conv", up, "_seg", "_cost"), "_conv", "_up").mapInArrow(products, matrix), "chat-costs"))
    state = by(levels.pop(), "_conv").mapInArrow(ends, STATES)
    same = lambda d, s, seg: d.join(s.withColumnRenamed("_conv", "_c").withColumnRenamed("_seg", "_s"), F.col("_conv").eqNullSafe(F.col("_c")) & (F.col(seg) == F.col("_s")))
    while levels:
        inner = levels.pop().select("_conv", up, "_seg", "_cost")
        state = tables.save(state, "chat-states")
        state = by(same(inner, state, "_up").select(*inner.columns, "_entry", "_exit", "_last", "_total"), "_conv", "_up").mapInArrow(between, STATES)
    joined = same(table, state, "_seg").select("_conv", "_seg", "_pos", "_role", "_text", "_turn", "_entry", "_exit", "_last", "_total")
    out = by(joined, "_conv", "_seg").mapInArrow(repaired, "conv long, seq long, turn long, role string, new_role string, action string, inserted string, cost double, total_cost double, rendered string")
    return out.withColumnRenamed("conv", conv)


def conversations(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Whole formatted conversations from the rows of ``format_chats``: conv_id, part, parts, text.

    A conversation of up to SEGMENT turns is one row, with part 0 of 1. Longer ones come in parts of up to SEGMENT
    turns, whose texts in order of part make the whole, so that no row or task holds an unbounded one. A
    null conversation is one as well. No turns give no rows.
    """
    count = turns.groupBy(conv).agg(F.count("*").alias("_n")).withColumnRenamed(conv, "_c")
    rows = turns.join(count, F.col(conv).eqNullSafe(F.col("_c"))).select(conv, "seq", "rendered", F.when(F.col("_n") <= SEGMENT, F.lit(-1)).otherwise(F.floor(F.col("seq") / SEGMENT)).alias("_p"))
    parts = rows.groupBy(conv, "_p").agg(F.array_sort(F.collect_list(F.struct("seq", "rendered"))).alias("x"))
    parts = parts.select(conv, "_p", F.array_join(F.transform("x", lambda t: t["rendered"]), "").alias("text"))
    number = parts.groupBy(conv).agg(F.array_sort(F.collect_list("_p")).alias("all")).withColumnRenamed(conv, "_c")  # a number for each SEGMENT turns
    return parts.join(number, F.col(conv).eqNullSafe(F.col("_c"))).select(conv, (F.array_position("all", F.col("_p")) - 1).alias("part"), F.size("all").cast("long").alias("parts"), "text")


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Every turn with its repair, and a digest of its part of the conversation. Nulls, ties and repeats as in ``format_chats``."""
    out = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "role", "new_role", "action", "inserted", "cost", "total_cost", F.sha2("rendered", 256).alias("rendered_sha256"))
