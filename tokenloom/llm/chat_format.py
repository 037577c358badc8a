"""Operator 1: chat formatting with role repair of least cost.

A legal conversation is an optional system turn and then user and assistant
turns in alternation, the user first. A dynamic programme over that automaton
picks for each turn, at the least total cost: keep it (0), merge it into the
turn before (1), insert an empty turn before it (2), or relabel it (3; merging
under another role costs both). Of equal costs the earlier in that order
wins, looked at from the last turn backwards. The repaired turns are rendered
with role headers; the fragments of a conversation, put together in the order
of ``seq``, are its text.

One conversation may hold a third of all rows. A first pass range-partitions
keys alone, without texts, by conversation and turn, so it spreads over many
shards, and each shard is read once as a stream. A conversation that begins and
ends within one needs nothing from outside. Others are cut into pieces, at the
edges of shards and after ``PIECE_ROWS`` rows or ``PIECE_BYTES`` bytes of text: what
the programme does in a piece depends only on the states before and after it,
so each piece gives a (min, +) matrix of costs with the order of paths that cost
the same. The driver joins the matrices and keeps the edges of the shards: two
matrices (about 300 bytes) a shard and one a piece of the long conversations, so
3 million of them if 100 TB were long conversations only. The second pass deals
the rows over the same shards, the only shuffle of texts, and decides and renders
them in the task that sorts them. No text is written in between.

``seq`` numbers the rows from 0 in the order of conversation, turn, role, the
text's ``xxhash64`` and the text, nulls first, whatever the number of partitions.
Rows equal in all of these are interchangeable. If the edge of a shard falls
among such rows, the rows are written to a table once, so that both passes split
them alike; if the passes see other numbers of rows, the query fails.

Null ``conv_id`` rows form one conversation. A null text is empty; a null or
unknown role has to be relabelled or merged. A very long text is a piece alone.
An empty table gives an empty result. Further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.search import below
from tokenloom.llm import scratch

ROLES = ("start", "system", "user", "assistant")
ACTIONS = ("keep", "merge", "insert", "relabel")
KEEP, MERGE, INSERT, RELABEL = range(4)  # also their costs
#: Roles that may follow each state.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FAR = 1 << 50
#: A conversation is cut after so many rows or bytes of text.
PIECE_ROWS, PIECE_BYTES = 200_000, 32 << 20
Way = tuple[int, int, int, int]  # cost, state before, the choice in a byte, place in the order of preference
KEY = "conv_id long, turn long, role string, h long, salt double"
ROW = f"{KEY}, code int, size long"
#: A row for the first key of a shard (piece -1), its last (-2, with the number of rows), and each piece.
FOUND = f"shard int, piece int, n long, {KEY}, costs array<long>, ranks array<int>"
RESULT = "seq long, conv_id long, turn long, role string, new_role string, action string, inserted string, cost int, rendered string"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def packed(state: int, action: int, inserted: int) -> int:
    return state << 4 | action << 2 | inserted


@lru_cache(maxsize=16)
def ways(role: int) -> tuple[tuple[Way, ...], ...]:
    """For each state after a turn of this role (0: unknown), the ways to get there, best first on equal totals."""
    found: list[list] = [[], [], [], []]
    for s, after in NEXT.items():
        for t in after:
            found[t].append((KEEP, s, 0, KEEP) if t == role else (RELABEL, s, 0, RELABEL))
            if role and role in NEXT[t]:
                found[role].append((INSERT, s, t, INSERT))
        if s:
            found[s].append((MERGE, s, 0, MERGE + RELABEL * (s != role)))
    return tuple(tuple((cost, s, packed(t, action, x), n) for n, (action, s, x, cost) in enumerate(sorted(to))) for t, to in enumerate(found))


@lru_cache(maxsize=1 << 14)
def forward(costs: tuple[int, ...], role: int) -> tuple[tuple[int, ...], tuple[Way | None, ...], int]:
    """The costs after a turn, less their least; the ways that give them; and that least."""
    new, by = [], []
    for to in ways(role):
        best = min(to, key=lambda w: (costs[w[1]] + w[0], w[3]), default=None)
        total = min(costs[best[1]] + best[0], FAR) if best else FAR
        new.append(total)
        by.append(best)
    least = min(new)
    return tuple(c if c == FAR else c - least for c in new), interned(tuple(by)), least


@lru_cache(maxsize=1 << 12)
def interned(by: tuple) -> tuple:
    return by


def forwards(codes: tuple[int, ...], entry: int) -> tuple[list[int], list[tuple]]:
    """Least costs of the states after these turns, and the ways of each turn."""
    costs, spent, trail = tuple(0 if t == entry else FAR for t in range(4)), 0, []
    for code in codes:
        costs, by, least = forward(costs, code)
        spent += least
        trail.append(by)
    return [FAR if c >= FAR else c + spent for c in costs], trail


def backwards(trail: list[tuple], state: int) -> tuple[bytes, bytes]:
    """The choices, and their preference from the last turn on."""
    choices, preference = bytearray(), bytearray()
    for by in reversed(trail):
        _, state, choice, place = by[state]
        choices.append(choice)
        preference.append(place)
    return bytes(reversed(choices)), bytes(preference)


def best_end(costs: list[int]) -> int:
    return min(range(4), key=lambda t: (costs[t], t))


def decide(codes: tuple[int, ...]) -> bytes:
    """The choices of a whole conversation."""
    costs, trail = forwards(codes, 0)
    return backwards(trail, best_end(costs))[0]


@lru_cache(maxsize=20_000)
def decide_short(codes: tuple[int, ...]) -> bytes:
    """Most conversations are short and share their roles with others."""
    return decide(codes)


def matrix(codes: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """For all pairs of states before and after a piece: the cost, and the rank among equal costs."""
    costs, ranks = [FAR] * 16, [0] * 16
    preferences: dict[int, list] = defaultdict(list)
    for entry in range(4):
        ends, trail = forwards(codes, entry)
        for leave in range(4):
            if ends[leave] < FAR:
                costs[4 * entry + leave] = ends[leave]
                preferences[leave].append((backwards(trail, leave)[1], entry))
    for leave, found in preferences.items():
        for rank, (_, entry) in enumerate(sorted(found)):
            ranks[4 * entry + leave] = rank
    return costs, ranks


def render(text: str, choice: int, opens: bool, closes: bool) -> str:
    """The fragment of a turn. A header closes the turn before; the last turn closes itself."""
    state, action, inserted = choice >> 4, choice >> 2 & 3, choice & 3
    if action == MERGE:
        head = "\n"
    else:
        head = "" if opens else "<|end|>\n"
        if inserted:
            head += f"<|{ROLES[inserted]}|>\n<|end|>\n"
        head += f"<|{ROLES[state]}|>\n"
    return head + text + ("<|end|>\n" if closes else "")


def _starts(ids: pa.Array) -> np.ndarray:
    """Rows whose conversation differs from the row before, the first one included."""
    value, null = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (null[1:] != null[:-1]))))


def segments(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int | None]]:
    """A sorted shard as whole conversations with their first rows, and as numbered pieces of the others.

    Where a conversation is cut depends on its rows alone, and not on the batches.
    """
    held: list[pa.RecordBatch] = []  # the rows of the conversation ``now`` that are not out yet
    rows = size = piece = 0
    nothing = now = object()
    whole = False  # whether it began within this shard and was not cut
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch.column("conv_id"))
        ids, bounds = batch.column("conv_id").take(pa.array(starts)).to_pylist(), np.append(starts, batch.num_rows)
        total = np.concatenate(([0], np.cumsum(batch.column("size").to_numpy())))
        small = (np.diff(bounds) < piece_rows) & (np.diff(total[bounds]) < PIECE_BYTES)
        small[-1] = False  # it may go on
        large = np.append(np.flatnonzero(~small), len(ids))
        k = 0
        while k < len(ids):
            if ids[k] != now:
                if held:
                    yield pa.concat_batches(held), np.zeros(1, np.int64), None if whole else piece
                    piece += not whole
                held, rows, size, whole = [], 0, 0, now is not nothing
                if whole and small[k]:
                    m = int(large[np.searchsorted(large, k)])
                    yield batch.slice(bounds[k], bounds[m] - bounds[k]), starts[k:m] - bounds[k], None
                    k = m
                now = ids[k]
            at, end = int(bounds[k]), int(bounds[k + 1])
            while at < end:
                cut = min(at + piece_rows - rows - 1, int(np.searchsorted(total[1:], total[at] + PIECE_BYTES - size)))
                to = min(cut + 1, end)
                held.append(batch.slice(at, to - at))
                rows, size, at = rows + to - at, size + int(total[to] - total[at]), to
                if cut < to:
                    yield pa.concat_batches(held), np.zeros(1, np.int64), piece
                    piece += 1
                    held, rows, size, whole = [], 0, 0, False
            k += 1
    if held:
        yield pa.concat_batches(held), np.zeros(1, np.int64), piece


def prepared(turns: DataFrame) -> DataFrame:
    role = F.lower(F.trim(F.col("role").cast("string")))
    code = sum((F.when(role == r, i).otherwise(0) for i, r in enumerate(ROLES) if i), F.lit(0))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.xxhash64(text).alias("h"),
        F.rand(7).alias("salt"), F.coalesce(code, F.lit(0)).cast("int").alias("code"), F.octet_length(text).cast("long").alias("size"), text.alias("text"),
    )


def survey(rows: DataFrame, piece_rows: int) -> list:
    """Edges and pieces of range-partitioned keys (see ``FOUND``)."""
    own = names(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, n, edge = TaskContext.get().partitionId(), 0, {}

        def seen(batches):
            nonlocal n
            for b in batches:
                if b.num_rows:
                    edge.setdefault(-1, b.slice(0, 1))
                    edge[-2] = b.slice(b.num_rows - 1)
                    n += b.num_rows
                yield b

        def row(key: pa.RecordBatch, piece: int, costs, ranks) -> pa.RecordBatch:
            head = [pa.array([shard], pa.int32()), pa.array([piece], pa.int32()), pa.array([n])]
            return pa.record_batch([*head, *[key.column(c) for c in names(KEY)], pa.array([costs], pa.list_(pa.int64())), pa.array([ranks], pa.list_(pa.int32()))], names=own)

        for batch, _, piece in segments(seen(batches), piece_rows):
            if piece is not None:
                yield row(batch.slice(0, 1), piece, *matrix(tuple(batch.column("code").to_pylist())))
        for place, key in edge.items():
            yield row(key, place, None, None)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = names(KEY)
    return rows.select(*names(ROW)).repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(run, FOUND).collect()


def joined(found: list) -> dict:
    """(shard, piece) -> the states before and after it, whether it opens and closes its conversation."""
    chains = defaultdict(list)
    for p in sorted(found, key=lambda p: (p.shard, p.piece)):
        if p.piece >= 0:
            chains[p.conv_id].append(p)
    out = {}
    for chain in chains.values():
        totals, trail = [0, FAR, FAR, FAR], []
        for p in chain:
            pairs = [[(min(totals[s] + p.costs[4 * s + t], FAR), p.ranks[4 * s + t], s) for s in range(4)] for t in range(4)]
            best = [min(to) for to in pairs]
            totals = [total for total, _, _ in best]
            trail.append([s for _, _, s in best])
        state = best_end(totals)
        for k in range(len(chain) - 1, -1, -1):
            before = trail[k][state]
            out[chain[k].shard, chain[k].piece] = (before, state, k == 0, k == len(chain) - 1)
            state = before
    return out


def shard_of(edges: list, schema: str) -> Column:
    """The number of edges that are smaller than a row's key."""
    if not edges:
        return F.lit(0)
    key = F.struct(*names(schema))
    array = F.from_json(F.lit(json.dumps([{c: p[c] for c in names(schema)} for p in edges])), T.ArrayType(T._parse_datatype_string(schema)))
    return below(array, len(edges), key)


def repair(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, turn, role -> new_role, action, inserted, cost and the rendered fragment, for every row."""
    spark, rows = turns.sparkSession, prepared(turns)
    found = survey(rows, piece_rows)
    edge = lambda place: {p.shard: p for p in found if p.piece == place}
    first, last = edge(-1), edge(-2)
    order, key = sorted(last), KEY.removesuffix(", salt double")
    whole = lambda p: (p.conv_id, p.turn, p.role, p.h)
    if any(whole(last[i]) == whole(first[j]) for i, j in zip(order, order[1:])):
        rows = scratch.materialise(rows, "turns")  # equal rows on both sides: split them by a number that stays
        found = survey(rows, piece_rows)
        last = edge(-2)
        order, key = sorted(last), KEY
    place = {shard: i for i, shard in enumerate(order)}
    counts = [last[shard].n for shard in order]
    known = spark.sparkContext.broadcast(({(place[s], piece): v for (s, piece), v in joined(found).items()}, [0, *np.cumsum(counts).tolist()]))
    own = names(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, (states, offsets) = TaskContext.get().partitionId(), known.value
        seq = begin = offsets[min(shard, len(offsets) - 1)]
        for batch, starts, piece in segments(batches, piece_rows):
            codes, n = batch.column("code").to_pylist(), batch.num_rows
            first, last = np.zeros((2, n), bool)
            if piece is None:
                bounds = [*starts.tolist(), n]
                choices = b"".join([(decide_short if j - i <= 32 else decide)(tuple(codes[i:j])) for i, j in zip(bounds, bounds[1:])])
                first[starts] = last[np.array(bounds[1:], np.int64) - 1] = True
            else:
                before, after, first[0], last[-1] = states[shard, piece]
                choices = backwards(forwards(tuple(codes), before)[1], after)[0]
            rendered = list(map(render, batch.column("text").to_pylist(), choices, first.tolist(), last.tolist()))
            choice = np.frombuffer(choices, np.uint8)
            state, action, inserted = choice >> 4, choice >> 2 & 3, choice & 3
            cost = action + np.where((action == MERGE) & (state != batch.column("code").to_numpy()), RELABEL, 0)
            name = lambda names, at: pa.array(names, pa.string()).take(pa.array(at))
            yield pa.record_batch([
                pa.array(seq + np.arange(n)), batch.column("conv_id"), batch.column("turn"), batch.column("role"),
                name(ROLES, state), name(ACTIONS, action), name((None, *ROLES[1:]), inserted), pa.array(cost, pa.int32()), pa.array(rendered, pa.string()),
            ], names=own)
            seq += n
        if shard + 1 < len(offsets) and seq != offsets[shard + 1]:
            raise RuntimeError(f"shard {shard} has {seq - begin} rows now and had {offsets[shard + 1] - begin}")

    shard = shard_of([last[s] for s in order[:-1]], key)
    dealt = rows.withColumn("shard", shard).repartitionById(max(len(order), 1), F.col("shard"))
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "h", "text")
    return dealt.select("conv_id", "turn", "role", "code", "size", "text").mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def sql() -> str:
    """The same programme turn by turn; rows of one turn and role are taken by text, so it holds for tables without such ties."""
    moves = []
    for role in range(4):
        for s, after in NEXT.items():
            moves += [(role, s, t, KEEP, 0, 0) if t == role else (role, s, t, RELABEL, 0, RELABEL) for t in after]
            moves += [(role, s, role, INSERT, t, INSERT) for t in after if role and role in NEXT[t]]
            if s:
                moves.append((role, s, s, MERGE, 0, MERGE if s == role else MERGE + RELABEL))
    names = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    head = f"'<|' || {names(ROLES)}[state + 1] || '|>' || chr(10)"
    empty = f"CASE WHEN extra > 0 THEN '<|' || {names(ROLES)}[extra + 1] || '|>' || chr(10) || '<|end|>' || chr(10) ELSE '' END"
    return f"""
WITH RECURSIVE move(code, before, state, action, extra, price) AS (VALUES {", ".join(map(str, moves))}),
said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE lower(trim(role)) WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 0 END AS code FROM conversations),
turns AS (SELECT *, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text) - 1 AS seq,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM said),
step(conv_id, n, state, cost, path) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), CAST([] AS STRUCT(state INT, action INT, extra INT, price INT)[]) FROM turns
  UNION ALL SELECT t.conv_id, t.n, m.state, min(s.cost + m.price), arg_min(list_append(s.path, {{'state': m.state, 'action': m.action, 'extra': m.extra, 'price': m.price}}), (s.cost + m.price) * 1000 + m.action * 100 + m.before * 10 + m.extra)
  FROM step s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.n = s.n + 1 JOIN move m ON m.code = t.code AND m.before = s.state GROUP BY t.conv_id, t.n, m.state),
best AS (SELECT s.conv_id, arg_min(path, cost * 10 + state) AS path FROM step s JOIN (SELECT conv_id, max(n) AS n FROM turns GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM s.conv_id AND l.n = s.n GROUP BY s.conv_id),
done AS (SELECT t.*, b.path[t.n].state AS state, b.path[t.n].action AS action, b.path[t.n].extra AS extra, b.path[t.n].price AS price FROM turns t JOIN best b ON b.conv_id IS NOT DISTINCT FROM t.conv_id)
SELECT seq, conv_id, turn, role, {names(ROLES)}[state + 1] AS new_role, {names(ACTIONS)}[action + 1] AS action, CASE WHEN extra > 0 THEN {names(ROLES)}[extra + 1] END AS inserted, CAST(price AS INT) AS cost,
  CASE WHEN action = {MERGE} THEN chr(10) ELSE CASE WHEN n > 1 THEN '<|end|>' || chr(10) ELSE '' END || {empty} || {head} END || text || CASE WHEN n = total THEN '<|end|>' || chr(10) ELSE '' END AS rendered
FROM done
"""
