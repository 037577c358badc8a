import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import chat_format, scratch

DATA = "/root/testdata/sf0.01"


def chat_best(roles):
    """Least cost of any repair, by trying all actions for all turns."""
    costs = {0: 0}
    for r in roles:
        new = {}
        for s, c in costs.items():
            ways = []
            for t in chat_format.NEXT[s]:
                ways.append((0 if t == r else 3, t))
                if r and r in chat_format.NEXT[t]:
                    ways.append((2, r))
            if s:
                ways.append((1 if s == r else 4, s))
            for w, t in ways:
                new[t] = min(new.get(t, 99999), c + w)
        costs = new
    return min(costs.values())


def test_chat_repair(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(60):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(1, 9) if conv else 400)]
        want[conv] = chat_best(roles)
        rows += [(conv, n, chat_format.ROLES[r] if r else rng.choice(["tool", None]), f"t{n}", "x") for n, r in enumerate(roles)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string")
    got = sorted(chat_format.repair(df).collect(), key=lambda r: r.seq)
    cost, state, text = Counter(), {}, defaultdict(str)
    for r in got:
        cost[r.conv_id] += r.cost
        s = state.get(r.conv_id, "start")
        for role in [r.inserted] * bool(r.inserted) + [r.new_role] * (r.action != "merge"):
            assert chat_format.ROLES.index(role) in chat_format.NEXT[chat_format.ROLES.index(s)]
            s = role
        assert r.new_role == s
        state[r.conv_id] = s
        text[r.conv_id] += r.rendered
    assert dict(cost) == want
    assert all(t.startswith("<|") and t.endswith("<|end|>\n") and t.count("<|end|>") * 2 == t.count("<|") for t in text.values())
    assert [r.turn for r in got if r.conv_id == 0] == list(range(400))
    assert chat_format.repair(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, 0, "USER ", None, "x")], df.schema)
    assert sorted(r.action for r in chat_format.repair(odd).collect()) == ["keep", "relabel", "relabel"]  # 3 + 3, a merge under another role would cost 4


def chat_whole(roles):
    """The choices of a repair in one piece, from the definition: ties by action, seen from the last turn."""
    least = [{0: 0}]
    for r in roles:
        new = {}
        for s, c in least[-1].items():
            for w, t, *_ in chat_ways(s, r):
                new[t] = min(new.get(t, 99999), c + w)
        least.append(new)
    state, out = min(least[-1], key=lambda t: (least[-1][t], t)), []
    for r, before in zip(reversed(roles), reversed(least[:-1])):
        found = [(before[s] + w, action, s, x) for s in before for w, t, action, x in chat_ways(s, r) if t == state]
        _, action, s, x = min(found)
        out.append((chat_format.ROLES[state], chat_format.ACTIONS[action], chat_format.ROLES[x] if x else None))
        state = s
    return out[::-1]


def chat_ways(s, r):
    for t in chat_format.NEXT[s]:
        yield (0, t, 0, 0) if t == r else (3, t, 3, 0)
        if r and r in chat_format.NEXT[t]:
            yield 2, r, 2, t
    if s:
        yield 1 if s == r else 4, s, 1, 0


@pytest.mark.parametrize(("parts", "piece_rows", "piece_bytes"), [(1, 10**6, 1 << 25), (5, 10**6, 1 << 25), (3, 7, 1 << 25), (4, 10**6, 15)])
def test_chat_repair_does_not_depend_on_the_pieces(spark, monkeypatch, parts, piece_rows, piece_bytes):
    monkeypatch.setattr(chat_format, "PIECE_BYTES", piece_bytes)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        rng = random.Random(8)
        roles = {conv: [rng.choice((0, 1, 1, 2, 2, 3)) for _ in range(rng.choice((1, 2, 3, 30)) if conv else 300)] for conv in range(40)}
        roles[40] = [1] * 100
        rows = [(conv or None, n, chat_format.ROLES[r] if r else None, f"{n},") for conv, own in roles.items() for n, r in enumerate(own)]
        got = sorted(chat_format.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), piece_rows).collect(), key=lambda r: r.seq)
        assert [(r.conv_id or 0, r.turn) for r in got] == [(conv, n) for conv, own in roles.items() for n in range(len(own))]
        for conv, own in roles.items():
            mine = [r for r in got if (r.conv_id or 0) == conv]
            want = chat_whole(own)
            assert [(r.new_role, r.action, r.inserted) for r in mine] == want
            assert sum(r.cost for r in mine) == chat_best(own)
            text = "".join(("\n" if a == "merge" else "<|end|>\n" * (n > 0) + (f"<|{x}|>\n<|end|>\n" if x else "") + f"<|{s}|>\n") + f"{n}," for n, (s, a, x) in enumerate(want)) + "<|end|>\n"
            assert "".join(r.rendered for r in mine) == text
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_results_do_not_depend_on_partitions_and_no_text_is_written(spark, monkeypatch):
    """``seq`` is the place in the whole order, and both passes read the texts from the table itself."""
    monkeypatch.setattr(scratch, "materialise", lambda *_: pytest.fail("texts were written"))
    got = []
    for n in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got.append(sorted(map(tuple, chat_format.query(spark, DATA).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(len(got[0])))
    turns = [(r.conv_id, r.turn) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    assert [r[1:3] for r in got[0]] == sorted(turns)


def test_equal_rows_that_are_split_over_shards(spark):
    rows = [(1, 0, "user", "x")] * 50 + [(None, None, None, None)] * 40 + [(2, i % 3, "assistant", "y" * (i % 4)) for i in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = [tuple(r) for r in sorted(chat_format.repair(df, 9).collect(), key=lambda r: r.seq)]
    assert [r[0] for r in got] == list(range(120)) and Counter(r[1] for r in got) == {1: 50, None: 40, 2: 30}
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert [tuple(r) for r in sorted(chat_format.repair(df).collect(), key=lambda r: r.seq)] == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_order_of_ties(spark):
    """Turn, role, hash of the text, text; nulls first."""
    rows = [(1, t, r, x) for t in (None, 0, 1) for r in (None, "assistant", "user") for x in ("b", "a", "", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = df.select("turn", "role", F.coalesce("text", F.lit("")).alias("text")).orderBy("turn", "role", F.xxhash64("text"), "text").collect()
    got = sorted(chat_format.repair(df).collect(), key=lambda r: r.seq)
    assert [(r.turn, r.role) for r in got] == [(r.turn, r.role) for r in want]
    for r, w in zip(got, want):
        assert w.text in r.rendered


def test_very_long_texts_and_clashing_names(spark, long_text):
    rows = [(1, 0, "user", long_text), (1, 1, "user", "x"), (1, 2, "assistant", long_text[::-1]), (2, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'s' AS seq", "1.5 AS salt", "'h' AS h", "'c' AS code", "'p' AS piece", "'z' AS shard")
    got = sorted(chat_format.repair(df).collect(), key=lambda r: r.seq)
    assert [(r.conv_id, r.turn, r.action, len(r.rendered)) for r in got] == [(1, 0, "keep", len(long_text) + 9), (1, 1, "merge", 2), (1, 2, "keep", len(long_text) + 8 + 14 + 8), (2, 0, "keep", 18)]


def test_sql_on_messy_roles(spark, tmp_path):
    rng = random.Random(11)
    rows = [(conv or None, n, rng.choice(["user", "assistant", "system", "tool", None, " User"]), None if rng.random() < 0.1 else f"t{n}") for conv in range(150) for n in range(rng.randint(1, 14))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat_format.query(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({chat_format.sql()}) ORDER BY seq").fetchall()
    assert sorted(map(tuple, got.collect())) == want and {r[5] for r in want} == set(chat_format.ACTIONS)
