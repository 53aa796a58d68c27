from __future__ import annotations

import hashlib
import os

import duckdb
from helpers import rows

from tesserae.llm import chat, queries

TREE = [
    # conversation, node, parent, role, text, score
    (1, 10, None, "system", "be kind", 0.0),
    (1, 11, 10, "user", "hi <|im_end|> \\ <\\| <|im_start|>", 1.0),
    (1, 12, 11, "assistant", "one\n", 5.0),
    (1, 13, 11, "assistant", "two \\n <|", 2.0),
    (1, 14, 13, "user", "and", 9.0),
    (2, 1, 99, "us%er\n<|", "an orphan is a root", 0.0),
    (2, 2, 3, "user", "on a cycle", 0.0),
    (2, 3, 2, "user", "on a cycle", 0.0),
    (3, 1, None, None, None, None),
    (3, 1, None, None, None, None),
    (None, 1, None, "assistant", "nobody's", 0.0),
    (None, 2, 1, "assistant", "", 0.0),
]
SCHEMA = "conv_id long, node long, parent long, role string, text string, score double"


def expected(nodes, conv):
    own = {n[1]: n for n in dict.fromkeys(n for n in nodes if n[0] == conv)}
    children = {}
    for n in own.values():
        if n[2] in own:
            children.setdefault(n[2], []).append(n[1])
    out = []

    def walk(path):
        below = children.get(path[-1], [])
        if not below:
            out.append((sum(own[p][5] or 0 for p in path) / len(path), path))
        for c in below:
            walk([*path, c])

    for n in own.values():
        if n[2] not in own:
            walk([n[1]])
    return [[(own[p][3] or "", own[p][4] or "") for p in path] for _, path in sorted(out, key=lambda x: (-x[0], x[1][-1]))]


def test_trees(spark):
    nodes = spark.createDataFrame(TREE, SCHEMA).selectExpr("*", "'x' as c", "'y' as path", "1 as branch", "2 as place")
    made = chat.conversations(nodes, keep_branches=5)
    got = {(r.conv_id, r.branch): (r.turns, r.under, r.formatted) for r in made.select("conv_id", "branch", "formatted", chat.read_back(made.formatted).alias("turns"), chat.loss_text(made.formatted, made.loss).alias("under")).collect()}
    want = {(c, i + 1): p for c in (1, 2, 3, None) for i, p in enumerate(expected(TREE, c))}
    assert set(got) == set(want) and len(want) == 5
    for k, turns in want.items():
        assert [tuple(t) for t in got[k][0]] == turns
        assert got[k][1] == "".join(t for r, t in turns if r == "assistant")
        assert got[k][2].count("<|im_start|>") == len(turns)
    best = chat.conversations(nodes).collect()
    assert len(best) == 4


def test_long_chain(spark):
    data = [(1, i, i - 1, "assistant" if i % 2 else "user", f"t{i}", 0.0) for i in range(150)]
    made = chat.conversations(spark.createDataFrame(data, SCHEMA)).select("formatted", "loss").withColumnRenamed("formatted", "f")
    r = made.select(chat.read_back(made.f).alias("t"), chat.loss_text(made.f, made.loss).alias("u")).first()
    assert [t.text for t in r.t] == [f"t{i}" for i in range(150)] and r.u == "".join(f"t{i}" for i in range(150) if i % 2)


def test_no_rows(spark):
    assert rows(chat.conversations(spark.createDataFrame([], SCHEMA))) == []
    assert rows(chat.digest(chat.conversations(chat.chains(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))) == []


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"create view {t.split('.')[0]} as select * from '{folder}/{t}'")
    got = queries.op8_chat(spark, folder)
    want = con.sql(queries.ORACLES["op8_chat"]).df()[got.columns]
    assert sorted(rows(got)) == sorted(tuple(x.item() if hasattr(x, "item") else x for x in r) for r in want.itertuples(index=False))


def test_chains_with_nulls_and_ties(spark):
    data = [(5, 1, "user", None), (5, 0, None, "a"), (5, 1, "user", None), (5, None, "assistant", "first"), (None, 0, "assistant", "x")]
    got = {r.conv_id: r for r in chat.digest(chat.conversations(chat.chains(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")))).collect()}
    said = "assistant\nfirst\n\na\nuser\n\nuser\n\n"
    assert got[5].n_turns == 4 and got[5].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[5].loss_chars == 5
    assert got[None].loss_sha256 == hashlib.sha256(b"x").hexdigest()


def test_spans_in_characters_and_bytes(spark):
    data = [(1, i, i - 1, "assistant" if i % 3 else "usér", "ß👍 <|x\\"[: i % 8], 0.0) for i in range(40)]
    r = chat.conversations(spark.createDataFrame(data, SCHEMA)).first()
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == [r.formatted.encode()[s.first_byte : s.first_byte + s.bytes].decode() for s in r.loss]
    plain = "".join(d[4] for d in data if d[3] == "assistant")
    assert "".join(r.formatted[s.start : s.start + s.length] for s in r.loss).replace("<\\|", "<|").replace("\\\\", "\\") == plain


def test_many_turns_take_linear_time(spark):
    """The masks of one conversation of 40,000 turns: an append for each turn took most of a minute."""
    import time

    from pyspark.sql import functions as F

    turns = spark.range(40_000).select(F.lit(1).alias("conv_id"), F.lit(1).alias("branch"), (F.col("id") + 1).alias("place"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("é word "), 3).alias("text"))
    began = time.perf_counter()
    spans = chat.placed_turns(turns).agg(F.max("span.start"), F.max("span.first_byte")).first()
    assert spans[1] - spans[0] == 3 * 39_999 and time.perf_counter() - began < 20
