"""The prefix trie against SQL on lists of turns, and its edge cases."""

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest

from stockloom.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", __import__("pyspark").sql.functions.lit(1))
    turns = prefix_trie.rebuilt(prefix_trie.numbered(df.repartition(3)))
    return sorted(tuple(None if pd.isna(x) else x for x in r) for r in prefix_trie.trie(turns).select(COLUMNS).collect())


def by_sql(rows):
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("c", conversations)
    con.execute("create view conversations as select conv_id::bigint conv_id, turn::bigint turn, role::varchar as role, text::varchar as text from c")
    return sorted(tuple(None if x is None else x for x in r) for r in con.execute(f"select {', '.join(COLUMNS)} from ({prefix_trie.sql()})").fetchall())


def key(rows):
    return sorted(rows, key=repr)


def test_equals_sql_on_shared_and_long_conversations(spark):
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["hi there", "yes", "no  way", "", None, "a b c"])) for c in range(120) for t in range(rnd.choice([1, 1, 2, 3, 5, 9, 12]))]
    long = [(rnd.choice(["u", "a"]), f"turn {i}") for i in range(70)]
    for c, n in ((1000, 70), (1001, 70), (1003, 40), (1004, 41), (1005, 16), (1006, 17), (1007, 8), (1008, 24)):  # ends at and inside blocks
        rows += [(c, t, *long[t]) for t in range(n)] + [(c, n, "u", f"own {c}")] * (c == 1004)
    rows += [(2000, None, "u", "first"), (2000, 1, "u", "b"), (2000, 1, "u", "a"), (2000, 1, "u", "a"), (2001, 5, "u", None)]  # null, tied and repeated turns
    assert key(nodes(spark, rows)) == key(by_sql(rows))
    assert key(nodes(spark, rows + [(None, 1, "u", "nobody")])) == key(by_sql(rows))


def test_copies_of_a_conversation_and_turnless_ones(spark):
    rows = [(c, t, "u", f"same {t}") for c in range(0, 400, 20) for t in range(3)]
    lone = [c for c in range(500, 520) if zlib.crc32(str(c).encode()) % 4 > 0 and c % 20][:3]
    rows += [(c, 0, "u", "gone") for c in lone]  # no family head and no turn after the first h: nothing is left
    got = nodes(spark, rows)
    assert key(got) == key(by_sql(rows))
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 20 + len(lone) and root[7] == hashlib.sha256(",".join(map(str, lone)).encode()).hexdigest()


def test_empty_table(spark):
    assert nodes(spark, []) == []


@pytest.mark.parametrize("n", [8, 9, 64, 65])
def test_one_chain(spark, n):
    got = {r[1]: r for r in nodes(spark, [(0, t, "u", f"w{t} x") for t in range(n)])}
    assert set(got) == set(range(n + 1)) and all(r[4] == (d < n) and r[5] == 1 and r[6] == 0 for d, r in got.items())
