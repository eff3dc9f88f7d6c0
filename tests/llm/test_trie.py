"""The prefix trie against brute force and its SQL, with groups and limits of every size."""

import hashlib
import random
import zlib

import pytest

from sightline.llm import trie

from .test_sql import agree

SCHEMA = "conv_id long, turn long, role string, text string, n long, m string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "preorder", "subtree_end"]


def brute(rows):
    turns = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    turns = {c: [(r, x, d) for _, r, d, x in sorted(t, key=lambda t: t[:3])] for c, t in turns.items()}
    whole = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = turns.get(base, [])[:h] + turns[c][h:]
    nodes = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    order = sorted(nodes, key=lambda k: [d for _, _, d in k])
    for at, k in enumerate(order):
        below = [j for j in nodes if j[: len(k)] == k]
        ends = sorted(c for c in nodes[k] if len(whole[c]) == len(k))
        kids = [j for j in below if len(j) == len(k) + 1]
        leaves = [j for j in below if not any(len(i) == len(j) + 1 and i[:-1] == j for i in below)]
        saved = sum((len(nodes[j]) - 1) * len(j[-1][1].encode()) for j in below if j)
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(), at, at + len(below)))
    return sorted(out, key=str)


def rows_of(convs=60, seed=1, most=14):
    r = random.Random(seed)
    rows = []
    for c in [*range(convs), -7, -5, 10**12]:
        same = r.random() < 0.5
        for t in range(r.randint(1, most)):
            rows.append((c, t, r.choice(["user", "assistant", None]) if not same else "user", f"é{t}" if same and r.random() < 0.95 else r.choice(["a", "b", None, ""]), 1, "x", 3))
    rows += [(None, 0, "user", "lost", 1, "x", 1), (3, None, "user", "before all", 1, "x", 1), (3, None, "user", "before all", 1, "x", 1), (4, 2, "user", "tie", 1, "x", 1), (4, 2, "assistant", "tie", 1, "x", 1)]
    rows += [(900 + k, t, "user", f"u{t}", 1, "x", 1) for k in range(0, 40, 5) for t in range(12)]  # identical
    rows += [(2000, t, "user", "long" * (t % 3), 1, "x", 1) for t in range(70)]  # one long
    return rows


def found(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


@pytest.mark.parametrize(("group", "heavy", "light"), [(4096, 10_000, 50_000), (3, 4, 1)])
def test_brute_force(spark, monkeypatch, group, heavy, light):
    for name, value in (("GROUP", group), ("HEAVY", heavy), ("LIGHT", light), ("PIECE", max(2, group))):
        monkeypatch.setattr(trie, name, value)
    rows = rows_of()
    random.Random(2).shuffle(rows)
    assert found(trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_one_conversation_one_turn_and_nothing(spark):
    one = [(7, 0, None, None, 0, "", 0)]
    df = spark.createDataFrame(one, SCHEMA)
    assert found(trie.trie(df)) == brute(one)
    assert trie.trie(df.where("conv_id < 0")).count() == 0
    assert trie.trie(df.selectExpr("CAST(NULL AS LONG) AS conv_id", "turn", "role", "text")).count() == 0


def test_all_alike(spark):
    rows = [(5 * k, t, "user", "x" * 50_000 if t == 1 else "y", 0, "", 0) for k in range(20) for t in range(9)]
    assert found(trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_sql_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame(rows_of(25, 3), SCHEMA).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    agree(spark, "op12_prefix_trie", tmp_path)
