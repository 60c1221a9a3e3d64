"""The trie of conversations against a plain one built turn by turn."""

import hashlib
import random
import zlib

import pytest

from folioforge.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, run int, block string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, most=6):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        said = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
        ends.setdefault(said, []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        leaves[node] = sum(leaves[x] for x in children.get(node, [])) or 1
        saved[node] = own_saved + sum(saved[x] for x in children.get(node, []))
    out = []
    for node, who in members.items():
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, tasks=5, most=6):
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        df = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], SCHEMA)
        got = sorted((tuple(r) for r in prefix_trie.trie(df, most).select(*COLUMNS).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain(rows, most)


def at_random(seed, n=60):
    draw = random.Random(seed)
    said = lambda: (draw.choice(["user", "assistant", None]), draw.choice(["hi", "ä😀", "", None, "go on", "x" * 9]))
    rows = []
    for i in range(n):
        conv = draw.choice([100 * draw.randrange(3), draw.randrange(400), -draw.randrange(250)])
        if any(r[0] == conv for r in rows):
            continue
        turns = list(range(draw.choice([1, 2, 3, 5, 9])))
        rows += [(conv, t if draw.random() < 0.95 else None, *said()) for t in turns]
    rows += draw.sample(rows, 5) + [(None, 0, "user", "nobody")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 2), (3, 3)])
def test_trie(spark, seed, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    check(spark, at_random(seed))


def test_long_and_equal_conversations(spark, monkeypatch):
    """One conversation of most turns over many partitions and blocks, and copies of it that leave it at every depth."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    rows = [(700 + 7, t, "user", f"turn {t}") for t in range(150)]
    for i in range(30):
        rows += [(5000 + i, t, "user", f"turn {t}" if t < 4 * i else f"own {i}") for t in range(4 * i + i % 3)]
    check(spark, rows, tasks=11, most=1)


def test_edges(spark):
    check(spark, [])
    check(spark, [(None, 1, "a", "b")])
    check(spark, [(5, None, None, None)])
    check(spark, [(c, t, "user", "same") for c in range(1990, 2020) for t in range(3)])
