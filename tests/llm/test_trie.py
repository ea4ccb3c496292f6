"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from auditloom.llm import prefix_trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_turns(rows):
    """Conversations as lists of (role, text)."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            out.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    return {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in out.items()}


def plain_rebuilt(rows):
    own = plain_turns(rows)
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def plain_trie(conversations):
    nodes, ends = {}, {}
    for c, ts in conversations.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = saved.get(p, 0) + own
        leaves[p] = leaves.get(p, 0) or 1
        if p:
            up = p[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[p]
            saved[up] = saved.get(up, 0) + saved[p]
    return sorted((
        min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), children.get(p, 0), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
    ) for p, cs in nodes.items())


def got(frame):
    return sorted(tuple(r) for r in frame.select(NAMES).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed, batch):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 900), 400):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ccc"])))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        made = got(prefix_trie.trie(prefix_trie.rebuild(frame(spark, rows))))
        plain = got(prefix_trie.trie(prefix_trie.turns(frame(spark, rows))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made == plain_trie(plain_rebuilt(rows))
    assert plain == plain_trie(plain_turns(rows))


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain_trie(plain_rebuilt([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]))
    assert got(prefix_trie.trie(prefix_trie.rebuild(rows))) == want


def test_hot_and_long_conversations(spark):
    """A third of all rows are copies of one conversation, a third are one conversation."""
    rows = [(c, t, "user", f"same {t}") for c in range(1, 400) for t in range(3)]
    rows += [(1000, t, "user", "é" * (t % 5)) for t in range(1200)]
    rows += [(c, 0, "user", "same 0") for c in range(2000, 2400)] + [(c, 1, "x", str(c)) for c in range(2000, 2400)]
    made = got(prefix_trie.trie(prefix_trie.turns(frame(spark, rows))))
    assert made == plain_trie(plain_turns(rows))


def test_odd_rows(spark):
    """Null ids are left out; ties, repeated rows, empty tables and further columns have a result."""
    rows = [(None, 0, "u", "x"), (7, 1, "u", "b"), (7, 1, "u", "b"), (7, None, None, None), (8, None, "", ""), (101, 0, "u", "only")]
    table = frame(spark, rows).selectExpr("*", "1 AS path", "'x' AS key", "2 AS depth")
    assert got(prefix_trie.trie(prefix_trie.rebuild(table))) == plain_trie(plain_rebuilt(rows))
    assert got(prefix_trie.trie(prefix_trie.rebuild(frame(spark, [])))) == []
    # Conversation 101 takes turns of the absent 100 and loses its own.
    assert plain_rebuilt(rows)[101] == ([] if zlib.crc32(b"101") % 6 else [("u", "only")])
