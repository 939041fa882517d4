"""The conversation trie against one built from plain tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from telospark.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - int(abs(c) % 5 * (1 if c > 0 else -1)), [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in kids[p])
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, m in members.items())


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if v is None else v for v in r) for r in conversations.prefix_trie(df).select(*cols).collect())


def talks(seed, n, kinds=3, most=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]), "é" * rng.randrange(kinds)) for c in range(-n // 10, n) if rng.random() < 0.9 for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("run_bytes,part", [(16 << 20, 16 << 20), (2000, 1500), (300, 400)])
def test_equal_to_a_plain_trie(spark, monkeypatch, run_bytes, part):
    for name, value in (("RUN", run_bytes), ("PART", part), ("TURNS", part), ("IDS", 7)):
        monkeypatch.setattr(conversations, name, value)
    rows = talks(run_bytes, 160)
    assert run(spark, rows) == plain(rows)


def test_copies_hot_first_turn_and_long_conversation(spark, monkeypatch):
    """Copies over many runs, one first turn for most, one conversation over several ranges, and
    prefixes that end where others go on, with every range a few entries wide."""
    for name, value in (("RUN", 1500), ("PART", 700), ("TURNS", 60), ("IDS", 16)):
        monkeypatch.setattr(conversations, name, value)
    rows = [(c, t, "user", "same") for c in range(400, 480) for t in range(1 + c % 4)]
    rows += [(c, t, "user", "hello" if t == 0 else str(c % (3 + t))) for c in range(500, 600) for t in range(6)]
    rows += [(700, t, "user", f"turn {t}") for t in range(400)] + [(705, t, "user", f"turn {t}") for t in range(399)]
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    """Nulls in every column, ties, repeated rows, an absent head, conversations without turns left,
    a very long text, clashing names, no rows."""
    rows = [(None, 1, "user", "lost"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (7, 3, "u", "x" * 200_000), (12, 0, "", "a:b"), (13, 0, "a", ":b"), (-3, 0, "u", "v"), (3, 0, None, ""), (8, 0, "", None)]
    assert run(spark, rows) == plain(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert conversations.prefix_trie(df.limit(0)).collect() == []
    clash = df.withColumns({c: F.lit("x") for c in ("c", "i", "key", "size", "part", "depth", "seq", "run")})
    assert sorted(map(str, conversations.prefix_trie(clash).collect())) == sorted(map(str, conversations.prefix_trie(df).collect()))
    turnless = [(c, 0, "u", "only") for c in (11, 13, 19, 36)]  # heads are absent, so those with one to drop keep nothing
    assert run(spark, turnless) == plain(turnless)


def test_merge_does_not_compare_shared_turns_again(monkeypatch):
    """Merged order is the sorted order with right LCPs, and turns behind a known LCP only are read."""
    rng = random.Random(1)
    keys = [bytes([i]) * conversations.KEY for i in range(3)]
    seqs = [b"".join(rng.choice(keys[: 1 + (d > 20)]) for d in range(rng.randrange(40))) for _ in range(300)]
    runs = []
    for k in range(0, 300, 23):
        part = sorted(seqs[k : k + 23])
        runs.append([(s, j, 0, 0, conversations.shared(part[j - 1], s) if j else 0) for j, s in enumerate(part)])
    read = []
    true_shared = conversations.shared
    monkeypatch.setattr(conversations, "shared", lambda a, b, start=0: read.append(true_shared(a, b) - start) or true_shared(a, b, start))
    out = list(conversations.merged(runs))
    assert [e[0] for e, _ in out] == sorted(seqs)
    assert all(lcp == (true_shared(out[i - 1][0][0], e[0]) if i else 0) for i, (e, lcp) in enumerate(out))
    levels = 4
    assert sum(read) < 300 * levels * 20 / 3, "most of the twenty common turns were read again"
