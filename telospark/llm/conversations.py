"""Prefix trie of conversations by an external mergesort that knows shared prefixes (LCPs).

A conversation is a sequence of turn keys (SHA-256 of role and text). Tasks sort runs of bounded size;
each entry of a run carries its LCP, the number of turns that it shares with the entry before. Runs
are exchanged by ranges of sequences. A task merges its range of all runs with a loser tree: the
loser at each of its nodes knows how many turns it shares with the last winner, so shared turns are
not compared again. The merged stream drives a stack of open nodes; a node is finished, and goes
out, when an entry no longer shares it.

Only nodes on the border of two ranges are seen by several tasks. Each task knows how many turns its
first and last entry share with those of the neighbouring ranges, so it knows which nodes these
are and where each begins; their figures are plain sums over the tasks.

Texts never leave the task that reads them but to order turns; equal conversations are one entry of
a run. A conversation is one entry, of 40 bytes a turn.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telospark.llm.common import small_enough, table

#: Bytes of a turn's key; bytes of sequences sorted as one run and merged in one task; turns that
#: one task puts in order.
KEY, RUN, PART, TURNS = 32, 16 << 20, 16 << 20, 1_000_000
#: Ids of one row of a list of members (by ranges of ids, so that a row is bounded).
IDS = 4096

_RUN_SCHEMA = "run long, at int, seq binary, sizes binary, n long, conv_id long, ids array<long>, lcp int"
_NODE_SCHEMA = "key binary, depth long, conv_id long, parent_key binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends boolean, open boolean"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order -> their places within their conversation and range, from 0."""
    part, now, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        ids = b.column(0).to_numpy()
        if not len(ids):
            continue
        new = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if ids[0] != now else ids[0]))
        at = np.arange(len(ids)) + n
        for s, e in zip(new.tolist(), np.append(new[1:], len(ids)).tolist()):
            at[s:e] = np.arange(e - s)
        now, n = ids[-1], int(at[-1]) + 1
        yield pa.record_batch({"c": b.column(0), "part": pa.array(np.full(len(ids), part), pa.int64()), "at": pa.array(at, pa.int64()), "key": b.column(1), "size": b.column(2)})


def numbered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, i (place from 0), key and size (UTF-8 bytes of the text) of every turn, by turn (null
    first), role and text. Ranges of that order are numbered and then added up, so a conversation of any length is
    spread over tasks. Rows without an id belong to no conversation."""
    spark = df.sparkSession
    r, x = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in (role, text))
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), r.alias("r"), x.alias("x"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TURNS))
    ranges = rows.repartitionByRange(tasks, "c", "t", "r", "x").sortWithinPartitions("c", "t", "r", "x")
    key = F.unhex(F.sha2(F.concat(F.char_length("r").cast("string"), F.lit(":"), "r", "x"), 256))
    keyed = ranges.select("c", key.alias("key"), F.octet_length("x").cast("long").alias("size"))
    turns = table(keyed.mapInArrow(_number, "c long, part long, at long, key binary, size long"), "turns")
    # conversations over several ranges: at most one a border
    counts = turns.groupBy("c", "part").agg(F.count("*").alias("n"))
    several = counts.withColumn("parts", F.count("*").over(Window.partitionBy("c"))).where("parts > 1")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = table(several.select("c", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "turn-base")
    return turns.join(small_enough(base), ["c", "part"], "left").select("c", (F.col("at") + F.coalesce("base", F.lit(0))).alias("i"), "key", "size")


def head_length(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame, heads: int = 5) -> DataFrame:
    """Turns of the rebuilt conversations: c, side (0 from the head, 1 its own, 2 a mark that c
    exists), i, key, size. c begins with the first head_length(c) turns of c - c % heads."""
    own = turns.where(F.col("i") >= head_length(F.col("c"))).select("c", F.lit(1).alias("side"), "i", "key", "size")
    mark = turns.where("i = 0").select("c", F.lit(2).alias("side"), "i", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("size"))
    near = F.expr(f"transform(sequence(if(c > 0, 0, {1 - heads}), if(c < 0, 0, {heads - 1})), d -> c + d)")
    head = turns.where(f"c % {heads} = 0 and i < 8").withColumn("c", F.explode(near))
    head = head.where(F.col("i") < head_length(F.col("c"))).select("c", F.lit(0).alias("side"), "i", "key", "size")
    return own.union(mark).union(head)


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two sequences share, of which `start` are known."""
    n, i = min(len(a), len(b)), start * KEY
    step = KEY
    while i < n and a[i : i + step] == b[i : i + step]:  # ever longer pieces; the last may be shorter
        i += step
        step *= 2
    if i >= n:
        return n // KEY
    while i < n and a[i : i + KEY] == b[i : i + KEY]:
        i += KEY
    return min(i, n) // KEY


def _sorted_run(run: int, entries: list[tuple[bytes, bytes, int]]) -> Iterator[pa.RecordBatch]:
    """Sequences in order, equal ones as one entry, each with its LCP."""
    entries.sort()
    rows: list[list] = []
    for seq, sizes, c in entries:
        if rows and rows[-1][2] == seq:
            rows[-1][6].append(c)
        else:
            rows.append([run, len(rows), seq, sizes, 0, c, [c], shared(rows[-1][2], seq) if rows else 0])
    for r in rows:
        r[4] = len(r[6])
    for k in range(0, len(rows), 5_000):
        cols = list(zip(*rows[k : k + 5_000]))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32())
        yield pa.record_batch({n: pa.array(v, t) for n, v, t in zip(("run", "at", "seq", "sizes", "n", "conv_id", "ids", "lcp"), cols, kinds)})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns by conversation, in order -> sorted runs of about RUN bytes."""
    run = TaskContext.get().partitionId() << 32
    entries: list[tuple[bytes, bytes, int]] = []
    now, keys, sizes, held = None, [], [], 0
    for b in batches:
        for c, side, key, size in zip(*(x.to_pylist() for x in b.columns)):
            if c != now:
                now, keys, sizes = c, [], []
            if side < 2:
                keys.append(key)
                sizes.append(size)
                continue
            entries.append((b"".join(keys), np.array(sizes, np.int64).tobytes(), c))  # the mark comes last
            held += len(keys) * (KEY + 8) + 64
            if held >= RUN:
                yield from _sorted_run(run, entries)
                run, entries, held = run + 1, [], 0
    yield from _sorted_run(run, entries)


def merged(runs: list[list[tuple]]) -> Iterator[tuple[tuple, int]]:
    """Entries (sequence, ..., lcp) of sorted runs in order, each with the turns it shares with the
    one before it. A loser tree: `last` holds, for each run, how many turns its entry shares with
    the last winner; of two entries that share unequally much with it, the one that shares more is
    the smaller, and only equal ones are compared, behind what they share."""
    k = 1 << max(0, len(runs) - 1).bit_length()
    at, last = [0] * k, [0] * k
    heads: list[tuple | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))

    def winner(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if last[a] != last[b]:
            return (a, b) if last[a] > last[b] else (b, a)
        n = shared(x[0], y[0], last[a])
        i = n * KEY
        p, q = x[0][i : i + KEY], y[0][i : i + KEY]
        if p == q and a > b or p > q:
            a, b = b, a
        last[b] = n  # the loser's, with the winner
        return a, b

    loser = [0] * k
    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        pairs = [winner(level[j], level[j + 1]) for j in range(0, len(level), 2)]
        for j, (_, b) in enumerate(pairs):
            loser[node + j] = b
        level = [a for a, _ in pairs]
    top = level[0]
    while heads[top] is not None:
        yield heads[top], last[top]
        at[top] += 1
        mine = runs[top]
        heads[top] = mine[at[top]] if at[top] < len(mine) else None
        if heads[top] is not None:
            last[top] = heads[top][-1]
        node, a = (k + top) // 2, top
        while node:
            a, loser[node] = winner(a, loser[node])
            node //= 2
        top = a


class _Node:
    __slots__ = ("hash", "size", "begins", "conv", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, state, size: int, begins: bool) -> None:
        self.hash, self.size, self.begins = state, size, begins
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, False
        self.waiting: list[tuple] = []  # finished children, until this node's smallest member is known


def nodes(stream: Iterator[tuple[tuple, int]], before: int | None, after: int | None) -> Iterator[tuple]:
    """Rows of _NODE_SCHEMA of the trie of a range. before, after: the turns that its first and last
    entries share with the neighbouring ranges (None: there is none). Figures of open nodes, those
    of several ranges, are shares that add up."""
    path: list[_Node] = []

    def close(last: bool) -> Iterator[tuple]:
        v, d = path.pop(), len(path)
        goes_on = last and after is not None and d <= after
        open_ = goes_on or not v.begins
        if v.begins and not v.children and not goes_on:
            v.leaves += 1
        v.saved += (v.n - (1 if v.begins else 0)) * v.size
        key = v.hash.digest()
        for row in v.waiting:
            yield (*row, key, None) if open_ else (*row, key, v.conv)
        mine = (key, d, v.conv, v.n, v.children, v.leaves, v.saved, v.ends, open_)
        if not path:
            yield (*mine, None, None)
            return
        up = path[-1]
        up.conv = v.conv if up.conv is None else min(up.conv, v.conv)
        up.n, up.leaves, up.saved = up.n + v.n, up.leaves + v.leaves, up.saved + v.saved
        if up.begins:
            up.waiting.append(mine)
        else:
            yield (*mine, up.hash.digest(), None)

    for (seq, sizes, n, conv, _), lcp in stream:
        if path:
            while len(path) > lcp + 1:
                yield from close(False)
        else:
            lcp = -1
        size = np.frombuffer(sizes, np.int64)
        for d in range(lcp + 1, len(seq) // KEY + 1):
            state = path[-1].hash.copy() if path else hashlib.sha256()
            if d:
                state.update(seq[(d - 1) * KEY : d * KEY])
            begins = lcp >= 0 or before is None or d > before
            if path and begins:
                path[-1].children += 1
            path.append(_Node(state, int(size[d - 1]) if d else 0, begins))
        v = path[-1]
        v.n, v.ends, v.conv = v.n + n, True, conv if v.conv is None else min(v.conv, conv)
    while path:
        yield from close(True)


def _merge(borders: dict[int, tuple[int | None, int | None]]):
    """Rows of a range of all runs -> its nodes."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.sort_by([("run", "ascending"), ("at", "ascending")])
        runs: dict[int, list[tuple]] = {}
        for r, *entry in zip(*(t[c].to_pylist() for c in ("run", "seq", "sizes", "n", "conv_id", "lcp"))):
            runs.setdefault(r, []).append(tuple(entry))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            key, d, conv, n, children, leaves, saved, ends, open_, up, up_conv = zip(*out)
            cols = (key, d, conv, up, up_conv, n, children, leaves, saved, ends, open_)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            out.clear()
            names = (x.split(" ")[0] for x in _NODE_SCHEMA.split(", "))
            return pa.record_batch({k: pa.array(v, kind) for k, v, kind in zip(names, cols, kinds)})

        for row in nodes(merged(list(runs.values())), *borders[t["part"][0].as_py()]):
            out.append(row)
            if len(out) >= 10_000:
                yield batch()
        if out:
            yield batch()

    def whole(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(t)))

    return whole


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists of ids, in order -> the digest of each list."""
    now, state = None, None
    for b in batches:
        out = []
        for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if key != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.record_batch({"key": pa.array([k for k, _ in out], pa.binary()), "ends_sha256": pa.array([h for _, h in out], pa.string())})
    if now is not None:
        yield pa.record_batch({"key": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def _members(runs: DataFrame, tasks: int) -> DataFrame:
    """key, ends_sha256 of each distinct sequence: SHA-256 of its conversations' ids, ascending."""
    one = runs.select(F.unhex(F.sha2("seq", 256)).alias("key"), F.explode("ids").alias("c"))
    blocks = one.groupBy("key", F.floor(F.col("c") / IDS).alias("block")).agg(F.array_sort(F.collect_list("c")).alias("ids"))
    rows = blocks.select("key", "block", F.expr("array_join(transform(ids, c -> cast(c as string)), ',')").alias("ids"))
    return rows.repartition(tasks, "key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")


def _ranged(runs: DataFrame, parts: int) -> DataFrame:
    """runs with the number of their range, of about equally many entries. Boundaries are whole
    sequences, so that a hot prefix is split; equal sequences stay together."""
    rows = runs.count()
    step = max(1, rows // (16 * parts))
    probes = sorted(bytes(r["seq"]) for r in runs.where(F.expr(f"pmod(cast(at as bigint) + hash(run), {step}) = 0")).select("seq").toLocalIterator())
    cuts = sorted({probes[len(probes) * k // parts] for k in range(1, parts)}) if probes else []

    @F.pandas_udf("int")
    def part(seq):
        import pandas as pd

        return pd.Series([bisect_right(cuts, bytes(s)) for s in seq], dtype="int32")

    return runs.withColumn("part", part("seq"))


def _borders(ranged: DataFrame) -> dict[int, tuple[int | None, int | None]]:
    """For each range, the turns that its ends share with the neighbouring ranges: numbers only."""

    @F.pandas_udf("int")
    def both(a, b):
        import pandas as pd

        return pd.Series([None if x is None else shared(bytes(x), bytes(y)) for x, y in zip(a, b)], dtype="Int32")

    order = Window.orderBy("part")  # one row per range
    ends = ranged.groupBy("part").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    ends = ends.withColumn("up", F.lag("hi").over(order)).select("part", both("up", "lo").alias("before")).orderBy("part").collect()
    after = [r["before"] for r in ends[1:]] + [None]
    return {r["part"]: (r["before"], a) for r, a in zip(ends, after)}


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations: conv_id (smallest
    member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the ids, ascending and comma-joined, of the members that end there).

    Turns are ordered by turn (null first), then role and text, so that ties and repeated rows have one
    order; null roles and texts are empty; rows with a null id belong to no conversation. A conversation
    without turns is a member of the root. Other columns are not read; an empty table gives an
    empty result.
    """
    spark = df.sparkSession
    turns = rebuilt(table(numbered_turns(df, conv, turn, role, text), "numbered"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by_conv = turns.repartition(tasks, "c").sortWithinPartitions("c", "side", "i").select("c", "side", "key", "size")
    runs = table(by_conv.mapInArrow(_runs, _RUN_SCHEMA), "runs")
    total = runs.agg(F.coalesce(F.sum(F.length("seq").cast("long") + 64), F.lit(0))).first()[0]
    ranged = table(_ranged(runs.drop("ids"), max(tasks, -(-total // PART))), "ranged")
    found = table(ranged.groupBy("part").applyInArrow(_merge(_borders(ranged)), _NODE_SCHEMA), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = found.where("open").groupBy("key").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("parent_key").alias("parent_key"), *sums, F.max("ends").alias("ends"))
    border = table(border, "border-nodes")
    heads = small_enough(border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up")))
    columns = ["key", "depth", "conv_id", "parent_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    done = found.where("not open and parent_conv_id is not null").select(*columns)
    left = found.where("not open and parent_conv_id is null").select(*columns).union(border.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    left = left.join(heads, "parent_key", "left").withColumn("parent_conv_id", F.col("up")).select(*columns)
    every = done.union(left)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = every.where("not ends").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return inner.select(*out).union(every.where("ends").join(_members(runs, tasks), "key").select(*out))
