"""MinHash near-dedup with sequential Bayesian verification.

One pass makes each text's set of five-word shingles, its digest and a MinHash signature. Equal
sets form classes. Class representatives that share a band of the signature are candidates; their
signatures are compared batch by batch, and a pair is dropped once the posterior probability that
its similarity reaches the threshold falls below the chosen miss probability. What is left is
verified on the full sets.

Pairs inside a bucket are not listed. First each member meets its bucket's pivot, the least in one
of PIVOTS seeded orders, so that a large group meets several of its members. What is linked then
forms components; where a bucket still holds several, the members of its largest one meet the others,
and the others each other, in blocks of bounded size. A task leaves the members that have a likely
partner, with the likeliest; these pairs are verified next. Where a block still holds several
components, its members come together with their texts, and the task verifies and unites them as it
goes: only the links that join two components leave it. No pair of a shared band goes unexamined
unless its two documents are already in one component.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telospark.llm.common import components, discard, free_shuffles, small_enough, table
from telospark.llm.tokens import slices, trim

WORDS = 5
HASHES = 256
BANDS = 32
ROWS = 4  # hashes per band
STEP = 32  # hashes compared between two looks at the posterior
PIVOTS = 4
#: Members of a block, and shingles of their sets together; bounds of a task's memory.
BLOCK = 1024
WEIGHT = 400_000
_GROUP = ("bucket", "kind", "p", "q")


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return byte, rng.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint32)


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> np.ndarray:
    have = _powers[0]
    while len(have) < n:
        step = np.uint64(pow(_BASE, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[0] = have
    return have


def word_hashes(raw: bytes, byte: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's words in order; A-Z lower-cased, words are runs of bytes other than
    0x20 and 0x09-0x0D."""
    b = np.frombuffer(raw, np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.flatnonzero(edge == -1) - starts
    b = b[inside]
    b = b + ((b >= 65) & (b <= 90)).view(np.uint8) * np.uint8(32)
    first = np.cumsum(sizes) - sizes
    power = _powers_to(int(sizes.max()))
    return _mix(np.add.reduceat(byte[b] * power[np.arange(len(b)) - np.repeat(first, sizes)], first) + sizes.astype(np.uint64))


def shingles(raw: bytes, byte: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words, the whole sequence is
    the one shingle."""
    w = word_hashes(raw, byte)
    if not len(w):
        return w
    n = min(words, len(w))
    s = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        s = s * np.uint64(_BASE) + w[j : len(w) - n + 1 + j]
    return np.unique(_mix(s))


def signature(s: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        x = h[at : at + 1024][None, :] * a[:, None]
        x += c[:, None]
        x ^= x >> np.uint32(15)
        np.minimum(low, x.min(axis=1), out=low)
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each look (after STEP, 2 STEP, ... hashes): fewer matches than this leave a posterior
    probability under `miss` that the similarity reaches the threshold (uniform prior):
    P(S >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def _survivors(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs (x[u], y[v]) that no look prunes, and their matches."""
    live, got = np.arange(len(u)), np.zeros(len(u), np.int32)
    for k, least in enumerate(need):
        cols = slice(k * STEP, (k + 1) * STEP)
        for at in range(0, len(live), 1 << 16):
            some = live[at : at + (1 << 16)]
            got[some] += (x[u[some], cols] == y[v[some], cols]).sum(axis=1, dtype=np.int32)
        live = live[got[live] >= least]
    return live, got[live]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def sign(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, the set's digest (d1, d2) and signature (null for an empty set)."""

    def run(batches):
        byte, a, c = _constants()
        for batch in batches:
            for b in slices(batch, "_text"):
                n, d, sig = [], [], []
                for raw in b.column(1).cast(pa.binary()).to_pylist():
                    s = shingles(raw or b"", byte)
                    n.append(len(s))
                    d.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(signature(s, a, c).tobytes() if len(s) else None)
                digest = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])
        trim()

    rows = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union, on the full sets."""

    def compare(batches):
        byte, _, _ = _constants()
        for b in batches:
            keep, held = [], {}
            for i, j, x, y in zip(*(b.column(k).to_pylist() for k in range(4))):
                if len(held) > 256:
                    held.clear()
                for k, raw in ((i, x), (j, y)):
                    if k not in held:
                        held[k] = shingles(raw, byte)
                keep.append(_linked(held[i], held[j], threshold))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        trim()

    x, y = texts.toDF("a", "x"), texts.toDF("b", "y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _blocks(members: DataFrame, found: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """members (bucket, doc_id, n_shingles) of the buckets that hold several components, once for
    each pair of blocks they are in: kind 0, block p of the bucket's largest component against block
    q of the others; kind 1, two blocks of the others. s tells the blocks apart; c is the component.

    Members of the largest component appear once per block of others: where most of a large bucket
    is united, its rows grow in proportion to its size. Also returns the tables that are read."""
    rest = members.join(small_enough(found), members["doc_id"] == found["id"], "left")
    rest = table(rest.select("bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("c")), "rest")
    per = rest.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    mixed = per.groupBy("bucket").agg(F.max(F.struct("n", "w", "c")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / WEIGHT)).cast("int")
    mixed = mixed.select("bucket", "k", F.col("top.c").alias("l"), blocks(F.col("top.n"), F.col("top.w")).alias("kl"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("ko"))
    mixed = table(mixed, "mixed")
    read = [rest, mixed]
    rest = rest.join(small_enough(mixed), "bucket")
    rest = rest.withColumn("i", F.pmod(F.xxhash64("doc_id"), F.when(F.col("c") == F.col("l"), F.col("kl")).otherwise(F.col("ko"))).cast("int"))
    place = lambda kind, p, q, s: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), s.alias("s"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    largest = F.transform(to(F.col("ko")), lambda j: place(0, F.col("i"), j, F.lit(0)))
    others = F.transform(to(F.col("kl")), lambda j: place(0, j, F.col("i"), F.lit(1)))
    among = F.transform(to(F.col("ko")), lambda j: place(1, F.least("i", j), F.greatest("i", j), F.col("i")))
    places = F.when(F.col("c") == F.col("l"), largest).when(F.col("k") > 2, F.concat(others, among)).otherwise(others)
    return rest.select("bucket", "doc_id", "c", F.explode(places).alias("at")).select("bucket", "at.*", "doc_id", "c"), read


def _pairs(t: pa.Table, x: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, matches) of a group's pairs of different components that no look prunes."""
    s, c = t["s"].to_numpy(), t["c"].to_numpy()
    if t["kind"][0].as_py() and t["p"][0].as_py() == t["q"][0].as_py():
        one = other = np.arange(len(s))
    else:
        one, other = (np.flatnonzero(m) for m in (s == s.min(), s != s.min()))
    out = []
    for u in np.array_split(one, max(1, len(one) * len(other) // (1 << 20))):  # a bounded part of the products at once
        u, v = (z.ravel() for z in np.meshgrid(u, other, indexing="ij"))
        apart = (c[u] != c[v]) & ((u < v) if one is other else True)
        u, v = u[apart], v[apart]
        live, got = _survivors(x, x, u, v, need)
        out.append((u[live], v[live], got))
    return tuple(np.concatenate(z) for z in zip(*out))


def _groups(batches):
    """Tables of the rows of each group, from batches sorted by group."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        k = np.stack([t[c].to_numpy().astype(np.int64) for c in _GROUP])
        at = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist()]
        for s, e in zip(at, at[1:]):
            yield t.slice(s, e - s).combine_chunks()
        held = t.slice(at[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _likely(rows: DataFrame, need: list[int]) -> DataFrame:
    """The members of each group (bucket, kind, p, q) that have a likely partner, and the likeliest."""

    def run(batches):
        for t in _groups(batches):
            if t.num_rows < 2:
                continue
            u, v, got = _pairs(t, _matrix(t["sig"]), need)
            if not len(u):
                continue
            a, b, score = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([got, got])
            d = t["doc_id"].to_numpy()
            order = np.lexsort((d[b], -score, a))
            first = order[np.concatenate(([True], np.diff(a[order]) > 0))]
            yield t.select([*_GROUP, "s", "doc_id"]).take(pa.array(a[first])).append_column("best", pa.array(d[b[first]])).combine_chunks().to_batches()[0]
        trim()

    return _grouped(rows).mapInArrow(run, "bucket long, kind int, p int, q int, s int, doc_id long, best long")


def _unite(rows: DataFrame, need: list[int], threshold: int) -> DataFrame:
    """The links (a, b) that join components of a group's members, likeliest pairs first; rows have
    the text besides."""

    def run(batches):
        byte, _, _ = _constants()
        for t in _groups(batches):
            root = t["c"].to_numpy().copy()
            if t.num_rows < 2 or (root == root[0]).all():
                continue
            u, v, got = _pairs(t, _matrix(t["sig"]), need)
            order = np.argsort(-got, kind="stable")
            d, sets, a, b = t["doc_id"].to_numpy(), {}, [], []
            texts = t["text"]
            for x, y in zip(u[order].tolist(), v[order].tolist()):
                if root[x] == root[y]:
                    continue
                for z in (x, y):
                    if z not in sets:
                        sets[z] = shingles(texts[z].as_py(), byte)
                if _linked(sets[x], sets[y], threshold):
                    root[root == root[x]] = root[y]
                    a.append(d[x])
                    b.append(d[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        trim()

    return _grouped(rows).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = 75, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of df.

    Two documents are linked if their shingle sets' Jaccard similarity is threshold/100 or more;
    component_id is the smallest doc_id reachable by links. 32 bands of 4 hashes miss a pair of
    similarity 0.75 with probability 5e-6, the Bayesian looks with about `miss` each.

    Null and empty texts, and texts without words, have an empty set and are linked with nothing.
    Rows of one doc_id share its component; a null doc_id has a null component and kept true.
    Extra columns of df are ignored.
    """
    spark = df.sparkSession
    need = least_matches(threshold / 100, miss)
    docs = table(sign(df, text, key), "signed")
    some = docs.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    classes = table(classes, "classes")
    copies = table(some.select("d1", "d2", "doc_id").join(small_enough(classes), ["d1", "d2"]).where("doc_id <> rep").select("doc_id").distinct(), "copies")
    reps = some.join(small_enough(copies), "doc_id", "left_anti")

    width = 2 * ROWS
    keys = [F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(BANDS)]
    bands = reps.select("doc_id", "n_shingles", F.explode(F.array(*keys)).alias("bucket"))
    order = F.xxhash64(F.pmod("bucket", F.lit(PIVOTS)), "doc_id")
    pivots = bands.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "doc_id")).alias("least"), F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b")
    pivots = table(pivots.select("bucket", F.col("least.doc_id").alias("pivot")), "pivots")
    members = table(bands.join(small_enough(pivots), "bucket").select("bucket", "doc_id", "n_shingles", "pivot"), "members")
    free_shuffles(spark)
    ids = table(members.select("doc_id").distinct(), "ids")
    sigs = table(reps.select("doc_id", "sig").join(small_enough(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "sigs")

    def prune(batches):
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column(2)), _matrix(b.column(3))
                at = np.arange(len(x))
                yield b.select([0, 1]).take(pa.array(_survivors(x, y, at, at, need)[0]))

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = table(ids.toDF("_id").distinct(), "ids")
        rows = df.select(F.col(key).cast("long").alias("_id"), F.encode(F.col(text), "UTF-8").alias("_text"))
        rows = table(rows.join(small_enough(ids), "_id", "left_semi").dropDuplicates(["_id"]), "texts")
        discard(ids)
        return rows

    def verified(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select("a").union(pairs.select("b")))
        out = table(_verify(pairs, texts, threshold), "links")
        discard(texts)
        free_shuffles(spark)
        return out

    stars = members.where("doc_id <> pivot").select(F.greatest("doc_id", "pivot").alias("a"), F.least("doc_id", "pivot").alias("b")).distinct()
    stars = stars.join(sigs.toDF("a", "x"), "a").join(sigs.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = verified(table(stars.mapInArrow(prune, "a long, b long"), "stars"))
    found = table(components(links), "found")
    rows, read = _blocks(members.select("bucket", "doc_id", "n_shingles"), found)
    likely = table(_likely(rows.join(sigs, "doc_id"), need), "likely")
    for done in read:
        discard(done)
    free_shuffles(spark)
    if not likely.isEmpty():
        best = likely.select(F.greatest("doc_id", "best").alias("a"), F.least("doc_id", "best").alias("b")).distinct()
        links = links.union(verified(table(best, "best")))
        found = table(components(links), "found")
        # Groups that still hold several components.
        now = likely.join(small_enough(found), likely["doc_id"] == found["id"], "left").select(*_GROUP, "s", "doc_id", F.coalesce("component", "doc_id").alias("c"))
        apart = now.groupBy(*_GROUP).agg(F.min("c").alias("_a"), F.max("c").alias("_b")).where("_a < _b").select(*_GROUP)
        apart = table(now.join(apart, list(_GROUP), "left_semi"), "apart")
        if not apart.isEmpty():
            texts = texts_of(apart.select("doc_id"))
            rows = apart.join(sigs, "doc_id").join(texts.toDF("doc_id", "text"), "doc_id")
            links = links.union(table(_unite(rows, need, threshold), "links"))
            discard(texts)
            found = table(components(links), "found")
        discard(apart)
    for done in (pivots, members, ids, sigs, likely):
        discard(done)
    free_shuffles(spark)
    out = docs.drop("sig").join(small_enough(classes).select("d1", "d2", "rep"), ["d1", "d2"], "left").withColumn("_root", F.coalesce("rep", "doc_id"))
    out = out.join(found.toDF("_root", "_c"), "_root", "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("_c", "_root"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
