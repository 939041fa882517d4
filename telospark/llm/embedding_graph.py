"""Embedding near-dedup on a robust-pruned flat graph.

Vectors go to their nearest few of a sample's centroids, so clusters overlap. Each cluster shard
builds a robust-pruned neighbour graph, from candidates that random trees bring together; a vector's adjacency lists from all its shards are united.
Every vector then searches its shards: greedy from the shard's medoid, then outward from all that
is in range until no more is found. Pairs are verified in double precision and counted in their
first common shard alone. Recall is audited against exact products of a bounded query sample, over
all links and query by query; below the target, vectors are spread over more shards, graphs get more
candidates and a higher degree, and the search is repeated. If that is not enough, the shards are
compared exactly, and if links are still missing an error is raised.

A shard holds at most BLOCK vectors: larger clusters are split into blocks and every pair of blocks
is a shard. Identical vectors count as one, with their number as weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telospark.llm.common import components, cut, table

#: Bounds of what the driver holds and broadcasts: the sample for centroids, and the centroids.
SAMPLE = 20_000
CENTROIDS = 2_048
PER_CLUSTER = 1_200
BLOCK = 8_192
CANDIDATES = 40
#: Candidates beyond the nearest, drawn from a vector's leaves, and as many from its shard.
WIDE = 40
#: Random trees of a shard, and the most vectors of a leaf.
TREES = 4
LEAF = 128
DEGREE = 20
ALPHA = 1.2
BEAM = 16
SLACK = 0.03
AUDIT = 400


def _floats(column) -> np.ndarray:
    return _rows(column.to_pylist())


def _rows(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length from their bytes: the first byte is the size of a component (4 or 8)."""
    size = raw[0][0]
    b = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)[:, 1:]
    return np.ascontiguousarray(b).view(np.float32 if size == 4 else np.float64)


def _length(raw: bytes) -> int:
    return (len(raw) - 1) // raw[0]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # huge and tiny components alike
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on the sample, deterministic."""
    rng = np.random.default_rng(3)
    x = x.astype(np.float32)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(6):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        heads = np.flatnonzero(np.diff(np.concatenate(([-1], near[order]))))
        sums = np.add.reduceat(x[order], heads, axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        ok = norms[:, 0] > 1e-6
        c[near[order][heads][ok]] = sums[ok] / norms[ok]
    return c


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors; all that build_graph() takes to find candidates go through here."""
    return np.matmul(x, y)


def _leaves(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """The rows in groups of LEAF at most: halved again and again, along the difference of two of a group."""
    open_, out = [np.arange(len(x))], []
    while open_:
        p = open_.pop()
        if len(p) <= LEAF:
            out.append(p)
            continue
        i, j = rng.choice(p, 2, replace=False)
        order = np.argsort(x[p] @ (x[i] - x[j]), kind="stable")
        open_ += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
    return out


def build_graph(x: np.ndarray, low: float = -1.0, effort: int = 1) -> list[np.ndarray]:
    """Robust-pruned adjacency of a shard's unit vectors, both directions.

    Candidates are the nearest of a vector's mates in the leaves of a few random trees, so a vector
    meets a number of others that doesn't grow with the shard. Besides them it has random candidates
    with cosine >= low, from its leaves and from the whole shard, pruned with a degree of their own:
    they link tight sub-groups of more vectors than the nearest reach."""
    m = len(x)
    if m < 2:
        return [np.zeros(0, np.int64)] * m
    limit = DEGREE * effort
    trees = TREES * effort if m > LEAF else 1
    k, w = max(CANDIDATES * effort // trees, 1), max(WIDE * effort // trees, 1)
    rng = np.random.default_rng(m)
    near, wide = np.full((m, trees, k), -1), np.full((m, trees, w), -1)
    for t in range(trees):
        for p in _leaves(x, rng):
            n = len(p)
            s = _cosines(x[p], x[p].T)
            s[np.arange(n), np.arange(n)] = -2
            some = min(k, n - 1)
            near[p, t, :some] = p[np.argpartition(-s, some - 1, axis=1)[:, :some]]
            some = min(w, n - 1)
            lot = np.where(s >= low, rng.random(s.shape, np.float32), 2)
            pick = np.argpartition(lot, some - 1, axis=1)[:, :some]
            wide[p, t, :some] = np.where(np.take_along_axis(lot, pick, 1) < 2, p[pick], -1)
    far = rng.choice(m, min(4, m), replace=False)
    heads, tails = [], []

    def prune(p: np.ndarray, c: np.ndarray, low: float) -> None:
        """Links p with what robust pruning keeps of their candidates c (-1: none)."""
        c = np.sort(c, axis=1)
        live = (c >= 0) & (c != p[:, None])
        live[:, 1:] &= c[:, 1:] != c[:, :-1]
        sim = np.where(live, _cosines(x[c], x[p][:, :, None])[:, :, 0], -2)
        order = np.argsort(-sim, axis=1, kind="stable")
        c, sim = (np.take_along_axis(z, order, 1) for z in (c, sim))
        live = sim >= low
        dist = 1 - sim
        between = 1 - np.matmul(x[c], x[c].transpose(0, 2, 1))
        taken = np.zeros(len(p), np.int64)
        for j in range(c.shape[1]):
            keep = live[:, j] & (taken < limit)
            heads.append(p[keep])
            tails.append(c[keep, j])
            taken += keep
            # what a kept neighbour stands closer to, by ALPHA, is reached through it
            live &= ~(keep[:, None] & (ALPHA * between[:, j] <= dist))

    for at in range(0, m, 512):
        p = np.arange(at, min(at + 512, m))
        prune(p, np.concatenate([near[p].reshape(len(p), -1), np.broadcast_to(far, (len(p), len(far)))], 1), -1.5)
        prune(p, np.concatenate([wide[p].reshape(len(p), -1), rng.integers(0, m, (len(p), WIDE * effort))], 1), low)
    h, t = np.concatenate(heads), np.concatenate(tails)
    codes = np.unique(np.concatenate([h * m + t, t * m + h]))
    return np.split(codes % m, np.searchsorted(codes // m, np.arange(1, m)))


def search(x: np.ndarray, adjacent: list[np.ndarray], threshold: float) -> np.ndarray:
    """links[i, j]: vector j was found from i (or i from j) with cosine >= threshold, in double
    precision. Greedy from the medoid, then range expansion."""
    m = len(x)
    f = x.astype(np.float32)
    degree = np.array([len(a) for a in adjacent])
    first = np.cumsum(degree) - degree
    flat = np.concatenate(adjacent).astype(np.int64) if m else np.zeros(0, np.int64)
    medoid = int((f @ f.mean(axis=0)).argmax())
    width = int(degree.max()) if m else 0
    padded = np.full((m, max(width, 1)), -1, np.int64)
    padded[np.repeat(np.arange(m), degree), np.arange(len(flat)) - np.repeat(first, degree)] = flat
    links = np.zeros((m, m), bool)
    for at in range(0, m, 256):
        q = np.arange(at, min(at + 256, m))
        n = len(q)
        row = np.arange(n)
        seen = np.zeros((n, m), bool)
        seen[:, medoid] = True
        ids, sims = np.full((n, BEAM), medoid), np.full((n, BEAM), -2.0, np.float32)
        sims[:, 0] = f[q] @ f[medoid]
        done = np.zeros((n, BEAM), bool)
        done[:, 1:] = True
        for _ in range(24):
            best = np.where(done, -3.0, sims).argmax(axis=1)
            open_ = ~done[row, best]
            if not open_.any():
                break
            done[row, best] = True
            nb = np.where(open_[:, None], padded[ids[row, best]], -1)
            nb = np.where((nb >= 0) & ~seen[row[:, None], nb], nb, -1)
            s = np.matmul(f[nb], f[q][:, :, None])[:, :, 0]
            s = np.where(nb >= 0, s, -2.0).astype(np.float32)
            r, c = np.nonzero(nb >= 0)
            seen[r, nb[r, c]] = True
            ids, sims, done = np.concatenate([ids, nb], 1), np.concatenate([sims, s], 1), np.concatenate([done, nb < 0], 1)
            top = np.argpartition(-sims, BEAM - 1, axis=1)[:, :BEAM]
            ids, sims, done = (np.take_along_axis(z, top, 1) for z in (ids, sims, done))
        low = threshold - SLACK
        r, c = np.nonzero(sims >= low)
        code = np.unique(np.concatenate([r * m + ids[r, c], row * m + q]))  # a query knows its own node
        seen[:] = False
        seen.ravel()[code] = True
        found = [code]
        while len(code):
            r, node = code // m, code % m
            take = degree[node]
            ends = np.cumsum(take)
            nb = flat[np.repeat(first[node] - ends + take, take) + np.arange(int(ends[-1]))]
            code = np.repeat(r, take) * m + nb
            code = np.unique(code[~seen.ravel()[code]])
            seen.ravel()[code] = True
            keep = np.concatenate([(f[q[c // m]] * f[c % m]).sum(axis=1) >= low for c in np.array_split(code, max(1, len(code) // 65_536))])
            code = code[keep]
            found.append(code)
        code = np.concatenate(found)
        for c in np.array_split(code, max(1, len(code) // 65_536)):
            i, j = q[c // m], c % m
            ok = (x[i] * x[j]).sum(axis=1) >= threshold
            links[i[ok], j[ok]] = True
    links |= links.T
    np.fill_diagonal(links, False)
    return links


def compare(x: np.ndarray, threshold: float) -> np.ndarray:
    """search() without a graph: exact blocked products."""
    links = np.zeros((len(x), len(x)), bool)
    for at in range(0, len(x), 512):
        links[at : at + 512] = x[at : at + 512] @ x.T >= threshold
    links |= links.T
    np.fill_diagonal(links, False)
    return links


def _roots(links: np.ndarray) -> np.ndarray:
    root = np.full(len(links), -1)
    for i in np.flatnonzero(links.any(axis=1)):
        if root[i] < 0:
            reached = np.zeros(len(links), bool)
            reached[i] = True
            front = np.array([i])
            while len(front):
                new = links[front].any(axis=0) & ~reached
                reached |= new
                front = np.flatnonzero(new)
            root[reached] = i
    return np.where(root < 0, np.arange(len(links)), root)


def _spread(reps: DataFrame, centroids: dict[int, tuple[int, np.ndarray]], overlap: int) -> DataFrame:
    """id, n, v and clusters (its nearest ones, ascending) of each distinct vector; vectors of
    dimensions without centroids form a cluster for each. centroids: by dimension, with the number
    of the first one's cluster."""
    given = reps.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(2).to_pylist()
            dims = np.array([_length(r) for r in raw])
            out: list = [None] * len(raw)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if int(d) not in given.value:
                    for i in rows:
                        out[i] = [-int(d)]
                    continue
                at, c = given.value[int(d)]
                s = unit(_rows([raw[i] for i in rows])).astype(np.float32) @ c.T
                k = min(overlap, len(c))
                near = at + np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
                for i, z in zip(rows, near.tolist()):
                    out[i] = z
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], ["id", "n", "v", "clusters"])

    return reps.mapInArrow(run, "id long, n long, v binary, clusters array<int>")


def _shards(spread: DataFrame) -> DataFrame:
    """A row for each shard (cluster, p, q) of each vector: block p of a cluster against block q."""
    each = spread.withColumn("cluster", F.explode("clusters"))
    half = BLOCK // 2
    sizes = each.groupBy("cluster").count().select("cluster", F.when(F.col("count") <= BLOCK, 1).otherwise(F.ceil(F.col("count") / half)).cast("int").alias("nb"))
    # at most CENTROIDS rows, and one per other dimension
    each = each.join(F.broadcast(sizes), "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return each.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("other", "nb")


def _search(reps: DataFrame, centroids: dict[int, tuple[int, np.ndarray]], overlap: int, threshold: float, effort: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id, links) with the weight of linked vectors, and the links' spanning forest (a, b). An
    effort of 0 compares shards exactly."""
    spread = table(_spread(reps, centroids, overlap), "spread")
    shards = _shards(spread)
    n = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def build(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        lists = build_graph(unit(_floats(t["v"].combine_chunks())).astype(np.float32), threshold - SLACK, effort)
        return pa.table({"id": ids, "near": pa.array([ids[a] for a in lists], pa.list_(pa.int64()))})

    def find(t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        t = t.take(pa.array(order)).combine_chunks()
        ids, x, weight, block = t["id"].to_numpy(), unit(_floats(t["v"].combine_chunks())), t["n"].to_numpy(), t["block"].to_numpy()
        if effort:
            near = t["near"].combine_chunks()
            at = np.searchsorted(ids, flat := near.flatten().to_numpy())
            inside = ids[np.minimum(at, len(ids) - 1)] == flat
            owner = np.repeat(np.arange(len(ids)), np.diff(near.offsets.to_numpy()))
            links = search(x, np.split(at[inside], np.searchsorted(owner[inside], np.arange(1, len(ids)))), threshold)
        else:
            links = compare(x, threshold)
        cluster, p, q = (t[c][0].as_py() for c in ("cluster", "p", "q"))
        lists = t["clusters"].combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        near = np.full((len(ids), count.max()), np.iinfo(np.int32).max, np.int32)
        near[np.repeat(np.arange(len(ids)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] = lists.flatten().to_numpy()
        total = np.zeros(len(ids), np.int64)
        for at in range(0, len(ids), 64):
            i, j = np.nonzero(links[at : at + 64])
            i += at
            if p != q:
                apart = block[i] != block[j]
                i, j = i[apart], j[apart]
            # the first cluster that both are in
            same = (near[i][:, :, None] == near[j][:, None, :]).any(axis=2)
            mine = np.where(same, near[i], np.iinfo(np.int32).max).min(axis=1, initial=np.iinfo(np.int32).max) == cluster
            total += np.bincount(i[mine], weights=weight[j[mine]], minlength=len(ids)).astype(np.int64)
        return pa.table({"id": ids, "links": total, "root": ids[_roots(links)]})

    if effort:
        keyed = shards.select("cluster", "p", "q", "id", "v")
        graph = keyed.groupBy("cluster", "p", "q").applyInArrow(build, "id long, near array<long>")
        graph = graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # united lists
        graph = table(graph.repartition(n), "graph")
        shards = shards.join(graph, "id")
    found = shards.groupBy("cluster", "p", "q").applyInArrow(find, "id long, links long, root long")
    found = table(found, "found")
    return found.groupBy("id").agg(F.sum("links").alias("links")), found.where("id <> root").selectExpr("id as a", "root as b").distinct()


def audit(reps: DataFrame, found: DataFrame, threshold: float, target: float, queries: int = AUDIT) -> tuple[int, int, int, int]:
    """(links found, links there are, queries that found `target` of their own links, queries that
    have links) of a bounded sample of queries against all vectors, by exact blocked products in
    double precision."""
    asked = reps.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(queries).collect()
    given = reps.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["v"])) for r in asked])

    def run(batches):
        by_dim: dict[int, list] = {}
        for i, v in given.value:
            by_dim.setdefault(len(v), []).append((i, v))
        for b in batches:
            raw, ids, weight = b.column(2).to_pylist(), b.column(0).to_numpy(), b.column(1).to_numpy()
            size = np.array([len(r) for r in raw])
            for d, some in by_dim.items():
                rows = np.flatnonzero(size == d)
                if not len(rows):
                    continue
                qi = np.array([i for i, _ in some])
                s = unit(_rows([v for _, v in some])) @ unit(_rows([raw[i] for i in rows])).T
                hit = (s >= threshold) & (qi[:, None] != ids[rows][None, :])
                yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(hit @ weight[rows])], ["id", "true"])

    there = reps.mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    own = F.least("true", F.coalesce("links", F.lit(0)))
    got = there.join(found, "id", "left").agg(F.sum(own), F.sum("true"), F.count_if((own >= target * F.col("true")) & (F.col("true") > 0)), F.count_if(F.col("true") > 0)).first()
    return tuple(x or 0 for x in got)


def near_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = 0.95, overlap: int = 3, target: float = 0.97, tries: int = 3) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vec_id of df, and recall: the share of links
    that the audit's queries found (the same in all rows; 1 without links).

    Vectors that are null or zero or hold null or non-finite components are linked with nothing;
    vectors of different lengths are not compared. Arrays of doubles are compared as doubles. Rows that repeat a vec_id count as one vector,
    the smallest valid one; rows with a null vec_id are returned unlinked, with a null component.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    wide = "double" in df.schema[vector].dataType.simpleString()  # kept as it is
    kind = np.float64 if wide else np.float32
    v = F.col(vector).cast("array<double>" if wide else "array<float>")
    good = F.col(key).isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.when(F.coalesce(good, F.lit(False)), v).alias("e"))
    rows = rows.groupBy("id").agg(F.min("e").alias("e"))

    head = bytes([np.dtype(kind).itemsize])

    def pack(batches):
        for b in batches:
            lists = b.column(1)
            raw = [None if x.values is None else head + x.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "v"])

    packed = table(rows.mapInArrow(pack, "id long, v binary"), "vectors")
    reps = table(packed.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "v"), "distinct")
    total = reps.count()
    sample = reps.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()  # bounded by SAMPLE
    by_dim: dict[int, list[bytes]] = {}
    for (raw,) in sample:
        by_dim.setdefault(_length(raw), []).append(bytes(raw))
    centroids = {}
    for d, raw in by_dim.items():
        k = min(CENTROIDS, max(1, round(total * len(raw) / len(sample) / PER_CLUSTER)))
        if len(raw) >= 8 * k or k == 1:
            centroids[d] = _centroids(unit(_rows(raw)), k)
    del sample, by_dim
    # One numbering of clusters over all dimensions.
    first = np.cumsum([0, *(len(c) for c in centroids.values())]).tolist()
    centroids = {d: (at, c) for (d, c), at in zip(centroids.items(), first)}
    for effort in [*(1 << i for i in range(tries)), 0]:
        counts, forest = _search(reps, centroids, overlap, threshold, effort)
        counts = cut(counts)
        got, there, whole, asked = audit(reps, counts, threshold, target)
        if got >= target * there and whole >= target * asked:
            break
        overlap += 2
    else:
        raise RuntimeError(f"{got} of {there} audited links found, {whole} of {asked} queries complete")
    linked = components(forest)
    twins = packed.join(reps, "v", "left").select(packed["id"].alias("vec_id"), reps["id"].alias("rep"), "n")
    out = twins.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(linked.toDF("rep", "_c"), "rep", "left")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"), F.coalesce("_c", "rep", "vec_id").alias("component_id"))
    return out.withColumns({"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)), "recall": F.lit(got / there if there else 1.0)})
