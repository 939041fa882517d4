"""Small feed-forward networks: training with Adam, prediction, grid search.

Weights are plain arrays with the feature settings they were trained for; JSON on disk, broadcast to
the tasks. Dense-ReLU(size), dropout after the first layer, more Dense-ReLU, one sigmoid output.
"""

from __future__ import annotations

import json
import secrets
from contextlib import ExitStack, contextmanager
from multiprocessing.connection import Client, Listener

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telospark.functions.features import feature_width, terminal_features
from telospark.functions.sequences import PEPTIDE, RESIDUES
from telospark.functions.stats import roc_auc
from telospark.sources.scratch import cut

# The grid of the reference settings.
SPLITS, DROPOUTS, SIZES, LAYERS, EPOCHS, DINUC = (6, 12, 18, 23), (0.0, 0.25, 0.5), (8, 16), (2,), (20, 40, 60), (True, False)


def initial(width: int, size: int, layers: int, rng: np.random.Generator) -> list[list]:
    widths = [width, *[size] * layers, 1]
    return [[rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)] for a, b in zip(widths, widths[1:])]


def gradients(net: list, x: np.ndarray, y: np.ndarray, mask: np.ndarray | None) -> list[list]:
    """Of the cross-entropy, summed over rows; mask: dropout behind the first layer."""
    acts = [x]
    for i, (w, b) in enumerate(net[:-1]):
        a = np.maximum(acts[-1] @ w + b, 0)
        acts.append(a * mask if i == 0 and mask is not None else a)
    grad = 1 / (1 + np.exp(-np.clip(acts[-1] @ net[-1][0] + net[-1][1], -60, 60))) - y
    out: list[list] = [[] for _ in net]
    for i in range(len(net) - 1, -1, -1):
        out[i] = [acts[i].T @ grad, grad.sum(axis=0)]
        if i:
            grad = (grad @ net[i][0].T) * (acts[i] > 0)
            if i == 1 and mask is not None:
                grad = grad * mask
    return out


class Adam:
    """The net's arrays become pieces of one, which is changed in place."""

    def __init__(self, net: list, rate: float):
        self.rate, self.step = rate, 0
        self.all = np.concatenate([a.ravel() for layer in net for a in layer])
        self.m, self.v, self.t, self.u = (np.zeros_like(self.all) for _ in range(4))
        at = 0
        for layer in net:
            for j, a in enumerate(layer):
                layer[j] = self.all[at : at + a.size].reshape(a.shape)
                at += a.size

    def update(self, grads: list) -> None:
        self.flat(np.concatenate([g.ravel() for parts in grads for g in parts]))

    def flat(self, g: np.ndarray) -> None:
        self.step += 1
        m, v, t, u = self.m, self.v, self.t, self.u
        m *= 0.9
        np.multiply(g, 0.1, out=t)
        m += t
        v *= 0.999
        np.multiply(g, g, out=t)
        t *= 0.001
        v += t
        np.divide(v, 1 - 0.999**self.step, out=t)
        np.sqrt(t, out=t)
        t += 1e-7
        np.multiply(m, self.rate / (1 - 0.9**self.step), out=u)
        u /= t
        self.all -= u


def train(x: np.ndarray, y: np.ndarray, size: int = 32, dropout: float = 0.5, layers: int = 2, rate: float = 0.001, epochs: int = 40, seed: int = 101, batch: int = 128, snapshots: dict | None = None) -> list[list]:
    """[[weights, bias], ...] fitted with Adam on binary cross-entropy; deterministic. snapshots:
    {epochs: None} is filled with the nets after so many. Counts (Rows, or a matrix of them) are not multiplied out:
    the first layer adds up the weights of a row's ones, and its gradients go to those weights alone."""
    rng = np.random.default_rng(seed)
    x = x if isinstance(x, Rows) else np.asarray(x, np.float64)
    y = np.asarray(y, np.float64)[:, None]
    width = x.shape[1]
    net = initial(width, size, layers, rng)
    ones = _ones(x) if layers else None
    if ones is not None:
        net[0][0] = np.concatenate([net[0][0], np.zeros((1, size))])  # of the column that isn't there
    adam = Adam(net, rate)
    for epoch in range(1, epochs + 1):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            mask = (rng.random((len(rows), size)) >= dropout) / (1 - dropout) if dropout > 0 and layers else None
            if ones is None:
                adam.update([[g / len(rows) for g in parts] for parts in gradients(net, x[rows], y[rows], mask)])
            else:
                adam.flat(_gradients_of_ones(net, ones[rows].astype(np.intp), y[rows], mask) / len(rows))
        if snapshots is not None and epoch in snapshots:
            snapshots[epoch] = _plain(net, width)
    return _plain(net, width)


def _plain(net: list, width: int) -> list[list]:
    return [[w[:width].copy() if i == 0 else w.copy(), b.copy()] for i, (w, b) in enumerate(net)]


def _ones(x: np.ndarray | Rows) -> np.ndarray | None:
    """For each row the columns of its ones, ascending, a column as often as it counts, filled up with the width; None
    if x holds anything but counts."""
    width = x.shape[1]
    if isinstance(x, Rows):
        found = np.sort(x.found, axis=1) if x.known.all() else None
    elif np.isfinite(x).all() and (x >= 0).all() and (x == np.floor(x)).all() and x.sum(axis=1).max(initial=0) <= 4 * PEPTIDE:
        many = x.astype(np.int64)
        row, column = np.nonzero(many)
        of, column = np.repeat(row, many[row, column]), np.repeat(column, many[row, column])
        each = many.sum(axis=1)
        found = np.full((len(x), max(1, int(each.max(initial=0)))), width)
        found[of, np.arange(len(of)) - (np.cumsum(each) - each)[of]] = column
    else:
        found = None
    return None if found is None else found[:, : max(1, int((found < width).sum(axis=1).max(initial=0)))]


def _gradients_of_ones(net: list, ones: np.ndarray, y: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """gradients() of rows of _ones(), one after the other."""
    (first, bias), size = net[0], net[0][0].shape[1]
    a = np.matmul(np.ones((1, ones.shape[1])), first.take(ones, axis=0))[:, 0]
    a += bias
    np.maximum(a, 0, out=a)
    acts = [a if mask is None else a * mask]
    for w, b in net[1:-1]:
        a = acts[-1] @ w
        a += b
        acts.append(np.maximum(a, 0, out=a))
    grad = 1 / (1 + np.exp(-np.clip(acts[-1] @ net[-1][0] + net[-1][1], -60, 60))) - y
    out = []
    for i in range(len(net) - 1, 0, -1):
        out[:0] = [(acts[i - 1].T @ grad).ravel(), grad.sum(axis=0)]
        grad = grad @ net[i][0].T
        grad *= acts[i - 1] > 0
        if i == 1 and mask is not None:
            grad *= mask
    # unit by unit, so that inner loops are long
    at = (np.arange(size) * len(first))[:, None] + ones.ravel()
    each = np.bincount(at.ravel(), np.repeat(np.ascontiguousarray(grad.T), ones.shape[1], axis=1).ravel(), first.size).reshape(size, -1)
    each[:, -1] = 0
    return np.concatenate([each.T.ravel(), grad.sum(axis=0), *out])


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of hashes (splitmix)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def train_part(x: np.ndarray, y: np.ndarray, keys: np.ndarray, gather, size: int, dropout: float, layers: int, epochs: int, rate: float = 0.001, seed: int = 101, batch: int = 128) -> list[list]:
    """The net that all parts of a table train together. A row's batch of an epoch and its dropout are
    functions of its key, and each batch's gradients are summed over the parts by gather (array ->
    the sum over all parts), so the net doesn't depend on how rows are dealt, up to rounding."""
    net = initial(x.shape[1], size, layers, np.random.default_rng(seed))
    adam, y, keys = Adam(net, rate), np.asarray(y, np.float64)[:, None], keys.astype(np.uint64)
    steps = -(-int(gather(np.array([float(len(x))]))[0]) // batch)
    units = np.arange(size, dtype=np.uint64)
    for epoch in range(epochs):
        at = (_mixed(keys, seed + 2 * epoch) % np.uint64(max(1, steps))).astype(np.int64)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(steps + 1))
        for step in range(steps):
            rows = order[ends[step] : ends[step + 1]]
            mask = None
            if dropout > 0 and layers:
                drawn = _mixed(_mixed(keys[rows], seed + 2 * epoch + 1)[:, None] + units, 7)
                mask = ((drawn >> np.uint64(11)) / 2.0**53 >= dropout) / (1 - dropout)
            grads = gradients(net, x[rows], y[rows], mask)
            flat = gather(np.concatenate([[float(len(rows))], *(g.ravel() for parts in grads for g in parts)]))
            if not flat[0]:
                continue
            done, mean = 1, flat / flat[0]
            for parts in grads:
                for j, g in enumerate(parts):
                    parts[j] = mean[done : done + g.size].reshape(g.shape)
                    done += g.size
            adam.update(grads)
    return net


def forward(net: list, x: np.ndarray) -> np.ndarray:
    for w, b in net[:-1]:
        x = np.maximum(x @ np.asarray(w) + np.asarray(b), 0)
    w, b = net[-1]
    return (1 / (1 + np.exp(-np.clip(x @ np.asarray(w) + np.asarray(b), -60, 60))))[:, 0]


class Model:
    """A trained network and the features it takes."""

    def __init__(self, net: list, split: int, dinuc: bool, end: str, compat: bool = True):
        self.net = [[np.asarray(w, np.float64), np.asarray(b, np.float64)] for w, b in net]
        self.split, self.dinuc, self.end, self.compat = split, dinuc, end, compat
        if len(self.net[0][0]) != feature_width(split, dinuc):
            raise ValueError("weights don't fit the features")

    def save(self, spark: SparkSession, path: str) -> None:
        body = {"net": [[w.tolist(), b.tolist()] for w, b in self.net], "split": self.split, "dinuc": self.dinuc, "end": self.end, "compat": self.compat}
        spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls(**json.loads(spark.read.text(path).first()[0]))

    def features(self, peptide: Column) -> Column:
        return terminal_features(peptide, self.split, self.dinuc, self.end, self.compat)

    def predict(self, spark: SparkSession, peptide: Column) -> Column:
        """P(label 1), by batches; null where the features are. The features are made in the task,
        equal to features(), so that 23 letters cross to it and not hundreds of numbers."""
        given = spark.sparkContext.broadcast(self.net)
        split, dinuc, end, compat = self.split, self.dinuc, self.end, self.compat

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            code, each = pd.factorize(s)  # each distinct peptide of a batch once; nulls are -1
            found, known = indices(pd.Series(each, dtype=object), split, dinuc, end, compat)
            score = np.append(np.where(known, forward_indices(given.value, found), np.nan), np.nan)
            return pd.Series(score[code], index=s.index, dtype="float64")

        return F.nanvl(run(peptide), F.lit(None).cast("double"))

    def scores(self, peptides: np.ndarray) -> np.ndarray:
        """predict() in a task, of an array of bytes; NaN where the features aren't known."""
        found, known = indices(peptides, self.split, self.dinuc, self.end, self.compat)
        return np.where(known, forward_indices(self.net, found), np.nan)


def hash_split(df: DataFrame, key: str, share: float, out: str, salt: str = "101") -> DataFrame:
    """out = 1 for about `share` of the keys, by md5; the same on every run and partitioning."""
    h = F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(salt + "|"), F.col(key)), "UTF-8")), 1, 8), 16, 10).cast("double") / 2.0**32
    return df.withColumn(out, (h < share).cast("int"))


@contextmanager
def _summing(ctx: BarrierTaskContext, tasks: int):
    """array -> its sum over the tasks of a barrier stage. The first task adds up, in the tasks' order,
    and answers; the stage's own gathering takes a second a call, so it only tells where to connect."""
    if tasks == 1:
        yield lambda a: a
        return
    me = ctx.partitionId()
    with ExitStack() as open_:
        if me == 0:
            key = secrets.token_bytes(32)
            listener = open_.enter_context(Listener(("0.0.0.0", 0), backlog=tasks, authkey=key))
            ctx.allGather(json.dumps({"port": listener.address[1], "key": key.hex()}))
            found = [open_.enter_context(listener.accept()) for _ in range(1, tasks)]
            others = [c for _, c in sorted(((c.recv(), c) for c in found), key=lambda x: x[0])]

            def gather(a: np.ndarray) -> np.ndarray:
                total = a.copy()
                for c in others:
                    total += np.frombuffer(c.recv_bytes())
                for c in others:
                    c.send_bytes(total.tobytes())
                return total

        else:
            told = json.loads(ctx.allGather("")[0])
            host = ctx.getTaskInfos()[0].address.rpartition(":")[0] or ctx.getTaskInfos()[0].address
            link = open_.enter_context(Client((host, told["port"]), authkey=bytes.fromhex(told["key"])))
            link.send(me)

            def gather(a: np.ndarray) -> np.ndarray:
                link.send_bytes(a.tobytes())
                return np.frombuffer(link.recv_bytes())

        yield gather
        ctx.barrier()  # no end of a link is closed before all have their last sum


#: Rows of a training table that one task holds, if there are slots for as many tasks.
ROWS = 50_000


def fit(df: DataFrame, split: int, dinuc: bool, end: str, size: int, dropout: float, layers: int, epochs: int, peptide: str = "peptide", label: str = "y", tasks: int | None = None) -> Model:
    """One network on all rows of a training table, data-parallel: the tasks of a barrier stage hold
    a part each, with its features made once, and add up their gradients batch by batch. Rows that
    can't be encoded are left out. tasks: by the number of rows, at most as many as can run at once."""
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(peptide).alias("p"), F.col(label).cast("double").alias("y")).where("p is not null and y is not null")
    rows = rows.withColumn("key", F.xxhash64("p", "y"))
    # equal rows are told apart, else they would always share a batch and their dropout
    rows = cut(rows.withColumn("key", F.xxhash64("key", F.row_number().over(Window.partitionBy("key").orderBy("p")))))
    tasks = tasks or max(1, min(sc.defaultParallelism, -(-rows.count() // ROWS)))

    def run(batches):
        ctx = BarrierTaskContext.get()
        t = pd.concat([pd.DataFrame({"p": [], "y": [], "key": np.zeros(0, np.int64)}), *(b.to_pandas() for b in batches if b.num_rows)])
        x = matrix(t["p"], split, dinuc, end)
        good = ~np.isnan(x).any(axis=1)

        with _summing(ctx, tasks) as gather:
            net = train_part(x[good], t["y"].to_numpy(np.float64)[good], t["key"].to_numpy(np.int64)[good], gather, size, dropout, layers, epochs)
        if ctx.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"net": [json.dumps([[w.tolist(), b.tolist()] for w, b in net])]})

    got = rows.repartition(tasks, "key").mapInArrow(run, "net string", barrier=True).collect()
    return Model(json.loads(got[0][0]), split, dinuc, end)


def grid_search(df: DataFrame, end: str, splits=SPLITS, dropouts=DROPOUTS, sizes=SIZES, layers=LAYERS, epochs=EPOCHS, dinucs=DINUC, peptide: str = "peptide", label: str = "y", valid: str = "valid") -> DataFrame:
    """AUC on the validation rows of every combination, best first. Combinations are rows; those that
    differ in epochs alone are one run, trained in a task of its own from the peptides, which are joined
    to the runs' numbers. One task holds the peptides of a run, and their features as numbers of two
    bytes; the matrix is made batch by batch."""
    spark = df.sparkSession
    rows = [(i, *c) for i, c in enumerate((s, d, z, n, e, u) for s in splits for d in dropouts for z in sizes for n in layers for e in epochs for u in dinucs)]
    grid = spark.createDataFrame(rows, "config int, split int, dropout double, size int, layers int, epochs int, dinuc boolean")
    peptides = df.select(F.col(peptide).alias("p"), F.col(label).cast("int").alias("y"), F.col(valid).cast("int").alias("valid"))
    # a run of the most epochs passes all shorter ones: these are one row with several stops
    stops = F.sort_array(F.collect_list(F.struct("epochs", "config"))).alias("stops")
    runs = grid.groupBy("split", "dropout", "size", "layers", "dinuc").agg(stops).withColumn("run", F.xxhash64("split", "dropout", "size", "layers", "dinuc"))

    # one row per run; the longest first, and a task for each: their numbers fall into partitions of their own
    found = sorted(runs.collect(), key=lambda r: (-r["stops"][-1]["epochs"] * r["size"] * feature_width(r["split"], r["dinuc"]), r["run"]))
    settings = {number: r.asDict(recursive=True) for number, r in zip(_numbers(spark, len(found)), found)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        c = settings[pdf["run"].iloc[0]]
        pdf = pdf.drop(columns="run").sort_values(["p", "y"])
        x = Rows.of(pdf["p"], c["split"], c["dinuc"], end)
        y, t = pdf["y"].to_numpy(), pdf["valid"].to_numpy() == 0
        configs = {s["config"]: s["epochs"] for s in c["stops"]}
        nets: dict = dict.fromkeys(configs.values())
        train(x.where(t), y[t], c["size"], c["dropout"], c["layers"], epochs=max(nets), snapshots=nets)
        held = x.where(~t)
        score = lambda net: np.concatenate([forward(net, held[a : a + SLICE]) for a in range(0, max(1, len(held)), SLICE)])
        return pd.concat([pd.DataFrame({"config": k, "y": y[~t], "score": score(nets[e])}) for k, e in configs.items()])

    each = spark.createDataFrame([(k,) for k in settings], "run long")
    trained = each.join(peptides, how="cross").repartition(len(settings), "run").groupBy("run").applyInPandas(one, "config int, y int, score double")
    return grid.join(roc_auc(trained, "y", "score", ["config"]), "config").orderBy(F.desc("auc"), "config")


def _numbers(spark: SparkSession, n: int) -> list[int]:
    """n numbers, the k-th of which a repartition by them into n deals to partition k."""
    held: dict[int, int] = {}
    first = 0
    while len(held) < n:
        rows = spark.range(first, first + 16 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("k")).collect()
        for r in rows:
            held.setdefault(r["k"], r["id"])
        first += 16 * n
    return [held[k] for k in range(n)]


_LETTERS = np.full(256, -1, np.int16)
_LETTERS[[ord(a) for a in RESIDUES]] = np.arange(len(RESIDUES))


def indices(peptides: pd.Series | np.ndarray, split: int, dinuc: bool, end: str, compat: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The features of functions.features in a task: for each peptide (letters, or bytes in an array) the columns that it has ones in
    (a column as often as it counts; filled up with the width, a column that isn't there), and whether
    its features are known."""
    n, width = len(RESIDUES), feature_width(split, dinuc)
    base = n if split < PEPTIDE else 0
    rows = peptides if isinstance(peptides, np.ndarray) else np.array([p.encode("ascii", "replace") for p in peptides], "S")
    longest = max(1, rows.dtype.itemsize)
    text = np.frombuffer(rows.astype(f"S{longest}").tobytes(), np.uint8).reshape(len(rows), longest)
    size = np.char.str_len(rows).astype(np.int64)[:, None] if len(rows) else np.zeros((0, 1), np.int64)
    at, letter = np.arange(longest)[None, :], _LETTERS[text].astype(np.int32)
    if split == PEPTIDE:
        near, back = at < size, size - 1 - at
    elif end == "cterm":
        near, back = at >= size - split, size - 1 - at
    else:
        near, back = at < split, np.minimum(split, size) - 1 - at
    there = (at < size) & (letter >= 0)
    counted = (back > 0) | (not compat) | (split == 1)
    placed = base + np.minimum(back, split - 1) * n + letter
    out = np.where(there & ~near, letter, np.where(there & near & counted, placed, width))
    known = np.ones(len(rows), bool)
    if dinuc and split:
        most = size[:, 0] if split == PEPTIDE else np.minimum(split, size[:, 0])
        first = np.maximum(size[:, 0] - np.minimum(most, 2), 0) if end == "cterm" else np.zeros(len(rows), np.int64)
        pair = first[:, None] + np.arange(2)
        inside = np.arange(2) < np.minimum(most, 2)[:, None]
        pair = np.minimum(pair, longest - 1)
        two, of = np.take_along_axis(letter, pair, 1), np.take_along_axis(text, pair, 1)
        known = ~(inside & (two < 0) & (of != ord("U"))).any(axis=1)
        both = inside.all(axis=1) & (two >= 0).all(axis=1)
        out = np.concatenate([out, np.where(both, base + split * n + two[:, 0] * n + two[:, 1], width)[:, None]], axis=1)
    return out.astype(np.int16 if width < 2**15 else np.int32), known


def dense(found: np.ndarray, width: int) -> np.ndarray:
    """indices() as a matrix."""
    flat = (np.arange(len(found))[:, None] * (width + 1) + found).ravel()
    return np.bincount(flat, minlength=len(found) * (width + 1)).reshape(len(found), width + 1)[:, :width].astype(np.float64)


def matrix(peptides: pd.Series, split: int, dinuc: bool, end: str, compat: bool = True) -> np.ndarray:
    """The features of functions.features in a task; a row of NaN where they are null."""
    found, known = indices(peptides, split, dinuc, end, compat)
    out = dense(found, feature_width(split, dinuc))
    out[~known] = np.nan
    return out


#: Peptides whose features are made at a time.
SLICE = 10_000


class Rows:
    """The features of peptides, kept as indices() (two bytes for each residue): rows of the matrix are made where
    they are asked for."""

    def __init__(self, found: np.ndarray, known: np.ndarray, width: int):
        self.found, self.known, self.shape = found, known, (len(found), width)

    @classmethod
    def of(cls, peptides: pd.Series, split: int, dinuc: bool, end: str) -> Rows:
        width = feature_width(split, dinuc)
        parts = [indices(peptides.iloc[a : a + SLICE], split, dinuc, end) for a in range(0, max(1, len(peptides)), SLICE)]
        columns = max(f.shape[1] for f, _ in parts)
        found = np.concatenate([np.pad(f, ((0, 0), (0, columns - f.shape[1])), constant_values=width) for f, _ in parts])
        return cls(found, np.concatenate([k for _, k in parts]), width)

    def __len__(self) -> int:
        return len(self.found)

    def where(self, rows: np.ndarray) -> Rows:
        return Rows(self.found[rows], self.known[rows], self.shape[1])

    def __getitem__(self, rows) -> np.ndarray:
        out = dense(self.found[rows], self.shape[1])
        out[~self.known[rows]] = np.nan
        return out


def forward_indices(net: list, found: np.ndarray) -> np.ndarray:
    """forward() of indices(), summed in one order, so that a peptide's score doesn't depend on what
    else is in its batch."""
    first = np.concatenate([np.asarray(net[0][0]), np.zeros((1, len(net[0][1])))])
    x = np.zeros((len(found), first.shape[1]))
    for k in range(found.shape[1]):
        x += first[found[:, k]]
    x += np.asarray(net[0][1])
    for w, b in net[1:]:
        x, old = np.zeros((len(x), len(b))), np.maximum(x, 0)
        for k, row in enumerate(np.asarray(w)):
            x += old[:, k : k + 1] * row
        x += np.asarray(b)
    return (1 / (1 + np.exp(-np.clip(x, -60, 60))))[:, 0]


def train_pair(df: DataFrame, end: str, threshold: float, key: str = "Gene_ID", peptide: str = "Peptide amino acid sequence", **grid) -> dict:
    """Grid search, test AUC and final networks of a terminus. Returns grid (DataFrame), test_auc,
    test (key, prediction, y of the held-out peptides), specific and bag (Model) and scored (DataFrame
    with 'regulatory potential')."""
    from telospark.operators.filters import low_bin

    spark = df.sparkSession
    df = df.withColumn("_at", F.monotonically_increasing_id())
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).where("_n = 1").drop("_n", "_at")
    df = df.withColumn("y", low_bin(F.col("Modal Bin"), threshold)).withColumn("peptide", F.col(peptide))
    df = hash_split(hash_split(df, key, 0.3, "test"), key, 0.3, "valid", "102")
    search = grid_search(df.where("test = 0"), end, **grid)
    best = search.first()
    settings = {k: best[k] for k in ("split", "dinuc", "size", "dropout", "layers", "epochs")}
    held = df.where("test = 1").withColumn("prediction", fit(df.where("test = 0"), end=end, **settings).predict(spark, F.col("peptide")))
    specific = fit(df, end=end, **settings)
    bag = fit(df, end=end, **(settings | {"split": 0, "dinuc": False}))
    scored = saturation(df.drop("y", "test", "valid"), specific, bag, peptide).withColumnRenamed("degron potential", "regulatory potential")
    return {"grid": search, "test_auc": roc_auc(held, "y", "prediction").first()[0], "test": held.select(key, "prediction", "y"), "specific": specific, "bag": bag, "scored": scored}


def saturation(df: DataFrame, specific: Model, bag: Model, peptide: str = "Peptide amino acid sequence") -> DataFrame:
    """All input columns and the two scores and their difference; each distinct peptide once."""
    spark = df.sparkSession
    p = df.select(F.col(peptide).alias("_p")).distinct()
    p = p.withColumn("sequence position specific", specific.predict(spark, F.col("_p"))).withColumn("bag of words", bag.predict(spark, F.col("_p")))
    p = p.withColumn("degron potential", F.col("sequence position specific") - F.col("bag of words"))
    return df.join(p, df[peptide] == p["_p"], "left").drop("_p")
