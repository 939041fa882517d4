"""Training that is spread over tasks."""

import random

import numpy as np
import pandas as pd
import pytest

from telospark.functions.sequences import RESIDUES
from telospark.operators import model

SETTINGS = dict(end="cterm", size=8, dropout=0.25, layers=2, epochs=12)


def peptides(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        p = "".join(rng.choice(RESIDUES) for _ in range(23))
        rows.append((p, int(p[-1] in "ARNDC" or p[-3] in "ARN")))
    return rows + rows[:20] + [(None, 1), ("A" * 21 + "BZ", 0), ("A" * 23, None)]


def flat(net):
    return np.concatenate([np.asarray(a).ravel() for layer in net for a in layer])


def test_weights_do_not_depend_on_the_number_of_tasks(spark):
    df = spark.createDataFrame(peptides(500), "peptide string, y int").repartition(5)
    nets = [flat(model.fit(df, 6, True, tasks=k, **SETTINGS).net) for k in (1, 2, 4)]
    assert np.abs(nets[0]).max() > 0.1
    for other in nets[1:]:
        np.testing.assert_allclose(other, nets[0], rtol=1e-7, atol=1e-9)


def test_parts_sum_their_gradients():
    """Two parts in step, summed by hand, give the net of the whole; rows in any order."""
    rng = np.random.default_rng(0)
    x, y = rng.random((300, 9)), (rng.random(300) > 0.5).astype(float)
    keys = rng.integers(0, 2**62, 300)
    whole = model.train_part(x, y, keys, lambda a: a, 4, 0.5, 2, 6, batch=32)
    turned = model.train_part(x[::-1], y[::-1], keys[::-1], lambda a: a, 4, 0.5, 2, 6, batch=32)
    np.testing.assert_allclose(flat(turned), flat(whole), rtol=1e-9, atol=1e-12)
    import threading

    barrier, slots, nets = threading.Barrier(2), [None, None], [None, None]

    def part(k, rows):
        def gather(a):
            slots[k] = a
            barrier.wait()
            out = slots[0] + slots[1]
            barrier.wait()
            return out

        nets[k] = model.train_part(x[rows], y[rows], keys[rows], gather, 4, 0.5, 2, 6, batch=32)

    threads = [threading.Thread(target=part, args=(k, rows)) for k, rows in enumerate((slice(0, 37), slice(37, 300)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for net in nets:
        np.testing.assert_allclose(flat(net), flat(whole), rtol=1e-9, atol=1e-12)


def test_fit_learns_and_takes_an_empty_table(spark):
    rows = [r for r in peptides(900) if r[0] and r[1] is not None and "B" not in r[0]]
    df = spark.createDataFrame(rows, "peptide string, y int")
    m = model.fit(df, 6, False, "cterm", 16, 0.0, 2, 60, tasks=3)
    x = model.matrix(pd.Series([r[0] for r in rows]), 6, False, "cterm")
    hit = (model.forward(m.net, x) > 0.5) == np.array([r[1] for r in rows])
    assert hit.mean() > 0.75
    assert len(model.fit(df.limit(0), 0, False, **SETTINGS).net) == 3


def test_shorter_runs_are_stops_of_longer_ones(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((200, 5)), rng.random(200) > 0.5
    stops = {2: None, 5: None}
    last = model.train(x, y, 4, 0.5, epochs=5, snapshots=stops)
    for epochs, net in stops.items():
        assert np.array_equal(flat(model.train(x, y, 4, 0.5, epochs=epochs)), flat(net))
    assert np.array_equal(flat(last), flat(stops[5]))
    df = spark.createDataFrame([(p, y, i % 3 == 0) for i, (p, y) in enumerate(peptides(150)[:150])], "peptide string, y int, valid boolean")
    got = model.grid_search(df, "cterm", splits=(6,), dropouts=(0.0, 0.5), sizes=(4,), epochs=(1, 3), dinucs=(False,)).collect()
    assert len(got) == 4 and [r.auc for r in got] == sorted((r.auc for r in got), reverse=True)
    p = pd.DataFrame([(r.peptide, r.y, r.valid) for r in df.collect()], columns=["p", "y", "valid"]).sort_values(["p", "y"])
    m, t = model.matrix(p["p"], 6, False, "cterm"), ~p["valid"].to_numpy()
    for r in got:
        score = model.forward(model.train(m[t], p["y"].to_numpy()[t], 4, r.dropout, 2, epochs=r.epochs), m[~t])
        one, two = score[p["y"].to_numpy()[~t] == 1], score[p["y"].to_numpy()[~t] == 0]
        assert r.auc == pytest.approx(((one[:, None] > two).sum() + (one[:, None] == two).sum() / 2) / (len(one) * len(two)))


def test_rows_are_the_matrix_and_small():
    """What a run of the grid holds: the same rows, and no wide matrix."""
    p = pd.Series([r[0] for r in peptides(300) if r[0]])
    for split, dinuc in ((6, True), (23, True), (12, False)):
        rows, whole = model.Rows.of(p, split, dinuc, "cterm"), model.matrix(p, split, dinuc, "cterm")
        assert np.array_equal(rows[np.arange(len(p))], whole, equal_nan=True) and rows.shape == whole.shape
        assert rows.found.nbytes <= 2 * 24 * len(p)
        t = np.arange(len(p)) % 3 > 0
        assert np.array_equal(rows.where(t)[5:40], whole[t][5:40], equal_nan=True)
    x, y = model.Rows.of(p[:250], 6, True, "cterm"), np.arange(250) % 2
    assert np.array_equal(flat(model.train(x, y, 4, 0.5, epochs=2)), flat(model.train(x[np.arange(250)], y, 4, 0.5, epochs=2)))


def test_counts_are_not_multiplied_out(spark, monkeypatch):
    """Nets of counts equal those of the matrix's products up to rounding, and make no matrix."""
    p = pd.Series([r[0] for r in peptides(300) if r[0] and "B" not in r[0]])
    y = np.arange(len(p)) % 3 == 0
    for split, dinuc, layers in ((6, True, 2), (23, False, 1), (0, False, 2)):
        x = model.Rows.of(p, split, dinuc, "cterm")
        monkeypatch.setattr(model, "_ones", lambda x: None)
        want = flat(model.train(x, y, 8, 0.25, layers, epochs=3))
        monkeypatch.undo()
        monkeypatch.setattr(model, "dense", None)
        np.testing.assert_allclose(flat(model.train(x, y, 8, 0.25, layers, epochs=3)), want, rtol=1e-7, atol=1e-9)
        monkeypatch.undo()


def test_each_run_is_a_task_of_its_own(spark):
    from pyspark.sql import functions as F

    ids = model._numbers(spark, 48)
    df = spark.createDataFrame([(i,) for i in ids], "run long").repartition(48, "run").select("run", F.spark_partition_id().alias("k"))
    assert {r.run: r.k for r in df.collect()} == {i: k for k, i in enumerate(ids)}
