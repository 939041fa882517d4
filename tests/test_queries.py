"""Every query with an SQL twin against DuckDB on the smallest tables; the others run."""

import os

import pytest

from telospark.plans import queries as core

duckdb = pytest.importorskip("duckdb")


def tidy(df):
    df = df[sorted(df.columns)]
    for c in df:
        if df[c].dtype == object:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def twin(tiny):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.sql(f"create view {f[:-8]} as select * from '{tiny}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_twin(spark, tiny, twin, name):
    a, b = tidy(core.QUERIES[name](spark, tiny).toPandas()), tidy(twin.sql(core.ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", ["dimotif", "saturation_scores", "train_grid"])
def test_runs(spark, tiny, name):
    assert core.QUERIES[name](spark, tiny).count() > 0


def test_mutations_of_every_transcript(spark, tiny):
    got = core.mutations(spark, tiny).groupBy("transcript_id").count().collect()
    assert len(got) == core.transcripts(spark, tiny).count() and {r["count"] for r in got} == {12}


def test_permutation_queries_run_all_simulations(spark, tiny, monkeypatch):
    from telospark.plans import analysis

    asked = []
    monkeypatch.setattr(analysis, "run", lambda *a, **k: asked.append(k) or spark.range(0))
    names = [n for n in core.QUERIES if n.startswith("permutation_")]
    for n in names:
        core.QUERIES[n](spark, tiny)
    assert len(asked) == len(names) == 6 and not any("simulations" in k for k in asked)


def test_the_whole_grid_is_trained(spark, tiny, monkeypatch):
    from telospark.operators import model

    asked = []
    monkeypatch.setattr(model, "grid_search", lambda *a, **k: asked.append((len(a), k)) or spark.range(0))
    core.QUERIES["train_grid"](spark, tiny)
    assert asked == [(2, {})] and len(model.SPLITS) * len(model.DROPOUTS) * len(model.SIZES) * len(model.LAYERS) * len(model.EPOCHS) * len(model.DINUC) == 144


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "motif"
