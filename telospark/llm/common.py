"""Helpers shared by the training-data operators: shared folder, lineage cuts, size-checked
broadcasts and connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get the functions of this package with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: A side is broadcast only if a count has shown that it has at most this many narrow rows.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs where
    it is unset, a new temporary folder. On a cluster it must be set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="telospark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder; not created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles(spark: SparkSession):
    """Within it, an execution's shuffle files go as soon as it ends: its result is on disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    with own_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


def table(df: DataFrame, kind: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: a lineage cut whose columns
    can still be pruned."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    with own_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table() that nothing still to be computed reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else df as it is. df should be a
    lineage-cut, narrow frame: it is counted (up to rows + 1)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): one row (id, component) per vertex, with
    component the smallest id reachable. Alternates large-star and small-star steps, each one
    aggregation and one join, until the edges no longer change; O(log n) rounds as a rule.

    Self loops keep isolated vertices; null ends are dropped.
    """
    e = edges.where("a is not null and b is not null").selectExpr("a as u", "b as v").distinct()
    loops = e.where("u = v").select("u")
    e = cut(e.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct())

    def mark(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()[:]

    last = mark(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("explode(array(struct(v as x, m as m), struct(u as x, m as m))) as s").selectExpr("s.x as u", "s.m as v")
        e = cut(small.where("u <> v").distinct())
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = e.selectExpr("u as id", "v as component")
    roots = e.selectExpr("v as id", "v as component").union(loops.selectExpr("u as id", "u as component"))
    return found.union(roots).groupBy("id").agg(F.min("component").alias("component"))
