"""Interval joins: an equality on the key, the range as a residual predicate of the hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINT = ("Substitution", "Deletion", "Insertion")
UPSTREAM = ("PrematureStop", "FrameShift")


def in_any(points: DataFrame, intervals: DataFrame, key: str, position: Column) -> DataFrame:
    """Rows of points with start <= position <= end of any interval (key, start, end) of their
    key; overlapping intervals count once."""
    i = intervals.select(F.col("key").alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    p = points.withColumn("_pos", position)
    return p.join(i, (p[key] == i["_k"]) & (p["_pos"] >= i["_s"]) & (p["_pos"] <= i["_e"]), "left_semi").drop("_pos")


def before_end(points: DataFrame, intervals: DataFrame, key: str, position: Column) -> DataFrame:
    """Rows of points before the end (exclusive) of some interval of their key: the largest end
    decides, so one aggregate replaces the range join."""
    i = intervals.groupBy(F.col("key").alias("_k")).agg(F.max("end").alias("_e"))
    p = points.withColumn("_pos", position)
    return p.join(i, (p[key] == i["_k"]) & (p["_pos"] < i["_e"]), "left_semi").drop("_pos")


def merged(intervals: DataFrame) -> DataFrame:
    """One row per key: its intervals as an array, and the largest end."""
    return intervals.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.max("end").alias("last_end"))


def disjoint(intervals: DataFrame) -> DataFrame:
    """One row per key: its intervals united into disjoint ones, ascending, and the largest end. An
    interval that begins behind all earlier ends opens a new one."""
    w = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.where(F.col("start") <= F.col("end")).withColumn("_new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("key", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = islands.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # an interval that is empty still has an end, which stops and frameshifts are held against
    ends = intervals.groupBy("key").agg(F.max("end").alias("last_end"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = spans.withColumn("spans", F.col("spans").cast("array<struct<start:bigint,end:bigint>>"))
    return ends.join(spans, "key", "left").select("key", F.coalesce("spans", none).alias("spans"), "last_end")


def covered(position: Column, spans: Column) -> Column:
    """Whether an ascending array of disjoint spans covers a position, by bisection: each step halves
    the spans that may be the last to start at or before it."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        left = F.get(spans, mid)["start"] <= position
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(~done & left, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(~done & ~left, mid).otherwise(s["hi"]).alias("hi"))

    begin = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    last = lambda s: F.get(spans, s["lo"] - 1)["end"] >= position
    return F.when(F.size(spans) > 0, F.coalesce(F.aggregate(steps, begin, step, last), F.lit(False))).otherwise(F.lit(False))


def overlap(effect: Column, offset: Column, spans: Column, last_end: Column) -> Column:
    """1 if a variant (0-based residue offset) touches an interval, else 0: substitutions and
    in-frame indels by position, stops and frameshifts if before some interval's end. spans: of
    disjoint()."""
    pos = offset + 1
    hit = F.when(effect.isin(*POINT), covered(pos, spans)).otherwise(effect.isin(*UPSTREAM) & (pos < last_end))
    return F.coalesce(hit, F.lit(False)).cast("int")


def with_key(df: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Rows whose key has intervals, with spans and last_end."""
    return df.join(disjoint(intervals).withColumnRenamed("key", key), key)
