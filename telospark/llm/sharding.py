"""Sharding by histogram sort.

Every row has a key (64-bit text hash, doc_id, place among rows equal in both). The driver proposes
key boundaries; one pass counts the exact bytes and rows below each over all partitions; the probes
around each wanted quantile are refined until a boundary meets the tolerance. Then the rows are
exchanged once, straight to their part of a shard, and sorted there.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telospark.llm.common import small_enough, table

#: Bytes of a part, the unit that one task sorts.
PART = 256 << 20
#: Equal rows (text and doc_id) beyond which they get places, so that a boundary can stand between them.
EQUAL = 64
_LOW = -(1 << 63)


class Radix(NamedTuple):
    """Keys as numbers: ((hash * ids) + id - low) * places + place."""

    low: int
    ids: int
    places: int

    @property
    def text(self) -> int:
        """Distance of two neighbouring texts."""
        return self.ids * self.places

    def split(self, k: int) -> tuple[int, int, int]:
        """A probe as (hash, id, place); it stands below all rows whose key is >= it."""
        return k // self.text + _LOW, k // self.places % self.ids + self.low, k % self.places


def _bucket(rows: list[np.ndarray], probes: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted probes are <= each row's key; both as columns of a key."""
    lo, hi = np.searchsorted(probes[0], rows[0], "left"), np.searchsorted(probes[0], rows[0], "right")
    if len(rows) == 1:
        return hi
    out = hi.copy()
    for a in np.unique(lo[lo < hi]):
        mine = (lo == a) & (hi > a)
        b = hi[mine][0]
        out[mine] = a + _bucket([x[mine] for x in rows[1:]], [x[a:b] for x in probes[1:]])
    return out


def _columns(probes: list[int], radix: Radix) -> list[np.ndarray]:
    return [np.array(x, np.int64) for x in zip(*map(radix.split, probes))] if probes else [np.zeros(0, np.int64)] * 3


def _placed(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, int]:
    """df (with __telo_h and __telo_i) with __telo_r, the place of a row among rows equal in both, and
    the largest count of equal rows; where they are EQUAL at most, all have place 0. Equal rows
    are interchangeable: those of a large group are written down, numbered by the task that writes
    them, and moved up by what earlier tasks have written."""
    names = ["__telo_h", "__telo_i"]
    large = table(keys.groupBy(*names).agg(F.count("*").alias("__telo_n")).where(F.col("__telo_n") > EQUAL), "equal-keys")
    most = large.agg(F.max("__telo_n")).first()[0]
    if most is None:
        return df.withColumn("__telo_r", F.lit(0).cast("long")), 1
    few = small_enough(large.select(*names))
    schema = df.schema

    def number(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            at = []
            for key in zip(b.column("__telo_h").to_pylist(), b.column("__telo_i").to_pylist()):
                at.append(seen.get(key, 0))
                seen[key] = at[-1] + 1
            yield b.append_column("__telo_at", pa.array(at, pa.int64())).append_column("__telo_w", pa.array([part] * len(at), pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    hot = table(df.join(few, names, "left_semi").select(*df.columns).mapInArrow(number, kinds + ", __telo_at long, __telo_w long"), "equal-rows")
    counts = hot.groupBy(*names, "__telo_w").agg(F.count("*").alias("__telo_n"))
    before = Window.partitionBy(*names).orderBy("__telo_w").rowsBetween(Window.unboundedPreceding, -1)
    base = table(counts.select(*names, "__telo_w", F.coalesce(F.sum("__telo_n").over(before), F.lit(0)).alias("__telo_b")), "equal-base")
    hot = hot.join(small_enough(base), [*names, "__telo_w"]).withColumn("__telo_r", F.col("__telo_at") + F.col("__telo_b"))
    rest = df.join(few, names, "left_anti").withColumn("__telo_r", F.lit(0).cast("long"))
    return rest.select(*df.columns, "__telo_r").union(hot.select(*df.columns, "__telo_r")), int(most)


def _count(keys: DataFrame, probes: list[int], radix: Radix) -> tuple[list[int], list[int]]:
    """Exact bytes and rows whose key is below each probe (probes sorted)."""
    given = _columns(probes, radix)

    def part(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            *key, s = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            at = _bucket(key, given)
            size += np.bincount(at, weights=s, minlength=len(size)).astype(np.int64)
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(size[full]), pa.array(rows[full])], ["at", "size", "rows"])

    got = keys.select("__telo_h", "__telo_i", "__telo_r", "__telo_size").mapInArrow(part, "at int, size long, rows long").groupBy("at").agg(F.sum("size"), F.sum("rows")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for at, s, r in got:
        size[at], rows[at] = s, r
    return np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def _splitters(keys: DataFrame, radix: Radix, total: int, rows: int, shards: int, parts: int, tolerance: float, whole: float, budget: int = 4096) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) of the boundaries between shards * parts parts, refined until
    each misses its quantile by at most `tolerance` of a shard (a quarter of a part for those inside
    a shard), or at most one row lies between the nearest boundaries. Boundaries between texts come first; a
    text's copies are cut by doc_id only where no boundary beside them is within `whole` of a shard."""
    n = shards * parts
    want = [total * k // n for k in range(1, n)]
    allow = [tolerance * total / shards if k % parts == 0 else 0.25 * total / n for k in range(1, n)]
    end = (1 << 64) * radix.text
    seen: dict[int, tuple[int, int]] = {0: (0, 0), end: (total, rows)}
    best: list[int | None] = [None] * (n - 1)
    while True:
        known = sorted(seen)
        below = np.array([seen[k][0] for k in known])
        ask: set[int] = set()
        probes = max(24, min(512, budget // max(1, best.count(None))))  # few open boundaries: finer steps
        for j, w in enumerate(want):
            if best[j] is not None:
                continue
            at = int(np.searchsorted(below, w, "right"))
            lo, hi = known[at - 1], known[min(at, len(known) - 1)]
            near = min((lo, hi), key=lambda k: abs(seen[k][0] - w))
            miss = abs(seen[near][0] - w)
            a, b = lo // radix.text, -(-hi // radix.text)
            inside = near not in (0, end)
            one_text = b - a <= 1 and lo % radix.text == 0 and near % radix.text == 0
            done = hi - lo <= 1 or seen[hi][1] - seen[lo][1] <= 1 or (inside and miss <= allow[j])
            if done or (inside and one_text and miss <= max(allow[j], whole * total / shards)):
                best[j] = near
                continue
            if b - a > 1:  # boundaries between texts
                new = {(a + (b - a) * k // probes) * radix.text for k in range(1, probes)}
            else:  # one text's copies: by doc_id and place
                new = {lo + (hi - lo) * k // probes for k in range(1, probes)}
            ask |= {k for k in new if lo < k < hi} or {lo + (hi - lo) // 2}
        ask -= seen.keys()
        if not ask:
            if all(b is not None for b in best):
                break
            continue
        ask_list = sorted(ask)
        seen.update(zip(ask_list, zip(*_count(keys, ask_list, radix))))
    return [(k, *seen[k]) for k in sorted({b for b in best if b not in (0, end)})]


def shard_by_bytes(df: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", parts: int | None = None, tolerance: float = 0.001, whole: float = 0.03) -> DataFrame:
    """df with size, law ('bytes'), shard and slot: near-equal bytes in each of `shards` shards.

    size: UTF-8 bytes of the text (null: none) plus 8. The order is (hash of the text, doc_id), so
    copies of a text stand together; a boundary meets its quantile within `tolerance` of a
    shard or stands at the nearest place between two texts, if that is within `whole` of a shard;
    else it falls among a text's copies, by doc_id. Each shard is exchanged
    as `parts` parts (8, or more for parts of about PART bytes), so that no task sorts a whole shard. slot counts a shard's rows from 0.

    Null texts count as one text; null doc_ids sort first; repeated rows, equal in text and doc_id, are
    told apart by a place where there are many, so a boundary may fall among them too; an empty
    table gives an empty result. Extra columns pass through; new ones replace columns of their names.
    """
    df = df.withColumn("size", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8)
    df = df.withColumns({"__telo_h": F.xxhash64(F.col(text)), "__telo_i": F.coalesce(F.col(key).cast("long"), F.lit(_LOW)), "__telo_size": F.col("size")})
    df, places = _placed(df, df.select("__telo_h", "__telo_i"))
    keys = table(df.select("__telo_h", "__telo_i", "__telo_r", "__telo_size"), "shard-keys")
    total, rows, low, high = keys.agg(F.coalesce(F.sum("__telo_size"), F.lit(0)), F.count("*"), F.min("__telo_i"), F.max("__telo_i")).first()
    radix = Radix(low, high - low + 1, places) if rows else Radix(0, 1, 1)
    parts = parts or max(8, -(-total // (shards * PART)))
    cuts = _splitters(keys, radix, total, rows, shards, parts, tolerance, whole) if rows else []
    # Boundaries of shards are the cuts nearest to the shards' quantiles.
    edge = {min(range(len(cuts)), key=lambda j: abs(cuts[j][1] - total * k // shards)) for k in range(1, shards)} if cuts else set()
    shard_of, before, first = [0], [0], 0
    for j, (_, _, r) in enumerate(cuts):
        shard_of.append(shard_of[-1] + (j in edge))
        first = r if j in edge else first
        before.append(r - first)
    probes = _columns([k for k, _, _ in cuts], radix)
    shard_at, before_at = np.array(shard_of, np.int32), np.array(before, np.int64)

    @F.pandas_udf("part int, shard int, before long")
    def part_of(h, i, r):
        import pandas as pd

        at = _bucket([h.to_numpy(), i.to_numpy(), r.to_numpy()], probes)
        return pd.DataFrame({"part": at.astype(np.int32), "shard": shard_at[at], "before": before_at[at]})

    moved = df.withColumn("__telo_p", part_of("__telo_h", "__telo_i", "__telo_r")).withColumns({"__telo_part": F.col("__telo_p.part"), "shard": F.col("__telo_p.shard"), "__telo_before": F.col("__telo_p.before")})
    moved = moved.drop("__telo_p").repartition(max(1, len(cuts) + 1), "__telo_part")
    slot = F.row_number().over(Window.partitionBy("__telo_part").orderBy("__telo_h", "__telo_i", "__telo_r"))
    return moved.withColumns({"law": F.lit("bytes"), "slot": F.col("__telo_before") + slot - 1}).drop("__telo_h", "__telo_i", "__telo_r", "__telo_size", "__telo_part", "__telo_before")
