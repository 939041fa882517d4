"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

A token budget runs down a domain-language-source tree by weights. A node never gets more than its
leaves can give (their tokens times the epochs allowed); what a child can't take goes to its
siblings by their weights, and only what a whole family can't take reaches its parent's siblings.
Each leaf then takes a token-prefix of its seeded epochs: all of the full ones, then documents in
the next epoch's order while the budget lasts. The tree is a table: a family is divided by windows
over its children, so the driver holds none of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telospark.llm.common import discard, small_enough, table

#: Rows equal in key and text are told apart by a place where there are more of them.
EQUAL = 64
Path = tuple[str, ...]


def _divide(nodes: DataFrame, family: list[str], weights: dict[Path, float]) -> DataFrame:
    """nodes (path columns, cap, and amount: the budget of their parent, `family`) with their own
    amount. Children fill up in the order of capacity over weight; the level at which the first one
    stays open is that of all later ones."""
    own = [c for c in nodes.columns if c not in ("cap", "amount")]
    given = {p: w for p, w in weights.items() if len(p) == len(own)}
    lookup = [F.lit(x) for p, w in given.items() for x in ("\x1f".join(p), float(w))]
    weight = F.try_element_at(F.create_map(*lookup), F.concat_ws("\x1f", *own)) if lookup else F.lit(None).cast("double")
    all_ = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    x = nodes.withColumn("_w", weight)
    named = F.count("_w").over(all_) > 0
    scale = F.when(named, F.sum("_w").over(all_) / F.greatest(F.sum(F.when(F.col("_w").isNotNull(), F.col("cap"))).over(all_), F.lit(1e-9))).otherwise(F.lit(1.0))
    x = x.withColumn("_w", F.coalesce("_w", F.col("cap") * scale))
    x = x.withColumn("_open", (F.col("_w") > 0) & (F.col("cap") > 0)).withColumn("_ratio", F.when(F.col("_open"), F.col("cap") / F.col("_w")))
    before = all_.orderBy(F.col("_ratio").asc_nulls_last(), *own).rowsBetween(Window.unboundedPreceding, -1)
    w = F.when(F.col("_open"), F.col("_w")).otherwise(F.lit(0.0))
    left = F.sum(w).over(all_) - F.coalesce(F.sum(w).over(before), F.lit(0.0))
    level = (F.col("amount") - F.coalesce(F.sum(F.when(F.col("_open"), F.col("cap"))).over(before), F.lit(0.0))) / left
    x = x.withColumn("_level", F.when(F.col("_open") & (left > 0), level))
    x = x.withColumn("_level", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(all_))  # null: all are full
    x = x.withColumn("_out", F.when(F.col("_open"), F.least("cap", F.coalesce(F.col("_w") * F.col("_level"), F.col("cap")))).otherwise(F.lit(0.0)))
    rest = F.greatest(F.col("amount") - F.sum("_out").over(all_), F.lit(0.0))
    closed = F.sum(F.when(~F.col("_open"), F.col("cap"))).over(all_)
    x = x.withColumn("_out", F.when(F.col("_open") | (F.col("cap") <= 0), F.col("_out")).otherwise(F.col("cap") * F.least(F.lit(1.0), rest / closed)))
    return x.select(*own, "cap", F.col("_out").alias("amount"))


def leaf_budgets(leaves: DataFrame, path: list[str], weights: dict[Path, float], fraction: float, epochs: int) -> DataFrame:
    """path and want, the tokens for each leaf (path columns, tokens). weights: by path of any
    length, relative to its siblings; a path without a weight has its share of the family's tokens,
    scaled so that a family without any weights is divided in proportion."""
    leaves = leaves.select(*path, (F.col("tokens") * F.lit(float(epochs))).alias("cap"))
    up = leaves.agg(F.least(F.sum("cap") * F.lit(fraction / epochs), F.sum("cap")).alias("amount"))
    for n in range(1, len(path) + 1):
        nodes = leaves.groupBy(*path[:n]).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(small_enough(up), path[: n - 1]) if n > 1 else nodes.crossJoin(F.broadcast(up))  # one row
        up = table(_divide(nodes, path[: n - 1], weights), "budgets").drop("cap")
    return up.withColumnRenamed("amount", "want")


def tokens_of(text: Column) -> Column:
    """White-space words, the token measure of mixing."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def told_apart(df: DataFrame, keys: DataFrame) -> DataFrame | None:
    """df (with __telo_k and __telo_t) with a __telo_k for each row of a group of more than EQUAL rows
    equal in both; None if there is no such group.

    Equal rows are interchangeable: they are written down, numbered within the task that wrote them,
    and moved up by what other tasks wrote. The keys are the same on every partitioning.
    """
    names = ["__telo_k", "__telo_t"]
    large = table(keys.groupBy(*names).count().where(F.col("count") > EQUAL).select(*names), "equal-keys")
    if large.isEmpty():
        return None
    few = small_enough(large)
    hot = df.join(few, names, "left_semi").select(*df.columns)
    hot = table(hot.withColumns({"__telo_w": F.spark_partition_id(), "__telo_m": F.monotonically_increasing_id()}), "equal-rows")
    counts = hot.groupBy(*names, "__telo_w").count()
    before = Window.partitionBy(*names).orderBy("__telo_w").rowsBetween(Window.unboundedPreceding, -1)
    base = table(counts.withColumn("__telo_b", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"), "equal-base")
    within = Window.partitionBy(*names, "__telo_w").orderBy("__telo_m")  # at most a task's rows
    hot = hot.withColumn("__telo_m", F.row_number().over(within)).join(small_enough(base), [*names, "__telo_w"])
    hot = hot.withColumn("__telo_k", F.xxhash64("__telo_k", F.col("__telo_b") + F.col("__telo_m")))
    return df.join(few, names, "left_anti").select(*df.columns).union(hot.select(*df.columns))


def mix(df: DataFrame, weights: dict[Path, float], domain: Column, fraction: float = 0.8, epochs: int = 2, seed: int = 7, text: str = "text", key: str = "doc_id", block: int = 2_000) -> DataFrame:
    """The selected rows of df, once per epoch, with domain, epoch, n_tokens and start (tokens of
    the leaf before it, over its epochs).

    The budget is `fraction` of all tokens. A document is taken if its leaf's tokens before it stay
    below the leaf's budget, so a leaf overshoots by less than one document. Null domain, lang or
    source count as 'unknown'; null and empty texts have no tokens and follow their place in the
    order; repeated rows are rows of their own, in an order fixed by their hash and text, and large
    groups of them are spread over the leaf's order. An empty table gives an empty result. Extra columns pass through; new ones replace columns of their names.
    """
    path = [F.coalesce(c.cast("string"), F.lit("unknown")) for c in (domain, F.col("lang"), F.col("source"))]
    # copies of a null key are told apart by their text
    order = [F.col(key), F.when(F.col(key).isNull(), F.xxhash64(text))]
    df = df.withColumns({"domain": path[0], "__telo_1": path[1], "__telo_2": path[2], "n_tokens": tokens_of(F.col(text)), "__telo_t": F.xxhash64(text), "__telo_k": F.xxhash64(*order)})
    leaf = ["domain", "__telo_1", "__telo_2"]
    narrow = [*leaf, "n_tokens", "__telo_k", "__telo_t"]
    rows = table(df.select(*narrow), "mix-rows")  # counted once for all that follows but the last pass
    apart = told_apart(df, rows)
    if apart is not None:
        discard(rows)
        df, rows = apart, table(apart.select(*narrow), "mix-rows")
    leaves = table(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    wanted = leaf_budgets(leaves, leaf, weights, fraction, epochs)
    plan = leaves.join(small_enough(wanted), leaf).select(*leaf, F.col("tokens").alias("__telo_all"), F.round("want").cast("long").alias("__telo_want"), (1 + F.floor(F.col("rows") / block)).alias("__telo_bins"))
    plan = table(plan.where("__telo_want > 0"), "plan")
    last = F.when(F.col("__telo_all") > 0, F.floor((F.col("__telo_want") - 1) / F.col("__telo_all"))).otherwise(F.lit(0)).cast("int")

    def binned(x: DataFrame) -> DataFrame:
        x = x.join(small_enough(plan), leaf).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
        x = x.withColumn("__telo_h", F.xxhash64(F.lit(seed), F.col("epoch"), F.col("__telo_k")))
        # The order's range is cut into bins of bounded size: a leaf's rows are never in one task.
        return x.withColumn("__telo_bin", F.least(F.floor((F.col("__telo_h") / F.lit(2.0**64) + 0.5) * F.col("__telo_bins")), F.col("__telo_bins") - 1).cast("long"))

    place = [*leaf, "epoch", "__telo_bin"]
    bins = binned(rows).groupBy(*place).agg(F.sum("n_tokens").alias("__telo_n"))
    before = Window.partitionBy(*leaf).orderBy("epoch", "__telo_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__telo_base", F.coalesce(F.sum("__telo_n").over(before), F.lit(0))).drop("__telo_n")
    bins = table(bins.join(small_enough(plan.select(*leaf, "__telo_want")), leaf).where("__telo_base < __telo_want").drop("__telo_want"), "bins")
    discard(rows)
    within = Window.partitionBy(*place).orderBy("__telo_h", F.col(key), "__telo_t").rowsBetween(Window.unboundedPreceding, -1)
    # What lies wholly beyond a leaf's budget is dropped before its rows are sorted.
    some = binned(df).join(small_enough(bins), place)
    out = some.withColumn("start", F.col("__telo_base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return out.where("start < __telo_want").drop("__telo_1", "__telo_2", "__telo_all", "__telo_want", "__telo_bins", "__telo_h", "__telo_t", "__telo_k", "__telo_bin", "__telo_base")
