"""Motif enrichment among top-ranked peptides: one pass over the peptides instead of one per motif.

The tested vocabulary (6,000 to 160,000 rows) is written for the two reads of the q-value step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telospark.functions.sequences import RESIDUES, first, kmers, last, piece
from telospark.functions.stats import bh_fdr, binomial_tail, bonferroni, knee, log2_odds, ranged
from telospark.sources.scratch import cut

WIDTH = 6


def ranked(df: DataFrame, order: list, peptide: str = "peptide") -> DataFrame:
    """peptide and rank (1-based)."""
    from telospark.operators.filters import rank_rows

    return rank_rows(df, order).select(F.col(peptide).alias("peptide"), "rank")


def vocabulary(df: DataFrame, k: int) -> DataFrame:
    """All residue strings of length k, one row each, in column motif."""
    out = F.array(F.lit(""))
    for _ in range(k):
        out = F.flatten(F.transform(out, lambda m: F.transform(F.array(*map(F.lit, RESIDUES)), lambda a: F.concat(m, a))))
    return df.sparkSession.range(1).select(F.explode(out).alias("motif"))


def pair_counts(df: DataFrame, top: int, end: str) -> DataFrame:
    """pos1 < pos2 (1 to 6, from the right of a six-wide mask), aa1, aa2, top_ct, bot_ct."""
    six = last(F.col("peptide"), WIDTH) if end == "cterm" else first(F.col("peptide"), WIDTH)
    places = [(i, j) for i in range(1, WIDTH) for j in range(i + 1, WIDTH + 1)]
    # mask position i from the right is letter 6 - i from the left
    each = F.array(*(F.struct(F.lit(i).alias("pos1"), F.lit(j).alias("pos2"), piece(six, WIDTH - i, 1).alias("aa1"), piece(six, WIDTH - j, 1).alias("aa2")) for i, j in places))
    rows = df.where(F.length(six) == WIDTH).select("rank", F.explode(each).alias("m")).select("rank", "m.*")
    return rows.groupBy("pos1", "pos2", "aa1", "aa2").agg(F.count_if(F.col("rank") <= top).alias("top_ct"), F.count("*").alias("bot_ct"))


def dimotifs(df: DataFrame, top: int, end: str) -> DataFrame:
    """All 15 * 400 positional pairs with counts, exact test, odds, Bonferroni and BH."""
    places = F.array(*(F.struct(F.lit(i).alias("pos1"), F.lit(j).alias("pos2")) for i in range(1, WIDTH) for j in range(i + 1, WIDTH + 1)))
    full = vocabulary(df, 2).select(F.left("motif", F.lit(1)).alias("aa1"), F.right("motif", F.lit(1)).alias("aa2"), F.explode(places).alias("p")).select("aa1", "aa2", "p.*")
    n = df.agg(F.count("*").alias("bot_total"))
    key = ["pos1", "pos2", "aa1", "aa2"]
    out = full.join(pair_counts(df, top, end), key, "left").join(F.broadcast(n))  # one row
    out = out.withColumns({"top_ct": F.coalesce("top_ct", F.lit(0)), "bot_ct": F.coalesce("bot_ct", F.lit(0)), "top_total": F.lit(top)})
    mask = F.array_join(F.transform(F.sequence(F.lit(WIDTH), F.lit(1)), lambda i: F.when(i == F.col("pos1"), F.col("aa1")).when(i == F.col("pos2"), F.col("aa2")).otherwise(F.lit("x"))), "")
    out = out.withColumn("motif", mask).withColumn("pvalue", binomial_tail(F.col("top_ct"), F.col("top_total"), F.col("bot_ct") / F.col("bot_total")))
    out = out.withColumn("log_or", log2_odds(F.col("top_ct"), F.col("top_total"), F.col("bot_ct"), F.col("bot_total")))
    out = out.withColumn("adjusted_pvalue", bonferroni(F.col("pvalue"), 6000, capped=False))
    return bh_fdr(cut(out)).select("motif", *key, "top_ct", "bot_ct", "top_total", "bot_total", "pvalue", "log_or", "adjusted_pvalue", "qvalue")


def substring_counts(df: DataFrame, k: int, top: int, end: str) -> DataFrame:
    """motif, top_ct, all_ct: non-overlapping occurrences in the six end residues, over all
    peptides and the top ones. Each peptide counts the distinct k-mers it has."""
    six = last(F.col("peptide"), WIDTH) if end == "cterm" else first(F.col("peptide"), WIDTH)
    rows = df.select("rank", six.alias("six")).select("rank", "six", F.explode(F.array_distinct(kmers(F.col("six"), k))).alias("motif"))
    found = (F.length("six") - F.length(F.replace(F.col("six"), F.col("motif"), F.lit("")))) / k
    rows = rows.withColumn("c", found.cast("long"))
    return rows.groupBy("motif").agg(F.coalesce(F.sum(F.when(F.col("rank") <= top, F.col("c"))), F.lit(0)).alias("top_ct"), F.sum("c").alias("all_ct"))


def residue_background(df: DataFrame, end: str) -> DataFrame:
    """aa, p: share of each residue at the six end places."""
    n = df.agg(F.count("*").alias("n"))
    c = vocabulary(df, 1).join(substring_counts(df, 1, 0, end), "motif", "left").join(F.broadcast(n))
    return c.select(F.col("motif").alias("aa"), (F.coalesce("all_ct", F.lit(0)) / (F.col("n") * WIDTH)).alias("p"))


def chain_motifs(df: DataFrame, k: int, top: int, end: str) -> DataFrame:
    """All residue strings of length 3 or 4: counts in the top set against a first-order Markov
    background of residues and dimers. trials: 4 * top for three, 3 * top for four."""
    if k not in (3, 4):
        raise ValueError("k must be 3 or 4")
    n = df.agg(F.count("*").alias("bot_total"))
    one = residue_background(df, end).withColumnRenamed("p", "p1")
    two = vocabulary(df, 2).join(substring_counts(df, 2, 0, end), "motif", "left").join(F.broadcast(n))
    two = two.select(F.col("motif").alias("d"), (F.coalesce("all_ct", F.lit(0)) / (F.col("bot_total") * (WIDTH - 1))).alias("p2"))
    out = vocabulary(df, k).join(substring_counts(df, k, top, end), "motif", "left").join(F.broadcast(n))
    p = F.lit(1.0)
    for i in range(k - 1):  # 400 dimers, 20 residues
        out = out.withColumn("d", F.substring("motif", i + 1, 2)).join(F.broadcast(two), "d").withColumnRenamed("p2", f"_d{i}").drop("d")
        p = p * F.col(f"_d{i}")
        if i:
            out = out.withColumn("aa", F.substring("motif", i + 1, 1)).join(F.broadcast(one), "aa").withColumnRenamed("p1", f"_a{i}").drop("aa")
            p = F.try_divide(p, F.col(f"_a{i}"))
    out = out.withColumn("background_p", p).withColumn("top_ct", F.coalesce("top_ct", F.lit(0))).withColumn("top_total", F.lit(top))
    trials = F.lit((7 - k) * top) if k == 4 else F.lit(4 * top)
    out = out.withColumn("pvalue", F.when(F.col("background_p").isNull(), F.lit(float("nan"))).otherwise(binomial_tail(F.col("top_ct"), trials, F.coalesce("background_p", F.lit(0.0)))))
    out = out.withColumn("log_or", log2_odds(F.col("top_ct"), F.col("top_total"), F.coalesce("background_p", F.lit(float("nan"))), F.lit(1.0)))
    out = out.withColumn("adjusted_pvalue", bonferroni(F.col("pvalue"), len(RESIDUES) ** k))
    return bh_fdr(cut(out)).select("motif", "top_ct", "background_p", "top_total", "bot_total", "pvalue", "log_or", "adjusted_pvalue", "qvalue")


def _range_wins(levels: np.ndarray, labels: np.ndarray, scores: np.ndarray, known: np.ndarray) -> pd.DataFrame:
    """For each threshold up to the highest level: rows of both classes whose level reaches it, and the
    wins of the first over the second among them (ties a half). Levels are added from the highest
    down; a new row is counted against those that are there by the places of their scores."""
    order = np.lexsort((scores, np.isnan(scores), known))  # nulls first, NaN last
    key = np.stack([known[order].astype(float), np.isnan(scores[order]).astype(float), np.nan_to_num(scores[order])])
    place = np.empty(len(order), np.int64)
    place[order] = np.concatenate(([0], np.cumsum((np.diff(key) != 0).any(axis=0))))
    width = int(place.max()) + 1
    by_level = np.argsort(-levels, kind="stable")
    ends = np.searchsorted(-levels[by_level], -np.arange(levels.max(), 0, -1), "right")
    there = {c: np.zeros(width) for c in (0, 1)}  # rows of a class by place
    rows, wins, start = [], 0.0, 0
    for level, end in zip(range(int(levels.max()), 0, -1), ends):
        new = by_level[start:end]
        start = end
        if len(new):
            came = {c: np.bincount(place[new[labels[new] == c]], minlength=width) for c in (0, 1)}
            upper = there[1].sum() - np.cumsum(there[1]) + there[1] / 2  # of the first class above a place
            wins += float(came[0] @ upper)
            there[0] += came[0]
            wins += float(came[1] @ (np.cumsum(there[0]) - there[0] / 2))
            there[1] += came[1]
        rows.append((level, there[1].sum(), there[0].sum(), wins))
    return pd.DataFrame(rows, columns=["level", "pos", "neg", "wins"])


def trimmed_auc(df: DataFrame, score: str, label: str = "y", step: int = 20, limit: int = 8000) -> DataFrame:
    """threshold, auc of `score` after dropping that many rows at both ends of the ranking (rank,
    1-based). Thresholds that leave one class have a null AUC.

    A row takes part in all thresholds up to its level, its distance from the nearer end. Rows are
    dealt once, by ranges of the score; a range gives, for each threshold, its rows and the wins
    among them, and running sums over the ranges add the wins across them."""
    n = df.agg(F.count("*").alias("_n"))
    rows = df.select("rank", F.col(score).cast("double").alias("score"), F.when(F.col(label) == 1, 1).when(F.col(label) == 0, 0).otherwise(2).alias("y")).join(F.broadcast(n))
    inside = F.least(F.col("rank") - 1, F.col("_n") - F.col("rank"))
    rows = rows.select("score", "y", F.least(F.lit((limit - 1) // step), F.floor(inside / step)).cast("int").alias("level")).where("level >= 1")
    parts = ranged(rows, "score")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _range_wins(pdf["level"].to_numpy(), pdf["y"].to_numpy(), pdf["score"].to_numpy(np.float64), ~pdf["absent"].to_numpy())
        return got.assign(part=int(pdf["_part"].iloc[0]))

    each = parts.withColumn("absent", F.col("score").isNull()).groupBy("_part").applyInPandas(run, "level int, pos double, neg double, wins double, part int")
    below = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    each = each.groupBy("level").agg(F.sum(F.col("wins") + F.col("pos") * F.col("_below")).alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    return each.select((F.col("level") * step).alias("threshold"), F.try_divide("_w", F.col("_p") * F.col("_q")).alias("auc"))


def top_threshold(df: DataFrame, specific: str = "sequence position specific", bag: str = "bag of words", label: str = "y", step: int = 20, limit: int = 8000) -> float | None:
    """Knee of AUC(specific) - AUC(bag) over trims; at most limit / step points reach the driver."""
    a = trimmed_auc(df, specific, label, step, limit).withColumnRenamed("auc", "_a")
    b = trimmed_auc(df, bag, label, step, limit)
    rows = a.join(b, "threshold").select("threshold", (F.col("_a") - F.col("auc")).alias("d")).where("d is not null").orderBy("threshold").collect()
    return knee([r[0] for r in rows], [r[1] for r in rows])
