"""Degron potential of mutations: the change in (specific - bag) of the terminal window. Windows are
scored where their variant stands, each distinct one of a batch once, so that no variant is worked
out a second time or moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telospark.functions.sequences import terminal_window
from telospark.operators.filters import hits_terminus, is_indel, is_substitution, nmd_insensitive_length, nmd_kept, nonsense_kept
from telospark.operators.model import Model


def peptide_score(spark: SparkSession, peptide: Column, specific: Model, bag: Model | None) -> Column:
    """Null for peptides with U."""
    known = F.when(~peptide.contains("U"), peptide)
    value = specific.predict(spark, known)
    return value - bag.predict(spark, known) if bag else value


def delta(spark: SparkSession, wild: Column, mutant: Column, specific: Model, bag: Model | None) -> Column:
    return peptide_score(spark, mutant, specific, bag) - peptide_score(spark, wild, specific, bag)


def eligible(df: DataFrame, nmd_indels: bool = True) -> Column:
    """Substitutions without decaying stops, and indels (without decaying ones if asked). Of a gene
    that stands for another transcript, substitutions of that one don't count."""
    own = F.col("own") if "own" in df.columns else F.lit(True)
    effect, ref, alt, mutant = (F.col(c) for c in ("effect", "ref", "alt", "mut_length"))
    n, safe = F.col("n"), F.col("safe")
    sub = own & is_substitution(effect, ref, alt) & nonsense_kept(effect, mutant, n, safe)
    indel = is_indel(effect, ref, alt)
    return sub | (indel & nmd_kept(mutant, n, safe) if nmd_indels else indel)


def windows(df: DataFrame, end: str) -> DataFrame:
    """Annotated variants with n (length of the protein), wild_window and mut_window: what scoring
    reads of the two proteins."""
    mutant = F.col("mut_end") if end == "cterm" else terminal_window(F.col("mut_protein"), end)
    return df.withColumns({"n": F.length("protein"), "wild_window": terminal_window(F.col("protein"), end), "mut_window": mutant})


#: Columns of a variant that scoring reads.
SCORED = ("gene", "transcript_id", "own_transcript", "own", "contig", "start", "ref", "alt", "effect", "aa_off", "short", "mut_length", "n", "safe", "wild_window", "mut_window")


def scored(variants: DataFrame, end: str) -> DataFrame:
    """Annotated variants without their sequences."""
    df = windows(variants, end).withColumn("safe", nmd_insensitive_length(F.col("ranges")))
    return df.select(*(c for c in SCORED if c in df.columns))


def with_delta(df: DataFrame, specific: Model, bag: Model | None, end: str) -> DataFrame:
    """Variants with their windows() that change the terminus, with delta, and mutant_score. A
    wild-type window with U gives delta 0 and no row for scoring."""
    df = df.where(hits_terminus(F.col("effect"), F.col("aa_off"), F.col("mut_length"), F.col("n"), end))
    df = df.where(~F.col("wild_window").contains("U") & ~F.col("mut_window").contains("U"))
    mutant, wild = (peptide_score(df.sparkSession, F.col(c), specific, bag) for c in ("mut_window", "wild_window"))
    df = df.withColumns({"mutant_score": mutant, "_wild": wild})
    return df.withColumn("delta", F.col("mutant_score") - F.col("_wild")).drop("mut_window", "wild_window", "_wild")


def score_mutations(df: DataFrame, specific: Model, bag: Model | None, end: str, raw: bool = False) -> DataFrame:
    """One row per scored mutation. df: annotated variants, or what scored() leaves of them. Normal: the change in potential; raw: the change in the
    specific model's score and the score itself, indels not filtered for decay."""
    df = df if "mut_window" in df.columns else scored(df, end)
    df = with_delta(df.where(eligible(df, nmd_indels=not raw)), specific, None if raw else bag, end)
    named = F.col("own_transcript") if "own_transcript" in df.columns else F.col("transcript_id")
    end_pos = F.col("start") + F.greatest(F.length("ref") - 1, F.lit(0))
    cols = [F.col("gene").alias("Hugo_Symbol"), named.alias("Transcript_ID"), F.col("contig").alias("Chromosome"), F.col("start").alias("Start_Position"), end_pos.alias("End_Position"), F.col("short").alias("HGVSp_Short")]
    if raw:
        return df.select(*cols, F.col("delta").alias("delta specific score"), F.col("mutant_score").alias("specific score"))
    return df.select(*cols, F.col("delta").alias("delta degron potential"))


def wild_type_scores(tx: DataFrame, specific: Model, bag: Model, end: str) -> DataFrame:
    """transcript_id, specific, bag and potential of each transcript's terminal window; null for
    windows with U."""
    spark = tx.sparkSession
    p = tx.select("transcript_id", terminal_window(F.col("protein"), end).alias("peptide"))
    p = p.withColumn("peptide", F.when(~F.col("peptide").contains("U"), F.col("peptide")))
    p = p.withColumn("specific", specific.predict(spark, F.col("peptide"))).withColumn("bag", bag.predict(spark, F.col("peptide")))
    return p.withColumn("potential", F.col("specific") - F.col("bag")).drop("peptide")
