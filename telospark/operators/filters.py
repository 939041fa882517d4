"""Predicates on mutations and annotated variants. Effects are matched by exact name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telospark.sources.scratch import cut

# Fixed values.
SUBSTITUTIONS = ("Substitution", "Silent", "AlternateStartCodon", "PrematureStop", "StartLoss", "StopLoss")
INDELS = ("Deletion", "Insertion", "FrameShift")
TRUNCATIONS = ("FrameShift", "PrematureStop", "StopLoss")
MAX_REF = 10
TERMINAL = 23


def allele_ok(ref: Column, alt: Column) -> Column:
    """No N in either allele and a reference of at most ten letters."""
    return ~ref.contains("N") & ~alt.contains("N") & (F.length(ref) <= MAX_REF)


def has_transcript(transcript_id: Column) -> Column:
    return transcript_id.isNotNull() & (transcript_id != "")


def coding_complete(biotype: Column, complete: Column) -> Column:
    return (biotype == "protein_coding") & complete


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1) & (ref != alt)


def is_substitution(effect: Column, ref: Column, alt: Column) -> Column:
    return effect.isin(*SUBSTITUTIONS) & is_snv(ref, alt)


def is_indel(effect: Column, ref: Column, alt: Column) -> Column:
    return effect.isin(*INDELS) & (F.length(ref) != F.length(alt))


def is_truncation(effect: Column) -> Column:
    return effect.isin(*TRUNCATIONS)


def nmd_insensitive_length(ranges: Column) -> Column:
    """Residues at the end whose stops escape decay: last coding exon and 50 bases before it."""
    tail = F.element_at(ranges, -1)
    return (tail["end"] - tail["start"] + 1) / 3.0 + 50 / 3.0


def nmd_class_of(size: Column, protein_length: Column, insensitive: Column) -> Column:
    """By the mutant protein's length: 0.5 unknown (no protein), 0 escapes, 1 sensitive."""
    return F.when(size.isNull() | (size == 0), 0.5).when(size > protein_length - insensitive, 0.0).otherwise(1.0)


def nmd_class(mutant: Column, protein_length: Column, insensitive: Column) -> Column:
    return nmd_class_of(F.length(mutant), protein_length, insensitive)


def nmd_kept(size: Column, protein_length: Column, insensitive: Column) -> Column:
    return nmd_class_of(size, protein_length, insensitive) < 1


def nonsense_kept(effect: Column, size: Column, protein_length: Column, insensitive: Column) -> Column:
    """Drops only premature stops that cause decay; size is the mutant protein's length."""
    return (effect != "PrematureStop") | nmd_kept(size, protein_length, insensitive)


def truncation_eligible(protein_length: Column, insensitive: Column) -> Column:
    """Genes that are not wholly insensitive to decay."""
    return insensitive / protein_length < 1


def hits_terminus(effect: Column, offset: Column, size: Column, protein_length: Column, end: str) -> Column:
    """Variants with a mutant protein (of length size) that change a terminus: at the C-terminus all indels and premature stops, and other
    substitutions strictly inside the last 23; at the N-terminus substitutions at offset <= 24."""
    there = F.coalesce(size > 0, F.lit(False))
    if end == "cterm":
        return there & (effect.isin(*INDELS, "PrematureStop") | (effect.isin(*SUBSTITUTIONS) & (offset > protein_length - TERMINAL)))
    return there & effect.isin(*SUBSTITUTIONS) & (offset <= 24)


def low_bin(value: Column, threshold: float) -> Column:
    """1 below the threshold, else 0; NaN and null are 0."""
    return F.when(~F.isnan(value) & (value < threshold), 1).otherwise(0)


def collapse_genes(df: DataFrame, mode: str = "transcript", ends: DataFrame | None = None) -> DataFrame:
    """Adds `unit`, the group of a test. 'transcript': each transcript of a gene by itself.
    'legacy': a gene has its first transcript and the variants of its last one (own_transcript); own: they are the
    same. ends: gene, _first and _last, if not those of df itself."""
    if mode == "transcript":
        return df.withColumn("unit", F.concat_ws("|", "gene", "transcript_id"))
    ends = ends if ends is not None else df.groupBy("gene").agg(F.min("transcript_id").alias("_first"), F.max("transcript_id").alias("_last"))
    df = df.join(ends, "gene").where(F.col("transcript_id") == F.col("_last")).withColumn("own_transcript", F.col("transcript_id"))
    return df.withColumns({"unit": F.col("gene"), "transcript_id": F.col("_first"), "own": F.col("_first") == F.col("_last")}).drop("_first", "_last")


def two_sided_trim(df: DataFrame, order: list, t: int) -> DataFrame:
    """Rows left after dropping the first and last t in the given order."""
    n = df.agg(F.count("*").alias("_n"))  # one row
    return rank_rows(df, order, "_r").join(F.broadcast(n)).where((F.col("_r") > t) & (F.col("_r") <= F.col("_n") - t)).drop("_r", "_n")


def rank_rows(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """df with its row number in the given order, from 1. Rows are dealt by ranges of the order and
    numbered there; a range begins where those before it end, so no task sees all rows. The ranges
    are computed when this returns."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    base = ranges.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranges.withColumn("_in", within).join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")
