"""Analyses end to end: read, annotate, test or score. Everything is one lazy plan per stage; the
transcript dimension is joined once and genes are never looped over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from telospark.operators import permutation
from telospark.operators.annotate import annotate, with_positions
from telospark.operators.filters import allele_ok, coding_complete, collapse_genes, has_transcript, nmd_insensitive_length, truncation_eligible
from telospark.operators.frames import with_frames
from telospark.sources.scratch import cut

#: Why a mutation has no effect.
REASONS = ("no transcript named", "allele with N or too long", "no complete coding transcript", "doesn't fit the transcript")
ORDER = ("degrons", "sites", "cterm", "nterm", "truncation", "stability")


def route(options: dict) -> str:
    """The analysis that a set of options asks for; the first given in ORDER wins."""
    for name in ORDER:
        if options.get(name):
            return name
    raise ValueError(f"give one of {', '.join(ORDER)}")


def score_end(options: dict) -> str:
    if options.get("cterm"):
        return "cterm"
    if options.get("nterm"):
        return "nterm"
    raise ValueError("give cterm or nterm models")


def annotated(mutations: DataFrame, tx: DataFrame, mode: str = "transcript", report: list[Observation] | None = None) -> tuple[DataFrame, DataFrame]:
    """(variants with effects, unit and transcript columns, rejected rows with the reason).

    Variants are annotated on their own transcript. mode 'legacy' then gives a gene its first known
    transcript and the variants of its last one; own tells whether these are the same. report gets
    observations that count what is left out, for each reason, while the variants are computed."""
    blank, odd = ~has_transcript(F.col("transcript_id")), ~allele_ok(F.col("ref"), F.col("alt"))
    seen = mutations.withColumn("reason", F.when(blank, REASONS[0]).when(odd, REASONS[1]))
    if report is not None:
        report += [Observation(), Observation()]
        seen = seen.observe(report[-2], F.count("*").alias("mutations"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS[:2]))
    named = mutations.where(~blank)
    rows = seen.where("reason is null").drop("reason")
    dims = with_frames(with_positions(tx.where(coding_complete(F.col("biotype"), F.col("complete"))))).drop("contig", "gene")
    out = annotate(rows.join(dims, "transcript_id", "left"))
    out = out.withColumn("reason", F.when(F.col("cds").isNull(), REASONS[2]).when(F.col("effect").isNull(), REASONS[3]))
    if report is not None:
        out = out.observe(report[-1], *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS[2:]))
    site = ["gene", "transcript_id", "contig", "start", "ref", "alt", "reason"]
    rejected = seen.where("reason is not null").select(*site).unionByName(out.where("reason is not null").select(*site))
    good = out.where("reason is null").drop("reason")
    if mode == "legacy":
        known = named.join(tx.select("transcript_id"), "transcript_id", "left_semi").groupBy("gene").agg(F.min("transcript_id").alias("_first"), F.max("transcript_id").alias("_last"))
        good = collapse_genes(good, mode, known).drop(*(c for c in dims.columns if c != "transcript_id")).join(dims, "transcript_id")
    else:
        good = collapse_genes(good, mode)
    return good, rejected


def reported(report: list[Observation]) -> dict[str, int]:
    """The counts of annotated(), once its variants have been computed."""
    return {k: v for o in report for k, v in o.get.items()}


def run(name: str, mutations: DataFrame, tx: DataFrame, simulations: int = 10_000, spans: DataFrame | None = None, models: tuple | None = None, energies: DataFrame | Callable[[DataFrame], DataFrame] | None = None, side: str = "lesser", mode: str = "transcript", seed: int = 101, report: list[Observation] | None = None) -> DataFrame:
    """The result table of one analysis; 'degrons_simple' is the older test of substitutions alone. energies: a table, or
    a rule that makes it from the annotated variants, which are then annotated once."""
    variants, _ = annotated(mutations, tx, mode, report)
    if name == "degrons_simple":
        test, statistic = permutation.DEGRON_LEGACY, permutation.Overlap(spans, "gene")
    elif name == "degrons":
        test, statistic = permutation.DEGRON, permutation.Overlap(spans, "gene")
    elif name == "sites":
        test, statistic = permutation.SITE, permutation.Overlap(spans, "transcript_id")
    elif name in ("cterm", "nterm"):
        test, statistic = permutation.TERMINAL, permutation.Potential(*models, name)
    elif name == "truncation":
        variants = variants.where(truncation_eligible(F.length("protein"), nmd_insensitive_length(F.col("ranges"))))
        test = permutation.TRUNCATION if side == "lesser" else permutation.TRUNCATION_GREATER
        statistic = permutation.Truncations()
    elif name == "stability":
        if callable(energies):
            variants = cut(permutation.narrow(variants))
            energies = cut(energies(variants))
        variants = variants.join(energies.select("gene").distinct(), "gene", "left_semi")
        test, statistic = permutation.STABILITY, permutation.Energy(energies)
    else:
        raise ValueError(f"no analysis named {name}")
    if name in ("degrons", "degrons_simple", "sites"):
        variants = variants.join(spans.select(F.col("key").alias(statistic.key)).distinct(), statistic.key, "left_semi")
    if "ranges" in variants.columns:
        variants = permutation.narrow(variants, name if name in ("cterm", "nterm") else None)
    variants = cut(variants)
    result = permutation.run_test(variants, permutation.dimension(tx.where(coding_complete(F.col("biotype"), F.col("complete")))), test, statistic, simulations, seed)
    return permutation.shape(result, variants, test)
