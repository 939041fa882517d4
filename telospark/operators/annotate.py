"""Variant annotation on a transcript, as column expressions.

Conventions: cds runs from the start codon to the stop codon, included; ranges are the coding
exons in transcript order, without the stop; stop_positions are the stop's three positions. An
insertion's start is the base before it. A deletion on the minus strand is anchored at its lowest
coordinate. Offsets count residues from 0. A reference allele that disagrees with the cds, or a
place outside it, has a null effect, which callers drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telospark.functions.sequences import let, piece, reverse_complement, trinucleotide
from telospark.operators import frames

STARTS = ("ATG", "CTG", "TTG")


def genome_positions(ranges: Column, strand: Column, stops: Column) -> Column:
    """Genome position of each cds base: exons in order, reversed within on the minus strand, then
    stop positions that the exons don't already hold."""

    def exon(r: Column) -> Column:
        return F.when(strand == "-", F.sequence(r["end"], r["start"], F.lit(-1).cast("long"))).otherwise(F.sequence(r["start"], r["end"], F.lit(1).cast("long")))

    body = F.flatten(F.transform(ranges, exon))
    up = F.array_sort(stops)
    return F.concat(body, F.array_except(F.when(strand == "-", F.reverse(up)).otherwise(up), body))


def with_positions(tx: DataFrame) -> DataFrame:
    """tx with genome, the position of each cds base."""
    return tx.withColumn("genome", genome_positions(F.col("ranges"), F.col("strand"), F.col("stop_positions")))


def annotate(df: DataFrame, at: Column | None = None) -> DataFrame:
    """df (start, ref, alt, and of its transcript strand, cds, utr3, genome, protein, and frames, stops
    and plain, which are made here if they aren't there) with cds_pos, tri, effect, aa_off,
    mut_length, mut_protein, mut_end (last 23 residues) and short. `at` gives the 0-based cds place
    of a simulated variant instead of start; ref then counts as given on the plus strand, deletions
    re-read from the cds.

    Nothing is translated but the codons at the junction; mutant proteins are made only where a
    plan reads mut_protein."""
    df = df if {"frames", "stops", "plain"} <= set(df.columns) else frames.with_frames(df)
    cds, protein = F.col("cds"), F.col("protein")
    minus, insertion = F.col("strand") == "-", F.col("ref") == ""
    ref = F.when(minus, reverse_complement(F.col("ref"))).otherwise(F.col("ref"))
    alt = F.when(minus, reverse_complement(F.col("alt"))).otherwise(F.col("alt"))
    if at is None:
        # minus strand: the last base of a deletion is its first in the transcript
        anchor = F.when(minus & ~insertion, F.col("start") + F.length("ref") - 1).otherwise(F.col("start"))
        place = (F.array_position("genome", anchor) - 1).cast("int")
    else:
        place = at.cast("int")
        ref = F.when((F.col("alt") == "") & ~insertion, piece(cds, at, F.length("ref"))).otherwise(ref)

    def located(v: Column) -> Column:
        cut = F.when(insertion & ~minus, v["place"] + 1).otherwise(v["place"])
        fits = (v["place"] >= 0) & (piece(cds, cut, F.length(v["ref"])) == v["ref"])
        whole = F.when(fits & protein.isNotNull(), cut)
        return let(whole, lambda c: F.when(c.isNotNull(), let(frames.junction(c, v["ref"], v["alt"]), lambda j: parted(v, c, j))))

    def parted(v: Column, cut: Column, j: Column) -> Column:
        return let(frames.offset(j).cast("int"), lambda d: described(v, cut, j, d))

    def described(v: Column, cut: Column, j: Column, differs: Column) -> Column:
        n, m = F.length(protein), j["length"]
        change = F.length(v["alt"]) - F.length(v["ref"])
        snv = (F.length(v["ref"]) == 1) & (F.length(v["alt"]) == 1)
        off = F.when(snv, j["first"]).otherwise(differs)
        head = F.concat(piece(cds, 0, cut), v["alt"], piece(frames.full_sequence(), cut + F.length(v["ref"]), 3))
        codon = F.when(cut >= 3, F.left(cds, F.lit(3))).otherwise(F.left(head, F.lit(3)))
        started = F.left(cds, F.lit(3)) == codon
        same, stopped = (m == n) & (differs > n), (off < n) & (m == off)
        effect = (
            F.when(~started & codon.isin(*STARTS), "AlternateStartCodon")
            .when(~started, "StartLoss")
            .when(same, "Silent")
            .when(change % 3 != 0, "FrameShift")
            .when(stopped, "PrematureStop")
            .when((change == 0) & (off >= n) & (m > n), "StopLoss")
            .when(change == 0, "Substitution")
            .when(change > 0, "Insertion")
            .otherwise("Deletion")
        )
        return let(F.struct(effect.alias("effect"), off.alias("off")), lambda e: F.struct(v["place"].alias("cds_pos"), e["effect"].alias("effect"), e["off"].alias("aa_off"), j.alias("j"), short(e["effect"], e["off"], j).alias("short")))

    def short(f: Column, off: Column, j: Column) -> Column:
        lead = F.concat(F.lit("p."), piece(F.concat(protein, F.lit("*")), off, 1), (off + 1).cast("string"))
        return (
            F.when(f == "FrameShift", F.concat(lead, F.lit("fs")))
            .when(f == "Deletion", F.concat(lead, F.lit("del")))
            .when(f == "Insertion", F.concat(lead, F.lit("ins")))
            .when(f == "Silent", F.lit("silent"))
            .when(f.isin("StartLoss", "AlternateStartCodon"), F.lit("p.M1?"))
            .otherwise(F.concat(lead, frames.residue(j, off)))
        )

    # Generating the struct keeps filters on the effect from working it out a second time.
    df = df.withColumn("_v", F.explode(F.array(let(F.struct(ref.alias("ref"), alt.alias("alt"), place.alias("place")), located))))
    read = F.col("_v.effect") != "StartLoss"  # no protein is made then
    new = {c: F.col(f"_v.{c}") for c in ("cds_pos", "effect", "short")}
    new |= {"aa_off": F.when(read, F.col("_v.aa_off")), "mut_length": F.when(read, F.col("_v.j.length"))}
    new |= {"mut_protein": F.when(read, frames.mutant_protein(F.col("_v.j"))), "mut_end": F.when(read, frames.mutant_end(F.col("_v.j")))}
    new["tri"] = trinucleotide(cds, F.col("_v.cds_pos"))
    return df.withColumns(new).drop("_v")
