"""Reading frames of a transcript, worked out once: what any variant does is then a look-up.

frames: the translations of cds and 3' end from base 0, 1 and 2, stops as '*'. stops: for each base,
the place of the first stop codon that is reached from it codon by codon, or where the last whole
codon ends. A variant replaces a few codons at its junction; behind them the sequence goes on in
one of the three frames until that frame's next stop. So the length of a mutant protein is one
jump, its residues are pieces of the frames, and no mutant sequence is translated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telospark.functions.sequences import PEPTIDE, let, piece, translate

#: Residues behind the junction that are compared at first, and then, before whole proteins are.
LOOK = (4, 48)


def full_sequence() -> Column:
    return F.concat("cds", F.coalesce("utr3", F.lit("")))


def _frame_stops(frame: Column) -> Column:
    """For each codon of a frame, and behind the last: the codon of the next stop, or their number."""
    runs = F.split(frame, r"\*")
    ends = F.aggregate(runs, F.array().cast("array<int>"), lambda a, r: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + 1, F.lit(0)) + F.length(r))))
    return let(ends, lambda e: F.flatten(F.transform(runs, lambda r, i: F.array_repeat(F.get(e, i), F.length(r) + 1))))


def with_frames(tx: DataFrame) -> DataFrame:
    """tx (cds, utr3, protein) with frames, stops and plain: whether the protein is what frame 0
    codes for."""
    full = full_sequence()
    tx = tx.withColumn("frames", F.array(*(translate(F.substring(full, k + 1, F.length(full))) for k in range(3))))
    tx = tx.withColumn("_ends", F.transform("frames", _frame_stops))
    # bound by let: inside the lambda the plan would work the ends out anew for every base
    places = let(F.col("_ends"), lambda e: F.transform(F.sequence(F.lit(0), F.length(full)), lambda i: 3 * F.get(F.get(e, i % 3), F.floor(i / 3).cast("int")) + i % 3))
    return tx.withColumn("stops", places).withColumn("plain", F.coalesce(F.col("protein") == F.substring_index(F.col("frames")[0], "*", 1), F.lit(False))).drop("_ends")


def junction(cut: Column, ref: Column, alt: Column) -> Column:
    """What a variant at 0-based place cut of the cds makes of it: first (the first codon touched),
    kept (residues made at the junction, up to a stop), frame, codon (where the sequence goes on),
    tail (its residues up to the stop), length (of the mutant protein) and aligned (the rest is in its old place)."""
    first = F.floor(cut / 3).cast("int")
    lead = cut - 3 * first
    behind = cut + F.length(ref)
    pad = F.pmod(-(lead + F.length(alt)), F.lit(3))
    codons = translate(F.concat(piece(F.col("cds"), 3 * first, lead), alt, piece(full_sequence(), behind, pad)))

    def told(x: Column) -> Column:
        stop = F.instr(x["codons"], "*")
        kept = F.when(stop > 0, F.left(x["codons"], stop - 1)).otherwise(x["codons"])
        at = x["at"]
        tail = F.when(stop > 0, 0).otherwise(F.coalesce(((F.get("stops", at) - at) / 3).cast("int"), F.lit(0)))
        early = F.col("stops")[0] < 3 * first  # a stop before the variant
        length = F.when(early, (F.col("stops")[0] / 3).cast("int")).otherwise(first + F.length(kept) + tail)
        aligned = (stop == 0) & (at == 3 * (first + F.length(x["codons"])))
        return F.struct(first.alias("first"), kept.alias("kept"), (at % 3).alias("frame"), F.floor(at / 3).cast("int").alias("codon"), tail.alias("tail"), length.alias("length"), aligned.alias("aligned"), early.alias("early"))

    return let(F.struct(codons.alias("codons"), (behind + pad).cast("int").alias("at")), told)


def mutant_protein(j: Column) -> Column:
    """The whole mutant protein of a junction, put together from pieces of the frames."""
    whole = F.concat(F.left(F.col("frames")[0], j["first"]), j["kept"], piece(F.get("frames", j["frame"]), j["codon"], j["tail"]))
    return F.when(j["early"], F.substring_index(F.col("frames")[0], "*", 1)).otherwise(whole)


def mutant_end(j: Column) -> Column:
    """Its last 23 residues; no more than those are put together."""
    short = F.concat(piece(F.col("frames")[0], F.greatest(j["first"] - PEPTIDE, F.lit(0)), F.least(j["first"], F.lit(PEPTIDE))), j["kept"], piece(F.get("frames", j["frame"]), j["codon"], j["tail"]))
    rest = piece(F.get("frames", j["frame"]), j["codon"] + j["tail"] - PEPTIDE, PEPTIDE)
    return F.when(j["early"], F.right(F.substring_index(F.col("frames")[0], "*", 1), F.lit(PEPTIDE))).when(j["tail"] >= PEPTIDE, rest).otherwise(F.right(short, F.lit(PEPTIDE)))


def residue(j: Column, at: Column) -> Column:
    """Residue `at` (from 0) of the mutant protein; '*' at its end, nothing beyond."""
    inner = at - j["first"]
    back = inner - F.length(j["kept"])
    made = (
        F.when(at == j["length"], F.lit("*"))
        .when((at < 0) | (at > j["length"]), F.lit(""))
        .when(at < j["first"], piece(F.col("frames")[0], at, 1))
        .when(inner < F.length(j["kept"]), piece(j["kept"], inner, 1))
        .otherwise(piece(F.get("frames", j["frame"]), j["codon"] + back, 1))
    )
    return F.when(j["early"], piece(F.concat(mutant_protein(j), F.lit("*")), at, 1)).otherwise(made)


def first_difference(a: Column, b: Column) -> Column:
    """0-based place where two strings part; the shorter length if one begins the other."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: piece(a, i, 1) != piece(b, i, 1))
    return F.when(n > 0, F.coalesce(F.get(at, 0), n)).otherwise(F.lit(0))


def offset(j: Column) -> Column:
    """Where the protein and the mutant one part, each with a stop behind it; their length if they are
    equal. A few residues behind the junction tell, as a rule; equal ones lead to longer looks."""
    old = F.concat("protein", F.lit("*"))

    def look(n: Column, otherwise: Column) -> Column:
        whole = j["tail"] <= n
        new = F.concat(j["kept"], piece(F.get("frames", j["frame"]), j["codon"], F.least(j["tail"], n)), F.when(whole, F.lit("*")).otherwise(F.lit("")))

        def parted(x: Column) -> Column:
            shorter = F.least(F.length(x["a"]), F.length(x["b"]))
            return let(first_difference(x["a"], x["b"]), lambda d: F.when((d < shorter) | whole | (F.length(x["a"]) < F.length(x["b"])), j["first"] + d).otherwise(otherwise))

        return let(new, lambda b: let(F.struct(piece(old, j["first"], F.length(b)).alias("a"), b.alias("b")), parted))

    jumped = look(F.lit(LOOK[0]), look(F.lit(LOOK[1]), look(j["tail"], F.lit(None).cast("int"))))
    same = j["aligned"] & (piece(old, j["first"], F.length(j["kept"])) == j["kept"])
    slow = first_difference(old, F.concat(mutant_protein(j), F.lit("*")))
    return F.when(~F.col("plain") | j["early"], slow).when(same, F.length(old)).otherwise(jumped)
