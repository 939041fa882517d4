"""Sequence functions on string columns: nucleotides, contexts, codons, peptides, motifs.

All are built-in expressions, so they stay in the JVM. Python-like slices never raise: positions
out of range give what is there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RESIDUES = "ARNDCEQGHILKMFPSTWYV"
BASES = "ACTG"
#: Amino acids of the 64 codons in T, C, A, G order (standard genetic code).
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CHASM = ("C*pG", "CpG*", "TpC*", "G*pA")
PEPTIDE = 23


def _int(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def piece(s: Column, start: Column | int, size: Column | int) -> Column:
    """size letters from 0-based start; negative sizes count as none."""
    return F.substring(s, _int(start) + 1, F.greatest(_int(size), F.lit(0)))


def first(s: Column, n: int) -> Column:
    """s[:n]; s[:-k] for negative n."""
    return F.left(s, F.lit(n)) if n >= 0 else F.left(s, F.greatest(F.length(s) + n, F.lit(0)))


def last(s: Column, n: int) -> Column:
    """s[-n:] for n > 0."""
    return F.right(s, F.lit(n))


def after(s: Column, n: int) -> Column:
    """s[n:]."""
    return F.substring(s, F.lit(n + 1), F.greatest(F.length(s), F.lit(1)))


def reverse_complement(s: Column) -> Column:
    """Keeps case; N, n and - stand for themselves. Null where another letter occurs."""
    ok = s.rlike("^[ACGTacgtNn-]*$")
    return F.when(ok, F.translate(F.reverse(s), "ACGTacgt", "TGCAtgca"))


def terminal_window(protein: Column, end: str) -> Column:
    """The 23 residues at the C-terminus, or those after the first at the N-terminus."""
    return last(protein, PEPTIDE) if end == "cterm" else piece(protein, 1, PEPTIDE)


def trinucleotide(cds: Column, pos: Column) -> Column:
    """The base at 0-based pos with its neighbours; at an edge the base is repeated outward."""
    n = F.length(cds)
    left = piece(cds, F.greatest(pos - 1, F.lit(0)), 1)
    right = piece(cds, F.least(pos + 1, n - 1), 1)
    return F.when((pos >= 0) & (pos < n), F.concat(left, piece(cds, pos, 1), right))


def chasm_context(tri: Column) -> Column:
    """Eight-class mutation context of a trinucleotide. The order of the rules matters: TCG is
    C*pG. Null unless it has three letters."""
    head, tail = F.left(tri, F.lit(2)), F.right(tri, F.lit(2))
    found = F.when(tail == "CG", CHASM[0]).when(head == "CG", CHASM[1]).when(head == "TC", CHASM[2]).when(tail == "GA", CHASM[3])
    return F.when(F.length(tri) == 3, found.otherwise(piece(tri, 1, 1)))


def context_names(kind: float) -> list[str]:
    """All contexts of a kind: 0 none, 1 base, 1.5 CHASM, 2 pair, 3 trinucleotide."""
    if kind == 0:
        return ["None"]
    if kind == 1.5:
        return [*CHASM, *BASES]
    names = [""]
    for _ in range(int(kind)):
        names = [a + b for a in names for b in BASES]
    return names


def context(cds: Column, pos: Column, kind: float) -> Column:
    """Mutation context of the base at 0-based pos."""
    if kind == 0:
        return F.lit("None")
    if kind == 1:
        return piece(cds, pos, 1)
    if kind == 2:
        return F.concat(piece(cds, F.greatest(pos - 1, F.lit(0)), 1), piece(cds, pos, 1))
    tri = trinucleotide(cds, pos)
    return chasm_context(tri) if kind == 1.5 else tri


def context_of(tri: Column, kind: float) -> Column:
    """The context of a kind from a trinucleotide of trinucleotide()."""
    if kind == 0:
        return F.lit("None")
    if kind == 1:
        return piece(tri, 1, 1)
    if kind == 2:
        return F.left(tri, F.lit(2))
    return chasm_context(tri) if kind == 1.5 else tri


def codon_map() -> Column:
    order = "TCAG"
    codons = [a + b + c for a in order for b in order for c in order]
    return F.create_map(*(F.lit(x) for pair in zip(codons, GENETIC_CODE) for x in pair))


def translate(cds: Column) -> Column:
    """Protein of a coding sequence with '*' for stops and X for unknown codons; a last partial
    codon is left out."""

    def run(c: Column) -> Column:
        n = F.floor(F.length(c) / 3).cast("int")
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(codon_map(), piece(c, i * 3, 3)), F.lit("X")))
        return F.when(n > 0, F.array_join(each, "")).otherwise(F.when(c.isNotNull(), F.lit("")))

    return let(F.upper(cds), run)


def protein_of(cds: Column) -> Column:
    """Protein up to the first stop, which is left out."""
    return F.substring_index(translate(cds), "*", 1)


def strip_prefix(change: Column) -> Column:
    """'p.K347*' -> 'K347*'."""
    return F.substring(change, F.lit(3), F.greatest(F.length(change), F.lit(1)))


def kmers(s: Column, k: int) -> Column:
    """Sliding substrings of k letters, in order."""
    n = F.length(s)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def motif_at_end(peptide: Column, motif: str, end: str) -> Column:
    """1 if the motif ('x' is any residue) stands at that end of the peptide, else 0; a peptide
    that is too short doesn't match."""
    body = motif.replace("x", ".")
    return peptide.rlike(f"{body}$" if end == "cterm" else f"^{body}").cast("int")


def motif_anywhere(peptide: Column, motif: Column | str, end: str) -> Column:
    """Non-overlapping occurrences of a motif in the last or first six residues."""
    six = last(peptide, 6) if end == "cterm" else first(peptide, 6)
    motif = F.lit(motif) if isinstance(motif, str) else motif
    return ((F.length(six) - F.length(F.replace(six, motif, F.lit("")))) / F.length(motif)).cast("int")


def motif_sum(peptide: Column, motifs: list[str], end: str, anywhere: bool = False) -> Column:
    """Total matches of several motifs."""
    f = motif_anywhere if anywhere else motif_at_end
    total = F.lit(0)
    for m in motifs:
        total = total + f(peptide, m, end)
    return total
