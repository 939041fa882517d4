"""Peptide features as array<double> columns.

Widths: a residue bag has 20 counts, a peptide of `split` end positions 20 each, the end dimer 400.
By default the position next to the end is left empty, as in the deployed models (compat=True);
compat=False fills it in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telospark.functions.sequences import PEPTIDE, RESIDUES, after, first, last, let, piece


def _residues() -> Column:
    return F.array(*map(F.lit, RESIDUES))


def residue_bag(s: Column) -> Column:
    """Counts of the 20 residues; other letters are ignored."""
    return let(s, lambda x: F.transform(_residues(), lambda a: (F.length(x) - F.length(F.replace(x, a, F.lit("")))).cast("double")))


def dimer_index(d: Column) -> Column:
    """0-399 (first residue major); null for other letters."""
    a, b = (F.locate(x, RESIDUES) if isinstance(x, str) else F.instr(F.lit(RESIDUES), x) for x in (F.left(d, F.lit(1)), F.right(d, F.lit(1))))
    return F.when((a > 0) & (b > 0) & (F.length(d) == 2), (a - 1) * len(RESIDUES) + b - 1)


def dimer_counts(s: Column) -> Column:
    """400 counts of adjacent pairs; pairs with U are skipped. Null where another letter outside
    the 20 occurs: such rows are to be rejected."""
    every = F.sequence(F.lit(0), F.lit(len(RESIDUES) ** 2 - 1))

    def count(s: Column) -> Column:
        n = F.length(s)
        at = F.transform(F.sequence(F.lit(1), n - 1), lambda i: dimer_index(F.substring(s, i, F.lit(2))))
        found = F.when(n >= 2, F.filter(at, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
        counts = let(found, lambda x: F.transform(every, lambda j: F.size(F.filter(x, lambda i: i == j)).cast("double")))
        return F.when(s.rlike(f"^[{RESIDUES}U]*$"), counts)

    return let(s, count)


def position_bag(s: Column, splits: int, width: int, compat: bool = True) -> Column:
    """Residue bags of `splits` bins counted from the right end; the last bin is what is left.
    With compat the first bin (next to the end) is empty."""
    if splits <= 1:
        return residue_bag(s)
    chunk = round(width / splits)
    n = F.length(s)
    bags = []
    for j in range(splits):
        if j == splits - 1:
            bags.append(residue_bag(first(s, -j * chunk)))
        elif j == 0 and compat:
            bags.append(F.array(*[F.lit(0.0)] * len(RESIDUES)))
        else:
            stop = F.greatest(n - j * chunk, F.lit(0))
            start = F.greatest(n - (j + 1) * chunk, F.lit(0))
            bags.append(residue_bag(piece(s, start, stop - start)))
    return F.concat(*bags)


def terminal_features(peptide: Column, split: int, dinuc: bool, end: str, compat: bool = True) -> Column:
    """Feature vector of a 23-residue peptide: [bag of the rest | positions at the end | dimer]."""
    if not 0 <= split <= PEPTIDE:
        raise ValueError("split must be 0 to 23")
    if split == 0:
        return residue_bag(peptide)
    near = peptide if split == PEPTIDE else last(peptide, split) if end == "cterm" else first(peptide, split)
    parts = [position_bag(near, split, split, compat)]
    if split < PEPTIDE:
        parts.insert(0, residue_bag(first(peptide, -split) if end == "cterm" else after(peptide, split)))
    if dinuc:
        parts.append(dimer_counts(last(near, 2) if end == "cterm" else first(near, 2)))
    return F.concat(*parts)


def feature_width(split: int, dinuc: bool) -> int:
    n = len(RESIDUES)
    return n if split == 0 else (n if split < PEPTIDE else 0) + n * split + (n * n if dinuc else 0)
