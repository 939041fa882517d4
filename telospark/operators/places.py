"""What a variant does at every place of a transcript, for the units of an Arrow batch at once. For use in a task.

The same rules as annotate() and sampling.snv_effects(), on arrays: the sequences of the units are laid end to end, a
row is a unit, a place and an allele, and no mutant protein is made but the windows that are scored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from telospark.functions.sequences import GENETIC_CODE, PEPTIDE
from telospark.operators.annotate import STARTS
from telospark.operators.filters import INDELS, SUBSTITUTIONS, TERMINAL

EFFECTS = ("", "AlternateStartCodon", "StartLoss", "Silent", "FrameShift", "PrematureStop", "StopLoss", "Substitution", "Insertion", "Deletion")
#: The number of an effect; 0 where a variant has none.
CODE = {e: i for i, e in enumerate(EFFECTS)}
_STOP, _X = ord("*"), ord("X")
_RESIDUE = np.frombuffer(GENETIC_CODE.encode(), np.uint8)
_UPPER, _EITHER = np.full(256, 4, np.int16), np.full(256, 4, np.int16)
for _i, _b in enumerate("TCAG"):
    _UPPER[ord(_b)] = _EITHER[ord(_b)] = _EITHER[ord(_b.lower())] = _i
_ACGT = np.frombuffer(b"ACGT", np.uint8)


def of(names: tuple[str, ...]) -> np.ndarray:
    """By an effect's number, whether it is one of names."""
    return np.isin(np.array(EFFECTS), names)


def ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first[i] to first[i] + size[i] - 1 of all i, one after the other, and their i."""
    i = np.repeat(np.arange(len(size)), size)
    return np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size), i


def _bytes(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("ascii", "replace") for x in column.to_pylist()]


def _coded(codons: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Residues of codons of three letters (last axis) by a table of letters; X for unknown ones."""
    c = given[codons]
    known = (c < 4).all(axis=-1)
    return np.where(known, _RESIDUE[np.where(known, 16 * c[..., 0] + 4 * c[..., 1] + c[..., 2], 0)], _X).astype(np.uint8)


class Sequences:
    """cds, utr3, protein and safe of the units of a batch."""

    def __init__(self, batch: pa.RecordBatch):
        cds, utr3, protein = (_bytes(batch.column(c)) for c in ("cds", "utr3", "protein"))
        self.units = len(cds)
        self.bases = np.array([len(x) for x in cds], np.int64)
        self.size = self.bases + [len(x) for x in utr3]
        # a unit begins at a multiple of three, and no codon reaches into the next one
        span = 3 * ((self.size + 3) // 3 + 1)
        self.off = np.cumsum(span) - span
        self.text = np.frombuffer(b"".join((x + y).ljust(n, b"\0") for x, y, n in zip(cds, utr3, span)) + b"\0" * 96, np.uint8)
        codons = np.lib.stride_tricks.sliding_window_view(self.text, 3)
        self.residue = np.append(_coded(codons, _EITHER), np.zeros(2, np.uint8))
        self.residue[: len(codons)][(codons == 0).any(axis=1)] = 0
        ends = np.repeat(self.off, 3) + np.concatenate([3 * (np.maximum(n - np.arange(3), 0) // 3) + np.arange(3) for n in self.size])
        stop = self.residue == _STOP
        stop[ends] = True
        at = np.where(stop, np.arange(len(stop)), len(stop))
        for k in range(3):
            at[k::3] = np.minimum.accumulate(at[k::3][::-1])[::-1]
        #: For each base, where the next stop in its frame stands, or where the last whole codon ends.
        self.stops = at
        self.first_stop = at[self.off] - self.off
        self.n = np.array([len(x) for x in protein], np.int64)
        self.known = np.array(batch.column("protein").is_valid().to_pylist(), bool)
        self.protein_off = np.cumsum(self.n) - self.n
        self.protein = np.frombuffer(b"".join(protein) + b"\0", np.uint8)
        k, unit = ranges(np.zeros(self.units, np.int64), self.n)
        differs = self.protein[:-1] != self.residue[np.minimum(self.off[unit] + 3 * k, len(self.residue) - 1)]
        #: Whether the protein is what frame 0 codes for.
        self.plain = self.known & (np.bincount(unit, differs, self.units) == 0) & (3 * self.n == self.first_stop)
        self.safe = np.array(batch.column("safe").to_numpy(zero_copy_only=False), np.float64)
        self.strand = batch.column("strand").to_pylist()

    def at(self, unit: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Letters of the whole sequence; 0 beyond it."""
        inside = (place >= 0) & (place < self.size[unit])
        return np.where(inside, self.text[np.where(inside, self.off[unit] + place, 0)], 0)

    def old(self, unit: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Residues of the protein, '*' at its end, 0 beyond."""
        inside = (k >= 0) & (k < self.n[unit])
        found = self.protein[np.where(inside, self.protein_off[unit] + k, 0)]
        return np.where(inside, found, np.where(k == self.n[unit], _STOP, 0))

    def escapes(self, unit: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether mutant proteins of these lengths (-1: unknown) escape decay."""
        return (size <= 0) | (size > self.n[unit] - self.safe[unit])


class Junction:
    """frames.junction() of rows: cut is replaced by alt (a row of letters each) over `replaced` bases."""

    def __init__(self, seq: Sequences, unit: np.ndarray, cut: np.ndarray, replaced: np.ndarray, alt: np.ndarray):
        self.seq, self.unit, self.first, self.alt, more = seq, unit, cut // 3, alt, alt.shape[1]
        lead, behind = cut - 3 * self.first, cut + replaced
        pad = -(lead + more) % 3
        codons = (lead + more + pad) // 3
        wide = max(1, int(codons.max(initial=0)))
        t = np.arange(3 * wide)[None, :]
        place = np.where(t < lead[:, None], 3 * self.first[:, None] + t, (behind - lead - more)[:, None] + t)
        text = seq.at(unit[:, None], place)
        if more:
            k = t - lead[:, None]
            inside = (k >= 0) & (k < more)
            text = np.where(inside, np.take_along_axis(alt, np.clip(k, 0, more - 1), 1), text)
        text = text.reshape(len(unit), wide, 3)
        # a codon that the sequence's end cuts off is left out
        whole = (np.arange(wide) < codons[:, None]) & (text != 0).all(axis=2)
        made = np.where(whole, _coded(text, _EITHER), 0)
        stop = made == _STOP
        stopped = stop.any(axis=1)
        self.kept = np.where(stopped, stop.argmax(axis=1), whole.sum(axis=1))
        self.made, self.go = made, behind + pad
        there = ~stopped & (self.go <= seq.size[unit])
        begin = np.where(there, seq.off[unit] + self.go, 0)
        tail = np.where(there, (seq.stops[begin] - begin) // 3, 0)
        self.early = seq.first_stop[unit] < 3 * self.first
        self.length = np.where(self.early, seq.first_stop[unit] // 3, self.first + self.kept + tail)

    def residue(self, k: np.ndarray) -> np.ndarray:
        """Residues k (a row of them for each row) of the mutant proteins, '*' at their ends, 0 beyond."""
        seq, u = self.seq, self.unit[:, None]
        inner = k - self.first[:, None]
        back = inner - self.kept[:, None]
        own = (inner < 0) | self.early[:, None]
        place = seq.off[u] + np.where(own, 3 * k, self.go[:, None] + 3 * back)
        inside = (k >= 0) & (k < self.length[:, None])
        found = seq.residue[np.where(inside, np.clip(place, 0, len(seq.residue) - 1), 0)]
        here = ~own & (back < 0)
        found = np.where(here, np.take_along_axis(self.made, np.clip(inner, 0, self.made.shape[1] - 1), 1), found)
        return np.where(inside, found, np.where(k == self.length[:, None], _STOP, 0))

    def offset(self) -> np.ndarray:
        """Where protein and mutant part, a stop behind each; one behind both if they are equal."""
        seq = self.seq
        off = np.where(seq.plain[self.unit] & ~self.early, self.first, 0)
        todo = np.arange(len(off))
        while len(todo):
            part, k = self.rows(todo), off[todo]
            a, b = seq.old(part.unit, k), part.residue(k[:, None])[:, 0]
            # an old residue may be any letter, also '*'
            ended = (k >= seq.n[part.unit] + 1) | (k >= part.length + 1)
            todo = todo[~ended & (a == b)]
            off[todo] += 1
        return off

    def rows(self, rows: np.ndarray) -> Junction:
        out = object.__new__(Junction)
        out.__dict__ = {k: v[rows] if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return out

    def window(self, end: str) -> np.ndarray:
        """terminal_window() of the mutants, as rows of letters."""
        k = np.arange(PEPTIDE)[None, :]
        begin = np.maximum(self.length - PEPTIDE, 0) if end == "cterm" else np.ones_like(self.length)
        found = self.residue(begin[:, None] + k)
        return np.where(begin[:, None] + k < self.length[:, None], found, 0)


class Rows:
    """Variants: unit, effect (its number), off (-1: none), size (the mutant protein's length where it is known, else
    -1), kept (decay leaves it), cut, replaced and alt (letters; a number for those of `alts`), and for substitutions
    letter (the new residue)."""

    def __init__(self, **columns):
        self.__dict__ = columns

    def __len__(self) -> int:
        return len(self.unit)


def substitutions(seq: Sequences, nmd: bool) -> Rows:
    """4 * bases rows of each unit: by place and base (A, C, G, T)."""
    place, unit = ranges(np.zeros(seq.units, np.int64), 4 * seq.bases)
    place, base = place >> 2, place & 3
    i, n = place // 3, seq.n[unit]
    spot = np.arange(3) + 3 * i[:, None]
    old = np.where(spot < seq.bases[unit][:, None], seq.at(unit[:, None], spot), 0)
    new = old.copy()
    new[np.arange(len(new)), place - 3 * i] = _ACGT[base]
    a = _coded(old, _UPPER)
    b = _coded(new, _UPPER)
    starts = np.array([np.frombuffer(s.encode(), np.uint8) for s in STARTS])
    none = (old[np.arange(len(old)), place - 3 * i] == _ACGT[base]) | ~seq.known[unit]
    begins = (new[:, None, :] == starts).all(axis=2).any(axis=1)
    told = [none, (i == 0) & begins, i == 0, (i > n) | (a == b), i == n, b == _STOP]
    effect = np.select(told, [CODE[e] for e in ("", "AlternateStartCodon", "StartLoss", "Silent", "StopLoss", "PrematureStop")], CODE["Substitution"])
    off = np.where((effect > 0) & (effect != CODE["StartLoss"]), i, -1)
    size = np.where(effect == CODE["PrematureStop"], off, -1)
    kept = (effect > 0) & (~np.array(nmd) | (effect != CODE["PrematureStop"]) | seq.escapes(unit, size))
    return Rows(seq=seq, unit=unit, effect=effect, off=off, size=size, kept=kept, cut=place, replaced=np.ones_like(place), alt=base, alts=[bytes([x]) for x in _ACGT], letter=b)


_TURN = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


def indels(seq: Sequences, unit: np.ndarray, alleles: list[tuple[str, str]]) -> Rows:
    """A row for every base of unit[i], with alleles[i] (ref, alt): as many rows as it has bases, then the next i."""
    turned = [((r[::-1].translate(_TURN), a[::-1].translate(_TURN)) if seq.strand[u] == "-" else (r, a)) for u, (r, a) in zip(unit, ((r.encode(), a.encode()) for r, a in alleles))]
    sane = np.array([seq.strand[u] != "-" or not (set(r + a) - set("ACGTacgtNn-")) for u, (r, a) in zip(unit, alleles)], bool)
    place, k = ranges(np.zeros(len(unit), np.int64), seq.bases[unit])
    rows = np.asarray(unit, np.int64)[k]
    alts = sorted({a for _, a in turned})
    number, forward = {a: j for j, a in enumerate(alts)}, np.array([seq.strand[u] != "-" for u in unit], bool)
    alt = np.array([number[a] for _, a in turned], np.int64)[k]
    lengths = np.array([len(r) for r, _ in turned], np.int64)
    # what a deletion deletes is read where it is drawn, up to the end
    deletes = np.array([len(r) > 0 and len(a) == 0 for r, a in turned], bool)
    replaced = np.where(deletes[k], np.minimum(lengths[k], seq.bases[rows] - place), lengths[k])
    cut = np.where((lengths == 0)[k] & forward[k], place + 1, place)
    fits = seq.known[rows] & sane[k]
    for i in np.flatnonzero(~deletes & (lengths > 0)):
        mine = np.flatnonzero(k == i)
        spot = place[mine, None] + np.arange(lengths[i])
        fits[mine] &= ((spot < seq.bases[unit[i]]) & (seq.at(rows[mine, None], spot) == np.frombuffer(turned[i][0], np.uint8))).all(axis=1)
    out = Rows(seq=seq, unit=rows, cut=cut, replaced=replaced, alt=alt, alts=alts, letter=None)
    effect, off, size = np.zeros(len(rows), np.int64), np.full(len(rows), -1), np.full(len(rows), -1)
    for mine, j in junctions(out, np.flatnonzero(fits)):
        effect[mine], off[mine], size[mine] = _described(out, mine, j)
    out.effect, out.off, out.size = effect, off, size
    out.kept = (effect > 0) & seq.escapes(rows, size)
    return out


def junctions(rows: Rows, which: np.ndarray):
    """Some rows in groups whose alleles are as long, with their junctions."""
    long = np.array([len(a) for a in rows.alts], np.int64)[rows.alt[which]]
    for n in np.unique(long):
        mine = which[long == n]
        letters = np.array([list(a.ljust(n, b"\0")[:n]) for a in rows.alts], np.uint8).reshape(len(rows.alts), n)
        yield mine, Junction(rows.seq, rows.unit[mine], rows.cut[mine], rows.replaced[mine], letters[rows.alt[mine]])


def _described(rows: Rows, mine: np.ndarray, j: Junction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """effect, off and size of rows that have an effect."""
    seq, unit, cut, replaced = rows.seq, j.unit, rows.cut[mine], rows.replaced[mine]
    more = j.alt.shape[1]
    n, m, change, differs = seq.n[unit], j.length, more - replaced, j.offset()
    off = np.where((more == 1) & (replaced == 1), j.first, differs)
    # the first codon: of the cds, the new letters and what follows
    t = np.broadcast_to(np.arange(3), (len(mine), 3))
    inner = t - cut[:, None]
    before, behind = seq.at(unit[:, None], t), seq.at(unit[:, None], t + (replaced - more)[:, None])
    codon = np.where(inner < 0, before, behind)
    if more:
        codon = np.where((inner >= 0) & (inner < more), np.take_along_axis(j.alt, np.clip(inner, 0, more - 1), 1), codon)
    own = np.where(t < seq.bases[unit][:, None], before, 0)
    started = (cut >= 3) | (codon == own).all(axis=1)
    begins = (codon[:, None, :] == np.array([np.frombuffer(s.encode(), np.uint8) for s in STARTS])).all(axis=2).any(axis=1)
    told = [
        (~started & begins, "AlternateStartCodon"),
        (~started, "StartLoss"),
        ((m == n) & (differs > n), "Silent"),
        (change % 3 != 0, "FrameShift"),
        ((off < n) & (m == off), "PrematureStop"),
        ((change == 0) & (off >= n) & (m > n), "StopLoss"),
        (change == 0, "Substitution"),
        (change > 0, "Insertion"),
    ]
    effect = np.select([c for c, _ in told], [CODE[e] for _, e in told], CODE["Deletion"])
    lost = effect == CODE["StartLoss"]
    return effect, np.where(lost, -1, off), np.where(lost, -1, m)


def at_terminus(rows: Rows, end: str) -> np.ndarray:
    """hits_terminus() of rows; an unknown length is that of a substitution that still has a protein."""
    there = ((rows.size > 0) | (rows.size == -1)) & (rows.effect > 0)
    if end == "cterm":
        inside = of(SUBSTITUTIONS)[rows.effect] & (rows.off >= 0) & (rows.off > rows.seq.n[rows.unit] - TERMINAL)
        return there & (of((*INDELS, "PrematureStop"))[rows.effect] | inside)
    return there & of(SUBSTITUTIONS)[rows.effect] & (rows.off >= 0) & (rows.off <= 24)
