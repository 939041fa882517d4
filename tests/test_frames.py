"""Variant effects by reading frames, against translation of whole mutant sequences in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from telospark.functions import sequences
from telospark.operators import annotate, frames, intervals

CODE = dict(zip([a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"], sequences.GENETIC_CODE))
SENSE = [c for c, a in CODE.items() if a != "*"]
RC = str.maketrans("ACGT", "TGCA")


def translated(s):
    return "".join(CODE.get(s[i : i + 3], "X") for i in range(0, len(s) - 2, 3)).split("*")[0]


def plain(cds, utr3, protein, strand, at, ref, alt):
    """(effect, aa_off, mutant protein, short) of a variant that fits."""
    insertion = ref == ""
    cut = at + 1 if insertion and strand == "+" else at
    if alt == "" and not insertion:
        ref = cds[cut : cut + len(ref)]
    elif cds[cut : cut + len(ref)] != ref:
        return None
    full = cds[:cut] + alt + cds[cut + len(ref) :] + (utr3 or "")
    new, n = translated(full), len(protein)
    a, b = protein + "*", new + "*"
    differs = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    off = cut // 3 if len(ref) == len(alt) == 1 else differs
    change = len(alt) - len(ref)
    if full[:3] != cds[:3]:
        effect = "AlternateStartCodon" if full[:3] in annotate.STARTS else "StartLoss"
    elif new == protein:
        effect = "Silent"
    elif change % 3:
        effect = "FrameShift"
    elif off < n and len(new) == off:
        effect = "PrematureStop"
    elif change == 0:
        effect = "StopLoss" if off >= n and len(new) > n else "Substitution"
    else:
        effect = "Insertion" if change > 0 else "Deletion"
    lead = f"p.{a[off : off + 1]}{off + 1}"
    short = {"FrameShift": lead + "fs", "Deletion": lead + "del", "Insertion": lead + "ins", "Silent": "silent", "StartLoss": "p.M1?", "AlternateStartCodon": "p.M1?"}.get(effect, lead + b[off : off + 1])
    return (effect, None, None, short) if effect == "StartLoss" else (effect, off, new, short)


def variants(seed, per=90):
    """Transcripts with repeats, without and with long 3' ends, with stops inside, and with a protein
    that isn't what the sequence codes for; variants of all kinds at all places of both strands."""
    rng = random.Random(seed)
    for t in range(8):
        pool = SENSE if t % 2 else rng.sample(SENSE, 2)
        cds = "ATG" + "".join(rng.choice(pool) for _ in range(30)) + "TAA"
        if t == 5:
            cds = "ATG" + "".join(rng.choice(SENSE) for _ in range(5)) + "TGA" + "".join(rng.choice(SENSE) for _ in range(9)) + "TAG"
        utr3 = ["", "GCCTAAGC", "G", None, "CCTGACC" * 3][t % 5]
        protein = translated(cds)
        protein = protein[:20] + "U" + protein[21:] if t == 6 else protein
        for strand in "+-":
            for _ in range(per):
                kind, p = rng.choice(["snv", "mnv", "del", "ins", "delins"]), rng.randrange(len(cds))
                size = {"snv": 1, "mnv": 3, "del": rng.choice([1, 2, 3, 6]), "ins": 0, "delins": rng.choice([1, 2, 3])}[kind]
                ref = cds[p : p + size]
                new = {"snv": 1, "mnv": len(ref), "del": 0, "ins": rng.choice([1, 2, 3, 6, 9]), "delins": rng.choice([1, 2, 4])}[kind]
                alt = cds[p + 1 : p + 1 + new] if kind == "ins" and rng.random() < 0.5 else "".join(rng.choice("ACGT") for _ in range(new))
                yield cds, utr3, protein, strand, p, ref, alt


@pytest.mark.parametrize("seed", [1, 2])
def test_effects_equal_translation_of_whole_mutants(spark, seed):
    want, rows = {}, []
    for i, (cds, utr3, protein, strand, p, ref, alt) in enumerate(variants(seed)):
        want[i] = plain(cds, utr3, protein, strand, p, ref, alt)
        given = (ref, alt) if strand == "+" else (ref[::-1].translate(RC), alt[::-1].translate(RC))
        rows.append((i, cds, utr3, protein, strand, p, *given))
    df = spark.createDataFrame(rows, "i int, cds string, utr3 string, protein string, strand string, p int, ref string, alt string").withColumn("start", F.lit(0).cast("long"))
    for r in annotate.annotate(df, at=F.col("p")).collect():
        w = want[r.i]
        assert (r.effect, r.aa_off, r.mut_protein, r.short) == (w or (None,) * 4), rows[r.i]
        if w and w[2] is not None:
            assert (r.mut_length, r.mut_end) == (len(w[2]), w[2][-23:]), rows[r.i]


def test_stops_are_the_next_in_each_frame(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ACGT") for _ in range(n)), u) for n, u in ((0, ""), (1, ""), (2, "A"), (60, None), (200, "TAATAG"), (31, "C"))]
    df = spark.createDataFrame(rows, "cds string, utr3 string").withColumn("protein", F.lit("M"))
    for r in frames.with_frames(df).collect():
        s = r.cds + (r.utr3 or "")
        for i in range(len(s) + 1):
            at = i
            while at + 3 <= len(s) and CODE[s[at : at + 3]] != "*":
                at += 3
            assert r.stops[i] == at
        assert [x.split("*")[0] for x in r.frames] == [translated(s[k:]) for k in range(3)]


def test_no_mutant_is_translated_for_lengths(spark):
    """Where only lengths and ends are read, the plan makes no whole mutant protein."""
    df = spark.createDataFrame([(0, "ATGTAA", "", "M", "+", 3, "T", "A", 0)], "i int, cds string, utr3 string, protein string, strand string, p int, ref string, alt string, start long")
    got = annotate.annotate(frames.with_frames(df), at=F.col("p")).select("effect", "mut_length")
    assert "_v" in got._jdf.queryExecution().optimizedPlan().toString() and got.first() == ("StopLoss", 2)


def test_many_intervals_by_bisection(spark):
    rng = random.Random(3)
    spans = [("a", s, s + rng.randrange(-1, 6)) for s in (rng.randrange(5000) for _ in range(1500))] + [("b", 7, 7), ("c", 9, 3)]
    df = spark.createDataFrame(spans, "key string, start int, end int")
    got = {r.key: r for r in intervals.disjoint(df).collect()}
    flat = [(s.start, s.end) for s in got["a"].spans]
    assert flat == sorted(flat) and all(x[1] < y[0] for x, y in zip(flat, flat[1:])) and got["c"].spans == [] and got["c"].last_end == 3
    points = spark.createDataFrame([(k, p) for k in "abc" for p in range(-3, 5100, 1 if k == "a" else 4)], "key string, p int")
    hit = points.join(intervals.disjoint(df), "key").select("key", "p", intervals.covered(F.col("p"), F.col("spans")).alias("hit")).collect()
    for r in hit:
        assert r.hit == any(k == r.key and s <= r.p <= e for k, s, e in spans)
