"""Effects at every place, worked out on arrays, against annotation; draws of many units together."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from telospark.functions.sequences import PEPTIDE, terminal_window
from telospark.operators import annotate, permutation, places, sampling
from test_operators import _transcript, _transcripts

ALLELES = [("N", ""), ("NN", ""), ("NNN", ""), ("N" * 9, ""), ("", "A"), ("", "TAG"), ("", "ACGTAC"), ("", "ACGTTGCAATGA"), ("CA", "G"), ("A", "GCTT"), ("G", "TTTT"), ("a", "gc"), ("T", "A"), ("CAT", "CAG"), ("CTA", "CTG"), ("ATG", "CTG")]
READ = ["unit", "transcript_id", "strand", "cds", "utr3", "protein", "safe"]


def units(spark, seed=17):
    """Both strands; a protein that isn't its frame's, one without a stop behind it, unknown bases, a short cds, no protein."""
    rng = random.Random(seed)
    rows = [_transcript(rng, f"T{i}", f"g{i}", codons=k, strand=s) for i, (k, s) in enumerate(((34, "+"), (34, "-"), (30, "+"), (30, "-"), (26, "+"), (8, "-"), (12, "+")))]
    rows[4] = (*rows[4][:6], rows[4][6][:30] + "NAcg" + rows[4][6][34:-3], "", *rows[4][8:])
    tx = _transcripts(spark, rows)
    odd = F.concat(F.left("protein", F.lit(9)), F.lit("U"), F.substring("protein", 11, 99))
    tx = tx.withColumn("protein", F.when(F.col("transcript_id").isin("T2", "T3"), odd).when(F.col("transcript_id") != "T6", F.col("protein")))
    tx = permutation.dimension(tx).withColumn("unit", F.col("transcript_id")).withColumn("safe", F.lit(26.5)).orderBy("unit")
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in tx.select(*READ).collect()], pa.schema([(c, pa.float64() if c == "safe" else pa.string()) for c in READ]))
    return tx, batch


def text(row):
    return row[row > 0].astype(np.uint8).tobytes().decode()


def test_indels_equal_annotation(spark):
    tx, batch = units(spark)
    seq = places.Sequences(batch)
    pairs = [(u, a) for u in range(seq.units) for a in ALLELES]
    got = places.indels(seq, np.array([u for u, _ in pairs]), [a for _, a in pairs])
    given = spark.createDataFrame([(u, i, *a) for i, (u, a) in ((i, (f"T{u}", a)) for i, (u, a) in enumerate(pairs))], "unit string, i int, ref string, alt string")
    each = given.join(tx, "unit").withColumn("drawn", F.explode(F.sequence(F.lit(0), F.length("cds") - 1))).withColumn("start", F.lit(0).cast("long"))
    want = annotate.annotate(each, at=F.col("drawn")).select("effect", "aa_off", "mut_length", "mut_end", terminal_window(F.col("mut_protein"), "nterm").alias("begin"), "i", "drawn").orderBy("i", "drawn").collect()
    assert len(want) == len(got) and len({r.effect for r in want}) >= 8
    end, begin = {}, {}
    for mine, j in places.junctions(got, np.flatnonzero(got.effect > 0)):
        end |= dict(zip(mine.tolist(), map(text, j.window("cterm"))))
        begin |= dict(zip(mine.tolist(), map(text, j.window("nterm"))))
    for k, r in enumerate(want):
        mine = (places.EFFECTS[got.effect[k]] or None, *(None if x < 0 else x for x in (got.off[k], got.size[k])))
        assert mine == (r.effect, r.aa_off, r.mut_length), (r, pairs[r.i])
        if r.effect not in (None, "StartLoss"):
            assert (end[k], begin[k]) == (r.mut_end, r.begin), (r, pairs[r.i])
        n = seq.n[got.unit[k]]
        assert got.kept[k] == (r.effect is not None and (not r.mut_length or r.mut_length > n - 26.5))
    assert max(map(len, end.values())) == PEPTIDE


def test_substitutions_equal_codon_effects(spark):
    tx, batch = units(spark)
    seq = places.Sequences(batch)
    got = places.substitutions(seq, nmd=True)
    want = sampling.snv_effects(tx, "unit").orderBy("unit", "drawn", "cds_alt").collect()
    assert len(want) == len(got) == 4 * seq.bases.sum()
    for k, r in enumerate(want):
        off = None if got.off[k] < 0 else got.off[k]
        assert (places.EFFECTS[got.effect[k]] or None, off) == (r.effect, r.aa_off), r
        assert r.short is None or r.short[-1] == chr(got.letter[k])


def test_many_units_are_drawn_together(monkeypatch):
    """Three hundred units take little more hashing calls than one."""
    calls = []
    monkeypatch.setattr(sampling, "_heads", lambda *a, f=sampling._heads: calls.append(1) or f(*a))
    made = {}
    for n in (1, 300):
        calls.clear()
        e = 5 * n
        base = {"heads": [f"T{1000 + u}|" for u in range(n)], "unit": np.repeat(np.arange(n), 5), "context": ["A"] * e, "names": None}
        base |= {"first": np.repeat(np.arange(n) * 8, 5), "size": np.full(e, 8), "add": np.zeros(e, int), "slot": np.tile(np.arange(5), n), "m": np.ones(e, int)}
        base |= {"spots": np.arange(8 * n), "flags": np.full(8 * n, 2, np.int8), "values": np.tile([0, 0, 0, 1.0, 0, 1, 0, 0], n)}
        hits, at = permutation._Draws(base, permutation.SITE, 101).found(np.full(n, 1.0), np.full(n, 5.0), 0, 1000)
        made[n] = len(calls)
        assert (hits >= 100).all() and all(len(x) == 100 for x in at)
        alone = [at[0]] if n == 1 else alone + [at[0]]
    assert alone[0] == alone[1] and made[300] <= 6 * made[1]


def test_energies_are_sent_or_joined_and_variants_annotated_once(spark, monkeypatch):
    from telospark.plans import analysis

    rng = random.Random(8)
    rows = [_transcript(rng, f"T{i}", f"g{i % 2}", codons=40, strand="+-"[i % 2]) for i in range(4)]
    muts = []
    for r in rows[::2]:
        muts += [(r[1], r[0], "1", p + 1, r[6][p], rng.choice([b for b in "ACGT" if b != r[6][p]])) for p in rng.sample(range(3, 85), 9)]
    tx, muts = _transcripts(spark, rows), spark.createDataFrame(muts, "gene string, transcript_id string, contig string, start long, ref string, alt string")

    def rule(variants):
        return variants.where("effect = 'Substitution'").selectExpr("gene", "substring(short, 3) as variant", "double(aa_off % 5) - 1 as ddg").distinct()

    made, real = [], analysis.annotated
    monkeypatch.setattr(analysis, "annotated", lambda *a, **k: made.append(1) or real(*a, **k))
    got = []
    for few in (500_000, 0):
        monkeypatch.setattr(permutation, "FEW", few)
        got.append(sorted(map(tuple, analysis.run("stability", muts, tx, 300, energies=rule).collect())))
    table = rule(permutation.narrow(real(muts, tx)[0]))
    got.append(sorted(map(tuple, analysis.run("stability", muts, tx, 300, energies=table).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 2 and any(0 < r[2] < 1 for r in got[0]) and len(made) == 3
