import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telospark.functions import sequences
from telospark.operators import annotate, filters, intervals, model, motifs, permutation, sampling
from telospark.plans import analysis
from telospark.sources import tables

RC = str.maketrans("ACGT", "TGCA")


def transcript(spark, strand="+"):
    cds = "ATGGCTGAACGTTTGCATTCGAAATGGTAA"  # MAERLHSKW*
    if strand == "+":
        ranges, stops = [(1, 12), (101, 115)], [116, 117, 118]
    else:
        ranges, stops = [(107, 118), (4, 18)], [1, 2, 3]
    row = ("T", "G", "1", strand, "protein_coding", True, cds, "GCCTAGC", [{"start": a, "end": b} for a, b in ranges], stops)
    df = spark.createDataFrame([row], tables.TRANSCRIPT_SCHEMA)
    return df.withColumn("protein", sequences.protein_of(F.col("cds")))


def places(strand):
    if strand == "+":
        return [*range(1, 13), *range(101, 119)]
    return [*range(118, 106, -1), *range(18, 0, -1)]


def effects(spark, strand, rows):
    """rows: (cds place, ref, alt) on the coding strand."""
    at, out = places(strand), []
    for p, ref, alt in rows:
        if strand == "+":
            out.append(("G", "T", "1", at[p], ref, alt))
        else:
            start = at[p + len(ref) - 1] if ref else at[p]
            out.append(("G", "T", "1", start, ref[::-1].translate(RC), alt[::-1].translate(RC)))
    df = spark.createDataFrame(out, "gene string, transcript_id string, contig string, start long, ref string, alt string").withColumn("n", F.monotonically_increasing_id())
    got, bad = analysis.annotated(df, transcript(spark, strand))
    return [(r.effect, r.aa_off, r.mut_protein, r.short) for r in got.orderBy("n").collect()], bad.count()


@pytest.mark.parametrize("strand", ["+", "-"])
def test_annotation_on_both_strands(spark, strand):
    rows = [
        (5, "T", "A"),  # GCT -> GCA, same residue
        (3, "G", "A"),  # A2T
        (6, "G", "T"),  # GAA -> TAA
        (27, "T", "C"),  # stop lost, on into the 3' end
        (0, "A", "C"),  # CTG
        (1, "T", "A"),  # AAG
        (9, "C", ""),  # frameshift
        (9, "CGT", ""),  # R4 deleted
        (3, "T", "A"),  # reference doesn't fit
    ]
    got, bad = effects(spark, strand, rows)
    assert [g[0] for g in got] == ["Silent", "Substitution", "PrematureStop", "StopLoss", "AlternateStartCodon", "StartLoss", "FrameShift", "Deletion"]
    assert bad == 1
    assert got[1][1:] == (1, "MTERLHSKW", "p.A2T")
    assert got[2][1:] == (2, "MA", "p.E3*")
    assert got[3][2].startswith("MAERLHSKWQA")
    assert got[5][2] is None
    assert got[6][1] == 3 and got[6][3] == "p.R4fs"
    assert got[7][1:] == (3, "MAELHSKW", "p.R4del")


@pytest.mark.parametrize("strand", ["+", "-"])
def test_genome_positions(spark, strand):
    got = annotate.with_positions(transcript(spark, strand)).first()["genome"]
    assert got == places(strand)


def test_nmd_classes(spark):
    df = spark.createDataFrame([(None,), ("",), ("M" * 9,), ("M",)], "m string")
    ranges = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))
    assert [r[0] for r in df.select(filters.nmd_class(F.col("m"), F.lit(24), filters.nmd_insensitive_length(ranges))).collect()] == [0.5, 0.5, 0.0, 1.0]


def test_terminal_rule_at_its_edges(spark):
    rows = [("Substitution", 77), ("Substitution", 78), ("FrameShift", 0), ("StartLoss", 90), ("NonCoding", 90)]
    df = spark.createDataFrame(rows, "effect string, off int")
    keep = df.where(filters.hits_terminus(F.col("effect"), F.col("off"), F.lit(9), F.lit(100), "cterm")).collect()
    assert [tuple(r) for r in keep] == [("Substitution", 78), ("FrameShift", 0), ("StartLoss", 90)]
    df = spark.createDataFrame([("Substitution", 24), ("Substitution", 25), ("FrameShift", 3)], "effect string, off int")
    keep = df.where(filters.hits_terminus(F.col("effect"), F.col("off"), F.lit(9), F.lit(100), "nterm")).collect()
    assert [r.off for r in keep] == [24]


def test_overlap_counts_intervals_once(spark):
    spans = spark.createDataFrame([("g", 5, 10), ("g", 8, 12)], "key string, start int, end int")
    rows = [("Substitution", 8), ("Substitution", 12), ("FrameShift", 0), ("PrematureStop", 11), ("PrematureStop", 10), ("Silent", 8)]
    df = spark.createDataFrame([("g", i, *r) for i, r in enumerate(rows)], "g string, i int, effect string, off int")
    got = intervals.with_key(df, spans, "g").orderBy("i").select(intervals.overlap(F.col("effect"), F.col("off"), F.col("spans"), F.col("last_end"))).collect()
    assert [r[0] for r in got] == [1, 0, 1, 0, 1, 0]
    assert intervals.in_any(df, spans, "g", F.col("off")).count() == 5


def test_draws_keep_context_and_repeat(spark):
    tx = spark.createDataFrame([("T", "ACGTTGCATCGATCGGATTACA")], "transcript_id string, cds string")
    slots = tx.select("transcript_id", "cds", F.explode(F.array(*map(F.lit, ["C*pG", "T", "A"]))).alias("context")).withColumn("slot", F.lit(0))
    index = sampling.context_positions(tx, 1.5)
    got = sampling.draws(slots, index, 0, 200)
    again = sampling.draws(slots.repartition(3), index, 100, 200)
    checked = got.select(sequences.context(F.col("cds"), F.col("drawn"), 1.5).alias("c"), "context")
    assert checked.where("c <> context").count() == 0
    assert again.join(got, ["context", "sim", "slot", "drawn"]).count() == 300
    assert got.where("context = 'A'").select("drawn").distinct().count() > 2
    odd = slots.limit(1).withColumn("context", F.lit("nope"))
    assert sampling.unseen(odd, index).count() == 1


def test_permutation_finds_a_cluster(spark):
    """All mutations inside the interval of one gene, spread out in the other."""
    rng = random.Random(5)
    codons = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in ("TAA", "TAG", "TGA")]
    rows, muts = [], []
    for gene in ("hot", "cold"):
        cds = "ATG" + "".join(rng.choice(codons) for _ in range(98)) + "TAA"
        rows.append((f"T{gene}", gene, "1", "+", "protein_coding", True, cds, "", [{"start": 1, "end": 297}], [298, 299, 300]))
        for i in range(24):
            p = rng.randrange(30, 60) if gene == "hot" else rng.randrange(3, 290)
            muts.append((gene, f"T{gene}", "1", p + 1, cds[p], rng.choice([b for b in "ACGT" if b != cds[p]])))
    tx = spark.createDataFrame(rows, tables.TRANSCRIPT_SCHEMA).withColumn("protein", sequences.protein_of(F.col("cds")))
    muts = spark.createDataFrame(muts, "gene string, transcript_id string, contig string, start long, ref string, alt string")
    spans = spark.createDataFrame([("hot", 10, 20), ("cold", 10, 20)], "key string, start int, end int")
    got = {r.gene: r for r in analysis.run("degrons", muts, tx, 200, spans=spans).collect()}
    assert got["hot"].pvalue < 0.02 < got["cold"].pvalue <= 1
    assert got["hot"].total_muts == 24 and got["hot"].qvalue >= got["hot"].pvalue
    with pytest.raises(ValueError):
        analysis.route({})
    assert analysis.route({"sites": "x", "cterm": "y"}) == "sites"


def _transcript(rng, name, gene, codons=40, strand="+", utr3="GCCTAAGC"):
    some = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in ("TAA", "TAG", "TGA")]
    cds = "ATG" + "".join(rng.choice(some) for _ in range(codons - 2)) + rng.choice(["TAA", "TAG", "TGA"])
    n = len(cds) - 3
    # two exons; the last one has 30 bases, so stops before its last 50 bases upstream decay
    return (name, gene, "1", strand, "protein_coding", True, cds, utr3, [{"start": 1, "end": n - 30}, {"start": n + 71, "end": n + 100}], [n + 101, n + 102, n + 103])


def _transcripts(spark, rows):
    return spark.createDataFrame(rows, tables.TRANSCRIPT_SCHEMA).withColumn("protein", sequences.protein_of(F.col("cds")))


MUTATION = "gene string, transcript_id string, contig string, start long, ref string, alt string"


def test_codon_effects_equal_annotation(spark):
    """Every substitution by its codon, and by its mutant protein."""
    rng = random.Random(3)
    tx = _transcripts(spark, [_transcript(rng, f"T{i}", "G") for i in range(4)])
    got = sampling.snv_effects(tx)
    each = got.select("transcript_id", "drawn", F.col("cds_ref").alias("ref"), F.col("cds_alt").alias("alt")).where("ref <> alt").join(tx, "transcript_id").withColumn("strand", F.lit("+"))
    want = annotate.annotate(each, at=F.col("drawn")).select("transcript_id", "drawn", F.col("alt").alias("cds_alt"), F.col("effect").alias("e"), F.col("aa_off").alias("o"), F.col("mut_protein").alias("m"), F.col("short").alias("s"))
    rows = got.where("cds_ref <> cds_alt").join(want, ["transcript_id", "drawn", "cds_alt"]).collect()
    assert len(rows) == 4 * 120 * 3
    for r in rows:
        assert (r.effect, r.aa_off) == (r.e, r.o), r
        assert r.effect != "Substitution" or r.short == r.s
        assert r.effect != "PrematureStop" or len(r.m) == r.aa_off
    assert got.where("cds_ref = cds_alt and effect is not null").count() == 0


def test_units_need_variants_that_decay_leaves(spark):
    """Only decaying indels: no row. Only decaying stops: a row of zero. Mixed: simulated by class."""
    rng = random.Random(6)
    rows = {k: _transcript(rng, f"T{k}", k, codons=300) for k in ("indels", "stops", "mixed")}
    muts = []
    for k, r in rows.items():
        cds = r[6]
        if k in ("indels", "mixed"):
            muts += [(k, f"T{k}", "1", 10 + i, cds[9 + i], "") for i in range(5)]  # early frameshifts
        if k == "mixed":
            muts += [(k, f"T{k}", "1", p + 1, cds[p], "ACGT"["ACGT".index(cds[p]) - 1]) for p in range(30, 36)]
    stop = rows["stops"][6]
    for p in range(3, 60):
        for b in "ACGT":
            codon = stop[p - p % 3 : p] + b + stop[p + 1 : p - p % 3 + 3]
            if b != stop[p] and codon in ("TAA", "TAG", "TGA"):
                muts.append(("stops", "Tstops", "1", p + 1, stop[p], b))
    assert any(m[0] == "stops" for m in muts)
    tx, m = _transcripts(spark, list(rows.values())), spark.createDataFrame(muts, MUTATION)
    spans = spark.createDataFrame([(k, 1, 300) for k in rows], "key string, start int, end int")
    got = {r.gene: r for r in analysis.run("degrons", m, tx, 60, spans=spans).collect()}
    assert "indels" not in got
    assert (got["stops"].num_degron_muts, got["stops"].pvalue) == (0, 1.0)
    assert got["mixed"].num_degron_muts >= 1 and got["mixed"].total_muts == 11
    cut = {r.gene: r for r in analysis.run("truncation", m, tx, 60).collect()}
    assert "indels" not in cut and cut["stops"].pvalue == 1.0


@pytest.mark.parametrize("draws", [4_000_000, 90])
def test_sites_equal_a_plain_simulation(spark, monkeypatch, draws):
    """The same draws, one by one in Python: statistic and p-value are equal, also where a unit is
    dealt into many ranges of simulations."""
    import hashlib

    monkeypatch.setattr(permutation, "DRAWS", draws)
    monkeypatch.setattr(permutation, "RANGE", 256 if draws > 90 else 7)
    rng = random.Random(12)
    rows = [_transcript(rng, f"T{i}", f"g{i}") for i in range(5)]
    muts = []
    for r in rows:
        cds = r[6]
        places = rng.sample(range(3, 86), 6)
        mine = [(r[1], r[0], "1", p + 1, cds[p], rng.choice([b for b in "ACGT" if b != cds[p]])) for p in places]
        muts += mine * (3 if r is rows[0] else 1)  # equal mutations are slots of their own
    spans = spark.createDataFrame([(r[0], 6, 16) for r in rows], "key string, start int, end int")
    tx = _transcripts(spark, rows)
    out = {r.gene: r for r in analysis.run("sites", spark.createDataFrame(muts, MUTATION), tx, 700, spans=spans).collect()}
    code = dict(zip([a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"], sequences.GENETIC_CODE))
    for r in rows:
        cds, name = r[6], r[0]
        tri = lambda p: cds[max(p - 1, 0)] + cds[p] + cds[min(p + 1, len(cds) - 1)]
        mine = sorted(((tri(m[3] - 1), m[3], m[4], m[5]) for m in muts if m[1] == name))
        size = len(cds) // 3 - 1
        safe = 30 / 3 + 50 / 3

        def hit(p, b):
            i = p // 3
            codon = cds[3 * i : 3 * i + 3]
            new = codon[: p % 3] + b + codon[p % 3 + 1 :]
            if i == 0 or i >= size or code[new] == code[codon]:
                return 0
            if code[new] == "*":
                return int(i + 1 < 16 and (i > size - safe or i == 0))
            return int(6 <= i + 1 <= 16)

        seen = sum(hit(s - 1, b) for _, s, _, b in mine)
        places = {}
        for p in range(len(cds)):
            places.setdefault(tri(p), []).append(p)
        hits = n = 0
        if seen:
            for sim in range(700):
                total = 0
                for slot, (t, _, _, b) in enumerate(mine):
                    x = int(hashlib.md5(f"101|{name}|{t}|{sim}|{slot}".encode()).hexdigest()[:8], 16)
                    total += hit(places[t][x % len(places[t])], b)
                hits += total >= seen
                n += 1
                if hits == 100:
                    break
        assert out[r[1]].num_site_muts == seen
        assert out[r[1]].pvalue == pytest.approx(hits / n if seen else 1.0), name


def test_indels_equal_a_plain_simulation(spark, monkeypatch):
    """Truncations of substitutions and indels together, drawn one by one in Python."""
    import hashlib

    from test_frames import plain

    monkeypatch.setattr(permutation, "DRAWS", 500)
    rng = random.Random(21)
    rows = [_transcript(rng, f"T{i}", f"g{i}", codons=60) for i in range(3)]
    muts = []
    for r in rows:
        cds = r[6]
        muts += [(r[1], r[0], "1", p + 1, cds[p], rng.choice([b for b in "ACGT" if b != cds[p]])) for p in rng.sample(range(3, 140), 5)]
        late = [p for p in range(120, 140)]
        muts += [(r[1], r[0], "1", p + 1, cds[p : p + k], "") for p, k in zip(late, (1, 2, 3, 1))]
        muts += [(r[1], r[0], "1", p + 1, "", a) for p, a in zip(late, ("A", "AC", "GGT"))]
    tx = _transcripts(spark, rows)
    out = {r.gene: r for r in analysis.run("truncation", spark.createDataFrame(muts, MUTATION), tx, 400).collect()}
    for r in rows:
        cds, name, utr3 = r[6], r[0], r[7]
        protein = sequences.GENETIC_CODE and "".join(dict(zip([a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"], sequences.GENETIC_CODE))[cds[i : i + 3]] for i in range(0, len(cds), 3)).split("*")[0]
        n, safe = len(protein), 30 / 3 + 50 / 3

        def told(p, ref, alt):
            """(whether it is placed, kept, truncating)"""
            got = plain(cds, utr3, protein, "+", p, ref, alt)
            if got is None:
                return None
            effect, _, new, _ = got
            decays = new is not None and new != "" and not len(new) > n - safe
            kept = effect != "PrematureStop" or not decays if len(ref) == len(alt) else not decays
            return kept, effect in ("FrameShift", "PrematureStop", "StopLoss")

        mine = [(m[3] - 1, m[4], m[5]) for m in muts if m[1] == name]
        tri = lambda p: cds[max(p - 1, 0)] + cds[p] + cds[min(p + 1, len(cds) - 1)]
        subs = sorted((tri(p), p, ref, alt) for p, ref, alt in mine if len(ref) == len(alt))
        indels = sorted((tri(p), p, ref, alt) for p, ref, alt in mine if len(ref) != len(alt))
        seen = sum(told(p, ref, alt)[1] for p, ref, alt in mine if told(p, ref, alt)[0])
        assert out[r[1]].num_truncations == seen > 0
        places = {}
        for p in range(len(cds)):
            places.setdefault(tri(p), []).append(p)
        number = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:8], 16)
        hits = runs = 0
        for sim in range(400):
            drawn = [told(q, cds[q], alt) for k, (t, _, _, alt) in enumerate(subs) for q in [places[t][number(101, name, t, sim, k) % len(places[t])]] if alt != cds[q]]
            drawn += [told(number(101, name, "None", sim, k) % len(cds), ref, alt) for k, (_, _, ref, alt) in enumerate(indels)]
            kept = [x[1] for x in drawn if x and x[0]]
            hits += not kept or sum(kept) <= seen
            runs += 1
            if hits == 100:
                break
        assert out[r[1]].pvalue == pytest.approx(hits / runs), name


def test_legacy_collapse(spark):
    """Variants are annotated on their own transcript; substitutions of another one don't count."""
    rng = random.Random(2)
    a, b = _transcript(rng, "T1", "g"), _transcript(rng, "T2", "g")
    muts = [("g", "T2", "1", p + 1, b[6][p], rng.choice([x for x in "ACGT" if x != b[6][p]])) for p in (20, 21, 40)] + [("g", "T1", "1", 5, a[6][4], "G" if a[6][4] != "G" else "C"), ("g", "T0", "1", 5, "A", "C")]
    tx, m = _transcripts(spark, [a, b]), spark.createDataFrame(muts, MUTATION)
    got, rejected = analysis.annotated(m, tx, "legacy")
    rows = got.collect()
    assert [r.reason for r in rejected.collect()] == ["no complete coding transcript"]
    assert len(rows) == 3 and {r.transcript_id for r in rows} == {"T1"} and {r.cds for r in rows} == {a[6]} and not any(r.own for r in rows)
    assert [r.transcript_id for r in rejected.collect()] == ["T0"]
    spans = spark.createDataFrame([("g", 1, 40)], "key string, start int, end int")
    assert analysis.run("degrons", m, tx, 20, spans=spans, mode="legacy").collect() == []
    simple = analysis.run("degrons_simple", m, tx, 20, spans=spans).collect()
    assert len(simple) == 2 and all(0 < r.pvalue <= 1 for r in simple)


def test_legacy_scores_take_a_gene_as_its_first_transcript(spark):
    """Variants of the last transcript, held against the first one's end; substitutions don't count."""
    from telospark.operators import score
    from telospark.plans.queries import fixed_models

    rng = random.Random(8)
    a, b = _transcript(rng, "T1", "g"), _transcript(rng, "T2", "g")
    lone = _transcript(rng, "T3", "h")
    n = len(b[6])
    sub = lambda r, g, p: (g, r[0], "1", p + 1 if p < n - 33 else p + 101, r[6][p], "ACGT"["ACGT".index(r[6][p]) - 1])
    muts = [sub(b, "g", n - 20), ("g", "T2", "1", n - 12 + 101, b[6][n - 12], ""), sub(a, "g", n - 20), sub(lone, "h", n - 20)]
    tx, m = _transcripts(spark, [a, b, lone]), spark.createDataFrame(muts, MUTATION)
    models = fixed_models("cterm")
    out = {mode: score.score_mutations(analysis.annotated(m, tx, mode)[0], *models, "cterm").collect() for mode in ("transcript", "legacy")}
    own = {(r.Hugo_Symbol, r.Transcript_ID, r.HGVSp_Short) for r in out["transcript"]}
    old = {(r.Hugo_Symbol, r.Transcript_ID, r.HGVSp_Short[-2:]) for r in out["legacy"]}
    assert {x[:2] for x in own} >= {("g", "T2"), ("h", "T3")} and len(own) >= 3
    assert {x[:2] for x in old} <= {("g", "T2"), ("h", "T3")} and all(x[2] == "fs" for x in old if x[0] == "g") and any(x[0] == "g" for x in old)
    wild = {r.transcript_id: r.potential for r in score.wild_type_scores(tx, *models, "cterm").collect()}
    for name, mode in (("T2", "transcript"), ("T1", "legacy")):
        got = [r for r in out[mode] if r.Hugo_Symbol == "g" and r.HGVSp_Short.endswith("fs")]
        scored = analysis.annotated(m, tx)[0].where("gene = 'g' and alt = ''").select(F.col("mut_end").alias("p"))
        mine = scored.select((models[0].predict(spark, F.col("p")) - models[1].predict(spark, F.col("p"))).alias("s")).first().s
        assert got[0]["delta degron potential"] == pytest.approx(mine - wild[name])


def test_training_learns_and_repeats(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.random((400, 20))
    y = (x[:, 3] > 0.5).astype(float)
    a, b = (model.train(x, y, 8, 0.0, epochs=400) for _ in range(2))
    assert all(np.array_equal(p, q) for l, m in zip(a, b) for p, q in zip(l, m))
    assert ((model.forward(a, x) > 0.5) == y).mean() > 0.9
    m = model.Model(a, 0, False, "cterm")
    m.save(spark, str(tmp_path / "m"))
    again = model.Model.load(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([("ACDEFGHIKLMNPQRSTVWYACD",), (None,)], "p string")
    one, two = (df.select(k.predict(spark, F.col("p"))).collect() for k in (m, again))
    assert one == two and one[1][0] is None
    with pytest.raises(ValueError):
        model.Model(a, 6, True, "cterm")


def test_dimotifs_against_a_loop(spark):
    rng = random.Random(8)
    peptides = ["".join(rng.choice("ACDE") for _ in range(10)) for _ in range(60)]
    df = spark.createDataFrame([(p, i + 1) for i, p in enumerate(peptides)], "peptide string, rank int")
    got = {r.motif: r for r in motifs.dimotifs(df, 20, "cterm").collect()}
    assert len(got) == 6000
    for m in ("xxxxAC", "DxxxEx", "xAxAxx"):
        hit = [all(a in ("x", b) for a, b in zip(m, p[-6:])) for p in peptides]
        assert (got[m].top_ct, got[m].bot_ct) == (sum(hit[:20]), sum(hit))
    got = {r.motif: r for r in motifs.chain_motifs(df, 3, 20, "nterm").where("motif in ('AAA', 'ACD', 'WWW')").collect()}
    assert got["AAA"].top_ct == sum(p[:6].count("AAA") for p in peptides[:20])
    one = {a: sum(p[:6].count(a) for p in peptides) / 360 for a in "ACD"}
    two = {d: sum(p[:6].count(d) for p in peptides) / 300 for d in ("AC", "CD")}
    assert got["ACD"].background_p == pytest.approx(two["AC"] * two["CD"] / one["C"])
    assert got["WWW"].background_p is None


def test_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Start_Position\tHugo_Symbol\tChromosome\tReference_Allele\tTumor_Seq_Allele2\tTranscript_ID\textra\n5\tG\t1\tA\t-\tT\tz\n6\tG\t2\t-\tC\tT\tz\n")
    got = tables.mutations(spark, str(tmp_path / "m.txt")).orderBy("start").collect()
    assert [tuple(r) for r in got] == [("G", "T", "1", 5, "A", ""), ("G", "T", "2", 6, "", "C")]
    assert tables.mutations(spark, str(tmp_path / "m.txt"), contig="2").count() == 1
    (tmp_path / "s.txt").write_text("ENST\tMOD_RSD\nT\t29\n")
    assert tuple(tables.sites(spark, str(tmp_path / "s.txt"), 3).first()) == ("T", 26, 32)
    (tmp_path / "d.txt").write_text("gene\tstart\tend\nG\t2\t9\n")
    assert tuple(tables.intervals(spark, str(tmp_path / "d.txt")).first()) == ("G", 2, 9)
    folder = tmp_path / "ddg"
    folder.mkdir()
    (folder / "G.txt").write_text("variant\ttotal energy\nA1B\t1.5\nA1B\t2.5\n")
    assert tuple(tables.energies(spark, str(folder)).first()) == ("G", "A1B", 2.5)
    (tmp_path / "p.txt").write_text("Peptide amino acid sequence\tModal Bin\tregulatory potential\tbag of amino acids\nAAA\t2.0\t0.5\tx\n")
    got = tables.peptides(spark, str(tmp_path / "p.txt"))
    assert got.columns[2:] == ["degron potential", "bag of words"] and got.first()[3] is None


def test_annotation_files_and_command_line(spark, tmp_path, capsys):
    """GTF and FASTA of both strands give the transcripts they were made from; the command line reads
    them, mutations with other headers, '-' alleles and long references, and writes what it rejects."""
    from telospark.plans import cli

    rng = random.Random(21)
    genome = "".join(rng.choice("ACGT") for _ in range(4000))
    comp = str.maketrans("ACGT", "TGCA")
    want, gtf, fasta = {}, ["#!genome-build toy"], []
    for k, strand in enumerate("+-"):
        codons = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in ("TAA", "TAG", "TGA")]
        cds = "ATG" + "".join(rng.choice(codons) for _ in range(48)) + "TGA"
        mrna = "GGGCC" + cds + "ACCTTTAA"
        # exons of the mRNA: 40, 60 and the rest, with gaps of 25
        sizes, at, exons = [40, 60, len(mrna) - 100], 100 + 1000 * k, []
        for n in sizes if strand == "+" else sizes[::-1]:
            exons.append((at + 1, at + n))
            at += n + 25
        order = exons if strand == "+" else exons[::-1]
        place = [p for a, b in order for p in (range(a, b + 1) if strand == "+" else range(b, a - 1, -1))]
        g = list(genome)
        for base, p in zip(mrna, place):
            g[p - 1] = base if strand == "+" else base.translate(comp)
        genome = "".join(g)
        name = f"ENST0000{k}"
        note = f'gene_id "G{k}.2"; transcript_id "{name}.3"; gene_name "GENE{k}"; transcript_biotype "protein_coding";'
        coding, stop = place[5 : 5 + len(cds) - 3], sorted(place[5 + len(cds) - 3 : 5 + len(cds)])
        cut = [(max(a, min(coding)), min(b, max(coding))) for a, b in exons if max(a, min(coding)) <= min(b, max(coding))]
        for feature, spots in (("exon", exons), ("CDS", cut), ("start_codon", [(min(coding[:3]), max(coding[:3]))]), ("stop_codon", [(stop[0], stop[-1])])):
            gtf += ["\t".join(["7", "toy", feature, str(a), str(b), ".", strand, ".", note]) for a, b in spots]
        fasta += [f">{name}.3 cdna chromosome:7 gene:G{k}", *[mrna[i : i + 60] for i in range(0, len(mrna), 60)]]
        want[name] = (f"GENE{k}", strand, cds, "ACCTTTAA", place[5 : 5 + len(cds)], stop)
    gtf.append("\t".join(["7", "toy", "exon", "3000", "3100", ".", "+", ".", 'gene_id "G9"; transcript_id "ENST9"; transcript_biotype "lncRNA";']))
    (tmp_path / "a.gtf").write_text("\n".join(gtf) + "\n")
    (tmp_path / "a.fa").write_text("\n".join(fasta) + "\n")
    got = {r.transcript_id: r for r in annotate.with_positions(tables.annotation(spark, str(tmp_path / "a.gtf"), str(tmp_path / "a.fa"))).collect()}
    assert got.keys() == want.keys()
    at, index = 0, []
    for line in (tmp_path / "a.fa").read_text().splitlines():
        at += len(line) + 1
        if line.startswith(">"):
            index.append([line[1:].split()[0], 0, at, 60, 61])
        else:
            index[-1][1] += len(line)
    (tmp_path / "a.fa.fai").write_text("".join("\t".join(map(str, x)) + "\n" for x in index))
    by_index = tables.annotation(spark, str(tmp_path / "a.gtf"), str(tmp_path / "a.fa"), contig="7", indexed=True)
    assert sorted(map(str, annotate.with_positions(by_index).collect())) == sorted(map(str, got.values()))
    assert tables.annotation(spark, str(tmp_path / "a.gtf"), str(tmp_path / "a.fa"), contig="8").count() == 0
    for k, (gene, strand, cds, utr3, place, stop) in want.items():
        r = got[k]
        assert (r.gene, r.strand, r.cds, r.utr3, r.complete, r.genome, r.stop_positions) == (gene, strand, cds, utr3, True, place, stop)
    rows = ["Tumor_Sample_Barcode\tTranscript_ID\tChromosome\tStart_Position\tHugo_Symbol\tTumor_Seq_Allele2\tReference_Allele"]
    for k, (gene, strand, cds, _, place, _) in want.items():
        for i in range(20, 32):
            ref = genome[place[i] - 1]
            rows.append(f"S{i}\t{k}\t7\t{place[i]}\t{gene}\t{'ACGT'['ACGT'.index(ref) - 1]}\t{ref}")
        rows.append(f"S\t{k}\t7\t{place[30]}\t{gene}\t-\t{genome[place[30] - 1]}")
        rows.append(f"S\t{k}\t7\t{place[30]}\t{gene}\t-\t{'A' * 11}")
        rows.append(f"S\t{k}\t7\t{place[30]}\t{gene}\tC\tN")
        rows.append(f"S\t{k}\t8\t{place[30]}\t{gene}\tC\tA")
    rows.append("S\tENST777\t7\t5\tNONE\tC\tA")
    (tmp_path / "m.txt").write_text("\n".join(rows) + "\n")
    (tmp_path / "d.txt").write_text("gene\tstart\tend\nGENE0\t5\t12\nGENE1\t5\t12\n")
    files = f"{tmp_path / 'a.gtf'},{tmp_path / 'a.fa'}"
    cli.main(["test", "-i", str(tmp_path / "m.txt"), "-x", files, "-d", str(tmp_path / "d.txt"), "-ns", "30", "--chromosome", "7", "--rejects", str(tmp_path / "r"), "-o", str(tmp_path / "o")], spark)
    out = {r.gene: r for r in tables.scan(spark, str(tmp_path / "o")).collect()}
    assert out.keys() == {"GENE0", "GENE1"}
    assert [(0 <= float(r.pvalue) <= 1, r.total_muts, float(r.num_degron_muts) >= 4) for r in out.values()] == [(True, "13", True)] * 2
    bad = tables.scan(spark, str(tmp_path / "r")).collect()
    assert sorted((r.transcript_id, r.reason) for r in bad) == sorted([("ENST777", "no complete coding transcript")] + [(k, "allele with N or too long") for k in want for _ in range(2)])
    said = capsys.readouterr().out
    assert "mutations: 31" in said and "no complete coding transcript: 1" in said and "allele with N or too long: 4" in said and "doesn't fit the transcript: 0" in said
    cli.main(["test", "-i", str(tmp_path / "m.txt"), "-x", files, "-d", str(tmp_path / "d.txt"), "--simple", "--mode", "legacy", "-ns", "20", "-o", str(tmp_path / "s")], spark)
    assert tables.scan(spark, str(tmp_path / "s")).count() == 2


def test_ranks_without_a_task_that_sees_all(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "v long, i long").repartition(7)
    got = filters.rank_rows(df, [F.desc("v"), "i"])
    assert [(r.v, r.i) for r in got.orderBy("rank").collect()] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["rank"] for r in got.select("rank").collect()) == list(range(1, 2001))
    dealt = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 1500
    assert filters.two_sided_trim(df, [F.desc("v"), "i"], 30).count() == 1940
    assert filters.rank_rows(df.limit(0), ["v"]).collect() == []


def test_numbers_in_tasks_equal_md5(spark):
    """Also across digits of the simulation, and for messages of more than one block."""
    import hashlib

    before = [b"101|T1|ACG|", b"101|T22|None|", b"101|" + b"x" * 41 + b"|A|", b"101|" + b"x" * 80 + b"|A|"]
    after = [b"|0", b"|17", b"|3", b"|400"]
    got = sampling.numbers(before, after, 7, 1203)
    for i, (x, y) in enumerate(zip(before, after)):
        assert got[i].tolist() == [int(hashlib.md5(x + b"%d" % k + y).hexdigest()[:8], 16) for k in range(7, 1203)]
    pick = sampling.draw([F.lit(101), F.lit("T1"), F.lit("ACG"), F.col("id"), F.lit(0)], F.lit(1000))
    assert [r[0] for r in spark.range(7, 1203).select(pick).collect()] == (got[0] % 1000).tolist()


def test_potentials_of_substitutions_equal_annotated_ones(spark):
    """Windows that are read off the protein, stops that are lost, and a protein that isn't its frame's."""
    from telospark.operators import score
    from telospark.plans.queries import fixed_models

    rng = random.Random(31)
    rows = [_transcript(rng, f"T{i}", f"g{i}", codons=k) for i, k in enumerate((32, 60, 12))]
    tx = _transcripts(spark, rows).withColumn("protein", F.when(F.col("transcript_id") == "T1", F.concat(F.lit("M"), F.substring("protein", 2, 40), F.lit("A"), F.substring("protein", 43, 99))).otherwise(F.col("protein")))
    units = permutation.dimension(tx).join(tx.select("transcript_id", "gene"), "transcript_id").withColumn("unit", F.col("transcript_id"))
    for end in ("cterm", "nterm"):
        models = fixed_models(end)
        got = {r.unit: r for r in permutation.substitution_table(units, permutation.TERMINAL, permutation.Potential(*models, end)).collect()}
        each = sampling.snv_effects(units, "unit", [c for c in units.columns if c != "unit"]).where("effect is not null")
        size = F.when(F.col("effect") == "PrematureStop", F.col("aa_off")).otherwise(1)
        told = each.select("unit", "drawn", "cds_alt", F.col("effect").alias("e"), F.col("aa_off").alias("o"), size.alias("size"), *permutation._SEQUENCES, F.col("cds_ref").alias("ref"), F.col("cds_alt").alias("alt"), F.lit("+").alias("strand"))
        told = score.windows(annotate.annotate(told, at=F.col("drawn")), end).withColumns({"effect": F.col("e"), "aa_off": F.col("o"), "mut_length": F.col("size")})
        want = score.with_delta(told, *models, end).select("unit", "drawn", "cds_alt", "delta").collect()
        kept = [r for r in want if got[r.unit].flags[4 * r.drawn + "ACGT".index(r.cds_alt)] == 2]
        assert len(kept) > 200 and any(abs(r.delta) > 1e-3 for r in kept)
        for r in kept:
            assert got[r.unit]["values"][4 * r.drawn + "ACGT".index(r.cds_alt)] == pytest.approx(r.delta, abs=1e-12), r
        assert sum(v is not None for u in got.values() for v in u["values"]) == len(kept)


def test_sure_slots_need_no_draws(spark, monkeypatch):
    """A unit whose contexts add the same at all their places makes no number at all."""
    cds = "ATG" + "ACC" * 30 + "TAA"
    row = ("T", "g", "1", "+", "protein_coding", True, cds, "", [{"start": 1, "end": 93}], [94, 95, 96])
    muts = spark.createDataFrame([("g", "T", "1", p + 1, cds[p], "G") for p in (9, 12, 12)], MUTATION)
    spans = spark.createDataFrame([("T", 1, 200)], "key string, start int, end int")
    monkeypatch.setattr(sampling, "numbers", None)
    (got,) = analysis.run("sites", muts, _transcripts(spark, [row]), 300, spans=spans).collect()
    assert (got.num_site_muts, got.pvalue) == (3, 1.0)
