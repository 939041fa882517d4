import contextlib
import io
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telospark.functions import features, sequences, stats


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_reverse_complement(spark):
    df = col(spark, ["ACGT", "aacgN-", "", "AXG", None])
    assert values(df, sequences.reverse_complement(F.col("v"))) == ["ACGT", "-Ncgtt", "", None, None]
    twice = sequences.reverse_complement(sequences.reverse_complement(F.col("v")))
    assert values(df.limit(3), twice) == ["ACGT", "aacgN-", ""]


def test_contexts_of_all_trinucleotides(spark):
    def expect(t):
        if t[1:] == "CG":
            return "C*pG"
        if t[:2] == "CG":
            return "CpG*"
        if t[:2] == "TC":
            return "TpC*"
        return "G*pA" if t[1:] == "GA" else t[1]

    tri = ["".join(t) for t in itertools.product("ACGT", repeat=3)]
    assert values(col(spark, tri), sequences.chasm_context(F.col("v"))) == [expect(t) for t in tri]
    df = col(spark, ["ACG"]).select(F.explode(F.array(*[sequences.trinucleotide(F.col("v"), F.lit(i)) for i in range(3)])).alias("v"))
    assert values(df, F.col("v")) == ["AAC", "ACG", "CGG"]
    assert [len(sequences.context_names(k)) for k in (0, 1, 1.5, 2, 3)] == [1, 4, 8, 16, 64]


def test_translation(spark):
    df = col(spark, ["ATGGCCTAAGG", "atgt", "", "ATGNNN", None])
    assert values(df, sequences.translate(F.col("v"))) == ["MA*", "M", "", "MX", None]
    assert values(df.limit(1), sequences.protein_of(F.col("v"))) == ["MA"]


def test_motifs(spark):
    df = col(spark, ["GGAAAAAA", "RA", "XDEKR"])
    assert values(df, sequences.motif_anywhere(F.col("v"), "AA", "cterm")) == [3, 0, 0]
    assert values(df, sequences.motif_at_end(F.col("v"), "KxR", "cterm")) == [0, 0, 0]
    assert values(df, sequences.motif_at_end(F.col("v"), "ExR", "cterm")) == [0, 0, 1]
    assert values(df, sequences.strip_prefix(F.col("v"))) == ["AAAAAA", "", "EKR"]


def python_features(s, split, dinuc, end, compat):
    from telospark.operators.model import matrix

    return matrix(pd.Series([s]), split, dinuc, end, compat)[0]


@pytest.mark.parametrize("end", ["cterm", "nterm"])
@pytest.mark.parametrize("compat", [True, False])
def test_features_agree_with_python(spark, end, compat):
    rng = random.Random(4)
    peptides = ["".join(rng.choice(sequences.RESIDUES + "U") for _ in range(23)) for _ in range(6)]
    for split, dinuc in ((0, False), (6, True), (12, False), (23, True)):
        got = values(col(spark, peptides), features.terminal_features(F.col("v"), split, dinuc, end, compat))
        for p, g in zip(peptides, got):
            assert len(g) == features.feature_width(split, dinuc)
            np.testing.assert_array_equal(g, python_features(p, split, dinuc, end, compat))


def test_compat_leaves_the_end_position_empty(spark):
    df = col(spark, ["A" * 22 + "W"])
    w = sequences.RESIDUES.index("W")
    assert values(df, features.terminal_features(F.col("v"), 6, False, "cterm"))[0][20 + w] == 0
    assert values(df, features.terminal_features(F.col("v"), 6, False, "cterm", compat=False))[0][20 + w] == 1


def test_unknown_letters_have_no_dimers(spark):
    assert values(col(spark, ["AB", "AU", "AR"]), F.aggregate(features.dimer_counts(F.col("v")), F.lit(0.0), lambda a, b: a + b)) == [None, 0.0, 1.0]


def bh(p):
    n, out = len(p), {}
    order = sorted(range(n), key=lambda i: p[i])
    low = 1.0
    for r in range(n, 0, -1):
        low = min(low, p[order[r - 1]] * n / r)
        out[order[r - 1]] = low
    return [out[i] for i in range(n)]


def test_bh_fdr(spark):
    rng = random.Random(1)
    p = [round(rng.random() ** 2, 2) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(p)), "i int, pvalue double")
    got = {r.i: r.qvalue for r in stats.bh_fdr(df).collect()}
    for i, q in enumerate(bh(p)):
        assert got[i] == pytest.approx(q)
        assert got[i] >= p[i] - 1e-12
    df = spark.createDataFrame([(0, 0.01), (1, float("nan")), (2, None)], "i int, pvalue double")
    got = {r.i: r.qvalue for r in stats.bh_fdr(df).collect()}
    assert got[0] == pytest.approx(0.02) and math.isnan(got[1]) and got[2] is None


def test_early_stop_equals_a_loop(spark):
    rng = random.Random(2)
    for rate in (0, 0.05, 0.5, 1):
        hits = [rng.random() < rate for _ in range(300)]
        n = h = 0
        for x in hits:
            n, h = n + 1, h + x
            if h >= 20:
                break
        df = spark.createDataFrame([("u", i, x) for i, x in enumerate(hits)], "u string, sim int, hit boolean")
        r = stats.early_stopped_pvalue(df, "hit", "sim", ["u"], 20).first()
        assert (r.n_sims, r.pvalue) == (n, pytest.approx(h / n))


def test_auc_by_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 9)) for _ in range(80)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    expect = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert stats.roc_auc(spark.createDataFrame(rows, "y int, s int"), "y", "s").first()[0] == pytest.approx(expect)
    assert stats.roc_auc(spark.createDataFrame([(1, 2)], "y int, s int"), "y", "s").first()[0] is None


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.5), (20, 0.3), (400, 0.01), (1500, 0.7)):
        q = Fraction(p)
        total = Fraction(0)
        for k in range(n, -1, -1):
            total += math.comb(n, k) * q**k * (1 - q) ** (n - k)
            if k % max(1, n // 15) == 0:
                assert stats.tail(k, n, p) == pytest.approx(float(total), rel=1e-9, abs=1e-300)
    assert stats.tail(0, 5, 0.0) == 1 and stats.tail(1, 5, 0.0) == 0 and stats.tail(5, 5, 1.0) == 1 and stats.tail(6, 5, 0.5) == 0
    assert stats.tail(32_000, 32_000, 0.95) == 0 or stats.tail(32_000, 32_000, 0.95) < 1e-300


def test_log2_odds_keeps_infinities(spark):
    df = spark.createDataFrame([(0, 5), (5, 5), (2, 4)], "a int, n int")
    got = values(df, stats.log2_odds(F.col("a"), F.col("n"), F.lit(1), F.lit(2)))
    assert got[0] == -math.inf and got[1] == math.inf and got[2] == 0
    assert math.isnan(values(df.limit(1), stats.log2_odds(F.col("a"), F.col("n"), F.lit(0), F.lit(2)))[0])


def test_knee():
    x = list(range(1, 101))
    assert 8 <= stats.knee(x, [1 / v for v in x]) <= 12
    assert stats.knee(x, [5.0] * 100) is None


def test_binomial_tails_against_long_arithmetic():
    """Relative error below 1e-11 for n up to 32,000."""
    import math
    from decimal import Decimal, localcontext

    rng = random.Random(1)
    with localcontext() as ctx:
        ctx.prec = 60
        for n in (1, 2, 16, 17, 100, 800, 32_000):
            for _ in range(8):
                p = rng.choice([rng.random(), rng.random() ** 4, 1 / 400, 1 / 8000])
                k = min(n, max(1, int(n * p + rng.gauss(0, 3) * (n * p * (1 - p)) ** 0.5 + rng.choice([0, 3, 20]))))
                x, q, total = Decimal(p), 1 - Decimal(p), Decimal(0)
                term = Decimal(math.comb(n, k)) * x**k * q ** (n - k)
                for i in range(k, n + 1):
                    total += term
                    term = term * (n - i) / (i + 1) * x / q
                    if i > n * p and term < total * Decimal(10) ** -40:
                        break
                if total > Decimal(10) ** -290:
                    assert abs((Decimal(stats.tail(k, n, p)) - total) / total) < Decimal(10) ** -11, (k, n, p)
    assert stats.tails([0, 3, 2, 2, 2], [5, 2, 5, 5, 0], [0.5, 0.5, 0.0, 1.0, 0.5]).tolist() == [1.0, 0.0, 0.0, 1.0, 0.0]


def test_q_values_by_ranges_equal_the_rule(spark):
    """Ties, NaN, null and more distinct values than one range holds; no window sees all p-values."""
    rng = random.Random(4)
    values = [round(rng.random(), 2) if rng.random() < 0.5 else rng.random() for _ in range(1500)] + [float("nan")] * 7 + [None] * 3 + [0.0, 1.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, pvalue double").repartition(6)
    got = {r.i: r.qvalue for r in stats.bh_fdr(df).collect()}
    known = sorted((v, i) for i, v in enumerate(values) if v is not None and v == v)
    n, low, want = len(known) + 7, 1.0, {}
    for rank in range(len(known), 0, -1):
        v, i = known[rank - 1]
        low = min(low, v * n / rank)
        want[i] = low
    for rank in range(len(known) - 1, 0, -1):  # ties share the value of their last rank
        if known[rank - 1][0] == known[rank][0]:
            want[known[rank - 1][1]] = want[known[rank][1]]
    for i, v in enumerate(values):
        assert (got[i] is None) if v is None else (got[i] != got[i]) if v != v else got[i] == pytest.approx(want[i])
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        stats.bh_fdr(df).explain("formatted")
    windows = [line for line in out.getvalue().splitlines() if "windowspecdefinition" in line and "pvalue" in line]
    assert windows and all("_part" in w for w in windows)


def test_trimmed_curve_equals_an_area_for_each_trim(spark):
    from telospark.operators import motifs

    rng = random.Random(6)
    rows = [(i + 1, rng.choice([0, 1, 1, None, 5]), rng.choice([None, float("nan"), 1.0, 2.0, 3.0, rng.random() * 4])) for i in range(300)]
    df = spark.createDataFrame(rows, "rank int, y int, s double").repartition(5)
    got = {r.threshold: r.auc for r in motifs.trimmed_auc(df, "s", "y", 7, 120).collect()}
    level = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    assert sorted(got) == list(range(7, 120, 7))
    for t, auc in got.items():
        kept = [(y, level(v)) for r, y, v in rows if t < r <= 300 - t]
        one, two = [v for y, v in kept if y == 1], [v for y, v in kept if y == 0]
        wins = sum((a > b) + (a == b) / 2 for a in one for b in two)
        assert auc == pytest.approx(wins / (len(one) * len(two)))
    area = stats.roc_auc(df, "y", "s").first()[0]
    one, two = [level(v) for _, y, v in rows if y == 1], [level(v) for _, y, v in rows if y == 0]
    assert area == pytest.approx(sum((a > b) + (a == b) / 2 for a in one for b in two) / (len(one) * len(two)))
