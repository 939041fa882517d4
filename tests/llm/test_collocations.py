"""Collocations against counting by hand, also with tiny blocks and split prefixes."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from telospark.llm import collocations

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=10, most=2000):
    f = {}
    for lang, text in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        n = sum(x for p, x in c.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["a", "B", "c", "dé", "É", "x\x1cy", "z ", "0"]
    seps = [" ", " ", " ", "\t", ", ", ". ", "\n", "\r\n", "\x0b", "  "]
    return [(rng.choice(["en", "en", "fr", None]), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(120)))) for _ in range(n)]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    return sorted(tuple(r) for r in collocations.collocations(df, **more).collect())


@pytest.mark.parametrize("part,block,size", [(500_000, 1 << 20, 4 << 20), (40, 64, 50), (3, 17, 9)])
def test_equal_to_counting(spark, monkeypatch, part, block, size):
    for name, value in (("PART", part), ("BLOCK", block), ("BYTES", size)):
        monkeypatch.setattr(collocations, name, value)
    rows = texts(part)
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, least=25, most=7) == plain(rows, 25, 7)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 6)
    rows = texts(9)
    assert run(spark, rows) == plain(rows)


def test_hot_pair_and_threshold_of_the_list(spark, monkeypatch):
    """One pair makes up most of the words, and fewer prefixes fit the list than are large."""
    monkeypatch.setattr(collocations, "PART", 20)
    monkeypatch.setattr(collocations, "HOT", 2)
    rows = texts(4, 60) + [("en", "der der " * 400 + "die"), ("en", "der die. " * 30)]
    assert run(spark, rows) == plain(rows)


def test_exact_arithmetic(spark):
    """Counts whose products pass 64 bits."""
    big = 2_000_000_000_001
    got = spark.sql(f"select {collocations._SCORE} as s from (select {big}L as a, {big + 7}L as l, {big * 3}L as r)").first().s
    assert got == 1000000 * big * big // ((big + 7) * big * 3)


def test_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", None), (None, "a b " * 12), ("und", "a b " * 3), ("fr", "w" * 300_000 + " x"), ("de", "p q. " * 9)] + [("es", "uno dos tres")] * 11
    assert run(spark, rows) == plain(rows)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert collocations.collocations(df.limit(0)).collect() == []
    clash = df.withColumns({c: F.lit("x") for c in ("n", "w1", "word", "prefix", "phrase", "score")})
    assert sorted(tuple(r) for r in collocations.collocations(clash).collect()) == plain(rows)
