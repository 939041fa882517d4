"""The licence scan against a plain scan of every block."""

import random
import re

import pytest
from pyspark.sql import functions as F

from telospark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text, templates=licenses.TEMPLATES, threshold=0.8):
    w = WORD.findall((text or "").translate(LOWER))
    places, base, best = [], set(), {}
    for p, label in licenses.PHRASES.items():
        q = p.split()
        for i in range(len(w)):
            if w[i : i + len(q)] == q:
                places.append(i)
                base.add(label)
    for k, t in enumerate(templates):
        own, stride = set(t.text.split()), licenses.stride_of(len(t.text.split()))
        for b in range(0, len(w), stride):
            n = len(own & set(w[b : b + 2 * stride]))
            if n >= threshold * len(own) - 1e-9:
                best[k] = max(best.get(k, (0, 0)), (n / len(own), len(own)))
    more = {templates[k].label for k, c in best.items() if c == max(v for j, v in best.items() if templates[j].family == templates[k].family)}
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else max(best.values(), default=(0.0, 0))[0]


def found(spark, rows, **more):
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), **more)
    return [((r.doc_id, r.text), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in out.collect()]


def test_random_texts_equal_the_plain_scan(spark):
    rng = random.Random(3)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.text.split()}) + ["étude", "ÉTUDE", "x1"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(licenses.TEMPLATES).text.split()
            w = [x for x in w if rng.random() > rng.choice((0, 0.1, 0.25))]
            parts += rng.choices(vocabulary, k=rng.randrange(40)) + w + rng.choice(list(licenses.PHRASES)).split()[: rng.randrange(1, 6)]
        text = rng.choice((" ", "\n", ", ")).join(parts)
        rows.append((i, text.upper() if i % 7 == 0 else text))
    for threshold in (0.8, 0.6, 1.0):
        for (_, text), got in found(spark, rows, threshold=threshold):
            assert got == plain(text, threshold=threshold)


def test_notices_and_clean_text(spark):
    cases = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n# Redistributions in binary form must reproduce the above copyright notice": "bsd-2",
        "The public took the general work of the version under this software with a copy of the list.": "",
    }
    pad = "other words stand here " * 9
    rows = [(i, f"{pad}{t} {pad}") for i, t in enumerate(cases)]
    got = {k[0]: v for k, v in found(spark, rows)}
    assert [got[i][5] for i in range(len(cases))] == list(cases.values())


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, overlapping places, clashing names, no rows."""
    long = "cc by nc " * 30_000
    rows = [(1, None), (2, ""), (None, "under the MIT license"), (None, None), (3, "cc by nc"), (3, "cc by nc"), (3, "apache license version 2"), (4, long)]
    got = found(spark, rows)
    assert sorted(map(str, got)) == sorted(str((r, plain(r[1]))) for r in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert licenses.scan(df.limit(0)).collect() == []
    clash = df.withColumns({c: F.lit("x") for c in ("token", "place", "template", "label", "family", "own", "at", "need", "stride", "labels", "score", "containment")})
    again = licenses.scan(clash)
    assert sorted(map(str, again.select("doc_id", "text", "n_base", "labels", "score").collect())) == sorted(map(str, licenses.scan(df).select("doc_id", "text", "n_base", "labels", "score").collect()))
    assert again.columns.count("labels") == 1 and [r.token for r in again.limit(1).collect()] == ["x"]
    with pytest.raises(ValueError):
        licenses.scan(df, threshold=0)


def test_no_python_on_the_path(spark, tiny):
    plan = licenses.scan(spark.read.parquet(f"{tiny}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
