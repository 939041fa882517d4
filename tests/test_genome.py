"""GTF and FASTA sources: ranges, filters and random access."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from telospark.sources import genome


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def gtf(rng, n):
    rows = ["#!genome-build toy"]
    for i in range(n):
        rows.append("\t".join([rng.choice(["1", "2", "X"]), "toy", rng.choice(["exon", "CDS", "gene"]), str(i), str(i + 9), ".", "+", ".", f'gene_id "G{i}"; transcript_id "T{i}"; note "{"é" * rng.randrange(9)}";']))
    return rows


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 32 << 20])
def test_ranges_give_each_line_once(spark, tmp_path, size):
    rows = gtf(random.Random(size), 60)
    (tmp_path / "a.gtf").write_text("\n".join(rows) + ("\n" if size != 7 else ""))
    reader = genome.GtfReader({"path": str(tmp_path / "a.gtf"), "range": size})
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("start").to_pylist()]
    assert got == [str(i) for i in range(60)]


def test_contig_feature_and_release_are_pushed(spark, tmp_path):
    want = []
    for release in (75, 95):
        rows = gtf(random.Random(release), 200)
        (tmp_path / f"release={release}").mkdir()
        (tmp_path / f"release={release}" / "a.gtf").write_text("\n".join(rows) + "\n")
        want += [(c[0], c[2], c[3], release) for c in (r.split("\t") for r in rows[1:])]
    df = genome.read(spark, genome.GtfSource, str(tmp_path), range=900)
    assert sorted((r.contig, r.feature, r.start, r.release) for r in df.collect()) == sorted(want)
    some = df.where((F.col("contig") == "2") & F.col("feature").isin("exon", "CDS") & (F.col("release") == 95) & (F.col("strand") == "+"))
    assert sorted((r.contig, r.feature, r.start, r.release) for r in some.collect()) == sorted(w for w in want if w[0] == "2" and w[1] != "gene" and w[3] == 95)
    text = plan(some)
    pushed = [line for line in text.splitlines() if "ushed" in line]
    assert pushed and all(x in " ".join(pushed) for x in ("contig", "release", "feature"))
    reader = genome.GtfReader({"path": str(tmp_path), "range": 900})
    assert list(reader.pushFilters([genome.EqualTo(("release",), 75), genome.EqualTo(("strand",), "+")])) == [genome.EqualTo(("strand",), "+")]
    assert {p.release for p in reader.partitions()} == {75}
    assert genome.GtfReader({"path": str(tmp_path)}).partitions() and df.where("release = 1").count() == 0


def test_one_record_reads_only_its_bytes(spark, tmp_path, monkeypatch):
    rng, want, body, index = random.Random(4), {}, "", []
    for i in range(50):
        s = "".join(rng.choice("acgt") for _ in range(rng.choice([0, 1, 59, 60, 61, 300])))
        body += f">T{i}.1 cdna\n"
        index.append(f"T{i}.1\t{len(s)}\t{len(body)}\t60\t61")
        body += "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60))
        want[f"T{i}.1"] = s.upper()
    (tmp_path / "a.fa").write_text(body)
    (tmp_path / "a.fa.fai").write_text("\n".join(index) + "\n")
    df = genome.read(spark, genome.FastaSource, str(tmp_path / "a.fa"), range=500)
    assert {r["name"]: r.sequence for r in df.collect()} == want and df.rdd.getNumPartitions() > 5
    one = df.where("name = 'T7.1'")
    assert [(r["name"], r.sequence) for r in one.collect()] == [("T7.1", want["T7.1"])]
    assert "T7.1" in " ".join(line for line in plan(one).splitlines() if "ushed" in line)
    reader = genome.FastaReader({"path": str(tmp_path / "a.fa")})
    assert list(reader.pushFilters([genome.In(("name",), ("T7.1", "T30.1", "none"))])) == []
    read, real = [], genome._open

    class Watched:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    class System:
        def __init__(self, fs):
            self.open_input_stream, self.fs = fs.open_input_stream, fs

        def open_input_file(self, path):
            return Watched(self.fs.open_input_file(path))

    monkeypatch.setattr(genome, "_open", lambda p: (System(real(p)[0]), real(p)[1]))
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("name").to_pylist()]
    assert sorted(got) == ["T30.1", "T7.1"] and sum(read) <= sum(len(want[k]) + 6 for k in got)
