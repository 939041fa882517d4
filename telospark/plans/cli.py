"""Command line: python -m telospark.plans.cli {test,score,train,saturate,motifs} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from telospark.operators import model, motifs, score
from telospark.plans import analysis
from telospark.sources import tables
from telospark.sources.scratch import cut


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="telospark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("test", "score"):
        s = sub.add_parser(name)
        s.add_argument("-i", "--input", required=True, help="mutations")
        s.add_argument("-x", "--transcripts", required=True, help="transcripts: Parquet, or GTF and cDNA FASTA, comma-separated")
        s.add_argument("--chromosome", help="only mutations of this chromosome")
        s.add_argument("--mode", choices=("transcript", "legacy"), default="transcript", help="what a test or score is about: each transcript, or a gene's first with the variants of its last")
        s.add_argument("--rejects", help="also write the mutations that can't be annotated")
        s.add_argument("-e", "--release", type=int)
        s.add_argument("--indexed", action="store_true", help="an index (.fai) lies beside the FASTA")
        s.add_argument("-c", "--cterm", help="two model paths, comma-separated")
        s.add_argument("-n", "--nterm", help="two model paths, comma-separated")
        s.add_argument("-o", "--output", required=True)
    sub.choices["score"].add_argument("--raw", action="store_true")
    t = sub.choices["test"]
    t.add_argument("-d", "--degrons")
    t.add_argument("--simple", action="store_true", help="with --degrons: substitutions alone, without decay and early stop")
    t.add_argument("-s", "--sites")
    t.add_argument("-f", "--flank", type=int, default=0)
    t.add_argument("-t", "--truncation", action="store_true")
    t.add_argument("--side", choices=("lesser", "greater"), default="lesser")
    t.add_argument("--stability", help="folder of energy tables")
    t.add_argument("-ns", "--simulations", type=int, default=10_000)
    t.add_argument("--seed", type=int, default=101)
    for name in ("cterm_train", "nterm_train"):
        s = sub.add_parser(name)
        s.add_argument("-i", "--input", required=True)
        s.add_argument("-o", "--output", required=True)
    s = sub.add_parser("saturate")
    s.add_argument("-i", "--input", required=True)
    s.add_argument("-m", "--models", required=True)
    s.add_argument("-o", "--output", required=True)
    s = sub.add_parser("motifs")
    s.add_argument("-i", "--input", required=True)
    s.add_argument("-t", "--type", choices=("cterm", "nterm"), required=True)
    s.add_argument("-k", "--top", type=int)
    s.add_argument("-q", "--quad", action="store_true", help="also motifs of four residues")
    s.add_argument("-o", "--output", required=True)
    return p


def _models(spark: SparkSession, paths: str) -> tuple[model.Model, model.Model]:
    a, b = paths.split(",")
    return model.Model.load(spark, a), model.Model.load(spark, b)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = vars(parser().parse_args(args))
    spark = spark or SparkSession.builder.appName("telospark").getOrCreate()
    report: list = []
    if o["command"] in ("test", "score"):
        muts, given = tables.mutations(spark, o["input"], o["chromosome"]), o["transcripts"].split(",")
        tx = tables.annotation(spark, *given, o["chromosome"], o["release"], o["indexed"]) if len(given) == 2 else tables.transcripts(spark, *given, o["release"])
        if o["rejects"]:
            tables.write(analysis.annotated(muts, tx, o["mode"])[1], o["rejects"])
    if o["command"] == "test":
        name = analysis.route(o)
        spans = tables.intervals(spark, o["degrons"]) if name == "degrons" else tables.sites(spark, o["sites"], o["flank"]) if name == "sites" else None
        models = _models(spark, o[name]) if name in ("cterm", "nterm") else None
        energies = tables.energies(spark, o["stability"]) if name == "stability" else None
        name = "degrons_simple" if name == "degrons" and o["simple"] else name
        tables.write(analysis.run(name, muts, tx, o["simulations"], spans, models, energies, o["side"], o["mode"], o["seed"], report), o["output"])
    elif o["command"] == "score":
        end = analysis.score_end(o)
        variants, _ = analysis.annotated(muts, tx, o["mode"], report)
        tables.write(score.score_mutations(cut(score.scored(variants, end)), *_models(spark, o[end]), end, o["raw"]), o["output"])
    elif o["command"] in ("cterm_train", "nterm_train"):
        end = o["command"][:5]
        got = model.train_pair(tables.peptides(spark, o["input"]), end, 2.5 if end == "cterm" else 3.5)
        tables.write(got["grid"], f"{o['output']}/grid")
        tables.write(got["scored"], f"{o['output']}/predictions")
        tables.write(got["test"], f"{o['output']}/test_predictions")
        got["specific"].save(spark, f"{o['output']}/specific")
        got["bag"].save(spark, f"{o['output']}/bag")
        print(f"test AUC {got['test_auc']}")
    elif o["command"] == "saturate":
        tables.write(model.saturation(tables.peptides(spark, o["input"]), *_models(spark, o["models"])), o["output"])
    else:
        from telospark.operators.filters import low_bin, rank_rows

        df = tables.peptides(spark, o["input"]).withColumn("_row", F.monotonically_increasing_id())
        df = df.withColumn("y", low_bin(F.col("Modal Bin"), 2.5 if o["type"] == "cterm" else 3.5)).withColumn("peptide", F.col("Peptide amino acid sequence"))
        df = rank_rows(df, [F.desc("degron potential"), "_row"]).cache()
        top = o["top"] or motifs.top_threshold(df)
        if top is None:
            raise SystemExit("no knee found; give --top")
        tables.write(motifs.dimotifs(df, int(top), o["type"]).orderBy("pvalue", "motif"), f"{o['output']}/dimotif")
        tables.write(motifs.chain_motifs(df, 3, int(top), o["type"]).orderBy("pvalue", "motif"), f"{o['output']}/trimotif")
        if o["quad"]:
            tables.write(motifs.chain_motifs(df, 4, int(top), o["type"]).orderBy("pvalue", "motif"), f"{o['output']}/quadmotif")
    for reason, n in analysis.reported(report).items():
        print(f"{reason}: {n}")


if __name__ == "__main__":
    main()
