"""Sources and sinks. Every table is tab-separated with a header; columns may stand in any order
and extra ones are ignored unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telospark.sources import genome

TRANSCRIPT_SCHEMA = "transcript_id string, gene string, contig string, strand string, biotype string, complete boolean, cds string, utr3 string, ranges array<struct<start:bigint,end:bigint>>, stop_positions array<bigint>"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; no inference pass."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def mutations(spark: SparkSession, path: str, contig: str | None = None, samples: bool = False) -> DataFrame:
    """gene, transcript_id, contig, start, ref, alt (and sample); '-' alleles become empty."""
    df = scan(spark, path)
    blank = lambda c: F.when(F.col(c) == "-", "").otherwise(F.coalesce(F.col(c), F.lit("")))
    cols = [F.col("Hugo_Symbol").alias("gene"), F.col("Transcript_ID").alias("transcript_id"), F.col("Chromosome").alias("contig"), F.col("Start_Position").cast("long").alias("start"), blank("Reference_Allele").alias("ref"), blank("Tumor_Seq_Allele2").alias("alt")]
    if samples and "Tumor_Sample_Barcode" in df.columns:
        cols.append(F.col("Tumor_Sample_Barcode").alias("sample"))
    df = df.select(*cols)
    return on_contig(df, contig) if contig else df


def on_contig(df: DataFrame, contig: str) -> DataFrame:
    return df.where(F.col("contig") == contig)


def transcripts(spark: SparkSession, path: str, release: int | None = None) -> DataFrame:
    """The transcript dimension, Parquet; a release column prunes partitions. Adds protein."""
    from telospark.functions.sequences import protein_of

    df = spark.read.parquet(path)
    df = df.where(F.col("release") == release) if release is not None and "release" in df.columns else df
    return df if "protein" in df.columns else df.withColumn("protein", protein_of(F.col("cds")))


def _attribute(name: str) -> Column:
    return F.regexp_extract("attributes", rf'(?:^|;)\s*{name} "([^"]*)"', 1)


def annotation(spark: SparkSession, gtf: str, cdna: str, contig: str | None = None, release: int | None = None, indexed: bool = False) -> DataFrame:
    """The transcript dimension (TRANSCRIPT_SCHEMA and protein) from an annotation in GTF and the
    transcripts' sequences in FASTA (cDNA: exons joined, 5' to 3'). Versions of ids are dropped.

    The coding sequence begins at the start codon, holds the coding exons and ends with the stop
    codon; what follows is utr3. complete: a start codon, a stop codon of three bases and a length
    of whole codons. Transcripts without coding exons or without a sequence are left out. contig and
    release (a folder of the GTF's) restrict what is read. indexed: the FASTA's index lies beside
    it; sequences are then read by byte ranges and neither split by records nor shuffled whole."""
    lines = genome.read(spark, genome.GtfSource, gtf)
    for name, value in (("contig", contig), ("release", release)):
        lines = lines.where(F.col(name) == value) if value is not None else lines
    lines = lines.where(F.col("feature").isin("exon", "CDS", "start_codon", "stop_codon"))
    biotype = F.coalesce(*(F.nullif(_attribute(n), F.lit("")) for n in ("transcript_biotype", "transcript_type", "gene_biotype", "gene_type")))
    gene = F.coalesce(F.nullif(_attribute("gene_name"), F.lit("")), _attribute("gene_id"))
    at = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    rows = lines.select("contig", "strand", "feature", at.alias("at"), F.substring_index(_attribute("transcript_id"), ".", 1).alias("transcript_id"), gene.alias("gene"), biotype.alias("biotype"))
    of = lambda f: F.array_sort(F.collect_set(F.when(F.col("feature") == f, F.col("at")))).alias("coding" if f == "CDS" else f)
    tx = rows.groupBy("transcript_id").agg(*(F.first(c, True).alias(c) for c in ("gene", "contig", "strand", "biotype")), *map(of, ("exon", "CDS", "start_codon", "stop_codon")))
    minus = F.col("strand") == "-"
    bases = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"] + 1)
    stops = F.flatten(F.transform("stop_codon", lambda r: F.sequence(r["start"], r["end"])))
    body = F.flatten(F.transform("coding", lambda r: F.sequence(r["start"], r["end"])))
    first = F.when(minus, F.array_max(F.transform("coding", lambda r: r["end"]))).otherwise(F.array_min(F.transform("coding", lambda r: r["start"])))
    tx = tx.where(F.size("coding") > 0).withColumns({"_first": first, "stop_positions": F.array_sort(stops)})
    ahead = F.transform("exon", lambda r: F.struct(F.when(minus, F.greatest(r["start"], F.col("_first") + 1)).otherwise(r["start"]).alias("start"), F.when(minus, r["end"]).otherwise(F.least(r["end"], F.col("_first") - 1)).alias("end")))
    tx = tx.withColumn("_skip", bases(F.filter(ahead, lambda r: r["start"] <= r["end"])))
    tx = tx.withColumn("_size", bases("coding") + F.size(F.array_except("stop_positions", body)))
    bare = lambda name: F.regexp_extract(name, r"^([^\s.|]+)", 1).alias("transcript_id")
    if indexed:
        found = genome.read(spark, genome.FastaSource, cdna).select(bare("name"), F.col("sequence").alias("_seq"))
    else:
        records = spark.read.option("lineSep", ">").text(cdna).where(F.trim("value") != "")
        sequence = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
        found = records.select(bare("value"), sequence.alias("_seq"))
    found = found.dropDuplicates(["transcript_id"])
    tx = tx.join(found, "transcript_id")
    cds = F.substring(F.col("_seq"), (F.col("_skip") + 1).cast("int"), F.col("_size").cast("int"))
    tx = tx.withColumn("cds", cds).withColumn("utr3", F.substring(F.col("_seq"), (F.col("_skip") + F.col("_size") + 1).cast("int"), F.length("_seq")))
    complete = (F.size("start_codon") > 0) & (F.size("stop_positions") == 3) & (F.length("cds") == F.col("_size")) & (F.col("_size") % 3 == 0)
    ranges = F.when(minus, F.reverse("coding")).otherwise(F.col("coding"))
    from telospark.functions.sequences import protein_of

    out = tx.select("transcript_id", "gene", "contig", "strand", "biotype", complete.alias("complete"), "cds", "utr3", ranges.alias("ranges"), "stop_positions")
    return out.withColumn("protein", protein_of(F.col("cds")))


def transcripts_of_gene(tx: DataFrame, gene: str) -> DataFrame:
    """Complete protein-coding transcripts of a gene; none for an unknown one."""
    return tx.where((F.col("gene") == gene) & (F.col("biotype") == "protein_coding") & F.col("complete"))


def intervals(spark: SparkSession, path: str, by_transcript: bool = False) -> DataFrame:
    """key, start, end (1-based, inclusive) of degron intervals."""
    return scan(spark, path).select(F.col("transcript_id" if by_transcript else "gene").alias("key"), F.col("start").cast("int"), F.col("end").cast("int"))


def sites(spark: SparkSession, path: str, flank: int) -> DataFrame:
    """key, start, end of modified residues with a flank on both sides."""
    return flank_sites(scan(spark, path).select(F.col("ENST").alias("key"), F.col("MOD_RSD").cast("int").alias("position")), flank)


def flank_sites(df: DataFrame, flank: int) -> DataFrame:
    return df.select("key", (F.col("position") - flank).alias("start"), (F.col("position") + flank).alias("end"))


def energies(spark: SparkSession, folder: str) -> DataFrame:
    """gene (from the file's name), variant, ddg; a file's last line for a variant wins."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(folder)
    df = df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("gene"), "variant", F.col("total energy").cast("double").alias("ddg"), F.monotonically_increasing_id().alias("_at"))
    return df.groupBy("gene", "variant").agg(F.max_by("ddg", "_at").alias("ddg"))


def peptides(spark: SparkSession, path: str) -> DataFrame:
    """A peptide table with its own columns; numeric ones cast; both old and new score names."""
    df = scan(spark, path)
    if "regulatory potential" in df.columns:
        df = df.withColumnRenamed("regulatory potential", "degron potential")
    if "bag of amino acids" in df.columns:
        df = df.withColumnRenamed("bag of amino acids", "bag of words")
    for c in ("Modal Bin", "sequence position specific", "bag of words", "degron potential"):
        if c in df.columns:
            df = df.withColumn(c, F.expr(f"try_cast(`{c}` as double)"))
    return df


def first_per_key(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order (not any row, as dropDuplicates would)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
