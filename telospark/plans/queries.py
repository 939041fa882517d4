"""Queries over the driver's tables, one or more for each operator, with SQL twins for DuckDB.

The tables hold no biology, so sequences are made from them: peptides from the letters of a text or
from an md5 of its id, DNA from md5 digits. Doubles are rounded before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telospark.functions import features, sequences, stats
from telospark.operators import aggregates, filters, intervals, motifs, sampling
from telospark.plans import twins
from telospark.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

R = sequences.RESIDUES


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5(prefix: str, column: str = "doc_id") -> Column:
    return F.md5(F.encode(F.concat(F.lit(prefix), F.col(column).cast("string")), "UTF-8"))


def text_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq: the letters of a text, in upper case."""
    return load(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


SEQ = "(SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)"


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, peptide: 23 residues of the vocabulary."""
    return load(spark, sf_dir, "documents").select("doc_id", "n_chars", F.translate(F.substring(md5("p"), 1, 23), "0123456789abcdef", "ARNDCEQGHILKMFPS").alias("peptide"))


PEP = "(SELECT doc_id, n_chars, translate(substr(md5('p' || doc_id), 1, 23), '0123456789abcdef', 'ARNDCEQGHILKMFPS') AS peptide FROM documents)"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, cds: 96 bases."""
    x = F.translate(F.concat(md5("a"), md5("b"), md5("c")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return load(spark, sf_dir, "documents").select("doc_id", x.alias("cds"))


DNA = "(SELECT doc_id, translate(md5('a' || doc_id) || md5('b' || doc_id) || md5('c' || doc_id), '0123456789abcdef', 'ACGTACGTACGTACGT') AS cds FROM documents)"
POS = f"(SELECT doc_id, cds, CAST(unnest(range(0, 96)) AS INTEGER) AS pos FROM {DNA})"
TRI = "CASE WHEN pos = 0 THEN substr(cds, 1, 1) || substr(cds, 1, 2) WHEN pos = 95 THEN substr(cds, 95, 2) || substr(cds, 96, 1) ELSE substr(cds, pos, 3) END"
CHASM = "CASE WHEN right(tri, 2) = 'CG' THEN 'C*pG' WHEN left(tri, 2) = 'CG' THEN 'CpG*' WHEN left(tri, 2) = 'TC' THEN 'TpC*' WHEN right(tri, 2) = 'GA' THEN 'G*pA' ELSE substr(tri, 2, 1) END"
CODE = "map([" + ",".join(f"'{a}{b}{c}'" for a in "TCAG" for b in "TCAG" for c in "TCAG") + "], [" + ",".join(f"'{a}'" for a in sequences.GENETIC_CODE) + "])"


# Strings and sequences


@query(f"SELECT doc_id, right(seq, 23) AS peptide FROM {SEQ}")
def peptide_terminal_c(spark, sf_dir):
    return text_peptides(spark, sf_dir).select("doc_id", sequences.terminal_window(F.col("seq"), "cterm").alias("peptide"))


@query(f"SELECT doc_id, substr(seq, 2, 23) AS peptide FROM {SEQ}")
def peptide_terminal_n(spark, sf_dir):
    return text_peptides(spark, sf_dir).select("doc_id", sequences.terminal_window(F.col("seq"), "nterm").alias("peptide"))


@query(f"SELECT doc_id, reverse(translate(cds, 'ACGT', 'TGCA')) AS rc FROM {DNA}")
def rev_comp(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", sequences.reverse_complement(F.col("cds")).alias("rc"))


@query(f"SELECT doc_id, pos, {TRI} AS tri FROM {POS}")
def trinuc_context(spark, sf_dir):
    x = dna(spark, sf_dir).select("doc_id", "cds", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("pos"))
    return x.select("doc_id", "pos", sequences.trinucleotide(F.col("cds"), F.col("pos")).alias("tri"))


@query(f"SELECT doc_id, pos, {CHASM} AS context FROM (SELECT doc_id, pos, {TRI} AS tri FROM {POS})")
def chasm_context(spark, sf_dir):
    x = sampling.context_index(dna(spark, sf_dir).withColumnRenamed("doc_id", "transcript_id"), 1.5)
    return x.select(F.col("transcript_id").alias("doc_id"), F.col("cds_pos").alias("pos"), "context")


@query(f"SELECT context, count(*) AS n FROM (SELECT {CHASM} AS context FROM (SELECT {TRI} AS tri FROM {POS})) GROUP BY context")
def context_histogram(spark, sf_dir):
    x = sampling.context_index(dna(spark, sf_dir).withColumnRenamed("doc_id", "transcript_id"), 1.5)
    return aggregates.context_histogram(x.withColumn("slot", F.lit(0)), []).select("context", "n")


@query(f"SELECT doc_id, pos, CASE WHEN pos = 0 THEN substr(cds, 1, 1) ELSE substr(cds, pos, 1) END || substr(cds, pos + 1, 1) AS pair, substr(cds, pos + 1, 1) AS base, 'None' AS none FROM {POS}")
def simple_contexts(spark, sf_dir):
    x = dna(spark, sf_dir).select("doc_id", "cds", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("pos"))
    at = (F.col("cds"), F.col("pos"))
    return x.select("doc_id", "pos", sequences.context(*at, 2).alias("pair"), sequences.context(*at, 1).alias("base"), sequences.context(*at, 0).alias("none"))


_NAMES = (
    "(SELECT 0.0 AS kind, 'None' AS name UNION ALL SELECT 1, unnest(['A','C','T','G']) UNION ALL SELECT 1.5, unnest(['C*pG','CpG*','TpC*','G*pA','A','C','T','G']) "
    "UNION ALL SELECT 2, a || b FROM (SELECT unnest(['A','C','T','G']) AS a), (SELECT unnest(['A','C','T','G']) AS b) "
    "UNION ALL SELECT 3, a || b || c FROM (SELECT unnest(['A','C','T','G']) AS a), (SELECT unnest(['A','C','T','G']) AS b), (SELECT unnest(['A','C','T','G']) AS c))"
)


@query(
    f"WITH t AS (SELECT {TRI} AS tri FROM {POS}), c AS (SELECT 0.0 AS kind, 'None' AS name FROM t UNION ALL SELECT 1, substr(tri, 2, 1) FROM t UNION ALL SELECT 1.5, {CHASM} FROM t UNION ALL SELECT 2, left(tri, 2) FROM t UNION ALL SELECT 3, tri FROM t), "
    f"n AS (SELECT kind, name, count(*) AS n FROM c GROUP BY ALL) SELECT CAST(v.kind AS DOUBLE) AS kind, v.name, coalesce(n, 0) AS n FROM {_NAMES} v LEFT JOIN n ON n.kind = v.kind AND n.name = v.name"
)
def context_names(spark, sf_dir):
    """All contexts of every kind, with the places of the sequences that have them."""
    kinds = (0, 1, 1.5, 2, 3)
    names = [F.struct(F.lit(float(k)).alias("kind"), F.lit(n).alias("name")) for k in kinds for n in sequences.context_names(k)]
    x = dna(spark, sf_dir).select("cds", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("pos")).select(sequences.trinucleotide(F.col("cds"), F.col("pos")).alias("tri"))
    each = F.array(*(F.struct(F.lit(float(k)).alias("kind"), sequences.context_of(F.col("tri"), k).alias("name")) for k in kinds))
    n = x.groupBy("tri").agg(F.count("*").alias("n")).select(F.explode(each).alias("s"), "n").groupBy("s.kind", "s.name").agg(F.sum("n").alias("n"))
    known = spark.range(1).select(F.explode(F.array(*names)).alias("s")).select("s.*")
    return known.join(n, ["kind", "name"], "left").select("kind", "name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"SELECT doc_id, array_to_string([coalesce({CODE}[substr(cds, 3 * i + 1, 3)], 'X') FOR i IN range(0, 32)], '') AS protein FROM {DNA}")
def codon_translate(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", sequences.translate(F.col("cds")).alias("protein"))


@query("SELECT o_orderkey, substr('p.' || o_orderpriority, 3) AS change FROM orders")
def strip_change_prefix(spark, sf_dir):
    x = F.concat(F.lit("p."), F.col("o_orderpriority"))
    return load(spark, sf_dir, "orders").select("o_orderkey", sequences.strip_prefix(x).alias("change"))


@query(f"SELECT doc_id, CAST(regexp_matches(peptide, 'A.R$') AS INTEGER) AS c_term, CAST(regexp_matches(peptide, '^G.E') AS INTEGER) AS n_term, CAST((length(right(peptide, 6)) - length(replace(right(peptide, 6), 'AA', ''))) / 2 AS INTEGER) AS c_any, CAST(length(left(peptide, 6)) - length(replace(left(peptide, 6), 'G', '')) AS INTEGER) AS n_any FROM {PEP}")
def motif_matches(spark, sf_dir):
    p = F.col("peptide")
    return peptides(spark, sf_dir).select("doc_id", sequences.motif_at_end(p, "AxR", "cterm").alias("c_term"), sequences.motif_at_end(p, "GxE", "nterm").alias("n_term"), sequences.motif_anywhere(p, "AA", "cterm").alias("c_any"), sequences.motif_anywhere(p, "G", "nterm").alias("n_any"))


@query(f"SELECT doc_id, CAST(CAST(regexp_matches(peptide, 'A.R$') AS INTEGER) + CAST(regexp_matches(peptide, 'G.$') AS INTEGER) AS INTEGER) AS at_end, CAST((6 - length(replace(right(peptide, 6), 'A', ''))) + (6 - length(replace(right(peptide, 6), 'RR', ''))) / 2 AS INTEGER) AS anywhere FROM {PEP}")
def motif_list_sums(spark, sf_dir):
    p = F.col("peptide")
    return peptides(spark, sf_dir).select("doc_id", sequences.motif_sum(p, ["AxR", "Gx"], "cterm").alias("at_end"), sequences.motif_sum(p, ["A", "RR"], "cterm", True).alias("anywhere"))


@query(f"SELECT kmer, count(*) AS n FROM (SELECT unnest([substr(peptide, i, 2) FOR i IN range(1, 23)]) AS kmer FROM {PEP}) GROUP BY kmer")
def kmer_histogram(spark, sf_dir):
    return peptides(spark, sf_dir).select(F.explode(sequences.kmers(F.col("peptide"), 2)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


# Features


def _long(df: DataFrame, name: str) -> DataFrame:
    x = df.select("doc_id", F.posexplode(name).alias("feature", "value")).where("value > 0")
    return x.select("doc_id", "feature", F.col("value").cast("int").alias("value"))


AA = "[" + ",".join(f"'{a}'" for a in R) + "]"


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS feature, CAST(length(w) - length(replace(w, {AA}[i], '')) AS INTEGER) AS value FROM (SELECT doc_id, right(seq, 23) AS w, unnest(range(1, 21)) AS i FROM {SEQ}) WHERE contains(w, {AA}[i])")
def residue_bag(spark, sf_dir):
    x = peptide_terminal_c(spark, sf_dir).select("doc_id", features.residue_bag(F.col("peptide")).alias("x"))
    return _long(x, "x")


@query(f"SELECT doc_id, CAST((instr('{R}', d[1]) - 1) * 20 + instr('{R}', d[2]) - 1 AS INTEGER) AS feature, CAST(count(*) AS INTEGER) AS value FROM (SELECT doc_id, unnest([substr(peptide, i, 2) FOR i IN range(1, 23)]) AS d FROM {PEP}) GROUP BY 1, 2")
def dimer_count(spark, sf_dir):
    return _long(peptides(spark, sf_dir).select("doc_id", features.dimer_counts(F.col("peptide")).alias("x")), "x")


@query(f"SELECT doc_id, CAST(j * 20 + instr('{R}', a) - 1 AS INTEGER) AS feature, 1 AS value FROM (SELECT doc_id, j, peptide[23 - j] AS a FROM (SELECT doc_id, peptide, unnest(range(1, 6)) AS j FROM {PEP}))")
def position_onehot(spark, sf_dir):
    x = features.position_bag(sequences.last(F.col("peptide"), 6), 6, 6)
    return _long(peptides(spark, sf_dir).select("doc_id", x.alias("x")), "x")


_WIDTHS = [(s, d, features.feature_width(s, d)) for s in (0, 6, 12, 18, 23) for d in (False, True)]


@query("SELECT doc_id, CAST(s AS INTEGER) AS split, CAST(d AS BOOLEAN) AS dinuc, CAST(CASE WHEN s = 0 THEN 20 ELSE CASE WHEN s < 23 THEN 20 ELSE 0 END + 20 * s + CASE WHEN d = 1 THEN 400 ELSE 0 END END AS INTEGER) AS width FROM (SELECT doc_id, unnest([0, 6, 12, 18, 23]) AS s FROM documents) CROSS JOIN (SELECT unnest([0, 1]) AS d)")
def feature_width(spark, sf_dir):
    each = [F.struct(F.lit(s).alias("split"), F.lit(d).alias("dinuc"), F.size(features.terminal_features(F.col("peptide"), s, d, end)).alias("width")) for (s, d, _), end in zip(_WIDTHS, ["cterm", "nterm"] * 5)]
    return peptides(spark, sf_dir).select("doc_id", F.explode(F.array(*each)).alias("s")).select("doc_id", "s.*")


# Filters


ALLELES = "(SELECT doc_id, CAST(doc_id % 5 + 1 AS VARCHAR) AS contig, translate(substr(md5('a' || doc_id), 1, CAST(1 + doc_id % 14 AS INTEGER)), '0123456789abcdef', 'ACGTACGTACGTACGN') AS ref, translate(substr(md5('b' || doc_id), 1, 2), '0123456789abcdef', 'ACGTACGTACGTACGN') AS alt FROM documents)"


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contig, and alleles of 1 to 14 letters, some with N."""
    base = lambda prefix, n: F.translate(F.substring(md5(prefix), F.lit(1), n), "0123456789abcdef", "ACGTACGTACGTACGN")
    x = load(spark, sf_dir, "documents")
    return x.select("doc_id", (F.col("doc_id") % 5 + 1).cast("string").alias("contig"), base("a", (1 + F.col("doc_id") % 14).cast("int")).alias("ref"), base("b", F.lit(2)).alias("alt"))


@query(f"SELECT doc_id, ref, alt FROM {ALLELES} WHERE NOT contains(ref, 'N') AND NOT contains(alt, 'N') AND length(ref) <= 10")
def allele_filter(spark, sf_dir):
    return alleles(spark, sf_dir).where(filters.allele_ok(F.col("ref"), F.col("alt"))).select("doc_id", "ref", "alt")


@query(f"SELECT doc_id, contig FROM {ALLELES} WHERE contig = '3'")
def chrom_filter(spark, sf_dir):
    return tables.on_contig(alleles(spark, sf_dir), "3").select("doc_id", "contig")


@query("SELECT p_partkey, CAST(CASE WHEN p_size / 10.0 < 2.5 THEN 1 ELSE 0 END AS INTEGER) AS y FROM part")
def class_label(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", filters.low_bin(F.col("p_size") / 10.0, 2.5).alias("y"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 50 - (l_tax * 300 / 3.0 + 50 / 3.0) THEN 0.0 ELSE 1.0 END AS nmd FROM lineitem")
def nmd_class(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    tail = F.array(F.struct(F.lit(1.0).alias("start"), (F.col("l_tax") * 300).alias("end")))
    mutant = F.repeat(F.lit("A"), F.col("l_quantity").cast("int"))
    return x.select("l_orderkey", "l_linenumber", filters.nmd_class(mutant, F.lit(50), filters.nmd_insensitive_length(tail)).cast("double").alias("nmd"))


EFFECT = "CASE l_linenumber % 7 WHEN 0 THEN 'Substitution' WHEN 1 THEN 'PrematureStop' WHEN 2 THEN 'FrameShift' WHEN 3 THEN 'Deletion' WHEN 4 THEN 'Silent' WHEN 5 THEN 'StopLoss' ELSE 'Insertion' END"


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as annotated variants of parts."""
    return load(spark, sf_dir, "lineitem").withColumns({"effect": F.expr(EFFECT), "aa_off": F.col("l_quantity").cast("int")})


@query(f"SELECT l_orderkey, l_linenumber, e AS effect FROM (SELECT *, {EFFECT} AS e, CAST(l_quantity AS INTEGER) AS o FROM lineitem) WHERE e IN ('Deletion', 'Insertion', 'FrameShift', 'PrematureStop') OR (e IN ('Substitution', 'Silent', 'StopLoss') AND o > 50 - 23)")
def terminal_filter(spark, sf_dir):
    keep = filters.hits_terminus(F.col("effect"), F.col("aa_off"), F.lit(1), F.lit(50), "cterm")
    return effects(spark, sf_dir).where(keep).select("l_orderkey", "l_linenumber", "effect")


@query(f"SELECT {EFFECT} IN ('FrameShift', 'PrematureStop', 'StopLoss') AS truncating, count(*) AS n FROM lineitem GROUP BY 1")
def class_partition(spark, sf_dir):
    x = effects(spark, sf_dir).withColumn("truncating", filters.is_truncation(F.col("effect")))
    return x.groupBy("truncating").agg(F.count("*").alias("n"))


@query(f"SELECT l_partkey AS part, CAST(count_if({EFFECT} IN ('FrameShift', 'PrematureStop', 'StopLoss')) AS BIGINT) AS truncations, count(*) AS total FROM lineitem GROUP BY 1")
def count_class(spark, sf_dir):
    return effects(spark, sf_dir).groupBy(F.col("l_partkey").alias("part")).agg(aggregates.truncations(F.col("effect")).alias("truncations"), F.count("*").alias("total"))


@query("SELECT l_partkey AS part, round(avg(CAST(l_quantity AS INTEGER) / (150 / 3.0)), 9) AS position FROM lineitem GROUP BY 1")
def avg_position(spark, sf_dir):
    return effects(spark, sf_dir).groupBy(F.col("l_partkey").alias("part")).agg(F.round(aggregates.average_position(F.col("aa_off"), F.lit(150)), 9).alias("position"))


@query("SELECT gene, first_tx AS transcript_id, count(*) AS n FROM (SELECT o_custkey AS gene, o_orderpriority AS tx, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS first_tx, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS last_tx FROM orders) WHERE tx = last_tx GROUP BY 1, 2")
def gene_collapse(spark, sf_dir):
    x = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gene"), F.col("o_orderpriority").alias("transcript_id"))
    return filters.collapse_genes(x, "legacy").groupBy("gene", "transcript_id").agg(F.count("*").alias("n"))


# Interval joins


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("start"), (F.col("p_size") + 5).alias("end"))


SPANS = "(SELECT p_partkey AS key, p_size AS s, p_size + 5 AS e FROM part)"


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM {SPANS} WHERE key = l_partkey AND s <= l_quantity AND l_quantity <= e)")
def interval_overlap_any(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    return intervals.in_any(x, spans(spark, sf_dir), "l_partkey", F.col("l_quantity")).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM {SPANS} WHERE key = l_partkey AND l_quantity < e)")
def interval_before_end(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    return intervals.before_end(x, spans(spark, sf_dir), "l_partkey", F.col("l_quantity")).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_partkey AS part, CAST(sum(CAST((ef IN ('Substitution', 'Deletion', 'Insertion') AND s <= o + 1 AND o + 1 <= e) OR (ef IN ('PrematureStop', 'FrameShift') AND o + 1 < e) AS INTEGER)) AS BIGINT) AS hits FROM (SELECT *, {EFFECT} AS ef, CAST(l_quantity AS INTEGER) AS o FROM lineitem) JOIN {SPANS} ON key = l_partkey GROUP BY 1")
def overlap_count(spark, sf_dir):
    x = intervals.with_key(effects(spark, sf_dir), spans(spark, sf_dir), "l_partkey")
    hit = intervals.overlap(F.col("effect"), F.col("aa_off"), F.col("spans"), F.col("last_end"))
    return x.groupBy(F.col("l_partkey").alias("part")).agg(F.sum(hit).alias("hits"))


@query("SELECT p_partkey AS key, p_size - 3 AS start, p_size + 3 AS \"end\" FROM part")
def flank_sites(spark, sf_dir):
    x = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("position"))
    return tables.flank_sites(x, 3)


@query("SELECT l_partkey AS key, CAST(len(list(DISTINCT (l_linenumber, l_quantity))) AS BIGINT) AS n, min(l_linenumber) AS low, CAST(max(l_quantity) AS INTEGER) AS last_end FROM lineitem GROUP BY 1")
def collect_intervals(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("start"), F.col("l_quantity").cast("int").alias("end"))
    x = intervals.merged(x)
    return x.select("key", F.size("spans").cast("long").alias("n"), F.array_min(F.transform("spans", lambda r: r["start"])).alias("low"), "last_end")


@query("SELECT l_orderkey, l_linenumber, p_size AS low FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40")
def membership_filter(spark, sf_dir):
    """Rows whose key has intervals."""
    big = load(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("start"), (F.col("p_size") + 5).alias("end"))
    x = intervals.with_key(load(spark, sf_dir, "lineitem"), big, "l_partkey")
    return x.select("l_orderkey", "l_linenumber", F.col("spans")[0]["start"].alias("low"))


def _energies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.lit("g").alias("gene"), F.concat(F.lit("p."), F.col("l_partkey").cast("string")).alias("short"))
    e = load(spark, sf_dir, "part").where("p_size > 25").select(F.lit("g").alias("gene"), F.col("p_partkey").cast("string").alias("variant"), F.col("p_retailprice").alias("ddg"))
    return v, e


@query("SELECT unit, round(coalesce(avg(ddg), 0), 6) AS ddg_avg FROM (SELECT DISTINCT l_suppkey AS unit, l_partkey FROM lineitem) LEFT JOIN (SELECT p_partkey, p_retailprice AS ddg FROM part WHERE p_size > 25) ON p_partkey = l_partkey GROUP BY unit")
def ddg_mean_distinct(spark, sf_dir):
    return aggregates.ddg_mean(*_energies(spark, sf_dir), ["unit"]).select("unit", F.round("ddg_avg", 6).alias("ddg_avg"))


@query("SELECT l_suppkey AS unit, round(coalesce(avg(ddg), 0), 6) AS ddg_avg FROM lineitem LEFT JOIN (SELECT p_partkey, p_retailprice AS ddg FROM part WHERE p_size > 25) ON p_partkey = l_partkey GROUP BY unit")
def ddg_mean_hits(spark, sf_dir):
    return aggregates.ddg_mean(*_energies(spark, sf_dir), ["unit"], distinct=False).select("unit", F.round("ddg_avg", 6).alias("ddg_avg"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dedup_first(spark, sf_dir):
    return tables.first_per_key(load(spark, sf_dir, "events"), "user_id", ["event_id"]).select("user_id", "event_id", "event_type")


# Statistics


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("pvalue"))


PVAL = "(SELECT l_partkey, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS pvalue FROM lineitem GROUP BY 1)"


@query(f"SELECT l_partkey, pvalue, round(least(1.0, min(pvalue * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9) AS qvalue FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY pvalue, l_partkey) AS r FROM {PVAL})".replace("min(pvalue * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)", "min(pvalue * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
def bh_fdr(spark, sf_dir):
    """In the twin, tied p-values get the value of the last rank by the running minimum as well."""
    return stats.bh_fdr(pvalues(spark, sf_dir)).select("l_partkey", "pvalue", F.round("qvalue", 9).alias("qvalue"))


@query(f"SELECT l_partkey, round(least(1.0, pvalue * n), 9) AS capped, round(pvalue * n, 9) AS plain FROM (SELECT *, count(*) OVER () AS n FROM {PVAL})")
def bonferroni(spark, sf_dir):
    x = pvalues(spark, sf_dir)
    n = x.agg(F.count("*").alias("n"))
    x = x.join(F.broadcast(n))  # one row
    return x.select("l_partkey", F.round(stats.bonferroni(F.col("pvalue"), F.col("n")), 9).alias("capped"), F.round(stats.bonferroni(F.col("pvalue"), F.col("n"), False), 9).alias("plain"))


@query("SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS low FROM events")
def cummin(spark, sf_dir):
    return stats.running_minimum(load(spark, sf_dir, "events"), "value", ["event_id"], "low", ["user_id"]).select("user_id", "event_id", "low")


@query("SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 9) AS pvalue FROM events GROUP BY 1")
def empirical_pvalue(spark, sf_dir):
    x = load(spark, sf_dir, "events").withColumn("hit", F.col("event_type") == "purchase")
    return stats.empirical_pvalue(x, "hit", ["user_id"]).select("user_id", F.round("pvalue", 9).alias("pvalue"))


@query("SELECT user_id, CAST(coalesce(min(CASE WHEN c >= 3 THEN i END), count(*)) AS BIGINT) AS n_sims, round(least(sum(h), 3) / coalesce(min(CASE WHEN c >= 3 THEN i END), count(*)), 9) AS pvalue FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, sum(h) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT user_id, event_id, CAST(event_type = 'purchase' AS INTEGER) AS h FROM events)) GROUP BY user_id")
def early_stop_pvalue(spark, sf_dir):
    x = load(spark, sf_dir, "events").withColumn("hit", F.col("event_type") == "purchase")
    return stats.early_stopped_pvalue(x, "hit", "event_id", ["user_id"], 3).select("user_id", F.col("n_sims").cast("long").alias("n_sims"), F.round("pvalue", 9).alias("pvalue"))


LAB = "(SELECT lang, quality AS y, n_chars AS s FROM documents JOIN labels USING (doc_id))"


@query(f"SELECT lang, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 9) AS auc FROM (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2 AS r FROM {LAB}) GROUP BY lang")
def roc_auc(spark, sf_dir):
    x = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return stats.roc_auc(x, "quality", "n_chars", ["lang"]).select("lang", F.round("auc", 9).alias("auc"))


@query("WITH d AS (SELECT n_chars AS s, quality AS y, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id)), t AS (SELECT unnest([10, 20, 30, 40, 50]) AS threshold), w AS (SELECT threshold, y, rank() OVER (PARTITION BY threshold ORDER BY s) + (count(*) OVER (PARTITION BY threshold, s) - 1) / 2 AS k FROM d JOIN t ON r > threshold AND r <= n - threshold) SELECT CAST(threshold AS INTEGER) AS threshold, round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 9) AS auc FROM w GROUP BY threshold")
def trimmed_auc_curve(spark, sf_dir):
    x = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", "quality")
    x = filters.rank_rows(x, [F.desc("n_chars"), "doc_id"])
    return motifs.trimmed_auc(x, "n_chars", "quality", 10, 51).select("threshold", F.round("auc", 9).alias("auc"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) > 25 AND row_number() OVER (ORDER BY n_chars DESC, doc_id) <= count(*) OVER () - 25")
def top_rank_trim(spark, sf_dir):
    return filters.two_sided_trim(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 25).select("doc_id")


@query("SELECT l_partkey, round(CASE WHEN a = 0 OR n - a = 0 THEN NULL ELSE log2((a / (n - a)) / (0.25 / 0.75)) END, 9) AS odds FROM (SELECT l_partkey, CAST(count_if(l_returnflag = 'R') AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1)")
def log2_odds(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count("*").alias("n"))
    v = stats.log2_odds(F.col("a"), F.col("n"), F.lit(0.25), F.lit(1.0))
    return x.select("l_partkey", F.round(F.when(F.abs(v) < float("inf"), v), 9).alias("odds"))


@query("SELECT k, n, round(list_sum([CAST(c AS DOUBLE) FOR c IN list_transform(range(k, n + 1), lambda i: (factorial(n) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(n - i AS INTEGER)))) * pow(0.3, i) * pow(0.7, n - i))]), 9) AS tail FROM (SELECT CAST(p_size % 15 + 1 AS INTEGER) AS k, 16 AS n FROM part GROUP BY 1)")
def binomial_tail(spark, sf_dir):
    x = load(spark, sf_dir, "part").select((F.col("p_size") % 15 + 1).cast("int").alias("k"), F.lit(16).alias("n")).distinct()
    return x.select("k", "n", F.round(stats.binomial_tail(F.col("k"), F.col("n"), F.lit(0.3)), 9).alias("tail"))


# Motif enrichment

TOP = 200
RANKED = f"(SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM {PEP})"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.ranked(peptides(spark, sf_dir), [F.desc("n_chars"), "doc_id"])


def _pairs(end: str) -> str:
    six = "right(peptide, 6)" if end == "cterm" else "left(peptide, 6)"
    return (
        f"WITH w AS (SELECT r, {six} AS six FROM {RANKED}), p AS (SELECT i AS pos1, j AS pos2 FROM range(1, 6) a(i), range(2, 7) b(j) WHERE i < j), "
        f"v AS (SELECT pos1, pos2, a AS aa1, b AS aa2 FROM p, (SELECT unnest({AA}) AS a), (SELECT unnest({AA}) AS b)), "
        f"c AS (SELECT pos1, pos2, six[7 - pos1] AS aa1, six[7 - pos2] AS aa2, count_if(r <= {TOP}) AS top_ct, count(*) AS bot_ct FROM w, p GROUP BY 1, 2, 3, 4) "
        "SELECT CAST(pos1 AS INTEGER) AS pos1, CAST(pos2 AS INTEGER) AS pos2, aa1, aa2, CAST(coalesce(top_ct, 0) AS BIGINT) AS top_ct, CAST(coalesce(bot_ct, 0) AS BIGINT) AS bot_ct FROM v LEFT JOIN c USING (pos1, pos2, aa1, aa2)"
    )


@query(_pairs("cterm"))
def dimotif_counts_c(spark, sf_dir):
    return motifs.dimotifs(ranked(spark, sf_dir), TOP, "cterm").select("pos1", "pos2", "aa1", "aa2", "top_ct", "bot_ct")


@query(_pairs("nterm"))
def dimotif_counts_n(spark, sf_dir):
    return motifs.dimotifs(ranked(spark, sf_dir), TOP, "nterm").select("pos1", "pos2", "aa1", "aa2", "top_ct", "bot_ct")


@query()
def dimotif(spark, sf_dir):
    return motifs.dimotifs(ranked(spark, sf_dir), TOP, "cterm").orderBy("pvalue", "motif")


def _finite(c: str, digits: int) -> Column:
    return F.round(F.when(F.abs(c) < float("inf"), F.col(c)), digits).alias(c)


def _tested(df: DataFrame, *key: str) -> DataFrame:
    return df.select(*key, *(_finite(c, d) for c, d in (("pvalue", 6), ("log_or", 6), ("adjusted_pvalue", 2), ("qvalue", 6))))


def _pair_tests(end: str) -> str:
    all_, odds = f"(SELECT count(*) FROM {PEP})", f"CASE WHEN {TOP} = top_ct THEN NULL ELSE (top_ct / ({TOP}.0 - top_ct)) / nullif(bot_ct / nullif(b.n - bot_ct, 0.0), 0) END"
    return twins.motif_tests(f"SELECT p.*, n FROM ({_pairs(end)}) p, (SELECT CAST(count(*) AS DOUBLE) AS n FROM {PEP}) b", "pos1, pos2, aa1, aa2", "top_ct", str(TOP), "bot_ct / n", odds.replace("b.n", "n"), "pvalue * 6000")


@query(_pair_tests("cterm"))
def dimotif_tests_c(spark, sf_dir):
    return _tested(motifs.dimotifs(ranked(spark, sf_dir), TOP, "cterm"), "pos1", "pos2", "aa1", "aa2")


@query(_pair_tests("nterm"))
def dimotif_tests_n(spark, sf_dir):
    return _tested(motifs.dimotifs(ranked(spark, sf_dir), TOP, "nterm"), "pos1", "pos2", "aa1", "aa2")


@query(f"SELECT a AS aa, round(coalesce(n, 0) / (t * 6.0), 9) AS p FROM (SELECT unnest({AA}) AS a) LEFT JOIN (SELECT aa, count(*) AS n FROM (SELECT unnest(string_split(right(peptide, 6), '')) AS aa FROM {PEP}) GROUP BY 1) ON a = aa, (SELECT count(*) AS t FROM {PEP})")
def residue_background(spark, sf_dir):
    return motifs.residue_background(ranked(spark, sf_dir), "cterm").select("aa", F.round("p", 9).alias("p"))


def _chain(end: str) -> str:
    six = "right(peptide, 6)" if end == "cterm" else "left(peptide, 6)"
    count = lambda k: f"(SELECT m, sum(CASE WHEN r <= {TOP} THEN c ELSE 0 END) AS top_ct, sum(c) AS n FROM (SELECT r, m, CAST((6 - length(replace(six, m, ''))) / {k} AS BIGINT) AS c FROM (SELECT DISTINCT r, six, substr(six, i, {k}) AS m FROM w, range(1, {8 - k}) x(i))) GROUP BY m)"
    return (
        f"WITH w AS (SELECT r, {six} AS six FROM {RANKED}), t AS (SELECT count(*) AS t FROM w), one AS (SELECT a, coalesce(n, 0) / (t * 6.0) AS p FROM (SELECT unnest({AA}) AS a) LEFT JOIN {count(1)} ON a = m, t), "
        f"two AS (SELECT m AS d, n / (t * 5.0) AS p FROM {count(2)}, t), "
        f"v AS (SELECT a || b || c AS motif FROM (SELECT unnest({AA}) AS a), (SELECT unnest({AA}) AS b), (SELECT unnest({AA}) AS c)) "
        f"SELECT motif, CAST(coalesce(top_ct, 0) AS BIGINT) AS top_ct, round(CASE WHEN o.p = 0 THEN NULL ELSE coalesce(x.p, 0) * coalesce(y.p, 0) / o.p END, 9) AS background_p FROM v LEFT JOIN {count(3)} ON m = motif LEFT JOIN two x ON x.d = left(motif, 2) LEFT JOIN two y ON y.d = right(motif, 2) JOIN one o ON o.a = substr(motif, 2, 1)"
    )


@query(_chain("cterm"))
def trimotif_counts_c(spark, sf_dir):
    return motifs.chain_motifs(ranked(spark, sf_dir), 3, TOP, "cterm").select("motif", "top_ct", F.round("background_p", 9).alias("background_p"))


@query(_chain("nterm"))
def trimotif_counts_n(spark, sf_dir):
    return motifs.chain_motifs(ranked(spark, sf_dir), 3, TOP, "nterm").select("motif", "top_ct", F.round("background_p", 9).alias("background_p"))


def _chain_tests(end: str) -> str:
    """The background with all its digits."""
    counts = _chain(end).replace("round(CASE WHEN o.p", "(CASE WHEN o.p").replace("END, 9) AS background_p", "END) AS background_p")
    odds = f"CASE WHEN {TOP} = top_ct OR background_p >= 1 THEN NULL ELSE (top_ct / ({TOP}.0 - top_ct)) / nullif(background_p / (1 - background_p), 0) END"
    return twins.motif_tests(counts, "motif", "top_ct", str(4 * TOP), "background_p", odds, "CASE WHEN pvalue IS NOT NULL THEN least(1.0, pvalue * 8000) END")


@query(_chain_tests("cterm"))
def trimotif_tests_c(spark, sf_dir):
    return _tested(motifs.chain_motifs(ranked(spark, sf_dir), 3, TOP, "cterm"), "motif")


@query(_chain_tests("nterm"))
def trimotif_tests_n(spark, sf_dir):
    return _tested(motifs.chain_motifs(ranked(spark, sf_dir), 3, TOP, "nterm"), "motif")


@query()
def trimotif(spark, sf_dir):
    return motifs.chain_motifs(ranked(spark, sf_dir), 3, TOP, "cterm").orderBy("pvalue", "motif")


@query()
def quadmotif(spark, sf_dir):
    return motifs.chain_motifs(ranked(spark, sf_dir), 4, TOP, "cterm").orderBy("pvalue", "motif")


# Transcripts, annotation, sampling and tests


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic transcript per document: 96 bases that start with ATG, hold no early stop and
    end with TAA, in two exons, on either strand."""
    body = F.regexp_replace(F.col("cds"), "(?:T(?=AA)|T(?=AG)|T(?=GA))", "C")
    x = dna(spark, sf_dir).withColumn("cds", F.concat(F.lit("ATG"), F.substring(body, 4, 90), F.lit("TAA")))
    at = F.col("doc_id") * 1000
    minus = F.col("doc_id") % 2 == 1
    up = F.expr("array(named_struct('start', a + 1, 'end', a + 40), named_struct('start', a + 101, 'end', a + 153))")
    down = F.expr("array(named_struct('start', a + 101, 'end', a + 153), named_struct('start', a + 61, 'end', a + 100))")
    stops = F.when(minus, F.array(at + 58, at + 59, at + 60)).otherwise(F.array(at + 154, at + 155, at + 156))
    x = x.withColumn("a", at).withColumns({"ranges": F.when(minus, down).otherwise(up), "stop_positions": stops, "strand": F.when(minus, "-").otherwise("+")})
    x = x.select(F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("transcript_id"), F.concat(F.lit("G"), (F.col("doc_id") % 40).cast("string")).alias("gene"), F.lit("1").alias("contig"), "strand", F.lit("protein_coding").alias("biotype"), F.lit(True).alias("complete"), "cds", F.lit("GCCTAAGC").alias("utr3"), "ranges", "stop_positions")
    return x.withColumn("protein", sequences.protein_of(F.col("cds")))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve mutations for every transcript: substitutions with the true reference, and
    two one-base deletions."""
    from telospark.operators.annotate import with_positions

    tx = with_positions(transcripts(spark, sf_dir))
    i = F.explode(F.sequence(F.lit(0), F.lit(11)))
    x = tx.withColumn("i", i).withColumn("p", sampling.draw([F.lit("m"), F.col("transcript_id"), F.col("i")], F.lit(93)))
    base = F.substring(F.col("cds"), F.col("p") + 1, F.lit(1))
    base = F.when(F.col("strand") == "-", F.translate(base, "ACGT", "TGCA")).otherwise(base)
    alt = F.when(F.col("i") >= 10, F.lit("")).otherwise(F.translate(base, "ACGT", "CATG"))
    return x.select("gene", "transcript_id", "contig", F.get("genome", F.col("p")).alias("start"), base.alias("ref"), alt.alias("alt"))


@query("WITH d AS (SELECT doc_id, doc_id * 1000 AS a, doc_id % 2 = 1 AS m, unnest(range(0, 96)) AS pos FROM documents) SELECT 'T' || doc_id AS transcript_id, CAST(pos AS INTEGER) AS pos, CAST(a + CASE WHEN m THEN CASE WHEN pos < 53 THEN 153 - pos WHEN pos < 93 THEN 100 - (pos - 53) ELSE 60 - (pos - 93) END ELSE CASE WHEN pos < 40 THEN 1 + pos WHEN pos < 93 THEN 101 + pos - 40 ELSE 154 + pos - 93 END END AS BIGINT) AS genome FROM d")
def cds_to_genome(spark, sf_dir):
    from telospark.operators.annotate import with_positions

    return with_positions(transcripts(spark, sf_dir)).select("transcript_id", F.posexplode("genome").alias("pos", "genome"))


TX = f"(SELECT doc_id, 'ATG' || substr(replace(replace(replace(cds, 'TAA', 'CAA'), 'TAG', 'CAG'), 'TGA', 'CGA'), 4, 90) || 'TAA' AS cds FROM {DNA})"


@query(
    f"WITH v AS (SELECT 'T' || doc_id AS transcript_id, cds, CAST(p AS INTEGER) AS drawn, alt FROM {TX}, range(0, 96) r(p), (SELECT unnest(['A','C','G','T']) AS alt) WHERE substr(cds, p + 1, 1) <> alt), "
    "m AS (SELECT *, drawn // 3 AS i, substr(cds, 3 * (drawn // 3) + 1, 3) AS old, substr(cds, 3 * (drawn // 3) + 1, drawn % 3) || alt || substr(cds, drawn + 2, 2 - drawn % 3) AS new FROM v), "
    f"t AS (SELECT *, {CODE}[old] AS a, {CODE}[new] AS b FROM m) "
    "SELECT transcript_id, drawn, alt AS cds_alt, CASE WHEN i = 0 THEN CASE WHEN new IN ('CTG', 'TTG') THEN 'AlternateStartCodon' ELSE 'StartLoss' END WHEN a = b THEN 'Silent' WHEN i = 31 THEN 'StopLoss' WHEN b = '*' THEN 'PrematureStop' ELSE 'Substitution' END AS effect FROM t"
)
def snv_effects(spark, sf_dir):
    """Every substitution of every coding base of every transcript."""
    return sampling.snv_effects(transcripts(spark, sf_dir), changed=True).select("transcript_id", "drawn", "cds_alt", "effect")


@query(f"SELECT 'T' || doc_id AS transcript_id, array_to_string([{CODE}[substr(cds, 3 * i + 1, 3)] FOR i IN range(0, 31)], '') AS protein FROM {TX}")
def transcript_proteins(spark, sf_dir):
    return transcripts(spark, sf_dir).select("transcript_id", "protein")


@query(twins.annotated(TX, CODE))
def annotated_variants(spark, sf_dir):
    from telospark.plans.analysis import annotated

    x, _ = annotated(mutations(spark, sf_dir), transcripts(spark, sf_dir))
    return x.select("gene", "transcript_id", "start", "ref", "alt", "cds_pos", "effect", "aa_off", "short")


@query(f"SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(list_sort(list(pos))[1 + CAST(CAST('0x' || substr(md5('101|' || doc_id || '|' || context || '|0|' || k), 1, 8) AS BIGINT) % count(*) AS INTEGER)] AS BIGINT) AS pos FROM (SELECT doc_id, pos, {CHASM} AS context FROM (SELECT doc_id, pos, {TRI} AS tri FROM {POS})), (SELECT unnest([0, 1, 2]) AS k) WHERE context = 'A' GROUP BY doc_id, context, k")
def sample_positions(spark, sf_dir):
    tx = dna(spark, sf_dir).withColumn("transcript_id", F.col("doc_id").cast("string"))
    slots = tx.select("transcript_id", "doc_id", F.lit("A").alias("context"), F.explode(F.array(*map(F.lit, range(3)))).alias("slot"))
    got = sampling.draws(slots, sampling.context_positions(tx, 1.5), 0, 1)
    return got.select("doc_id", F.col("slot").alias("k"), F.col("drawn").cast("long").alias("pos"))


def _analysis(name: str, **more) -> Query:
    def run(spark, sf_dir):
        from telospark.plans import analysis

        tx, muts = transcripts(spark, sf_dir), mutations(spark, sf_dir)
        options = {k: f(spark, sf_dir) for k, f in more.items()}
        out = analysis.run(name, muts, tx, **options).withColumnRenamed("average position", "average_position")
        doubles = [c for c, kind in out.dtypes if kind == "double"]
        return out.withColumns({c: F.round(c, 9) for c in doubles})

    return run


def _degron_spans(spark, sf_dir):
    return transcripts(spark, sf_dir).select(F.col("gene").alias("key")).distinct().select("key", F.lit(5).alias("start"), F.lit(12).alias("end"))


def _site_spans(spark, sf_dir):
    return transcripts(spark, sf_dir).select(F.col("transcript_id").alias("key"), F.lit(8).alias("start"), F.lit(14).alias("end"))


def _energy_table(variants: DataFrame) -> DataFrame:
    x = variants.where("effect = 'Substitution'").select("gene", sequences.strip_prefix(F.col("short")).alias("variant")).distinct()
    return x.withColumn("ddg", F.pmod(F.xxhash64("gene", "variant"), F.lit(1000)) / 250.0)


def fixed_models(end: str):
    """Small networks with weights from a rule, for queries; real ones are trained."""
    import numpy as np

    from telospark.operators.model import Model

    out = []
    for split, dinuc in ((6, True), (0, False)):
        n = features.feature_width(split, dinuc)
        w = [np.sin(np.arange(n * 4)).reshape(n, 4) / 4, np.cos(np.arange(16)).reshape(4, 4) / 2, np.array([[1.0], [-1.0], [0.5], [-0.5]])]
        out.append(Model([[a, np.full(a.shape[1], 0.1)] for a in w], split, dinuc, end))
    return tuple(out)


QUERIES |= {
    "permutation_degrons": _analysis("degrons", spans=_degron_spans),
    "permutation_sites": _analysis("sites", spans=_site_spans),
    "permutation_truncation": _analysis("truncation"),
    "permutation_cterm": _analysis("cterm", models=lambda s, d: fixed_models("cterm")),
    "permutation_nterm": _analysis("nterm", models=lambda s, d: fixed_models("nterm")),
    "permutation_stability": _analysis("stability", energies=lambda s, d: _energy_table),
}


_TRUNCATING = "CAST(effect IN ('FrameShift', 'PrematureStop', 'StopLoss') AS INTEGER)"
_IN_SITE = "CAST((effect IN ('Substitution', 'Deletion', 'Insertion') AND off + 1 BETWEEN 8 AND 14) OR (effect IN ('PrematureStop', 'FrameShift') AND off + 1 < 14) AS INTEGER)"
_IN_DEGRON = "CAST((effect IN ('Substitution', 'Deletion', 'Insertion') AND off + 1 BETWEEN 5 AND 12) OR (effect IN ('PrematureStop', 'FrameShift') AND off + 1 < 12) AS INTEGER)"
ORACLE_SQL |= {
    "permutation_sites": twins.permutation(TX, CODE, _IN_SITE, "num_site_muts", "true", indels=False, side=">=", empty_hits=False, simulations=10_000),
    "permutation_degrons": twins.permutation(TX, CODE, _IN_DEGRON, "num_degron_muts", "true", indels=True, side=">=", empty_hits=True, simulations=10_000),
    "permutation_truncation": twins.permutation(TX, CODE, _TRUNCATING, "num_truncations", "minus", indels=True, side="<=", empty_hits=True, simulations=10_000),
}


def _rounded(out: DataFrame) -> DataFrame:
    out = out.toDF(*(c.lower().replace(" ", "_") for c in out.columns))
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"})


@query(twins.scores(TX, CODE, *fixed_models("cterm"), R, raw=False))
def score_mutations(spark, sf_dir):
    from telospark.operators import score
    from telospark.plans.analysis import annotated

    x, _ = annotated(mutations(spark, sf_dir), transcripts(spark, sf_dir))
    return _rounded(score.score_mutations(x, *fixed_models("cterm"), "cterm"))


@query(twins.scores(TX, CODE, *fixed_models("cterm"), R, raw=True))
def score_mutations_raw(spark, sf_dir):
    from telospark.operators import score
    from telospark.plans.analysis import annotated

    x, _ = annotated(mutations(spark, sf_dir), transcripts(spark, sf_dir))
    return _rounded(score.score_mutations(x, *fixed_models("cterm"), "cterm", raw=True))


@query(twins.wild_types(TX, CODE, *fixed_models("cterm"), R))
def wild_type_scores(spark, sf_dir):
    from telospark.operators import score

    return _rounded(score.wild_type_scores(transcripts(spark, sf_dir), *fixed_models("cterm"), "cterm"))


@query("SELECT 'T' || doc_id AS transcript_id FROM documents WHERE doc_id % 40 = 7")
def transcripts_of_gene(spark, sf_dir):
    return tables.transcripts_of_gene(transcripts(spark, sf_dir), "G7").select("transcript_id")


_BAG = f"[CAST(length(peptide) - length(replace(peptide, a, '')) AS DOUBLE) FOR a IN {AA}]"


def _net_sql() -> str:
    """The fixed bag model, written out: every layer is a list of dot products."""
    net = fixed_models("cterm")[1].net
    x = _BAG
    for n, (w, b) in enumerate(net):
        rows = ", ".join(f"list_dot_product(x, {[float(v) for v in w[:, j]]}) + {float(b[j])}" for j in range(w.shape[1]))
        if n < len(net) - 1:
            x = f"list_transform([{x}], lambda x: list_transform([{rows}], lambda v: greatest(0.0, v)))[1]"
        else:
            x = f"list_transform([{x}], lambda x: 1 / (1 + exp(-({rows}))))[1]"
    return f"SELECT doc_id, round({x}, 6) AS p FROM {PEP}"


@query(_net_sql())
def model_predict(spark, sf_dir):
    bag = fixed_models("cterm")[1]
    return peptides(spark, sf_dir).select("doc_id", F.round(bag.predict(spark, F.col("peptide")), 6).alias("p"))


@query()
def saturation_scores(spark, sf_dir):
    from telospark.operators import model

    out = model.saturation(peptides(spark, sf_dir), *fixed_models("cterm"), "peptide")
    return out.toDF(*(c.replace(" ", "_") for c in out.columns))


@query()
def train_grid(spark, sf_dir):
    """The whole grid on peptides whose label is made from their composition."""
    from telospark.operators import model

    x = peptides(spark, sf_dir).withColumn("y", (features.residue_bag(F.col("peptide"))[0] >= 2).cast("int")).withColumn("key", F.col("doc_id").cast("string"))
    x = model.hash_split(x, "key", 0.3, "valid")
    return model.grid_search(x, "cterm")


@query("SELECT doc_id, CAST(CAST('0x' || substr(md5('101|' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 AS INTEGER) AS test FROM documents")
def hash_split(spark, sf_dir):
    from telospark.operators import model

    x = load(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("k"))
    return model.hash_split(x, "k", 0.3, "test").select("doc_id", "test")
