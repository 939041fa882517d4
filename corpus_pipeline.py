"""The corpus pipeline: quality classifier, near-dedup, surrogates, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes each result as Parquet in
the shared folder and rereads it as the next stage's docs. All stages but the last return the
columns of documents, for every row that they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telospark.llm import minhash, mixing, packing, pii, quality
from telospark.llm.common import cut, small_enough, table
from telospark.llm.queries import PII_KEY, WEIGHTS, domain_of, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on labelled rows of all documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, threshold=0.7).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates; rows that repeat a
    doc_id stay or go together."""
    dropped = cut(minhash.near_duplicates(docs, threshold=75).where("not kept").select("doc_id").distinct())
    return docs.join(small_enough(dropped), "doc_id", "left_anti").select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities replaced by surrogates; n_chars follows the new text."""
    out = pii.pseudonymize(docs, PII_KEY)
    return out.selectExpr("doc_id", "text", "lang", "source", "if(n_entities > 0, cast(char_length(text) as bigint), n_chars) as n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the token budget of the source tree, once per epoch."""
    return mixing.mix(docs, WEIGHTS, domain_of(), fraction=0.8, epochs=2, seed=7).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences, with its ids: a sequence is the ids of its pieces
    by offset."""
    return packing.packed_pieces(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii_surrogates", replace_personal_data),
    ("hierarchical_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the trained classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
