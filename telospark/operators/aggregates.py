"""Aggregations over annotated variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telospark.operators.filters import TRUNCATIONS


def context_histogram(df: DataFrame, by: list[str], context: str = "context") -> DataFrame:
    """Counts by context, with the first slot for its order of appearance."""
    return df.groupBy(*by, context).agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"))


def average_position(offset: Column, cds_length: Column) -> Column:
    """Mean relative position; NaN if no offset is known."""
    return F.coalesce(F.avg(offset / (cds_length / 3)), F.lit(float("nan")))


def truncations(effect: Column) -> Column:
    return F.count_if(effect.isin(*TRUNCATIONS))


def ddg_mean(variants: DataFrame, energies: DataFrame, by: list[str], name: str = "short", distinct: bool = True) -> DataFrame:
    """Mean energy of the known variants, each name once (or with repeats); 0 if none is known."""
    rows = variants.select(*by, "gene", F.substring(F.col(name), 3, 10_000).alias("variant"))
    rows = rows.dropDuplicates() if distinct else rows
    got = rows.join(energies, ["gene", "variant"], "left").groupBy(*by).agg(F.coalesce(F.avg("ddg"), F.lit(0.0)).alias("ddg_avg"))
    return got


def delta_sum(delta: Column) -> Column:
    return F.coalesce(F.sum(delta), F.lit(0.0))
