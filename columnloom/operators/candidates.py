"""Source pairs to be matched, their payload, and resuming an interrupted run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.operators.text import numbered


def columns_per_source(columns: DataFrame) -> DataFrame:
    return columns.groupBy("domain_id", "source_id").agg(F.count(F.lit(1)).alias("n_columns"))


def domain_columns(domains: DataFrame, columns: DataFrame) -> DataFrame:
    """domain_id, source_id, column_id."""
    return domains.join(columns.select("source_id", "column_id"), "source_id").select("domain_id", "source_id", "column_id")


def valid_domains(columns: DataFrame) -> DataFrame:
    """domain_id, n_sources of domains with at least two sources that have columns."""
    found = columns.select("domain_id", "source_id").distinct().groupBy("domain_id").agg(F.count(F.lit(1)).alias("n_sources"))
    return found.where("n_sources >= 2")


def source_pairs(sources: DataFrame) -> DataFrame:
    """domain_id, source_a, source_b for all pairs inside a domain, in list order. ``sources``: domain_id, source_id, ordinal."""
    a, b = sources.alias("a"), sources.alias("b")
    joined = a.join(b, (F.col("a.domain_id") == F.col("b.domain_id")) & (F.col("a.ordinal") < F.col("b.ordinal")))
    return joined.select(F.col("a.domain_id").alias("domain_id"), F.col("a.source_id").alias("source_a"), F.col("b.source_id").alias("source_b"))


def pair_payload(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """Pairs with the ordered column ids of both sources (columns_a, columns_b). ``columns``: source_id, column_id, ordinal."""
    lists = columns.groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_id"))), lambda s: s["column_id"]).alias("ids"))
    out = pairs.join(lists.select(F.col("source_id").alias("source_a"), F.col("ids").alias("columns_a")), "source_a")
    out = out.join(lists.select(F.col("source_id").alias("source_b"), F.col("ids").alias("columns_b")), "source_b")
    return out.select("domain_id", "source_a", "source_b", "columns_a", "columns_b")


def resume_pending(pairs: DataFrame, done: DataFrame, every: int = 10) -> DataFrame:
    """Pairs not done yet with their position and checkpoint number (``every`` pairs each)."""
    rest = pairs.join(done.select("domain_id", "source_a", "source_b").distinct(), ["domain_id", "source_a", "source_b"], "left_anti")
    keyed = rest.withColumn("__key", F.concat_ws("\u0001", "domain_id", "source_a", "source_b"))
    placed = numbered(keyed, "__key", "position").drop("__key")
    return placed.withColumn("position", F.col("position").cast("long")).withColumn("checkpoint", F.floor(F.col("position") / every).cast("long"))
