"""Writers: views, domains, documents, matches, checkpoints, prepared texts, the audit log, the console report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.functions.text import BLOCK_SEPARATOR


def source_views(views: DataFrame, path: str) -> None:
    """One JSON object per source: description and inventory."""
    _objects(views.groupBy("source_id").agg(F.min_by("description", "ordinal").alias("description"), F.sort_array(F.collect_list(F.struct("ordinal", "table_name", "columns"))).alias("schema_inventory")), path, "source_id")


def table_views(views: DataFrame, path: str) -> None:
    """One JSON object per table: description and columns with type and samples."""
    _objects(views.groupBy("source_id", "table_name").agg(F.min_by("table_desc", "ordinal").alias("description"), F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "data_type", "samples"))).alias("columns")), path, "source_id")


def column_views(views: DataFrame, path: str) -> None:
    """One JSON object per table: column names to descriptions in catalog order; of a repeated name the last description."""
    views = views.groupBy("source_id", "table_name", "column_name").agg(F.min("ordinal").alias("first"), F.max_by("description", "ordinal").alias("description")).withColumnRenamed("first", "ordinal")
    entries = F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "description")))
    rows = views.groupBy("source_id", "table_name").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["column_name"], e["description"]))).alias("columns"))
    _objects(rows, path, "source_id")


def _objects(rows: DataFrame, path: str, partition: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).json(path)


def domain_map(domains: DataFrame, path: str) -> None:
    members = domains.groupBy("domain_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))
    members.write.mode("overwrite").json(path)


def documents(docs: DataFrame, path: str, domain: str = "domain_id", text: str = "text") -> DataFrame:
    """Append the documents that are not stored yet; the key is the content's hash within its domain, so retries add nothing."""
    spark = docs.sparkSession
    keyed = docs.withColumn("doc_hash", F.sha2(F.concat_ws("\n", domain, text), 256)).dropDuplicates(["doc_hash"])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        keyed = keyed.join(spark.read.parquet(path).select("doc_hash"), "doc_hash", "left_anti")
    keyed.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def matches(found: DataFrame, path: str) -> None:
    found.select("col_a", "col_b", F.col("domain_id").alias("domain")).write.mode("overwrite").json(path)


def checkpoint(found: DataFrame, pairs: DataFrame, path: str) -> None:
    """Store the matches of finished source pairs and that they are finished; doing a pair again replaces it.

    ``found`` and ``pairs`` have domain_id, source_a, source_b and the checkpoint number.
    """
    for name, rows in (("matches", found), ("done", pairs)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("checkpoint").parquet(f"{path}/{name}")


def prepared_corpus(entries: DataFrame, path: str) -> None:
    """layer, id, content and metadata as JSON."""
    entries.write.mode("overwrite").json(path)


def knowledge_text(blocks: DataFrame, path: str, order: str, text: str = "text") -> None:
    """Blocks in order, parted by the separator line; each file of the folder continues the one before."""
    ordered = blocks.orderBy(order).select(F.col(text).alias("value"))
    ordered.write.mode("overwrite").option("lineSep", BLOCK_SEPARATOR).text(path)


def audit_log(rows: DataFrame, path: str) -> None:
    """Append step, question, answer."""
    rows.select("step", "question", "answer").write.mode("append").json(path)


def report(metrics: DataFrame) -> list[str]:
    """One line per label; a table of metrics is as small as the number of truth files."""
    rows = metrics.orderBy(F.col("label") == "ALL", "label").collect()
    return [f"{r.label}: truth {r.n_truth}, predicted {r.n_predicted}, TP {r.tp}, FP {r.fp}, FN {r.fn}, P {r.precision:.4f}, R {r.recall:.4f}, F1 {r.f1:.4f}" for r in rows]
