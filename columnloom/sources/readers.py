"""Readers: configuration, source folders, CSV tables, semantic views, domains, truth, predictions, prepared texts.

Everything that holds data is read by Spark, so any file system it knows will do. Listings go through Spark's own file
system layer and are sorted, as folders have no order.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shapes of the views.
SOURCE_VIEW = "description string, schema_inventory array<struct<table_name:string,columns:array<string>>>"
TABLE_VIEW = "table_name string, description string, columns array<struct<column_name:string,data_type:string,samples:array<string>>>"
FLAT_TRUTH = "matches array<struct<source_id:string,source_table:string,source_column:string,target_id:string,target_table:string,target_column:string>>"
GROUP_TRUTH = "array<struct<aligned_columns:array<struct<source_id:string,table:string,column:string>>>>"
MATCHES = "array<struct<col_a:string,col_b:string,domain:string>>"


@dataclass(frozen=True)
class Config:
    """Where the data is and how to match; credentials are a provider's business and never kept here."""

    data_path: str = "data"
    similarity_threshold: float = 0.75
    batch_size: int = 10
    checkpoint_every: int = 10


def load_config(spark: SparkSession, path: str) -> Config:
    """Known keys of a JSON object; others are ignored."""
    rows = spark.read.text(path, wholetext=True).first()
    found = json.loads(rows[0]) if rows else {}
    return Config(**{f.name: found[f.name] for f in fields(Config) if f.name in found})


def listed(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is_folder) of a folder's entries by name; empty where there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    return sorted((x.getPath().getName(), x.isDirectory()) for x in system.listStatus(at))


def sources(spark: SparkSession, root: str, count: int | None = None) -> list[str]:
    """The folders source1, source2, ... that exist, in numeric order; up to source{count} if given."""
    numbers = sorted(int(name[6:]) for name, folder in listed(spark, root) if folder and re.fullmatch(r"source[1-9][0-9]*", name))
    return [f"source{n}" for n in numbers if count is None or n <= count]


def tables(spark: SparkSession, root: str, source: str) -> list[str]:
    """Stems of a source's CSV files."""
    return [name[:-4] for name, folder in listed(spark, f"{root}/{source}") if name.endswith(".csv") and not folder]


def table_views(spark: SparkSession, root: str, source: str) -> list[str]:
    """Tables that have a table view: neither the source's own view nor column views count."""
    end = "_semantic_view.json"
    names = [name for name, folder in listed(spark, f"{root}/{source}") if name.endswith(end) and not folder]
    return [n[: -len(end)] for n in names if not n.endswith("_columns" + end) and not n.startswith(f"{source}_")]


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line; an unreadable or empty file has none."""
    try:
        return spark.read.csv(path, header=True).columns
    except Exception:  # noqa: BLE001  a bad file is skipped, whatever is wrong with it
        return []


def csv_table(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """The whole file with inferred types. ``multi_line`` reads values with line ends, which makes each file one task.

    Unless told, a scan looks for lines with an odd number of quotes, which only such values leave.
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
        multi_line = bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=multi_line, escape='"')


def csv_head(spark: SparkSession, path: str, rows: int = 5) -> DataFrame:
    """The first rows with types inferred from these rows alone; other rows are not parsed."""
    names = csv_header(spark, path)
    head = spark.read.text(path).limit(rows + 1)  # the first file split's first lines
    lines = [r.value for r in head.collect()]
    return spark.read.csv(spark.sparkContext.parallelize(lines, 1), header=True, inferSchema=True, escape='"') if names else spark.createDataFrame([], T.StructType([]))


def declared_types(spark: SparkSession, path: str) -> DataFrame:
    """column_name, declared_type of an object {column: {type}}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<type:string>>").alias("m"))
    return whole.select(F.explode("m").alias("column_name", "v")).select("column_name", F.col("v.type").alias("declared_type"))


def source_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key, value of either metadata shape."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("key", "value"))


def source_view(spark: SparkSession, root: str, source: str) -> DataFrame:
    """source_id, description, ordinal, table_name, columns: a row per table of the inventory."""
    rows = spark.read.schema(SOURCE_VIEW).json(f"{root}/{source}/{source}_semantic_view.json", multiLine=True)
    rows = rows.select(F.lit(source).alias("source_id"), F.coalesce("description", F.lit("")).alias("description"), F.posexplode_outer("schema_inventory").alias("ordinal", "t"))
    return rows.select("source_id", "description", "ordinal", F.col("t.table_name").alias("table_name"), F.col("t.columns").alias("columns"))


def table_view(spark: SparkSession, root: str, source: str, table: str) -> DataFrame:
    """source_id, table_name, description, column_name, ordinal, data_type, samples."""
    rows = spark.read.schema(TABLE_VIEW).json(f"{root}/{source}/{table}_semantic_view.json", multiLine=True)
    rows = rows.select(F.lit(source).alias("source_id"), F.lit(table).alias("table_name"), "description", F.posexplode_outer("columns").alias("ordinal", "c"))
    return rows.select("source_id", "table_name", "description", F.col("c.column_name").alias("column_name"), "ordinal", F.coalesce("c.data_type", F.lit("unknown")).alias("data_type"), F.coalesce("c.samples", F.array().cast("array<string>")).alias("samples"))


def column_view(spark: SparkSession, root: str, source: str, table: str) -> DataFrame:
    """source_id, table_name, column_name, ordinal, description in the order of the object's keys."""
    whole = spark.read.text(f"{root}/{source}/{table}_columns_semantic_view.json", wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", "map<string,string>")).alias("ordinal", "column_name", "description"))
    return rows.select(F.lit(source).alias("source_id"), F.lit(table).alias("table_name"), "column_name", "ordinal", "description")


def domain_map(spark: SparkSession, path: str) -> DataFrame:
    """domain_id, domain_ord, source_id, source_ord in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "map<string,array<string>>")).alias("domain_ord", "domain_id", "members"))
    return whole.select("domain_id", "domain_ord", F.posexplode("members").alias("source_ord", "source_id"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """col_a, col_b, domain of a list of matches."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", MATCHES)).alias("m"))
    return whole.select("m.col_a", "m.col_b", "m.domain")


def truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both shapes of truth files under a path or glob: flat rows and anchor rows, each file read as what it is.

    The shape is told by the first character (an object or a list); the label is the file's stem.
    """
    label = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(label.alias("label"), "value")
    first = F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1)
    flat = whole.where(first == "{").select("label", F.explode(F.from_json("value", FLAT_TRUTH)["matches"]).alias("m")).select("label", "m.*")
    groups = whole.where(first == "[").select("label", F.posexplode(F.from_json("value", GROUP_TRUTH)).alias("anchor_id", "a"))
    cells = groups.select("label", "anchor_id", F.explode("a.aligned_columns").alias("c"))
    anchors = cells.select("label", "anchor_id", F.concat_ws(".", "c.source_id", "c.table", "c.column").alias("column_id"), F.col("c.source_id").alias("source_id"))
    return flat, anchors


def prepared_corpus(spark: SparkSession, path: str) -> DataFrame:
    """layer, id, content of a list of prepared entries, without empty contents."""
    shape = "array<struct<layer:string,id:string,content:string>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)).alias("e")).select("e.*")
    return whole.where(F.length("content") > 0)


def knowledge_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of whole prepared files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
