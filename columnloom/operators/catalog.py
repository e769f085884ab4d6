"""Column catalog: types, samples, ids, inventory, enrichment with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnloom.functions.text import NO_DESCRIPTION, REFER_TO_TABLE, column_id, profile_type

SAMPLES, HEAD_ROWS, FIRST_ROWS = 3, 5, 1000


def _text(df: DataFrame, name: str, kind: str):
    """A sample as text. Doubles get the short decimal form; not-a-number counts as null."""
    if kind in ("double", "float"):
        value = F.col(f"`{name}`").cast("double")
        short = value.cast("string")
        plain = F.regexp_replace(F.regexp_replace(short.cast("decimal(38,17)").cast("string"), r"0+$", ""), r"\.$", ".0")
        return F.when(value.isNotNull() & ~F.isnan(value), F.when(short.contains("E"), F.coalesce(plain, short)).otherwise(short))
    return F.col(f"`{name}`").cast("string")


def profile_types(df: DataFrame, source_id: str, table_name: str) -> DataFrame:
    """source_id, table_name, column_name, ordinal, data_type from the schema alone; no data is read."""
    rows = [(source_id, table_name, name, i, profile_type(kind)) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "source_id string, table_name string, column_name string, ordinal int, data_type string")


def schema_inventory(df: DataFrame, source_id: str, table_name: str) -> DataFrame:
    """source_id, table_name, columns array<string>."""
    return df.sparkSession.createDataFrame([(source_id, table_name, df.columns)], "source_id string, table_name string, columns array<string>")


#: What a value must look like for its column to be of a type, tried in this order.
_SHAPES = [("bool", r"^(True|False|TRUE|FALSE|true|false)$"), ("int64", r"^[+-]?[0-9]+$"), ("float64", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(NaN|nan|inf|Infinity)$")]


def profile_head_types(df: DataFrame, source_id: str, table_name: str, order_by: list[str], head: int = HEAD_ROWS) -> DataFrame:
    """source_id, table_name, column_name, ordinal, data_type, inferred from the text of the first rows alone.

    Whole numbers beside a missing value are float64, and so is a column without any value; whatever fits no shape is str.
    """
    first = df.orderBy(*order_by).limit(head)
    cells = first.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias("ordinal", "value"))
    fits = [F.coalesce(F.bool_and(F.col("value").rlike(shape)), F.lit(True)).alias(kind) for kind, shape in _SHAPES]
    seen = cells.groupBy("ordinal").agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("rows"), *fits)
    kind = (
        F.when(F.col("n") == 0, "float64").when(F.col("bool") & (F.col("n") == F.col("rows")), "bool")
        .when(F.col("int64"), F.when(F.col("n") == F.col("rows"), "int64").otherwise("float64")).when(F.col("float64"), "float64").otherwise("str")
    )
    names = profile_types(df, source_id, table_name).drop("data_type")
    return names.join(F.broadcast(seen.select("ordinal", kind.alias("data_type"))), "ordinal", "left").select("source_id", "table_name", "column_name", "ordinal", F.coalesce("data_type", F.lit("float64")).alias("data_type"))


def profile_samples(df: DataFrame, source_id: str, table_name: str, order_by: list[str], k: int = SAMPLES, head: int | None = None, first: int = FIRST_ROWS) -> DataFrame:
    """source_id, table_name, column_name, ordinal, samples: the first k non-null values, duplicates kept.

    ``head`` restricts the search to the first rows. Nearly every column has its samples among the ``first`` rows, which
    one scan takes without sorting the table; only for the columns that have not, a scan of that column alone follows.
    """
    kinds, at = dict(df.dtypes), F.struct(*[F.col(c) for c in order_by])
    text = [_text(df, c, kinds[c]).alias(f"c{i}") for i, c in enumerate(df.columns)]
    rows = df.orderBy(*order_by).limit(head or first).select(at.alias("__at"), *text)
    cells = rows.select("__at", F.posexplode(F.array(*[f"c{i}" for i in range(len(df.columns))])).alias("ordinal", "value"))
    if head is None:
        known = cells.groupBy("ordinal").agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        for r in known:
            if r.n < k and r.rows >= first:
                more = df.select(at.alias("__at"), text[r.ordinal].alias("value")).where("value IS NOT NULL").orderBy("__at").limit(k)
                cells = cells.where(F.col("ordinal") != r.ordinal).unionByName(more.select("__at", F.lit(r.ordinal).alias("ordinal"), "value"))
    place = Window.partitionBy("ordinal").orderBy("__at")
    kept = cells.where("value IS NOT NULL").withColumn("n", F.row_number().over(place)).where(F.col("n") <= k)
    found = kept.groupBy("ordinal").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda s: s["value"]).alias("samples"))
    names = profile_types(df, source_id, table_name).drop("data_type")
    return names.join(F.broadcast(found), "ordinal", "left").select("source_id", "table_name", "column_name", "ordinal", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def with_ids(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("column_id", column_id(F.col("source_id"), F.col("table_name"), F.col("column_name")))


def with_table_descriptions(catalog: DataFrame, tables: DataFrame, default: str = NO_DESCRIPTION) -> DataFrame:
    """Add table_desc from (source_id, table_name, description), with a default."""
    described = tables.select("source_id", "table_name", F.col("description").alias("table_desc"))
    return catalog.join(described, ["source_id", "table_name"], "left").withColumn("table_desc", F.coalesce("table_desc", F.lit(default)))


def with_descriptions(catalog: DataFrame, views: DataFrame, default: str = REFER_TO_TABLE) -> DataFrame:
    """Add description from column views (source_id, table_name, column_name, description), with a default."""
    return catalog.join(views, ["source_id", "table_name", "column_name"], "left").withColumn("description", F.coalesce("description", F.lit(default)))


def unmatched_views(catalog: DataFrame, views: DataFrame) -> DataFrame:
    """View keys that name no column of the catalog: reported, never stored as ids."""
    return views.join(catalog, ["source_id", "table_name", "column_name"], "left_anti")


def with_fallback(views: DataFrame, headers: DataFrame) -> DataFrame:
    """Columns of the views, and of the file headers for tables that have no view."""
    seen = views.select("source_id", "table_name").distinct()
    rest = headers.join(seen, ["source_id", "table_name"], "left_anti").withColumn("description", F.lit(None).cast("string"))
    return views.select("source_id", "table_name", "column_name", "description").unionByName(rest.select("source_id", "table_name", "column_name", "description"))


def needs_description(df: DataFrame, column: str = "description", least: int = 10) -> DataFrame:
    """Add needs_description: no text, or a text under ``least`` characters after trimming."""
    return df.withColumn("needs_description", F.coalesce(F.length(F.trim(F.col(column))) < least, F.lit(True)))


def uncertain_split(df: DataFrame, column: str = "description", below: int = 15) -> DataFrame:
    """Add escalate: the small model's answer says it is uncertain and little else."""
    text = F.col(column)
    return df.withColumn("escalate", F.coalesce(F.upper(text).contains("UNCERTAIN") & (F.length(text) < below), F.lit(False)))
