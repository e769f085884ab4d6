"""Texts made of the catalog: embedding texts, table documents, batches, narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from columnloom.functions.text import BLOCK_SEPARATOR, list_literal


# The wordings of the texts below, which prepared texts made elsewhere carry too.


def source_text(sources: DataFrame) -> DataFrame:
    """source_id, text from (source_id, description, tables array<string>)."""
    return sources.select("source_id", F.concat(F.coalesce("description", F.lit("")), F.lit(" Tables: "), F.array_join("tables", ", ")).alias("text"))


def column_text(catalog: DataFrame, augmented: bool = True) -> DataFrame:
    """column_id, text: the name, and in the augmented mode the description behind it."""
    text = F.concat_ws(" ", "column_name", F.coalesce("description", F.lit(""))) if augmented else F.col("column_name")
    return catalog.select("column_id", text.alias("text"))


def _ordered(order: str, text, separator: str):
    """The texts of a group joined in the order of a column, whatever order the rows came in."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), text.alias("text")))), lambda s: s["text"]), separator)


def table_documents(catalog: DataFrame) -> DataFrame:
    """source_id, table_name, doc_ord, text: one document per table, a line per column in catalog order."""
    line = F.concat(F.lit("- "), "column_name", F.lit(" ("), "data_type", F.lit("): "), "description", F.lit(" Samples: "), list_literal(F.col("samples")))
    docs = catalog.groupBy("source_id", "table_name").agg(F.min("ordinal").alias("doc_ord"), F.min_by("table_desc", "ordinal").alias("table_desc"), _ordered("ordinal", line, "\n").alias("lines"))
    head = F.concat(F.lit("Table "), "source_id", F.lit("."), "table_name", F.lit(" is about: "), "table_desc", F.lit("\nIt contains the following columns:\n"), "lines")
    return docs.select("source_id", "table_name", "doc_ord", head.alias("text"))


def batches(docs: DataFrame, order: str, text: str, size: int = 10, separator: str = BLOCK_SEPARATOR, within: str | None = None) -> DataFrame:
    """(within,) batch_no, n_docs, text: ``size`` consecutive documents joined.

    Without ``within`` the position is a global one (:func:`numbered`).
    """
    keys = [within] if within else []
    if within:
        placed = docs.withColumn("__n", F.row_number().over(Window.partitionBy(within).orderBy(order)) - 1)
    else:
        placed = numbered(docs, order, "__n")
    placed = placed.withColumn("batch_no", F.floor(F.col("__n") / size).cast("long"))
    return placed.groupBy(*keys, "batch_no").agg(F.count(F.lit(1)).alias("n_docs"), _ordered("__n", F.col(text), separator).alias("text"))


#: Rows of a part when a table is numbered, bounds of one level of its search, and sampled keys per part.
PART_ROWS, WIDTH, KEYS = 250_000, 128, 20


def _bounds(df: DataFrame, key: Column, parts: int, total: int) -> list[str]:
    """Keys, as JSON, that cut ``df`` into about ``parts`` even parts; from a sample that Spark sorts."""
    drawn = df.select(key.alias("k")).sample(min(1.0, KEYS * parts / max(1, total)), seed=7).orderBy("k")
    keys = [r[0] for r in drawn.select(F.to_json(F.struct("k"))).collect()]
    if len(keys) < 2 * parts:
        return []
    chosen = [keys[len(keys) * n // parts] for n in range(1, parts)]
    return [k for n, k in enumerate(chosen) if not n or k != chosen[n - 1]]


def _part(key: Column, kind: str, bounds: list[str]) -> Column:
    """How many bounds are not above the key, in two steps of about ``WIDTH`` comparisons; the bounds are one constant."""

    def below(held: Column) -> Column:
        return F.size(F.filter(held, lambda b: b["k"] <= key))

    if not bounds:
        return F.lit(0)
    whole = f"array<struct<k:{kind}>>"
    if len(bounds) <= WIDTH:
        return below(F.from_json(F.lit(f"[{','.join(bounds)}]"), whole))
    step = -(-len(bounds) // WIDTH)
    blocks = [bounds[n : n + step] for n in range(0, len(bounds), step)]
    block = F.greatest(below(F.from_json(F.lit(f"[{','.join(b[0] for b in blocks)}]"), whole)), F.lit(1))
    inner = F.from_json(F.lit("[" + ",".join(f"[{','.join(b)}]" for b in blocks) + "]"), f"array<{whole}>")
    return (block - 1) * step + below(F.element_at(inner, block))


def numbered(df: DataFrame, order: str, name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Positions from 0 in a global order, nulls first, with no task that sees all rows.

    The order is the column and, among equal values, a hash of the whole row, so that rows of one value still part (equal
    rows do not, as any order of theirs is right). It is cut at bounds from a sample, one part for ``part_rows`` rows, up
    to ``WIDTH`` squared parts. The bounds are constants of the plan, so a part holds the same rows whenever it is computed
    again. A row's position is its rank in its part plus the sizes of the parts before.
    """
    total = df.count()
    parts = min(WIDTH * WIDTH, max(1, -(-total // part_rows)))
    key = F.struct(F.col(order).alias("o"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    kind = f"struct<o:{df.select(order).schema[0].dataType.simpleString()},h:bigint>"
    cut = df.withColumn("__p", _part(key, kind, _bounds(df, key, parts, total) if parts > 1 else []))
    sizes = cut.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))  # one row per part
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__p", before.alias("__s")))  # as many rows as parts
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return cut.withColumn("__i", inside).join(starts, "__p").withColumn(name, F.col("__s") + F.col("__i")).drop("__p", "__i", "__s")


def nonempty_docs(docs: DataFrame, column: str = "content") -> DataFrame:
    return docs.where(F.length(column) > 0)


def column_narrative(catalog: DataFrame, prefix: int = 200) -> DataFrame:
    """column_id, text: one paragraph per column with the first characters of the table's description."""
    text = F.concat(
        F.lit("Column '"), "column_name", F.lit("' (Type: "), "data_type", F.lit(") belongs to table '"), "table_name", F.lit("' in "), "source_id", F.lit(". Semantic Meaning: "), "description",
        F.lit(". Sample Values: "), list_literal(F.col("samples")), F.lit(". Table Context: This table is about "), F.substring("table_desc", 1, prefix), F.lit("..."),
    )
    return catalog.select("column_id", text.alias("text"))


def field_narrative(catalog: DataFrame) -> DataFrame:
    """column_id, text: meaning, technical specification and lineage, a line each."""
    text = F.concat(
        F.lit("FIELD: '"), "column_name", F.lit("' in Table '"), "table_name", F.lit("' ("), "source_id", F.lit(")\nSEMANTIC MEANING: "), "description",
        F.lit("\nTECHNICAL SPEC: Type "), "data_type", F.lit(", Samples "), list_literal(F.col("samples")), F.lit("\nLINEAGE: "), F.concat_ws(" > ", "source_id", "table_name", "column_name"),
    )
    return catalog.select("column_id", text.alias("text"))


def table_narrative(catalog: DataFrame) -> DataFrame:
    """source_id, table_name, text: description and the columns with their samples."""
    item = F.concat("column_name", F.lit(" (Samples: "), list_literal(F.col("samples")), F.lit(")"))
    tables = catalog.groupBy("source_id", "table_name").agg(F.min_by("table_desc", "ordinal").alias("table_desc"), _ordered("ordinal", item, "\n- ").alias("items"))
    text = F.concat(F.lit("TABLE: "), "table_name", F.lit("\nSOURCE: "), "source_id", F.lit("\nDESCRIPTION: "), "table_desc", F.lit("\nCOLUMN_MANIFEST_WITH_SAMPLES:\n- "), "items")
    return tables.select("source_id", "table_name", text.alias("text"))


def source_narrative(inventory: DataFrame) -> DataFrame:
    """source_id, text from (source_id, description, ordinal, table_name, columns array<string>)."""
    item = F.concat(F.lit("- Table: "), "table_name", F.lit(" (Columns: "), F.array_join("columns", ", "), F.lit(")"))
    sources = inventory.groupBy("source_id").agg(F.min_by("description", "ordinal").alias("description"), _ordered("ordinal", item, "\n").alias("manifest"))
    return sources.select("source_id", F.concat(F.lit("DATA SOURCE: "), "source_id", F.lit("\nBUSINESS SCOPE: "), "description", F.lit("\nASSET MANIFEST:\n"), "manifest").alias("text"))
