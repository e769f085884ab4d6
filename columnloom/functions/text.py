"""Text expressions: ids, trimming, canonical pairs, list literals, JSON from free text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator of document batches and knowledge-base blocks.
BLOCK_SEPARATOR = "\n\n===\n\n"
LINK = "<->"
NO_DESCRIPTION = "No description available."
REFER_TO_TABLE = "Refer to table description."


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` takes off spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_dashes(text: Column) -> Column:
    return F.regexp_replace(text, r"^-+|-+$", "")


def column_id(source: Column, table: Column, column: Column) -> Column:
    """Dotted id. Column names may hold dots, so ids are built and compared but never taken apart."""
    return F.concat_ws(".", source, table, column)


def underscore_id(source: Column, table: Column, column: Column) -> Column:
    return F.concat_ws("_", source, table, column)


def source_of(column_id: Column) -> Column:
    """The text before the first dot, the only part of an id that can be read back."""
    return F.substring_index(column_id, ".", 1)


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ids in byte order, so that both orientations are one pair."""
    return F.least(a, b), F.greatest(a, b)


def list_literal(items: Column) -> Column:
    """An array of strings as ``["a", "b"]`` (JSON)."""
    return F.to_json(items)


def safe_name(name: Column) -> Column:
    return F.translate(name, "/ ", "__")


def json_object(text: Column, schema: str) -> Column:
    """The JSON object between the first ``{`` and the last ``}``; without braces the whole text; else null.

    Two objects in one text span both and give null: the whole text is tried only where there is no brace.
    """
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    chosen = F.when(braces != "", braces).otherwise(text)
    return F.when(F.json_array_length(F.concat(F.lit("["), chosen, F.lit("]"))) == 1, F.from_json(chosen, schema))


#: Spark type -> the name that profiles show.
PROFILE_TYPES = {"tinyint": "int64", "smallint": "int64", "int": "int64", "bigint": "int64", "float": "float64", "double": "float64", "boolean": "bool"}


def profile_type(spark_type: str) -> str:
    """Canonical name of an observed type: int64, float64, bool or str."""
    return "float64" if spark_type.startswith("decimal") else PROFILE_TYPES.get(spark_type, "str")


def declared_type(declared: str) -> str:
    """Spark type of a declared column type such as ``varchar(20)``, ``numeric(9)`` or ``bigint unsigned``."""
    name, _, rest = re.sub(r"\s+", " ", declared.strip().lower()).partition("(")
    words = name.split()
    base, unsigned = (words[0] if words else ""), "unsigned" in declared.lower()
    if base in ("numeric", "decimal"):
        digits = [int(x) for x in re.findall(r"\d+", rest.partition(")")[0])]
        return f"decimal({min(digits[0], 38)},{digits[1] if len(digits) > 1 else 0})" if digits else "decimal(38,0)"
    whole = {"tinyint": "tinyint", "smallint": "smallint", "int": "int", "integer": "int", "mediumint": "int", "bigint": "bigint"}
    wider = {"tinyint": "smallint", "smallint": "int", "int": "bigint", "bigint": "decimal(20,0)"}
    if base in whole:
        return wider[whole[base]] if unsigned else whole[base]
    if base in ("real", "float"):
        return "float" if base == "real" else "double"
    if base == "double":
        return "double"
    if base in ("boolean", "bool"):
        return "boolean"
    return {"date": "date", "timestamp": "timestamp", "datetime": "timestamp"}.get(base, "string")
