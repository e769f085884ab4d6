"""External functions: completion and embedding providers, batched on the executors.

A provider is an object that can be pickled; nothing here needs a network. The offline defaults make runs reproducible:
the completion default describes a column from its name, type and samples, the embedding default hashes character
n-grams. Errors come back in a ``status`` column and never as a description.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.functions.text import json_object
from columnloom.operators.catalog import uncertain_split

#: Rows of one call.
BATCH = 10


class CompletionProvider(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class EmbeddingProvider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class TemplateCompletion:
    """Says of a column what its name, type and samples tell; ``uncertain`` where there is no sample."""

    def __init__(self, certain: bool = False) -> None:
        self.certain = certain

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            name, kind, samples = (prompt.split("\t") + ["", ""])[:3]
            words = " ".join(re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)).lower() or name
            empty = samples in ("", "[]")
            out.append("Uncertain" if empty and not self.certain else f"The {words} of the record ({kind})" + (f", for example {samples}." if not empty else "."))
        return out


class InventoryCompletion:
    """Describes a source or a table by what the JSON behind the last line break of its prompt lists."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            items = json.loads(prompt.rsplit("\n", 1)[-1] or "[]")
            names = [x.get("table_name") or x.get("column_name") for x in items]
            what = "tables" if any("table_name" in x for x in items) else "columns"
            out.append(f"Holds the {what} {', '.join(names)}." if names else "Uncertain")
        return out


class NoExtraction:
    """The offline default: nothing is extracted from texts."""

    def complete(self, prompts: list[str]) -> list[str]:
        return ["{}"] * len(prompts)


class HashingEmbedding:
    """Signed hashing of character n-grams with sublinear counts, length 1. Its scores are not an encoder's."""

    def __init__(self, dimension: int = 384, sizes: tuple[int, ...] = (3, 4, 5)) -> None:
        self.dimension, self.sizes = dimension, sizes

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            padded = f" {' '.join(re.findall(r'[^\W_]+', text.lower()))} "
            for n in self.sizes:
                for k in range(len(padded) - n + 1):
                    h = zlib.crc32(padded[k : k + n].encode())
                    out[i, h % self.dimension] += 1 if h >> 31 else -1
        out = np.sign(out) * np.log1p(np.abs(out))
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def complete(rows: DataFrame, prompt: str, provider: CompletionProvider, batch: int = BATCH, parallel: int | None = None) -> DataFrame:
    """``rows`` with answer and status (``ok`` or the error); calls hold ``batch`` prompts, a failed call fails its rows only.

    ``parallel`` sets how many tasks call at once. Calls may repeat when a task is retried.
    """
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), batch):
                piece = part.iloc[start : start + batch].copy()
                try:
                    answers = list(provider.complete(piece[prompt].tolist()))
                    if len(answers) != len(piece):
                        raise ValueError(f"{len(answers)} answers to {len(piece)} prompts")
                    piece["answer"] = [a if isinstance(a, str) else None for a in answers]
                    piece["status"] = ["ok" if isinstance(a, str) else "no text" for a in answers]
                except Exception as error:  # noqa: BLE001  whatever a remote service raises
                    piece["answer"], piece["status"] = None, f"{type(error).__name__}: {error}"
                yield piece[[*names, "answer", "status"]]

    source = rows.repartition(parallel) if parallel else rows
    return source.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", answer string, status string")


def two_tier(rows: DataFrame, prompt: str, small: CompletionProvider, large: CompletionProvider, below: int = 15, batch: int = BATCH) -> DataFrame:
    """``rows`` with answer, status and tier: the large model sees only what the small one left uncertain or failed."""
    first = complete(rows, prompt, small, batch)
    split = uncertain_split(first, "answer", below).withColumn("escalate", F.col("escalate") | (F.col("status") != "ok"))
    kept = split.where(~F.col("escalate")).drop("escalate").withColumn("tier", F.lit("small"))
    again = split.where("escalate").drop("escalate", "answer", "status")
    return kept.unionByName(complete(again, prompt, large, batch).withColumn("tier", F.lit("large")))


def embed(rows: DataFrame, text: str, provider: EmbeddingProvider, name: str = "vector") -> DataFrame:
    """``rows`` with an array<float> column."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([v.astype(np.float32) for v in provider.embed(part.fillna("").tolist())])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(name, F.pandas_udf(run, "array<float>")(F.col(text)))


def column_prompts(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("prompt", F.concat_ws("\t", "column_name", "data_type", F.to_json("samples")))


#: What an answer about a text may hold.
EXTRACTED = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<src:string,tgt:string,description:string,keywords:string,weight:double>>"


def extract(docs: DataFrame, text: str, provider: CompletionProvider | None = None, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that a provider finds in texts, in the shape of the graph's own tables.

    ``docs``: source_id and the text. Answers are JSON objects, perhaps with words around; others, and failed calls, give
    nothing. A relation whose ends are not both among the extracted entities of its text is left out.
    """
    answers = complete(docs.select("source_id", F.col(text).alias("prompt")), "prompt", provider or NoExtraction(), batch)
    read = answers.where("status = 'ok'").select("source_id", json_object(F.col("answer"), EXTRACTED).alias("found")).where("found IS NOT NULL")
    nodes = read.select("source_id", F.explode("found.entities").alias("e")).where("e.name IS NOT NULL")
    nodes = nodes.groupBy(F.col("e.name").alias("node_id")).agg(F.min("e.type").alias("node_type"), F.min("e.description").alias("description"), F.min("source_id").alias("source_id"))
    known = F.transform("found.entities", lambda e: e["name"])
    edges = read.select("source_id", known.alias("known"), F.explode("found.relations").alias("r")).where(F.array_contains("known", F.col("r.src")) & F.array_contains("known", F.col("r.tgt")))
    edges = edges.select(F.col("r.src").alias("src_id"), F.col("r.tgt").alias("tgt_id"), F.coalesce("r.keywords", F.lit("")).alias("keywords"), F.coalesce("r.weight", F.lit(1.0)).alias("weight"), F.col("r.description").alias("description"), "source_id")
    return nodes, edges.dropDuplicates(["src_id", "tgt_id", "keywords"])
