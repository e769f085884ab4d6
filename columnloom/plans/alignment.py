"""From a catalog to scored matches: enrichment, domains, graph, candidate pairs, answers, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.functions.text import LINK, json_object
from columnloom.operators import candidates, cluster, evaluate, graph, parse, providers, text, vectors
from columnloom.operators.catalog import needs_description


def enrich(catalog: DataFrame, small: providers.CompletionProvider, large: providers.CompletionProvider) -> DataFrame:
    """``catalog`` with a description for every column: what is there if usable, else the two-tier answer; null on failure.

    Columns are keyed by the catalog's own ids, so an answer can't rename, add or lose one.
    """
    marked = needs_description(catalog)
    asked = providers.column_prompts(marked.where("needs_description")).select("column_id", "prompt")
    answers = providers.two_tier(asked, "prompt", small, large).select("column_id", "answer", "status", "tier")
    out = marked.join(answers, "column_id", "left")
    return out.withColumn("description", F.when(F.col("needs_description"), F.when(F.col("status") == "ok", F.col("answer"))).otherwise(F.col("description"))).drop("answer", "needs_description")


def source_prompts(sources: DataFrame) -> DataFrame:
    """``sources`` with a prompt: who the source is, what is known of it, and its inventory as JSON on the last line.

    ``sources``: source_id, description, metadata (text), inventory array<struct<table_name,columns>>.
    """
    said = F.concat(
        F.lit("Describe this data source in under 100 words of plain English; answer with the description only.\nSource: "), "source_id",
        F.lit("\nKnown: "), F.coalesce("metadata", F.lit("{}")), F.lit("\n"), F.to_json("inventory"),
    )
    return sources.withColumn("prompt", said)


def table_prompts(catalog: DataFrame) -> DataFrame:
    """source_id, table_name, ordinal, prompt: the table's columns with types and samples as JSON on the last line."""
    item = F.struct("ordinal", F.struct("column_name", "data_type", "samples").alias("item"))
    rows = catalog.groupBy("source_id", "table_name").agg(F.min("ordinal").alias("first"), F.transform(F.sort_array(F.collect_list(item)), lambda s: s["item"]).alias("items"))
    said = F.concat(F.lit("Describe this table in at most 80 words of technical English; answer with the description only.\nTable: "), "table_name", F.lit("\n"), F.to_json("items"))
    return rows.select("source_id", "table_name", F.col("first").alias("ordinal"), said.alias("prompt"))


def enrich_sources(sources: DataFrame, provider: providers.CompletionProvider) -> DataFrame:
    """source_id, description, status: the description that is there if usable, else the provider's; null on failure."""
    marked = needs_description(source_prompts(sources))
    asked = providers.complete(marked.where("needs_description").select("source_id", "prompt"), "prompt", provider).select("source_id", "answer", "status")
    out = marked.join(asked, "source_id", "left")
    kept = F.when(F.col("needs_description"), F.when(F.col("status") == "ok", F.col("answer"))).otherwise(F.col("description"))
    return out.select("source_id", kept.alias("description"), F.coalesce("status", F.lit("given")).alias("status"))


def enrich_tables(catalog: DataFrame, provider: providers.CompletionProvider) -> DataFrame:
    """source_id, table_name, description, status: every table is asked about; null on failure."""
    asked = providers.complete(table_prompts(catalog), "prompt", provider)
    return asked.select("source_id", "table_name", F.when(F.col("status") == "ok", F.col("answer")).alias("description"), "status")


def with_domains(catalog: DataFrame, provider: providers.EmbeddingProvider, thresholds: list[float] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``catalog`` with domain_id; sources in no admissible cut share one domain.

    ``sources``: source_id, description, as :func:`enrich_sources` gives; without it a source is its tables' descriptions.
    """
    tables = catalog.groupBy("source_id", "table_name").agg(F.min("ordinal").alias("ordinal"), F.min_by("table_desc", "ordinal").alias("table_desc"))
    described = tables.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "table_desc"))), lambda s: s["table_desc"]), " ").alias("description"), F.array_sort(F.collect_list("table_name")).alias("tables"))
    if sources is not None:
        own = sources.select("source_id", F.col("description").alias("own"))
        described = described.join(own, "source_id", "left").withColumn("description", F.coalesce("own", "description")).drop("own")
    embedded = providers.embed(text.source_text(described), "text", provider).withColumn("universe", F.lit("all"))
    found = cluster.domains(embedded, thresholds).select("source_id", "domain_id")
    return catalog.join(found, "source_id", "left").withColumn("domain_id", F.coalesce("domain_id", F.lit("domain_all")))


def knowledge_graph(catalog: DataFrame, provider: providers.EmbeddingProvider, threshold: float = vectors.THRESHOLD, augmented: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and scored pairs. ``augmented`` False is the names-only mode."""
    texts = text.column_text(catalog, augmented)
    embedded = providers.embed(texts, "text", provider).join(catalog.select("column_id", "source_id", "domain_id", "ordinal"), "column_id")
    pairs = vectors.similarity_join(embedded, threshold)
    similar = graph.similarity_edges(pairs, catalog.select("column_id", "description") if augmented else None)
    return graph.skeleton_nodes(catalog), graph.skeleton_edges(catalog).unionByName(similar), pairs


def ask(catalog: DataFrame, pairs: DataFrame, provider: providers.CompletionProvider) -> DataFrame:
    """domain_id, response_id, response: one question per source pair, with both column lists."""
    sources = catalog.groupBy("domain_id", "source_id").agg(F.min("ordinal").alias("ordinal"))
    payload = candidates.pair_payload(candidates.source_pairs(sources) if pairs is None else pairs, catalog)
    prompt = F.concat_ws("\n", F.lit(f"Which columns mean the same? Answer one pair a line: id {LINK} id"), F.array_join("columns_a", "\n"), F.lit("---"), F.array_join("columns_b", "\n"))
    asked = payload.withColumn("response_id", F.concat_ws("|", "domain_id", "source_a", "source_b")).withColumn("prompt", prompt)
    return providers.complete(asked.select("domain_id", "response_id", "source_a", "source_b", "prompt"), "prompt", provider).withColumnRenamed("answer", "response")


def column_questions(catalog: DataFrame) -> DataFrame:
    """domain_id, column_id, source_id, prompt: one question per column about columns of other sources."""
    said = F.concat(
        F.lit("Which columns of other sources mean the same as "), "column_id", F.lit("? Name them by their full ids and say why.\nMeaning: "), "description",
        F.lit("\nType: "), "data_type", F.lit("\nSamples: "), F.to_json("samples"),
    )
    return catalog.select("domain_id", "column_id", "source_id", said.alias("prompt"))


def ask_columns(catalog: DataFrame, provider: providers.CompletionProvider) -> DataFrame:
    """domain_id, col_a, col_b: the ids that the answers about single columns mention; failed calls name none."""
    answers = providers.complete(column_questions(catalog), "prompt", provider)
    return parse.mention_pairs(answers.where("status = 'ok'").withColumnRenamed("answer", "response"), catalog)


#: What an answer that proposes domains holds.
PROPOSAL = "domains array<struct<name:string,sources:array<string>,scope:string>>"


def domain_question(texts: DataFrame) -> DataFrame:
    """One row, prompt: all sources' texts (source_id, text), of which there are as many as sources, and what to answer."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_id", "text"))), lambda s: F.concat(s["source_id"], F.lit(": "), s["text"])), "\n")
    ask = F.lit('Group these data sources into business domains; if uncertain, group. Answer with one JSON object only: {"domains": [{"name": "", "sources": [""], "scope": ""}]}\n')
    return texts.agg(F.concat(ask, listed).alias("prompt"))


def proposed_domains(answers: DataFrame, known: DataFrame) -> DataFrame:
    """domain_id, source_id: what answers propose in JSON, perhaps with words around; sources that nobody knows are left out.

    A source proposed for several domains goes to the first by name. ``answers``: answer; ``known``: source_id.
    """
    read = answers.select(F.explode(json_object(F.col("answer"), PROPOSAL)["domains"]).alias("d"))
    rows = read.select(F.col("d.name").alias("domain_id"), F.explode("d.sources").alias("source_id")).where("domain_id IS NOT NULL")
    return rows.join(known.select("source_id").distinct(), "source_id", "left_semi").groupBy("source_id").agg(F.min("domain_id").alias("domain_id")).select("domain_id", "source_id")


def propose_domains(texts: DataFrame, provider: providers.CompletionProvider) -> DataFrame:
    """domain_id, source_id by one question over all sources (source_id, text)."""
    answers = providers.complete(domain_question(texts), "prompt", provider)
    return proposed_domains(answers.where("status = 'ok'"), texts)


def retrieved(questions: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 60, hops: int = 1) -> DataFrame:
    """question_id, node_id, hop, score: the k nodes nearest each question, and what lies around them in the graph.

    ``questions``: question_id, vector; ``nodes``: node_id, vector. hop 0 are the nearest; a node's score is the best of
    those nearest nodes at its least distance from them.
    """
    near = vectors.nearest(questions, nodes, k)
    around = graph.neighborhood(edges, near.select("node_id").distinct(), hops)
    met = near.select("question_id", F.col("node_id").alias("seed_id"), "score").join(around, "seed_id")
    least = F.min(F.struct("hop", (-F.col("score")).alias("low"))).alias("least")
    return met.groupBy("question_id", "node_id").agg(least).select("question_id", "node_id", F.col("least.hop").alias("hop"), (-F.col("least.low")).alias("score"))


def answered(questions: DataFrame, nodes: DataFrame, edges: DataFrame, provider: providers.CompletionProvider, k: int = 60, hops: int = 1) -> DataFrame:
    """question_id, answer, status: each question is asked with the descriptions of the nodes retrieved for it.

    ``questions``: question_id, text, vector; ``nodes``: node_id, description, vector.
    """
    met = retrieved(questions, nodes, edges, k, hops).join(nodes.select("node_id", "description"), "node_id", "left")
    line = F.struct("hop", (-F.col("score")).alias("low"), "node_id", F.concat_ws(": ", "node_id", "description").alias("line"))
    context = met.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["line"]), "\n").alias("context"))
    asked = questions.join(context, "question_id", "left").select("question_id", F.concat_ws("\n\n", "context", "text").alias("prompt"))
    return providers.complete(asked, "prompt", provider).select("question_id", "answer", "status")


def matches(catalog: DataFrame, responses: DataFrame) -> DataFrame:
    """Validated pairs of the answers; an answer may name columns of its own two sources only."""
    known = responses.select("response_id", F.explode(F.array("source_a", "source_b")).alias("source_id")).join(catalog.select("source_id", "column_id"), "source_id")
    return parse.parse_matches(responses.where("status = 'ok'"), known.select("response_id", "column_id"))


def scored(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics per truth file and ``ALL``."""
    return evaluate.eval_all(truth, vectors.canonical_pairs(found, "col_a", "col_b"))
