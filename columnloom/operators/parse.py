"""Matches out of free-text answers: the line parser, the mention scan, validation against known columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.functions.text import LINK, pair, source_of, strip, strip_dashes


def proposed_pairs(responses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """domain_id, response_id, line_no, col_a, col_b (and ``carry``) from lines ``a <-> b``. No join: also runs on a stream.

    Dashes before the left id are list bullets and go; the right id is only trimmed; other marks stay and fail later.
    """
    lines = responses.select("domain_id", "response_id", *carry, F.posexplode(F.split(strip(F.col("response")), "\n")).alias("line_no", "line"))
    parts = F.split(strip(F.col("line")), LINK)
    lines = lines.where(F.col("line").contains(LINK)).withColumn("parts", parts).where(F.size("parts") == 2)
    found = lines.select("domain_id", "response_id", *carry, "line_no", strip(strip_dashes(strip(F.col("parts")[0]))).alias("col_a"), strip(F.col("parts")[1]).alias("col_b"))
    return found.where(source_of(F.col("col_a")) != source_of(F.col("col_b")))


def parse_matches(responses: DataFrame, known: DataFrame) -> DataFrame:
    """domain_id, response_id, col_a, col_b: validated pairs, each once per response, in the orientation met first.

    ``known``: response_id, column_id, the ids that the response may name.
    """
    found = proposed_pairs(responses)
    for side in ("col_a", "col_b"):
        found = found.join(known.select("response_id", F.col("column_id").alias(side)).distinct(), ["response_id", side], "left_semi")
    low, high = pair(F.col("col_a"), F.col("col_b"))
    first = F.min_by(F.struct("col_a", "col_b"), "line_no").alias("first")
    return found.groupBy("domain_id", "response_id", low.alias("low"), high.alias("high")).agg(first).select("domain_id", "response_id", "first.col_a", "first.col_b")


def invented_ids(responses: DataFrame, known: DataFrame) -> DataFrame:
    """response_id, column_id: ids that answers name but nobody knows; reported, never stored."""
    found = proposed_pairs(responses)
    named = found.select("response_id", F.col("col_a").alias("column_id")).unionByName(found.select("response_id", F.col("col_b").alias("column_id"))).distinct()
    return named.join(known, ["response_id", "column_id"], "left_anti")


#: Answers that one task scans for a domain's ids.
SCAN_ROWS = 2000


def mention_pairs(responses: DataFrame, columns: DataFrame) -> DataFrame:
    """domain_id, col_a, col_b: another source's column whose id occurs anywhere in the answer about a column.

    Occurrence is a substring test, so an id that begins another is found in it. A domain's answers are dealt into parts
    of about ``SCAN_ROWS``; each part meets the domain's ids once and is scanned for all of them together, by looking up
    the text's pieces of every length that an id has.
    ``responses``: domain_id, column_id, source_id, response. ``columns``: domain_id, column_id, source_id.
    """
    asked = responses.select("domain_id", "column_id", "source_id", "response").where("response IS NOT NULL AND domain_id IS NOT NULL")
    parts = asked.groupBy("domain_id").agg(F.ceil(F.count(F.lit(1)) / SCAN_ROWS).cast("int").alias("parts"))
    dealt = asked.join(parts, "domain_id").withColumn("part", F.pmod(F.xxhash64("column_id", "response"), F.col("parts")).cast("int"))
    named = columns.select(F.col("domain_id").alias("domain"), F.col("column_id").alias("known_id"), F.col("source_id").alias("known_source")).distinct()
    times = parts.select(F.col("domain_id").alias("domain"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))
    ids = named.join(times, "domain")

    def scan(said: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        sources: dict[str, set] = {}
        for other, source in zip(known["known_id"], known["known_source"], strict=True):
            if other is not None:
                sources.setdefault(other, set()).add(source)
        lengths = sorted({len(x) for x in sources})
        found = set()
        for own, source, text in zip(said["column_id"], said["source_id"], said["response"], strict=True):
            for n in lengths:
                for at in range(len(text) - n + 1):
                    other = text[at : at + n]
                    if other in sources and any(s is not None and source is not None and s != source for s in sources[other]):
                        found.add((said["domain_id"].iloc[0], own, other))
        return pd.DataFrame(sorted(found, key=str), columns=["domain_id", "a", "b"])

    pairs = dealt.groupBy("domain_id", "part").cogroup(ids.groupBy("domain", "piece")).applyInPandas(scan, "domain_id string, a string, b string")
    low, high = pair(F.col("a"), F.col("b"))
    return pairs.select("domain_id", low.alias("col_a"), high.alias("col_b")).distinct()
