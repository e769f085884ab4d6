"""Matches from a stream of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.functions.text import pair
from columnloom.operators.parse import proposed_pairs


def stream_matches(responses: DataFrame, known: DataFrame, event_time: str = "ts", late: str = "1 hour") -> DataFrame:
    """domain_id, response_id, col_a, col_b of a streaming table of answers, each pair once per response, the smaller id first.

    ``known`` (response_id, column_id) is a static table. State is a pair per response, dropped after the watermark.
    """
    timed = responses.select("domain_id", "response_id", "response", event_time).withWatermark(event_time, late)
    found = proposed_pairs(timed, (event_time,))
    for side in ("col_a", "col_b"):
        found = found.join(known.select("response_id", F.col("column_id").alias(side)), ["response_id", side])
    low, high = pair(F.col("col_a"), F.col("col_b"))
    pairs = found.select("domain_id", "response_id", low.alias("col_a"), high.alias("col_b"), event_time)
    return pairs.dropDuplicates().drop(event_time)
