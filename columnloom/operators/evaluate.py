"""Truth pairs, set algebra and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from columnloom.functions.text import column_id, pair, source_of

ALL = "ALL"


def gt_pairs_flat(matches: DataFrame) -> DataFrame:
    """label, col_a, col_b from rows (label, source_id, source_table, source_column, target_id, target_table, target_column)."""
    a = column_id(F.col("source_id"), F.col("source_table"), F.col("source_column"))
    b = column_id(F.col("target_id"), F.col("target_table"), F.col("target_column"))
    low, high = pair(a, b)
    return matches.select("label", low.alias("col_a"), high.alias("col_b")).distinct()


def gt_pairs_group(anchors: DataFrame) -> DataFrame:
    """label, col_a, col_b: all cross-source pairs of the columns aligned under one anchor, each pair once per label.

    ``anchors``: label, anchor_id, column_id, source_id. Every pair is part of the result, so the self-join per anchor is
    the output's own size; ids are made distinct first.
    """
    rows = anchors.select("label", "anchor_id", "column_id", "source_id").distinct()
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.label") == F.col("b.label")) & (F.col("a.anchor_id") == F.col("b.anchor_id")) & (F.col("a.column_id") < F.col("b.column_id")) & (F.col("a.source_id") != F.col("b.source_id"))
    return a.join(b, on).select(F.col("a.label").alias("label"), F.col("a.column_id").alias("col_a"), F.col("b.column_id").alias("col_b")).distinct()


def relevant_predictions(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, col_a, col_b: predictions with both sources among those of the label's truth."""
    sources = truth.select("label", source_of(F.col("col_a")).alias("source")).unionByName(truth.select("label", source_of(F.col("col_b")).alias("source"))).distinct()
    out = predicted.select("col_a", "col_b").distinct().withColumn("source", source_of(F.col("col_a"))).join(sources, "source").drop("source")
    return out.withColumn("source", source_of(F.col("col_b"))).join(sources, ["label", "source"], "left_semi").select("label", "col_a", "col_b")


def compared(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, col_a, col_b, in_truth, in_predicted."""
    keys = ["label", "col_a", "col_b"]
    left = truth.select(*keys).distinct().withColumn("t", F.lit(True))
    right = relevant_predictions(truth, predicted).withColumn("p", F.lit(True))
    return left.join(right, keys, "full").select(*keys, F.coalesce("t", F.lit(False)).alias("in_truth"), F.coalesce("p", F.lit(False)).alias("in_predicted"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _scores(sums: DataFrame) -> DataFrame:
    out = sums.withColumn("precision", _ratio(F.col("tp"), F.col("n_predicted"))).withColumn("recall", _ratio(F.col("tp"), F.col("n_truth")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))


def eval_metrics(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, n_truth, n_predicted, tp, fp, fn, precision, recall, f1; a zero denominator gives 0."""
    t, p = F.col("in_truth"), F.col("in_predicted")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = compared(truth, predicted).groupBy("label").agg(count(t).alias("n_truth"), count(p).alias("n_predicted"), count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"))
    return _scores(sums)


def eval_all(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores per label and, as ``ALL``, of the united truth. Pairs across labels' sources count only in ``ALL``."""
    united = truth.select(F.lit(ALL).alias("label"), "col_a", "col_b").distinct()
    return eval_metrics(truth.select("label", "col_a", "col_b").unionByName(united), predicted)


def hits(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return truth.select("col_a", "col_b").intersect(predicted.select("col_a", "col_b"))


def false_positives(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return predicted.select("col_a", "col_b").subtract(truth.select("col_a", "col_b"))


def false_negatives(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return truth.select("col_a", "col_b").subtract(predicted.select("col_a", "col_b"))


def examples(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The first n pairs in order."""
    return pairs.orderBy("col_a", "col_b").limit(n)


def flagged(pairs: DataFrame, in_truth: bool, in_predicted: bool) -> DataFrame:
    """Hits (both), false positives or false negatives of one table that says of each distinct pair where it is.

    ``pairs``: col_a, col_b, in_truth, in_predicted. Nothing moves, unlike where truth and predictions are two tables.
    """
    where = [F.col(c) if x else ~F.col(c) for c, x in (("in_truth", in_truth), ("in_predicted", in_predicted))]
    return pairs.where(where[0] & where[1]).select("col_a", "col_b")


def flagged_metrics(pairs: DataFrame) -> DataFrame:
    """The scores of ``eval_metrics`` from one table of distinct pairs.

    ``pairs``: col_a, col_b, labels (of the truth that has the pair; an empty array outside it), in_predicted. They are
    counted by labels and sources first, so only counts move; labels and their sources are few.
    """
    counts = pairs.groupBy("labels", source_of(F.col("col_a")).alias("source_a"), source_of(F.col("col_b")).alias("source_b"), "in_predicted").agg(F.count(F.lit(1)).alias("n"))
    those = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    # an outer explode, and conditions inside sums: no filter sinks below one use of the counts, so that pairs are made once
    each = counts.select(F.explode_outer("labels").alias("label"), "source_a", "source_b", "in_predicted", "n")
    truth = each.groupBy("label").agg(F.sum("n").alias("n_truth"), those(F.col("in_predicted")).alias("tp"), F.array_union(F.collect_set("source_a"), F.collect_set("source_b")).alias("sources")).where("label IS NOT NULL")
    inside = F.array_contains("sources", F.col("source_a")) & F.array_contains("sources", F.col("source_b"))
    sums = counts.crossJoin(F.broadcast(truth)).groupBy("label", "n_truth", "tp").agg(those(F.col("in_predicted") & inside).alias("n_predicted"))
    return _scores(sums.select("label", "n_truth", "n_predicted", "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn")))
