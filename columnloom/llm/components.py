"""Connected components and pairwise work in blocks, for the operators on pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from columnloom.llm.common import discard, release, staged


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for each node of ``edges`` (a long, b long); a component is its smallest node.

    Each node points at its smallest neighbour, pointers are doubled until they rest at roots, and the edges are
    contracted to edges between roots, which leaves few after one round. Joins have unique keys on one side, so a hub's
    rows can be split, aggregates are partial first, and every step is staged.
    """
    left = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    labels = None
    while left.limit(1).count():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        roots = staged(ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), f"{name}-roots")
        moved = True
        while moved:
            above, before = roots.select(F.col("node").alias("root"), F.col("root").alias("top")), roots
            roots = staged(roots.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), f"{name}-roots")
            discard(before)
            moved = roots.where("moved").limit(1).count()
        ids = roots.select("node", "root")
        if labels is None:
            labels = staged(ids.withColumnRenamed("root", "component"), f"{name}-labels")
        else:
            merged, before = labels.join(ids.withColumnRenamed("node", "component"), "component", "left"), labels
            labels = staged(merged.select("node", F.coalesce("root", "component").alias("component")), f"{name}-labels")
            discard(before)
        of_a, of_b = (ids.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        met, before = left.join(of_a, "a").join(of_b, "b").where("root_a <> root_b"), left
        left = staged(met.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), f"{name}-edges")
        discard(before, roots)
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def pivots(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, pivot): each component's node with the most of the edges (a, b), which lies amid the others most likely."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(labels, "node")
    return degree.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "node")).alias("m")).select("component", F.col("m.node").alias("pivot"))


def sure_links(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a distance to one pivot per component tells about links, without looking at pairs.

    ``members``: component, rep, copies, x (long), such that two members surely link where their x add up to 0 or less.
    Returns (rep, n), the copies of other members each one surely links with; (a, b), edges that connect whatever sure
    links connect, all to the member of least x; and (component, rep, least, most): the members that have a pair of which
    x doesn't tell. A component's values of x are counted first, so no task sees its members.
    """
    counts = members.groupBy("component", "x").agg(F.sum("copies").alias("c"))
    none = F.lit(0).cast("long")
    marks = counts.select("component", F.col("x").alias("at"), none.alias("asks"), "c").unionByName(counts.select("component", (-F.col("x")).alias("at"), none + 1, none).toDF("component", "at", "asks", "c"))
    below = F.sum("c").over(Window.partitionBy("component").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    found = marks.withColumn("n", below).where("asks = 1").select("component", (-F.col("at")).alias("x"), "n")
    own = F.when(F.col("x") <= 0, F.col("copies")).otherwise(0)
    n = members.join(found, ["component", "x"]).select("rep", (F.col("n") - own).alias("n")).where("n > 0")
    ends = members.groupBy("component").agg(F.min(F.struct("x", "rep")).alias("first"), F.max("x").alias("most"))
    placed = members.join(ends, "component")
    edges = placed.where((F.col("x") + F.col("first.x") <= 0) & (F.col("rep") != F.col("first.rep"))).select(F.col("first.rep").alias("a"), F.col("rep").alias("b"))
    unsure = placed.where(F.col("x") + F.col("most") > 0).select("component", "rep", (F.col("x") > 0).alias("far"))
    return n, edges, unsure


def far_blocks(rows: DataFrame, far_rows: Column | int, near_rows: Column | int, weight: Column | None = None) -> DataFrame:
    """``rows`` with columns ``i``, ``j``, ``side``, so that a far row meets any other row of its component in one (component, i, j).

    ``rows``: component, rep, far. Two rows that are not far never meet. Parts have about ``far_rows`` (and ``weight`` of
    them) far ones or ``near_rows`` others, which may be columns over ``fars`` and ``nears``, a component's numbers.
    """
    weight = F.lit(1) if weight is None else weight
    one = F.lit(1).cast("long")
    sizes = rows.groupBy("component").agg(
        F.sum(F.col("far").cast("long")).alias("fars"), F.sum((~F.col("far")).cast("long")).alias("nears"),
        F.sum(F.when(F.col("far"), weight).otherwise(0)).alias("far_weight"), F.sum(F.when(F.col("far"), 0).otherwise(weight)).alias("near_weight"),
    ).where("fars > 0")
    sizes = sizes.select("component", F.greatest(one, F.ceil(F.greatest("fars", "far_weight") / far_rows)).alias("p"), F.greatest(one, F.ceil(F.greatest("nears", "near_weight") / near_rows)).alias("q"))
    placed = rows.join(sizes, "component")
    first = F.lit(0).cast("long")
    far = placed.where("far").withColumn("own", F.pmod(F.xxhash64("rep"), "p"))
    among = far.withColumn("other", F.explode(F.sequence(first, F.col("p") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", F.col("own"))
    left = far.withColumn("i", -1 - F.col("own")).withColumn("j", F.explode(F.sequence(first, F.col("q") - 1))).withColumn("side", first)
    near = placed.where("NOT far").withColumn("j", F.pmod(F.xxhash64("rep"), "q")).withColumn("i", F.explode(F.sequence(-F.col("p"), first - 1))).withColumn("side", first + 1)
    return among.drop("own", "other", "p", "q").unionByName(left.drop("own", "p", "q")).unionByName(near.drop("p", "q"))


def in_blocks(rows: DataFrame, key: str, item: str, size: str, block_rows: int) -> DataFrame:
    """``rows`` with columns ``i``, ``j``, ``side``, so that any two rows of a key meet in one (key, i, j).

    A key of at most ``block_rows`` rows is one block. A larger one is dealt into parts by a hash of ``item``, and each
    row goes to the pairs of parts that hold its own; a pair of parts has about twice ``block_rows`` rows however large
    the key.
    """
    n = F.ceil(F.col(size) / F.lit(block_rows)).cast("int")
    side = F.pmod(F.xxhash64(item), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    return rows.withColumn("side", side).withColumn("other", other).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other")


def across(side: np.ndarray) -> np.ndarray | None:
    """Which pairs of a block of rows with sides count: None for all where there is one side, else those of unequal sides."""
    return None if (side == side[0]).all() else side[:, None] != side[None, :]


def grouped(df: DataFrame, *keys: str, then: str | None = None) -> DataFrame:
    """Rows of equal keys together: partitioned and sorted by them (and by ``then``), ready for :func:`runs`."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *([then] if then else []))


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """One table for each run of equal leading ``n_keys`` columns (not null, integers) in a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[:, start].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)
    release()


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph with edges (a[k], b[k]) over n nodes.

    It takes the earliest edges that it can, so with nodes in a fixed order, groups that overlap give mostly equal edges.
    """
    parent = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = x, y
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y))
            if len(out) == n - 1:
                break
    return out
