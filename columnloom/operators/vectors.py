"""Cosine similarity between columns: pairs, distances, the threshold self-join, nearest columns.

Pairs are made in blocks. The rows of a domain are dealt into parts; each pair of parts is one group of bounded size that
NumPy matrix products score, and only pairs that pass the filter leave it. A domain's work so spreads over many tasks
however uneven the domains are. A row is copied once for each part, so the parts stay few: about ``BLOCK`` rows each, but
no more than ``PARTS`` parts until these would hold more than ``MOST`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from columnloom.functions.text import pair

BLOCK, PARTS, MOST = 1024, 16, 16384
#: Scores of a block that are held at once, and those that are put in order together.
STRIP, ORDERED = 1 << 18, 1 << 22
THRESHOLD = 0.75


def unit_rows(vectors: list | np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero vector stays zero, so its cosine with anything is 0."""
    x = vectors if isinstance(vectors, np.ndarray) else np.array([np.asarray(v, np.float64) for v in vectors])
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _blocks(rows: DataFrame, domain: str, parts: Callable[[Column], Column] = lambda n: F.ceil(n / BLOCK)) -> DataFrame:
    """``rows`` with side, i and j, once for each block (i, j) that its part, ``side``, belongs to; an id has one part."""
    sizes = rows.groupBy(domain).agg(parts(F.count(F.lit(1))).cast("int").alias("parts"))
    dealt = rows.join(sizes, domain).withColumn("side", F.pmod(F.xxhash64("column_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other", "parts")


def _few_parts(n: Column) -> Column:
    return F.greatest(F.ceil(n / MOST), F.least(F.lit(PARTS).cast("long"), F.ceil(n / BLOCK)))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    if len(pc.unique(pc.list_value_length(vectors))) > 1:
        raise ValueError("vectors of different lengths")
    return pc.list_flatten(vectors).to_numpy().astype(np.float64).reshape(len(vectors), -1)


def _strips(part: pa.Table, cross_source: bool, kin: np.ndarray | None = None, held: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows a strip, rows beside it, their scores and which of them are pairs; each pair of a block is in one strip.

    Neighbouring rows with one number in ``kin`` stay in one strip.
    """
    i, j, side = part["i"][0].as_py(), part["j"][0].as_py(), part["side"].to_numpy()
    unit, source = unit_rows(_matrix(part["vector"])), pd.factorize(part["source_id"].to_pandas())[0]
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    turned, at = np.ascontiguousarray(unit[right].T), 0
    while at < len(left):
        end = min(at + max(1, (held or STRIP) // max(1, len(right))), len(left))
        while kin is not None and end < len(left) and kin[left[end]] == kin[left[end - 1]]:
            end += 1
        rows, at = left[at:end], end
        wanted = right[None, :] > rows[:, None] if i == j else np.ones((len(rows), len(right)), bool)
        if cross_source:
            wanted &= source[rows][:, None] != source[right][None, :]
        yield rows, right, unit[rows] @ turned, wanted


def _by_score(at: np.ndarray, flat: np.ndarray) -> None:
    """Put the places ``at`` in order of their scores to six digits; score and place in one number sort in place."""
    for k in range(0, len(at), STRIP):
        some = at[k : k + STRIP]
        some |= np.rint(np.nan_to_num(flat[some]) * 1e6).astype(np.int64) << 40
    at.sort()
    at &= (1 << 40) - 1


def _vectors(columns: DataFrame, domain: str, cross_source: bool) -> DataFrame:
    """Rows that can have pairs: an unknown source is not known to be another one."""
    rows = columns.select(domain, "column_id", "ordinal", "source_id", "vector").where(F.col("vector").isNotNull())
    return rows.where(F.col("source_id").isNotNull()) if cross_source else rows


def scored_pairs(columns: DataFrame, keep: Callable[[np.ndarray], np.ndarray] | None = None, cross_source: bool = True, domain: str = "domain_id", digits: int | None = None, only: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """domain_id, id_a, id_b, source_a, source_b, score for pairs in catalog order (a before b).

    ``columns``: domain_id, column_id, ordinal, source_id, vector. ``keep`` maps scores to the pairs wanted; those that
    leave are rounded to ``digits``, and have the columns ``only``. With ``ordered``, ``ORDERED`` pairs at a time leave by
    score: equal scores then lie together, and files of all pairs are smaller.
    """
    kinds = {domain: "string", "id_a": "string", "id_b": "string", "source_a": "string", "source_b": "string", "score": "double"}
    names = list(only or kinds)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches)).sort_by([("ordinal", "ascending"), ("column_id", "ascending")]).combine_chunks()
        ids, sources = part["column_id"].combine_chunks(), part["source_id"].combine_chunks()
        for rows, right, scores, wanted in _strips(part, cross_source, held=ORDERED if ordered else None):
            if keep is not None:
                wanted &= keep(scores)
            at, flat = np.flatnonzero(wanted), scores.ravel()
            del scores, wanted
            if ordered:
                _by_score(at, flat)
            for k in range(0, max(1, len(at)), STRIP):
                some = at[k : k + STRIP]
                x, y = np.divmod(some, len(right))
                found = flat[some] if digits is None else np.round(flat[some], digits)
                a, b = pa.array(np.minimum(rows[x], right[y])), pa.array(np.maximum(rows[x], right[y]))
                made = {domain: lambda: pa.repeat(part[domain][0], len(a)), "id_a": lambda: ids.take(a), "id_b": lambda: ids.take(b), "source_a": lambda: sources.take(a), "source_b": lambda: sources.take(b), "score": lambda: pa.array(found)}
                yield pa.RecordBatch.from_arrays([made[name]() for name in names], names)
            del at, flat

    schema = ", ".join(f"{name} {kinds[name]}" for name in names)
    return _blocks(_vectors(columns, domain, cross_source), domain, _few_parts).groupBy(domain, "i", "j").applyInArrow(block, schema)


def flagged_pairs(columns: DataFrame, flags: dict[str, Callable[[np.ndarray], np.ndarray]], domain: str = "domain_id") -> DataFrame:
    """domain_id, col_a, col_b and a boolean for each of ``flags``: cross-source pairs with a flag, each once, smaller id first.

    A flag maps scores to booleans; a pair has it if any of its scores has, where ids occur more than once. All rows of two
    ids meet in one block, so the pairs need no exchange to be distinct.
    """
    names = [domain, "col_a", "col_b", *flags]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches)).sort_by("column_id").combine_chunks()
        ids = part["column_id"].combine_chunks()
        place = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        once = place[-1] == len(place)
        for rows, right, scores, wanted in _strips(part, True, None if once else place):
            marks = [f(scores) & wanted for f in flags.values()]
            x, y = np.nonzero(np.logical_or.reduce(marks))
            a, b, found = np.minimum(rows[x], right[y]), np.maximum(rows[x], right[y]), [m[x, y] for m in marks]
            if not once and len(a):
                pairs = place[a] * (len(place) + 1) + place[b]
                order = np.argsort(pairs, kind="stable")
                first = np.flatnonzero(np.diff(pairs[order], prepend=-1))
                a, b, found = a[order][first], b[order][first], [np.logical_or.reduceat(m[order], first) for m in found]
            yield pa.RecordBatch.from_arrays([pa.repeat(part[domain][0], len(a)), ids.take(a), ids.take(b), *map(pa.array, found)], names)

    schema = f"{domain} string, col_a string, col_b string, " + ", ".join(f"{x} boolean" for x in flags)
    return _blocks(_vectors(columns, domain, True), domain, _few_parts).groupBy(domain, "i", "j").applyInArrow(block, schema)


def similarity_join(columns: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Cross-source pairs of a domain with a cosine of at least ``threshold``."""
    return scored_pairs(columns, lambda s: s >= threshold)


def distance(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - score))


def topk_similar(columns: DataFrame, k: int) -> DataFrame:
    """column_id, rank, other_id, score: each column's k most similar columns of other sources; ties by id."""
    schema = "column_id string, other_id string, score double"

    def block(part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        unit, side, ids = unit_rows(part["vector"].tolist()), part["side"].to_numpy(), part["column_id"].to_numpy()
        scores = np.round(unit @ unit.T, 6)
        source = pd.factorize(part["source_id"])[0]
        scores[source[:, None] == source[None, :]] = -np.inf
        if i != j:
            scores[side[:, None] == side[None, :]] = -np.inf
        by_id = np.argsort(ids, kind="stable")
        best = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]
        value = np.take_along_axis(scores, best, 1)
        row, col = np.nonzero(np.isfinite(value))
        return pd.DataFrame({"column_id": ids[row], "other_id": ids[best[row, col]], "score": value[row, col]})

    rows = columns.select("domain_id", "column_id", "ordinal", "source_id", "vector").where(F.col("vector").isNotNull())
    found = _blocks(rows, "domain_id").groupBy("domain_id", "i", "j").applyInPandas(block, schema)
    order = Window.partitionBy("column_id").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Questions are shared with every task, so their number is checked.
MAX_QUESTIONS = 10_000


def nearest(questions: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """question_id, node_id, score: each question's k nearest nodes by cosine; ties by id.

    ``questions``: question_id, vector, at most ``MAX_QUESTIONS``; ``nodes``: node_id, vector. Every task keeps k nodes a
    question of each batch, so what moves does not grow with the nodes' number in a batch.
    """
    asked = questions.where("vector IS NOT NULL").select("question_id", "vector").limit(MAX_QUESTIONS + 1).collect()
    if len(asked) > MAX_QUESTIONS:
        raise ValueError(f"more than {MAX_QUESTIONS} questions at once")
    shared = questions.sparkSession.sparkContext.broadcast(([r.question_id for r in asked], unit_rows([r.vector for r in asked]) if asked else None))

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit = shared.value
        for part in parts:
            part = part.sort_values("node_id", kind="stable")
            if not len(part) or not names:
                continue
            scores = np.round(unit @ unit_rows(part["vector"].tolist()).T, 6)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            ids = part["node_id"].to_numpy()
            yield pd.DataFrame({"question_id": np.repeat(names, top.shape[1]), "node_id": ids[top].ravel(), "score": np.take_along_axis(scores, top, 1).ravel()})

    found = nodes.where("vector IS NOT NULL").select("node_id", "vector").mapInPandas(best, "question_id string, node_id string, score double")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "node_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def canonical_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (col_a, col_b) with the smaller id first."""
    low, high = pair(F.col(a), F.col(b))
    return pairs.select(low.alias("col_a"), high.alias("col_b")).distinct()
