"""Near copies of embeddings by NN-descent.

Vectors with equal labels and a cosine of at least ``THRESHOLD`` (double precision) are linked.

1. Equal vectors of a label are one *class*, pre-aggregated by a digest. A class carries its vector, as given, and a mark:
   the sides of ``BITS`` random hyperplanes on which it lies. Marks of linked vectors differ in ``_reach`` bits at most but
   for a chance of 1e-8, those of unrelated vectors in more. Only marks move while the graph is made.
2. Classes whose marks differ in ``TIGHT`` bits at most are contracted to a leader, whose slack is the most bits any of
   them differs by; the number of differing bits is a metric, so the slack of two leaders is taken off their distance.
3. A first neighbour graph: in each of several tables of hyperplanes, leaders with the same code give each other their
   best ``NEIGHBOURS`` within reach. The tables are as many as miss a pair at the threshold with probability ``MISS``.
4. NN-descent: each leader's neighbours and reverse neighbours are compared with one another, and better neighbours enter
   the lists, until a round changes none, for ``ROUNDS`` rounds at most. A full list doubles, up to ``MAX_NEIGHBOURS``. A
   leader that sees more than that at once is *dense*: it passes on a spanning forest, and needs no list, by step 6.
5. The connected components of the graph are verified in double precision. In a large one, the angles to one pivot tell
   most links, which are counted without pairs; only members that have pairs of which they don't tell are compared.
6. What lists of dense leaders may lack: a component with a dense class is compared with every vector of the label that,
   by its angle to the pivot, may link with a member. So the ceiling of the lists decides no link.
7. Recall is audited: the links of ``AUDIT`` classes, against all vectors, in one pass, each class counting once and
   apart by number of links. Below ``RECALL`` all pairs across components are compared; where that doesn't help either, the
   operator fails.

Edge cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links with
nothing and is its own component; vectors of different length don't link; repeated rows are copies of each other; a null
vec_id is never a component's id unless alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.llm.common import discard, fresh, keyed, small_side, staged, to_batch
from columnloom.llm.components import connected_components, far_blocks, grouped, in_blocks, pivots, runs, spanning, sure_links

THRESHOLD = 0.93
#: Bits of a mark; differing bits that contract; bits of the code by which tight groups meet, and classes of a part of one.
BITS, TIGHT, TIGHT_CODE, TIGHT_PART = 256, 12, 16, 512
WORDS = BITS // 64
#: Chance that all tables part a pair at the threshold, and classes of a table's bucket. TABLES, if set, is their number.
MISS, BUCKET, TABLES = 1e-4, 2048, None
NEIGHBOURS, MAX_NEIGHBOURS, ROUNDS, PART = 8, 32, 8, 256
#: Classes of a component that is one block; classes of a part where a larger one's are compared; classes of a slice.
BLOCK, CELL, SLICE = 256, 2048, 512
AUDIT, RECALL = 1024, 0.99
#: Single precision decides what is looked at again in double precision, by this much more.
MARGIN = 1e-4
#: The audit asks for links above the threshold by more than double precision can be wrong.
CLEAR = 1e-9
#: Steps of an angle of 1 in which angles to a pivot are told.
STEPS = 4096

_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_MARK = [f"m{w}" for w in range(WORDS)]


def _matrix(column, dtype=np.float64) -> np.ndarray:
    """Vectors in binary, of equal lengths, as rows of length 1 in double precision."""
    values = column.to_pylist()
    x = np.frombuffer(b"".join(values), dtype).reshape(len(values), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that the norm neither overflows nor vanishes
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_length(column, dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors of each length."""
    lengths = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, _matrix(column.take(pa.array(at)), dtype)


@cache
def _planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, n))


def _marks(units: np.ndarray) -> np.ndarray:
    """The sides of the hyperplanes as 64-bit words."""
    return np.packbits(units @ _planes(units.shape[1], BITS, 94) > 0, axis=1).view(np.int64)


def _reach(threshold: float, bits: int = BITS) -> int:
    """Bits by which the marks of a pair at the threshold differ, and 5.5 standard deviations more."""
    p = math.acos(threshold) / math.pi
    return math.ceil(bits * p + 5.5 * math.sqrt(bits * p * (1 - p)))


def _close(marks: np.ndarray, left: np.ndarray, right: np.ndarray, slack: np.ndarray, reach: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, apart): the pairs of ``left`` and ``right`` (of different rows, where both are one: x < y) within reach.

    ``first`` is the reach in the first half of the words, which sorts out nearly all pairs.
    """
    words = np.ascontiguousarray(marks.T).view(np.uint64)
    half, out, loose = WORDS // 2, [], np.minimum(slack, BITS // 2).astype(np.uint8) if slack.any() else None
    for start in range(0, len(left), 128):
        x, y = left[start : start + 128], right[start:] if left is right else right
        apart = sum(np.bitwise_count(words[w][x][:, None] ^ words[w][y][None, :]) for w in range(half))
        limit = first if loose is None else (loose[x] + np.uint8(first))[:, None] + loose[y][None, :]
        i, j = np.divmod(np.flatnonzero(apart <= limit), len(y))
        if left is right:
            i, j = i[j > i], j[j > i]
        out.append((x[i], y[j]))
    x, y = (np.concatenate(o) for o in zip(*out, strict=True))
    apart = sum(np.bitwise_count(words[w][x] ^ words[w][y]).astype(np.int64) for w in range(WORDS)) - slack[x] - slack[y]
    near = apart <= reach
    return x[near], y[near], apart[near]


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame, type]:
    """Rows (vec_id, space, d0, d1, able), classes (rep, space, d0, d1, vector, copies, least, mark), and the vectors' type."""
    dtype = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    key = fresh(vectors, "row_key")
    source = keyed(vectors.select(id_col, vector_col, label_col), key)
    v = F.col(vector_col).cast(f"array<{'float' if dtype is np.float32 else 'double'}>")
    able = F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = source.select(F.col(key).alias("row_key"), F.col(id_col).cast("long").alias("vec_id"), F.xxhash64(label_col, F.size(v)).alias("space"), v.alias("v"), F.coalesce(able, F.lit(False)).alias("able"))
    schema = pa.schema([("row_key", pa.int64()), ("vec_id", pa.int64()), ("space", pa.int64()), ("able", pa.bool_()), ("d0", pa.int64()), ("d1", pa.int64())])

    def binary(column: pa.ListArray) -> list[bytes]:
        values, ends = column.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0), column.offsets.to_numpy()
        return [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, at = batch.column(4), np.flatnonzero(batch.column(4).to_numpy(zero_copy_only=False))
            d = np.zeros((batch.num_rows, 2), np.int64)
            if len(at):
                d[at] = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in binary(batch.column(3).take(pa.array(at)))]), np.int64).reshape(-1, 2)
            yield to_batch({"row_key": batch.column(0), "vec_id": batch.column(1), "space": batch.column(2), "able": held, "d0": d[:, 0], "d1": d[:, 1]}, schema)

    digests = staged(rows.mapInArrow(digest, "row_key long, vec_id long, space long, able boolean, d0 long, d1 long"), "nn-rows")
    sets = staged(digests.where("able").groupBy("space", "d0", "d1").agg(F.min("row_key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "nn-sets")
    made = pa.schema([(c, pa.int64()) for c in ("rep", "space", "d0", "d1", "copies", "least", *_MARK)] + [("vector", pa.binary())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.array(binary(batch.column(6)), pa.binary())
            marks = np.zeros((batch.num_rows, WORDS), np.int64)
            for at, units in _by_length(held, dtype):
                marks[at] = _marks(units)
            yield to_batch({**dict(zip(("rep", "space", "d0", "d1", "copies", "least"), batch.columns[:6], strict=True)), **{m: marks[:, w] for w, m in enumerate(_MARK)}, "vector": held}, made)

    chosen = sets.withColumnRenamed("rep", "row_key")
    full = rows.where("able").select("row_key", "v").join(small_side(chosen, chosen.count()), "row_key").select("row_key", "space", "d0", "d1", "copies", "least", "v")
    classes = full.mapInArrow(mark, ", ".join(f"{c} long" for c in ("rep", "space", "d0", "d1", "copies", "least", *_MARK)) + ", vector binary")
    return digests, staged(classes, "nn-classes"), dtype


# --- the graph ------------------------------------------------------------------------------------------------------


def _tight(classes: DataFrame) -> DataFrame:
    """(rep, leader, slack) of the classes in tight groups of at least two; codes part a group, parts of a code too."""
    code = F.xxhash64("space", F.shiftrightunsigned(F.col("m0"), 64 - TIGHT_CODE))
    rows = classes.select("rep", code.alias("code"), *_MARK)
    sizes = rows.groupBy("code").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(sizes, "code").withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / TIGHT_PART)))
    schema = pa.schema([("rep", pa.int64()), ("leader", pa.int64()), ("slack", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for block in runs(batches, 2):
            if block.num_rows > 1:
                rep, marks = block.column(2).to_numpy(), np.stack([block.column(3 + w).to_numpy() for w in range(WORDS)], 1)
                n = np.arange(len(rep))
                x, y, apart = _close(marks, n, n, np.zeros(len(rep), np.int64), TIGHT, TIGHT)
                x, y, apart = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([apart, apart])
                order = np.argsort(x, kind="stable")
                y, apart, ends = y[order], apart[order], np.searchsorted(x[order], np.arange(len(rep) + 1))
                free = np.ones(len(rep), bool)
                for i in np.flatnonzero(np.diff(ends)):
                    if free[i]:
                        near = slice(ends[i], ends[i + 1])
                        own = free[y[near]]
                        members, far = y[near][own], apart[near][own]
                        free[i] = free[members] = False
                        if len(members):
                            out.append(np.stack([rep[np.append(members, i)], np.full(len(members) + 1, rep[i]), np.full(len(members) + 1, far.max())]))
        found = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
        yield to_batch({"rep": found[0], "leader": found[1], "slack": found[2]}, schema)

    return grouped(rows.select("code", "part", "rep", *_MARK), "code", "part", then="rep").mapInArrow(run, "rep long, leader long, slack long")


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64()), ("dense", pa.bool_())])
_EDGES_SQL = "a long, b long, sim double, dense boolean"


def _near(x: np.ndarray, y: np.ndarray, apart: np.ndarray, rep: np.ndarray, k: np.ndarray) -> Iterator[tuple]:
    """(a, b, apart, dense): each row's best k of the pairs; of a row that has too many, edges of a spanning forest."""
    both, other, apart = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([apart, apart])
    dense = np.bincount(both, minlength=len(rep)) > MAX_NEIGHBOURS
    order = np.lexsort((apart, both))
    order = order[~dense[both[order]]]
    row = both[order]
    keep = order[np.arange(len(row)) - np.searchsorted(row, row) < k[row]]
    yield rep[both[keep]], rep[other[keep]], apart[keep], np.zeros(len(keep), bool)
    if dense.any():
        thick = np.flatnonzero(dense[x] | dense[y])
        thick = thick[np.lexsort((y[thick], x[thick]))]
        far = dict(zip(zip(x[thick].tolist(), y[thick].tolist(), strict=True), apart[thick].tolist(), strict=True))
        tree = spanning(x[thick], y[thick], len(rep))
        if tree:
            (u, v), far = np.array(tree, np.int64).T, np.array([far[e] for e in tree])
            yield rep[u], rep[v], far, dense[u]
            yield rep[v], rep[u], far, dense[v]


class _Edges:
    """Collects what :func:`_near` finds in blocks and hands it on as batches."""

    def __init__(self, threshold: float) -> None:
        self.reach, self.first, self.held = _reach(threshold), _reach(threshold, BITS // 2), []

    def compare(self, rep: np.ndarray, side: np.ndarray, slack: np.ndarray, k: np.ndarray, marks: np.ndarray) -> None:
        """Rows meet those of the other side, or each other where there is one side."""
        left = right = np.arange(len(rep))
        if (side != side[0]).any():
            left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min())
        found = _close(marks, left, right, slack, self.reach, self.first)
        if len(found[0]):
            self.held += _near(*found, rep, k)

    def batch(self) -> pa.RecordBatch:
        a, b, apart, dense = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 4
        self.held = []
        return to_batch({"a": a, "b": b, "sim": np.cos(np.pi * apart / BITS), "dense": dense.astype(bool)}, _EDGES)


def _compared(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(a, b, sim, dense) from comparing the rows (keys..., rep, slack, k, mark) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _Edges(threshold)
        for block in runs(batches, len(keys)):
            if block.num_rows > 1:
                rep, slack, k, *words = (block.column(len(keys) + c).to_numpy() for c in range(3 + WORDS))
                edges.compare(rep, np.zeros(len(rep)), slack, k, np.stack(words, 1))
            if len(edges.held) > 500:
                yield edges.batch()
        yield edges.batch()

    return grouped(rows.select(*keys, "rep", "slack", "k", *_MARK), *keys).mapInArrow(run, _EDGES_SQL)


#: Leaders that are sorted into the buckets of all tables at once.
HELD = 32_768


def _first_edges(leaders: DataFrame, threshold: float, tables: int | None, neighbours: int, dtype) -> DataFrame:
    """(a, b, sim, dense) of leaders that share a bucket. ``leaders``: rep, space, slack, mark, vector.

    What a task has of a bucket moves as one row: leaders, slack and marks in binary.
    """
    largest = leaders.groupBy("space").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, largest) / BUCKET)))
    stay = (1 - math.acos(threshold) / math.pi) ** bits
    tables = tables or (math.ceil(math.log(MISS) / math.log(1 - stay)) if bits else 1)
    names = ["rep", "space", "slack", *_MARK]
    entry = 2 + WORDS  # words of 8 bytes

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bucket of each leader and table, entries of the leaders)."""
        held: list[pa.RecordBatch] = []

        def made() -> tuple[np.ndarray, np.ndarray]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            code = np.zeros((table.num_rows, tables), np.int64)
            if bits:
                for at, units in _by_length(table.column(len(names)).combine_chunks(), dtype):
                    side = (units.astype(np.float32) @ _planes(units.shape[1], tables * bits, 93).astype(np.float32) > 0).reshape(len(at), tables, bits)
                    code[at] = side @ (1 << np.arange(bits))
            own = [table.column(c).to_numpy() for c in range(len(names))]
            return own[1][:, None] ^ ((code * tables + np.arange(tables)) * 0x2545F4914F6CDD1D), np.stack([own[0], *own[2:]], 1)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield made()
        if held:
            yield made()

    count_schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
    blob_schema = pa.schema([("bucket", pa.int64()), ("entries", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _ in coded(batches):
            own, n = np.unique(bucket, return_counts=True)
            yield to_batch({"bucket": own, "n": n}, count_schema)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, entries in coded(batches):
            flat = bucket.ravel()
            order = np.argsort(flat, kind="stable")
            own, start = np.unique(flat[order], return_index=True)
            ends = np.append(start[1:], len(flat)) * 8 * entry
            packed = memoryview(entries[order // tables].tobytes())
            yield to_batch({"bucket": own, "entries": [packed[a:b].tobytes() for a, b in zip((start * 8 * entry).tolist(), ends.tolist(), strict=True)]}, blob_schema)

    def opened(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, entry)

    part_schema = pa.schema([("bucket", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("side", pa.int64()), ("entries", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in part_schema}
            for bucket, blob, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(blob, np.int64).reshape(-1, entry)
                side = (rows[:, 0] * 0x2545F4914F6CDD1D >> 17) % parts
                for own in np.unique(side).tolist():
                    mine = rows[side == own].tobytes()
                    for other in range(parts):
                        for name, value in zip(out, (bucket, min(own, other), max(own, other), own, mine), strict=True):
                            out[name].append(value)
            yield to_batch(out, part_schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _Edges(threshold)
        for block in runs(batches, 3):
            rows = opened(block.column(4))
            if len(rows) > 1:
                side = np.repeat(block.column(3).to_numpy(), [len(x) // (8 * entry) for x in block.column(4).to_pylist()])
                edges.compare(rows[:, 0], side, rows[:, 1], np.full(len(rows), neighbours), rows[:, 2:])
            if len(edges.held) > 500:
                yield edges.batch()
        yield edges.batch()

    rows = leaders.select(*names, "vector")
    sizes = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    large = staged(sizes.where(F.col("n") > 2 * BUCKET).select("bucket", F.ceil(F.col("n") / BUCKET).alias("parts")), "nn-large")
    blobs, n_large, zero = rows.mapInArrow(sort, "bucket long, entries binary"), large.count(), F.lit(0).cast("long")
    small = blobs.join(small_side(large.select("bucket"), n_large), "bucket", "left_anti") if n_large else blobs
    whole = small.select("bucket", zero.alias("i"), zero.alias("j"), zero.alias("side"), "entries")
    if n_large:
        dealt = blobs.join(small_side(large, n_large), "bucket").select("bucket", "entries", "parts")
        whole = whole.unionByName(dealt.mapInArrow(deal, "bucket long, i long, j long, side long, entries binary"))
    return grouped(whole, "bucket", "i", "j").mapInArrow(compare, _EDGES_SQL)


def _lists(edges: DataFrame, lengths: DataFrame | None, neighbours: int, name: str) -> DataFrame:
    """(a, k, near array<struct<sim,b>>): the best k of each class."""
    lists = edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("sim", "b")), False).alias("near"))
    lists = lists.join(lengths, "a", "left").withColumn("k", F.coalesce("k", F.lit(neighbours))) if lengths is not None else lists.withColumn("k", F.lit(neighbours))
    return staged(lists.select("a", "k", F.slice("near", F.lit(1), F.col("k")).alias("near")), name)


def neighbour_graph(classes: DataFrame, threshold: float, tables: int | None, neighbours: int, dtype=np.float64) -> DataFrame:
    """(a, b, dense): edges of the graph after NN-descent; dense where a has more neighbours than lists hold."""
    tight = staged(_tight(classes), "nn-tight")
    n_tight = tight.count()
    leaders = classes.join(small_side(tight.where("rep <> leader").select("rep"), n_tight), "rep", "left_anti")
    leaders = leaders.join(small_side(tight.where("rep = leader").select("rep", "slack"), n_tight), "rep", "left")
    leaders = leaders.select("rep", "space", F.coalesce("slack", F.lit(0).cast("long")).alias("slack"), *_MARK, "vector")
    first = staged(_first_edges(leaders, threshold, tables, neighbours, dtype), "nn-first")
    leaders = leaders.drop("vector")
    dense = first.where("dense").select("a").distinct()
    fixed = first.where("dense").select("a", "b").distinct()  # edges of forests, which lists of dense leaders need not hold
    lists = _lists(first.where("NOT dense"), None, neighbours, "nn-lists")
    changed = lists.select("a")
    for _ in range(ROUNDS):
        edges = lists.select("a", F.explode("near").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.sim").alias("sim"))
        grown = lists.select("a", F.when(F.size("near") >= F.col("k"), F.least(F.col("k") * 2, F.lit(MAX_NEIGHBOURS))).otherwise(F.col("k")).alias("k"))
        # Neighbourhoods: a leader, its neighbours and those it is a neighbour of; a hub's is dealt into parts.
        both = edges.select(F.col("a").alias("hub"), F.col("b").alias("rep")).unionByName(edges.select(F.col("b").alias("hub"), F.col("a").alias("rep"))).distinct()
        active = staged(both.join(changed.select(F.col("a").alias("hub")), "hub", "left_semi"), "nn-pairs")
        sizes = active.groupBy("hub").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        members = active.join(sizes, "hub").withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / PART)))
        members = members.join(leaders, "rep").join(grown.withColumnRenamed("a", "rep"), "rep", "left").withColumn("k", F.coalesce("k", F.lit(neighbours)).cast("long"))
        better = staged(_compared(members, ["hub", "part"], threshold), "nn-better")
        dense, fixed = dense.union(better.where("dense").select("a")), fixed.union(better.where("dense").select("a", "b"))
        after = _lists(edges.unionByName(better.where("NOT dense").select("a", "b", "sim")), grown, neighbours, "nn-lists")
        ids = F.transform("near", lambda e: e["b"])
        old = lists.select("a", ids.alias("old"))
        changed = staged(after.select("a", ids.alias("new")).join(old, "a", "left").where(F.col("old").isNull() | (F.size(F.array_except("new", "old")) > 0)).select("a"), "nn-changed")
        discard(active, lists)
        lists = after
        if not changed.limit(1).count():
            break
    dense = dense.union(lists.where(F.size("near") >= MAX_NEIGHBOURS).select("a")).distinct().withColumn("dense", F.lit(True))
    edges = lists.select("a", F.explode("near.b").alias("b")).union(fixed).union(tight.where("rep <> leader").select("rep", "leader").toDF("a", "b"))
    return staged(edges.distinct().join(dense, "a", "left").select("a", "b", F.coalesce("dense", F.lit(False)).alias("dense")), "nn-graph")


# --- exact links ----------------------------------------------------------------------------------------------------


def _linked(units: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, allowed: Callable | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row with rows of the other list (of later ones, where both are one), and a spanning forest of the links.

    Single precision says which pairs are compared in double precision. ``allowed``: (x, y) -> which pairs count.
    """
    single = units.astype(np.float32)
    n, tree, edges = np.zeros(len(units), np.int64), np.arange(len(units)), []
    for start in range(0, len(left), SLICE):
        x, y = left[start : start + SLICE], right[start:] if left is right else right
        maybe = single[x] @ single[y].T >= threshold - MARGIN
        if left is right:
            maybe &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
        if allowed is not None:
            maybe &= allowed(x, y)
        x, y, maybe = x[maybe.any(1)], y[maybe.any(0)], maybe[maybe.any(1)][:, maybe.any(0)]
        if not len(x):
            continue
        linked = maybe & (units[x] @ units[y].T >= threshold)
        n[x] += linked @ copies[y]
        n[y] += copies[x] @ linked
        for k, own in zip(x.tolist(), linked, strict=True):
            others = y[own]
            if (tree[others] != tree[k]).any():
                met, first = np.unique(tree[others], return_index=True)
                edges += [(k, o) for o in others[first[met != tree[k]]].tolist()]
                tree[np.isin(tree, met)] = tree[k]
    return n, edges


def _exact(rows: DataFrame, keys: list[str], threshold: float, dtype, rule: str | None = None) -> DataFrame:
    """(a, b, n): n links of class a where b is null, else an edge of a spanning forest of the links.

    ``rows``: keys..., rep, side, copies, of, vector. Rows of a run meet those of the other side, or each other where there
    is one side. ``rule``: with "sum" pairs count where ``of`` adds up to more than 0, with "other" where it differs.
    """
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            a, b, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=b < 0), pa.array(n, pa.int64())], schema=_LINKS)

        for block in runs(batches, k):
            if block.num_rows > 1:
                rep, side, copies, of = (block.column(k + c).to_numpy() for c in range(4))
                one = (side == side[0]).all()
                left = np.arange(len(rep)) if one else np.flatnonzero(side == side.min())
                right = left if one else np.flatnonzero(side != side.min())
                allowed = None
                if rule == "sum":
                    allowed = lambda x, y: of[x][:, None] + of[y][None, :] > 0  # noqa: E731, B023
                elif rule == "other":
                    allowed = lambda x, y: of[x][:, None] != of[y][None, :]  # noqa: E731, B023
                n, edges = _linked(_matrix(block.column(k + 4), dtype), copies, left, right, threshold, allowed)
                at, (x, y) = np.flatnonzero(n), np.array(edges, np.int64).reshape(-1, 2).T
                out.append((rep[at], np.full(len(at), -1), n[at]))
                out.append((rep[x], rep[y], np.zeros(len(x), np.int64)))
            if len(out) > 500:
                yield made()
        yield made()

    return grouped(rows.select(*keys, "rep", "side", "copies", "of", "vector"), *keys, then="rep").mapInArrow(run, "a long, b long, n long")


def _angles(rows: DataFrame, dtype) -> DataFrame:
    """(component, rep, copies, steps): angles to the component's pivot, in steps, not rounded down."""
    schema = pa.schema([("component", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("steps", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = np.zeros(batch.num_rows, np.int64)
            pivots = batch.column(4)
            for at, units in _by_length(batch.column(3), dtype):
                off = units - _matrix(pivots.take(pa.array(at)), dtype)
                steps[at] = np.ceil(2 * np.arcsin(np.minimum(1, np.sqrt(np.einsum("ij,ij->i", off, off)) / 2)) * STEPS + 1e-6)
            yield to_batch({"component": batch.column(0), "rep": batch.column(1), "copies": batch.column(2), "steps": steps}, schema)

    return rows.select("component", "rep", "copies", "vector", "pivot").mapInArrow(run, "component long, rep long, copies long, steps long")


def _inside(classes: DataFrame, near: DataFrame, middles: DataFrame, threshold: float, dtype) -> DataFrame:
    """Links inside the components of ``near``, as :func:`_exact` gives them. ``middles``: component, pivot."""
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = near.withColumnRenamed("node", "rep").join(sizes, "component").join(classes.select("rep", "copies", "vector"), "rep")
    small = members.where(F.col("size") <= BLOCK).withColumn("side", F.lit(0)).withColumn("of", F.lit(0).cast("long"))
    links = _exact(small, ["component"], threshold, dtype)
    chosen = sizes.where(F.col("size") > BLOCK).join(middles, "component").select("component", F.col("pivot").alias("rep"))
    middle = classes.join(chosen, "rep").select("component", F.col("vector").alias("pivot"))
    told = staged(_angles(members.where(F.col("size") > BLOCK).join(middle, "component"), dtype), "nn-angles")
    if not told.limit(1).count():
        return links
    whole = math.floor((math.acos(threshold) - CLEAR) * STEPS)
    told = told.withColumn("x", 2 * F.col("steps") - whole)
    sure, edges, unsure = sure_links(told.select("component", "rep", "copies", "x"))
    none = F.lit(None).cast("long")
    links = links.unionByName(sure.select(F.col("rep").alias("a"), none.alias("b"), "n")).unionByName(edges.select("a", "b", F.lit(0).cast("long").alias("n")))
    unsure_ones = staged(told.join(unsure.select("rep", "far"), "rep"), "nn-unsure")
    rows = [F.greatest(F.lit(float(CELL)), F.sqrt(F.col(c) * CELL)) for c in ("fars", "nears")]
    blocks = far_blocks(unsure_ones, *rows).join(classes.select("rep", "vector"), "rep").withColumn("of", F.col("x"))
    return links.unionByName(_exact(blocks, ["component", "i", "j"], threshold, dtype, "sum"))


def _outside(classes: DataFrame, groups: DataFrame, near: DataFrame, dense: DataFrame, threshold: float, dtype) -> DataFrame:
    """Links, as :func:`_exact` gives them, of groups with a dense class to classes of other components of ``near``.

    ``dense``: component, of ``groups``, each of which lies inside a component of ``near``. Of the label's classes those
    are asked about whose angle to the group's smallest is no more than its radius and the threshold's angle together;
    between two dense groups the lower one asks.
    """
    owned = classes.select("rep", "space", "copies", "vector").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    owned = owned.join(near.select(F.col("node").alias("rep"), F.col("component").alias("counted")), "rep", "left").withColumn("counted", F.coalesce("counted", "rep"))
    owned = owned.join(dense.select("component", F.lit(True).alias("dense")), "component", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    asking = owned.where("dense")
    middle = asking.where("rep = component").select("component", "counted", "space", F.col("vector").alias("pivot"))
    radius = _angles(asking.join(middle.select("component", "pivot"), "component"), dtype).groupBy("component").agg(F.max("steps").alias("radius"))
    centres = staged(middle.join(radius, "component"), "nn-centres")
    counts = centres.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("pivots")).join(classes.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / (4 * CELL)).alias("parts")), "space")
    zero = F.lit(0).cast("long")
    left = centres.join(counts, "space").withColumn("p", F.pmod(F.xxhash64("component"), "pivots")).withColumn("q", F.explode(F.sequence(zero, F.col("parts") - 1)))
    right = owned.join(counts, "space").withColumn("q", F.pmod(F.xxhash64("rep"), "parts")).withColumn("p", F.explode(F.sequence(zero, F.col("pivots") - 1)))
    both = left.select("space", "p", "q", F.lit(0).alias("side"), F.col("component").alias("rep"), "component", "counted", F.lit(True).alias("dense"), "radius", F.col("pivot").alias("vector"))
    both = both.unionByName(right.select("space", "p", "q", F.lit(1).alias("side"), "rep", "component", "counted", "dense", zero.alias("radius"), "vector"))
    schema = pa.schema([("component", pa.int64()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, 3):
            side, rep, component, counted, dense_, radius_ = (block.column(c).to_numpy() for c in range(3, 9))
            centre, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(centre) and len(other):
                units = _matrix(block.column(9), dtype)
                least = np.cos(np.minimum(np.pi, np.arccos(threshold) + (radius_[centre] + 1) / STEPS)) - MARGIN
                meets = units[centre].astype(np.float32) @ units[other].astype(np.float32).T >= least[:, None]
                meets &= np.where(dense_[other][None, :], component[centre][:, None] < component[other][None, :], True)
                c, o = np.nonzero(meets & (counted[centre][:, None] != counted[other][None, :]))
                yield to_batch({"component": component[centre][c], "rep": rep[other][o]}, schema)

    met = grouped(both.select("space", "p", "q", "side", "rep", "component", "counted", "dense", "radius", "vector"), "space", "p", "q").mapInArrow(run, "component long, rep long")
    met = staged(met, "nn-met")
    out_size = met.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("outs"))
    in_size = asking.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("ins"))
    both_sizes = staged(out_size.join(in_size, "component"), "nn-sizes")
    ins = asking.select("component", "rep", "copies", "vector").join(both_sizes, "component").withColumn("p", F.pmod(F.xxhash64("rep"), "ins")).withColumn("q", F.explode(F.sequence(zero, F.col("outs") - 1)))
    outs = met.join(classes.select("rep", "copies", "vector"), "rep").join(both_sizes, "component").withColumn("q", F.pmod(F.xxhash64("rep"), "outs")).withColumn("p", F.explode(F.sequence(zero, F.col("ins") - 1)))
    names = ["component", "p", "q", "rep", "copies", "vector"]
    rows = ins.select(*names, F.lit(0).alias("side")).unionByName(outs.select(*names, F.lit(1).alias("side"))).withColumn("of", F.col("side").cast("long"))
    return _exact(rows, ["component", "p", "q"], threshold, dtype, "other")


def _across(classes: DataFrame, near: DataFrame, threshold: float, dtype=np.float64) -> DataFrame:
    """As :func:`_exact`, for all links between classes of one label in different components of ``near``.

    Every such pair is compared. The parts of a large label grow with the root of its size, and so does the number of
    parts each class is sent to.
    """
    sizes = classes.groupBy("space").agg(F.count(F.lit(1)).alias("size"))
    rows = classes.join(near.withColumnRenamed("node", "rep"), "rep", "left").withColumn("of", F.coalesce("component", "rep")).join(sizes, "space")
    part = F.greatest(F.lit(float(CELL)), F.sqrt(F.col("size") * CELL))
    return _exact(in_blocks(rows, "space", "rep", "size", part), ["space", "i", "j"], threshold, dtype, "other")


def audit(classes: DataFrame, links: DataFrame, threshold: float, queries: int = AUDIT, dtype=np.float64) -> float:
    """Of a bounded sample of classes, the share with all links found, against all vectors.

    Each class counts once, however many links or copies it has, and the share is the least over classes of alike many
    links (by powers of two), so that large groups can't outvote small ones.
    """
    held = "vector" if "vector" in classes.columns else "unit"
    total = classes.count()
    draw = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 20))
    asked = classes.where(draw < int(min(1.0, queries / max(1, total)) * (1 << 20)) + 1).select("space", "rep", held).collect()
    spaces: dict[int, tuple] = {}
    for space in {r.space for r in asked}:
        own = [r for r in asked if r.space == space]
        spaces[space] = (np.array([r.rep for r in own]), _matrix(pa.array([bytes(r[held]) for r in own]), dtype))
    shared = classes.sparkSession.sparkContext.broadcast(spaces)
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            space, rep, copies = (batch.column(c).to_numpy() for c in (0, 1, 3))
            for s, (ids, units) in shared.value.items():
                at = np.flatnonzero(space == s)
                if len(at):
                    near = units @ _matrix(batch.column(2).take(pa.array(at)), dtype).T >= threshold + CLEAR
                    near &= ids[:, None] != rep[at][None, :]
                    for i, n in zip(ids.tolist(), (near @ copies[at]).tolist(), strict=True):
                        found[i] = found.get(i, 0) + n
        yield to_batch({"rep": list(found), "n": list(found.values())}, schema)

    true = classes.select("space", "rep", held, "copies").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    whole = true.where("n > 0").join(links, "rep", "left").select(F.floor(F.log2("n")).alias("band"), (F.coalesce("links", F.lit(0)) >= F.col("n")).cast("double").alias("whole"))
    least = whole.groupBy("band").agg(F.avg("whole").alias("share")).agg(F.min("share")).first()[0]
    return 1.0 if least is None else least


def _counted(found: DataFrame) -> DataFrame:
    """(rep, links) of what :func:`_exact` gave."""
    return staged(found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links")), "nn-links")


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, classes, dtype = _classes(vectors, id_col, vector_col, label_col)
    graph = neighbour_graph(classes, threshold, TABLES, NEIGHBOURS, dtype)
    near = connected_components(graph.select("a", "b"), "nn-near")
    inner = staged(_inside(classes, near, pivots(graph, near), threshold, dtype), "nn-inside")
    groups = connected_components(inner.where("b IS NOT NULL").select("a", "b"), "nn-groups")
    found = inner
    dense = staged(graph.where("dense").select(F.col("a").alias("node")).distinct().join(groups, "node").select("component").distinct(), "nn-dense")
    if dense.limit(1).count():
        # Outside of the components that links make, not of those of the graph, which unrelated vectors may have joined.
        missed = staged(_outside(classes, groups, near, dense, threshold, dtype), "nn-outside")
        found = inner.unionByName(missed)
    links = _counted(found)
    recall = audit(classes, links, threshold, AUDIT, dtype)
    if recall < RECALL:
        found = inner.unionByName(staged(_across(classes, near, threshold, dtype), "nn-across"))
        links = _counted(found)
        recall = audit(classes, links, threshold, AUDIT, dtype)
    if recall < RECALL:
        raise RuntimeError(f"near_embeddings: all links found for only {recall:.4f} of the audited classes, {RECALL} wanted")
    if found is not inner:
        groups = connected_components(found.where("b IS NOT NULL").select("a", "b"), "nn-groups")
    groups = groups.withColumnRenamed("node", "rep")
    own = ["space", "d0", "d1"]
    known = classes.select("rep", *own, "copies", "least").join(links, "rep", "left").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = staged(known.select(*own, "component", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "nn-known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = known.join(least, "component").select(*own, "n_links", "component_id")
    out = rows.where("able").join(of_class, own).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
