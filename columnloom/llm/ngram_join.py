"""N-gram Jaccard join with Bayesian candidate pruning.

Two documents are linked when the Jaccard similarity of their sets of ``WORDS``-word shingles (lower case, white-space
words; a shorter text is one shingle) is at least ``THRESHOLD``.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit digest of the set and ``HASHES``
   MinHash values. Documents with equal sets are one *class*, pre-aggregated, so copies are never paired.
2. Classes meet in buckets of ``BAND`` MinHash values. With 24 bands of 4 a pair at 0.8 misses all with probability
   3e-6. Inside a bucket pairs compare their values ``STEP`` at a time and are dropped once the posterior probability of
   reaching the threshold, from a uniform prior, is below ``TOLERANCE``. A bucket passes on edges that connect the pairs
   that are left, not the pairs. A bucket of more than ``BUCKET_ROWS`` classes is dealt into parts that all meet its
   pivot; classes that are a likely pair with it are connected through it, and only the others meet every part.
3. The connected components hold every linked pair. Each is verified exactly on shingle sets recomputed from the texts,
   and yields each class's number of links and edges that connect the links. A large component's texts move once, to
   parts that hold its pivot: the symmetric difference is a metric, so what sets two classes apart from the pivot mostly
   tells whether they link, which is counted without a pair. Only classes that have pairs of which it doesn't tell are
   compared, in blocks, by their differences from the pivot alone.

Edge cases: null, empty and white-space texts have no shingles and link with nothing; repeated rows are copies; ties in
who stays go to the smallest doc_id, then row; an empty table gives an empty result; other columns are ignored by
``ngram_join`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.llm.common import batches_of, drop_rows, fresh, keyed, pieces, small_side, staged, to_batch
from columnloom.llm.components import across, connected_components, far_blocks, grouped, pivots, runs, spanning, sure_links

WORDS, THRESHOLD = 5, 0.8
HASHES, BAND, STEP, TOLERANCE = 96, 4, 16, 1e-5
#: Classes in a block of a bucket; classes and shingles of a component that is one block, or of a part of a larger one;
#: classes and shingles of a part where differences are compared.
BUCKET_ROWS, VERIFY_ROWS, VERIFY_SHINGLES, OPEN_ROWS, OPEN_SHINGLES = 512, 256, 500_000, 512, 500_000
#: Texts of an Arrow batch, and bytes of them worked on at once.
TEXT_ROWS, TEXT_BYTES = 1000, 1_000_000

_U = np.uint64
_draw = np.random.default_rng(20240501)
_A = _draw.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_B = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BASE = _U(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers(size: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))


def word_hashes(words: list[list[str]]) -> np.ndarray:
    """64-bit hashes of all words, computed on the bytes of all texts at once."""
    flat = list(itertools.chain.from_iterable(words))
    if not flat:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(" ".join(flat).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.append(np.diff(starts), len(raw) - starts[-1]))
    power = _powers(1 << int(place.max() + 1).bit_length())
    values = (raw.astype(np.uint64) + _U(1)) * power[place]
    values[ends[:-1]] = 0
    return _mix(np.add.reduceat(values, starts))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted."""
    split = [(t or "").lower().split() for t in texts]
    own = word_hashes(split)
    n, out, at = len(own), [], 0
    long = np.zeros(max(0, n - words + 1), np.uint64)
    factors = _mix(np.arange(1, words + 1, dtype=np.uint64)) | _U(1)
    for k in range(words if len(long) else 0):
        long += own[k : k + len(long)] * factors[k]
    long = _mix(long)
    for w in split:
        if len(w) >= words:
            out.append(np.unique(long[at : at + len(w) - words + 1]))
        elif w:
            short = (own[at : at + len(w)] * factors[: len(w)]).sum(keepdims=True)
            out.append(_mix(short ^ _mix(np.array([len(w)], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(w)
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (uint32) of non-empty sets, one row each."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> _U(32), starts)
    return out


@cache
def least_matches(threshold: float, step: int = STEP, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, P(similarity >= threshold | matches) is below the tolerance.

    With a uniform prior and m matches in n the posterior is Beta(m+1, n-m+1), whose upper tail at t is the probability
    of at most m successes in n+1 trials with chance t.
    """
    out = []
    for n in range(step, HASHES + 1, step):
        below, need = 0.0, 0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                need = m
                break
        out.append((n, need))
    return out


def likely_pairs(signatures: np.ndarray, allowed: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that incremental comparison doesn't rule out."""
    a, b = np.triu_indices(len(signatures), 1)
    if allowed is not None:
        keep = allowed[a, b]
        a, b = a[keep], b[keep]
    matches, start = np.zeros(len(a), np.int32), 0
    for n, need in least_matches(threshold):
        matches += (signatures[a, start:n] == signatures[b, start:n]).sum(1, dtype=np.int32)
        keep = matches >= need
        a, b, matches, start = a[keep], b[keep], matches[keep], n
    return a, b


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the sets' intersections; its diagonal and what no two sets share don't count."""
    n = len(sets)
    both = np.zeros((n, n), np.float64)
    flat = np.concatenate(sets)
    if not len(flat):
        return both
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(n), [len(s) for s in sets]), counts[inverse] > 1
    column = np.cumsum(counts > 1)[inverse][shared] - 1
    owner, width = owner[shared], int((counts > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(256, 4_000_000 // max(1, n))
    for start in range(0, width, step):
        lo, hi = np.searchsorted(column, [start, start + step])
        part = np.zeros((n, min(step, width - start)), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        both += part @ part.T
    return both


def _ratio(threshold: float) -> tuple[int, int]:
    """(p, q): sets of n and m elements link where q times their symmetric difference is at most p times n + m."""
    least = Fraction(str(threshold))
    return least.denominator - least.numerator, least.denominator + least.numerator


def jaccard_links(sets: list[np.ndarray], allowed: np.ndarray | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs at or above the threshold, exactly."""
    sizes, (p, q) = np.array([len(s) for s in sets], np.int64), _ratio(threshold)
    total = sizes[:, None] + sizes[None, :]
    linked = q * (total - 2 * overlaps(sets)) <= p * total
    np.fill_diagonal(linked, False)
    return linked & allowed if allowed is not None else linked


def difference_links(parts: list[np.ndarray], sizes: np.ndarray, allowed: np.ndarray | None, threshold: float) -> np.ndarray:
    """As :func:`jaccard_links`, for sets given by their symmetric differences from one set; pairs that these tell are left out."""
    own, (p, q) = np.array([len(d) for d in parts], np.int64), _ratio(threshold)
    total, sums = sizes[:, None] + sizes[None, :], own[:, None] + own[None, :]
    linked = (q * (sums - 2 * overlaps(parts)) <= p * total) & (q * sums > p * total)
    np.fill_diagonal(linked, False)
    return linked & allowed if allowed is not None else linked


def _signed(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """row_key, doc_id, n, set_a, set_b, signature."""
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", TEXT_BYTES):
            sets = shingle_sets(batch.column(2).to_pylist())
            full = [s for s in sets if len(s)]
            marks = minhashes(full) if full else np.zeros((0, HASHES), np.uint32)
            rest = iter(marks)
            yield to_batch({
                "row_key": batch.column(0), "doc_id": batch.column(1), "n": [len(s) for s in sets],
                "set_a": [int(s.sum().astype(np.int64)) if len(s) else 0 for s in sets],
                "set_b": [int(np.bitwise_xor.reduce(_mix(s + _U(7))).astype(np.int64)) if len(s) else 0 for s in sets],
                "signature": [next(rest).tobytes() if len(s) else None for s in sets],
            }, schema)

    rows = docs.select(F.col(key).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "row_key long, doc_id long, n long, set_a long, set_b long, signature binary")


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _likely(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the likely pairs of each run of (keys..., rep, side, signature), across sides if there are two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"a": [], "b": []}
        for block in runs(batches, len(keys)):
            if block.num_rows > 1:
                rep, side, marks = (block.column(len(keys) + c) for c in range(3))
                rep = rep.to_numpy()
                for x, y in spanning(*likely_pairs(_signatures(marks), across(side.to_numpy()), threshold), len(rep)):
                    out["a"].append(int(rep[x]))
                    out["b"].append(int(rep[y]))
            if len(out["a"]) > 10_000:
                yield to_batch(out, _EDGES)
                out = {"a": [], "b": []}
        yield to_batch(out, _EDGES)

    return grouped(rows.select(*keys, "rep", "side", "signature"), *keys, then="rep").mapInArrow(run, "a long, b long")


def _around_pivots(rows: DataFrame, threshold: float) -> DataFrame:
    """(bucket, part, a, b): edges from the pivot of a large bucket to what is likely a pair with it, and between others.

    ``rows``: bucket, part, rep, pivot, signature, the pivot in every part. Classes that are no likely pair with the pivot
    are *far*, and come with b null: the pairs among the rest are connected already, those of far ones are looked for in
    their part here, and in the other parts later.
    """
    schema = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, 2):
            rep, pivot, marks = block.column(2).to_numpy(), block.column(3)[0].as_py(), _signatures(block.column(4))
            centre = int(np.flatnonzero(rep == pivot)[0])
            star = np.zeros((len(rep), len(rep)), bool)
            star[centre] = star[:, centre] = True
            near = np.zeros(len(rep), bool)
            near[np.concatenate(likely_pairs(marks, star, threshold))] = True
            near[centre] = True
            far = np.flatnonzero(~near)
            out = {"a": [pivot] * (int(near.sum()) - 1), "b": rep[near & (rep != pivot)].tolist()}
            if len(far):
                for x, y in spanning(*likely_pairs(marks, ~(near[:, None] & near[None, :]), threshold), len(rep)):
                    out["a"].append(int(rep[x]))
                    out["b"].append(int(rep[y]))
                out["a"] += rep[far].tolist()
                out["b"] += [None] * len(far)
            n = len(out["a"])
            yield to_batch({"bucket": [block.column(0)[0].as_py()] * n, "part": [block.column(1)[0].as_py()] * n, **out}, schema)

    return grouped(rows.select("bucket", "part", "rep", "pivot", "signature"), "bucket", "part", then="rep").mapInArrow(run, "bucket long, part long, a long, b long")


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that connect each bucket's likely pairs.

    Small buckets are one block. In a large one every part meets the bucket's pivot, which connects the bulk of a group
    of near copies in one pass; only its far classes are compared with every part.
    """
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda k: F.substring("signature", k * (4 * BAND) + 1, 4 * BAND)))
    rows = classes.select(F.col("rep"), bands.alias("band", "part")).select("rep", F.xxhash64("band", "part").alias("bucket"))
    rows = staged(rows, "ngram-bands")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    marks = classes.select("rep", "signature")
    small = rows.join(shared.where(F.col("size") <= BUCKET_ROWS).select("bucket"), "bucket").join(marks, "rep")
    found = _likely(small.withColumn("side", F.lit(0)), ["bucket"], threshold)
    n_parts = F.ceil(F.col("size") / BUCKET_ROWS)
    large = staged(shared.where(F.col("size") > BUCKET_ROWS).select("bucket", "pivot", n_parts.alias("parts")), "ngram-large")
    if not large.limit(1).count():
        return found
    dealt = rows.join(large, "bucket").where("rep <> pivot").withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    pivots = large.select("bucket", "pivot", F.col("pivot").alias("rep"), "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    every = dealt.select("bucket", "part", "rep", "pivot").unionByName(pivots.select("bucket", "part", "rep", "pivot"))
    star = staged(_around_pivots(every.join(marks, "rep"), threshold), "ngram-star")
    found = found.unionByName(star.where("b IS NOT NULL").select("a", "b"))
    far = star.where("b IS NULL").select("bucket", "part", F.col("a").alias("rep"))
    pieces_of = staged(far.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("pieces")).join(large, "bucket"), "ngram-far")
    if not pieces_of.limit(1).count():
        return found
    left = far.join(pieces_of, "bucket").withColumn("piece", F.pmod(F.xxhash64("rep", F.lit(7)), "pieces")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left = left.where("other <> part").select("bucket", F.col("other").alias("part"), "piece", "rep", F.lit(0).alias("side"))
    right = dealt.join(pieces_of.select("bucket", "pieces"), "bucket").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    met = left.unionByName(right.select("bucket", "part", "piece", "rep", F.lit(1).alias("side")))
    return found.unionByName(_likely(met.join(marks, "rep"), ["bucket", "part", "piece"], threshold))


_FOUND = pa.schema([("component", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("apart", pa.int64()), ("difference", pa.binary())])
_FOUND_SQL = "component long, a long, b long, n long, apart long, difference binary"


def _linked_rows(rep: np.ndarray, copies: np.ndarray, linked: np.ndarray) -> Iterator[tuple]:
    """(a, null, n): n links of class a; (a, b, 0): an edge of a spanning forest of the links."""
    n = linked @ copies
    for k in np.flatnonzero(n):
        yield int(rep[k]), None, int(n[k])
    for x, y in spanning(*np.nonzero(np.triu(linked | linked.T)), len(rep)):
        yield int(rep[x]), int(rep[y]), 0


def _verified(texts: DataFrame, threshold: float) -> DataFrame:
    """Links inside components, as (component, a, b, n, apart, difference).

    ``texts``: component, rep, copies, size, weight (shingles of the component), pivot, text. A small component is one
    block, whose links come out as :func:`_linked_rows` gives them. A large one is dealt into parts that all hold the
    component's pivot; each class comes out with its number of shingles, how many set it apart from
    the pivot, and which.
    """
    parts = F.ceil(F.greatest(F.col("size") / VERIFY_ROWS, F.col("weight") / VERIFY_SHINGLES)).cast("long")
    own = F.pmod(F.xxhash64("rep"), parts)
    places = F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(own))
    rows = texts.withColumn("own", own).withColumn("parts", parts).withColumn("part", F.explode(places)).select("component", "part", "rep", "own", "parts", "copies", "text", "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = dict(zip(_FOUND.names, zip(*out, strict=True), strict=True)) if out else {name: [] for name in _FOUND.names}
            out.clear()
            return to_batch({k: list(v) for k, v in columns.items()}, _FOUND)

        for block in runs(batches, 2):
            component, part, rep = block.column(0)[0].as_py(), block.column(1)[0].as_py(), block.column(2).to_numpy()
            sets = shingle_sets(block.column(6).to_pylist())
            if block.column(4)[0].as_py() == 1:
                if len(rep) > 1:
                    out += [(component, a, b, n, None, None) for a, b, n in _linked_rows(rep, block.column(5).to_numpy(), jaccard_links(sets, None, threshold))]
            else:
                pivot = sets[int(np.flatnonzero(rep == block.column(7)[0].as_py())[0])]
                for k in np.flatnonzero(block.column(3).to_numpy() == part):
                    apart = np.setxor1d(sets[k], pivot, assume_unique=True)
                    out.append((component, int(rep[k]), None, len(sets[k]), len(apart), apart.tobytes()))
            if len(out) > 2_000:
                yield made()
        yield made()

    return grouped(rows, "component", "part", then="rep").mapInArrow(run, _FOUND_SQL)


def _unsure_links(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) as :func:`_linked_rows` gives them, for the pairs that the distances to the pivot don't tell.

    ``members``: component, rep, copies, n, apart, difference, far. Only the differences from the pivot move, in blocks of
    ``OPEN_ROWS`` rows and ``OPEN_SHINGLES`` shingles a side.
    """
    rows = far_blocks(members, OPEN_ROWS, OPEN_ROWS, F.col("apart") * (OPEN_ROWS / OPEN_SHINGLES)).select("component", "i", "j", "rep", "side", "copies", "n", "difference")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, 3):
            if block.num_rows > 1:
                rep, side, copies, sizes = (block.column(c).to_numpy() for c in (3, 4, 5, 6))
                apart = [np.frombuffer(d, np.uint64) for d in block.column(7).to_pylist()]
                found = list(_linked_rows(rep, copies, difference_links(apart, sizes, across(side), threshold)))
                if found:
                    yield to_batch({k: list(v) for k, v in zip("abn", zip(*found, strict=True), strict=True)}, schema)

    return grouped(rows, "component", "i", "j", then="rep").mapInArrow(run, "a long, b long, n long")


def _all_links(found: DataFrame, copies: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) of all components, from what :func:`_verified` found."""
    links = found.where("apart IS NULL").select("a", "b", "n")
    members = found.where("apart IS NOT NULL").withColumnRenamed("a", "rep").drop("b")
    if not members.limit(1).count():
        return links
    p, q = _ratio(threshold)
    members = staged(members.join(copies, "rep").withColumn("x", q * F.col("apart") - p * F.col("n")), "ngram-members")
    sure, edges, unsure = sure_links(members.select("component", "rep", "copies", "x"))
    none = F.lit(None).cast("long")
    links = links.unionByName(sure.select(F.col("rep").alias("a"), none.alias("b"), "n")).unionByName(edges.select("a", "b", F.lit(0).cast("long").alias("n")))
    return links.unionByName(_unsure_links(members.join(unsure.select("rep", "far"), "rep"), threshold))


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, kept, n_shingles, row_key.

    class_id is the smallest doc_id of the rows reachable by links, n_links the number of other rows linked directly,
    kept marks the one row of the group that stays. ``key`` names a column of :func:`keyed` row keys, if there is one.
    """
    if key is None:
        key = fresh(docs, "row_key")
        docs = keyed(docs.select(id_col, text_col), key)
    with batches_of(docs.sparkSession, TEXT_ROWS):
        signed = staged(_signed(docs, id_col, text_col, key), "ngram-signed")
    same = ["set_a", "set_b", "n"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key"))
    sets = staged(signed.where("n > 0").groupBy(*same).agg(F.min("row_key").alias("rep"), F.count(F.lit(1)).alias("copies"), first.alias("first")), "ngram-sets")
    classes = staged(signed.join(sets.select(F.col("rep").alias("row_key")), "row_key", "left_semi").select(F.col("row_key").alias("rep"), "signature"), "ngram-classes")

    likely = staged(_candidates(classes, threshold), "ngram-likely")
    near = connected_components(likely, "ngram-near")
    of_class = sets.select(F.col("rep").alias("node"), "copies", "n")
    sizes = near.join(of_class, "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    chosen = staged(near.join(sizes, "component").join(of_class, "node").join(pivots(likely, near), "component").select(F.col("node").alias("row_key"), "component", "size", "weight", "copies", "pivot"), "ngram-chosen")
    texts = docs.select(F.col(key).alias("row_key"), F.col(text_col).alias("text")).join(small_side(chosen, chosen.count()), "row_key")
    with batches_of(docs.sparkSession, TEXT_ROWS):
        verified = staged(_verified(texts.withColumnRenamed("row_key", "rep"), threshold), "ngram-verified")
    found = staged(_all_links(verified, sets.select("rep", "copies"), threshold), "ngram-found")

    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b"), "ngram-groups").withColumnRenamed("node", "rep")
    known = sets.join(links, "rep", "left").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = staged(known, "ngram-known")
    stays = known.groupBy("component").agg(F.min("first").alias("stays"))
    known = known.join(stays, "component").select(*same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("stays.doc_id").alias("class_id"), F.col("stays.row_key").alias("stays"))
    rows = signed.select("row_key", "doc_id", *same)
    out = rows.where("n > 0").join(known, same).select("doc_id", "class_id", "n_links", (F.col("row_key") == F.col("stays")).alias("kept"), F.col("n").alias("n_shingles"), "row_key")
    alone = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), F.col("n").alias("n_shingles"), "row_key")
    return out.unionByName(alone)


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of near copies; all columns stay."""
    key = fresh(docs, "row_key")
    docs = keyed(docs, key)
    gone = staged(ngram_join(docs, threshold, key=key).where(~F.col("kept")).select(F.col("row_key").alias(key)), "ngram-drop")
    return drop_rows(docs, gone, key).drop(key)
