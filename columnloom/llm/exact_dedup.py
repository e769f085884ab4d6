"""Exact dedup over a cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. The index is sharded by digest.
Each shard holds *content* (the live digests with their kept row and size, bucketed by shard) and a *cuckoo filter*
over 64-bit keys of the digests. A digest that misses the filter is new and inserted without a look at the content;
a hit is verified against the content, so a false positive costs a lookup and never merges two texts. Deleting
removes the fingerprint; overflow rebuilds the filter at twice the size from the stored keys.

Entries reach their shard pre-aggregated per (digest, salt), so a digest that a third of all rows share arrives as at
most ``SALTS`` rows. A shard holds ``SHARD_ROWS`` digests on average; an index that outgrows this is dealt into more shards.

Edge cases: null or empty texts form one group; of equal (doc_id, text) rows exactly one stays (the one with the
largest internal row key); a null doc_id loses to any other; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import random
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.llm.common import drop_rows, fresh, keyed, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 8
MIN_SHARDS, SHARD_ROWS = 64, 200_000
SLOTS, MAX_KICKS = 4, 200
CONTENT = "shard int, digest binary, keep_id long, keep_row long, n long"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 marks a free slot."""

    def __init__(self, n_keys: int = 0, buckets: int | None = None, table: bytes | None = None) -> None:
        self.buckets = buckets or 1 << max(2, (int(n_keys / (SLOTS * 0.85)) + 1).bit_length())
        self.table = array("H", table) if table else array("H", bytes(2 * SLOTS * self.buckets))
        self.random = random.Random(self.buckets)

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key >> 48) % 65535 + 1
        first = key & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & (self.buckets - 1)

    def __contains__(self, key: int) -> bool:
        mark, a, b = self._places(key)
        return mark in self.table[a * SLOTS : a * SLOTS + SLOTS] or mark in self.table[b * SLOTS : b * SLOTS + SLOTS]

    def _put(self, bucket: int, mark: int) -> bool:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.table[i]:
                self.table[i] = mark
                return True
        return False

    def insert(self, key: int) -> bool:
        """False when the filter overflows; the caller then resizes from its stored keys, as a fingerprint was lost."""
        mark, a, b = self._places(key)
        if self._put(a, mark) or self._put(b, mark):
            return True
        at = self.random.choice((a, b))
        for _ in range(MAX_KICKS):
            i = at * SLOTS + self.random.randrange(SLOTS)
            mark, self.table[i] = self.table[i], mark
            at = self._other(at, mark)
            if self._put(at, mark):
                return True
        return False

    def delete(self, key: int) -> bool:
        """Remove one fingerprint of a key that is known to be stored."""
        mark, a, b = self._places(key)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[i] == mark:
                    self.table[i] = 0
                    return True
        return False


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[8:16], "little")


class Shard:
    """One shard: the filter before the bucketed content."""

    def __init__(self, expected: int = 0) -> None:
        self.filter, self.content = CuckooFilter(expected), {}
        self.verified = self.resized = 0

    def _store(self, digest: bytes, entry: tuple) -> None:
        self.content[digest] = entry
        if not self.filter.insert(_key(digest)):
            self._resize()

    def _resize(self) -> None:
        buckets = self.filter.buckets
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets=buckets)
            self.resized += 1
            if all(self.filter.insert(_key(d)) for d in self.content):
                return

    def find(self, digest: bytes) -> tuple | None:
        if _key(digest) not in self.filter:
            return None
        self.verified += 1
        return self.content.get(digest)

    def add(self, digest: bytes, keep_id: int | None, keep_row: int, n: int) -> None:
        found = self.find(digest)
        if found is None:
            self._store(digest, (keep_id, keep_row, n))
        else:
            best = max(((-1 << 63) if k is None else k, r, k) for k, r in (found[:2], (keep_id, keep_row)))
            self.content[digest] = (best[2], best[1], found[2] + n)

    def remove(self, digest: bytes) -> bool:
        if self.find(digest) is None:
            return False
        del self.content[digest]
        return self.filter.delete(_key(digest))


def _frame(shard_id: int, shard: Shard) -> pd.DataFrame:
    rows = [(shard_id, d, k, r, n) for d, (k, r, n) in shard.content.items()]
    out = pd.DataFrame(rows, columns=["shard", "digest", "keep_id", "keep_row", "n"])
    return out.astype({"shard": "int32", "keep_id": "Int64", "keep_row": "int64", "n": "int64"})


def _number(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _fill(entries: pd.DataFrame) -> pd.DataFrame:
    shard = Shard(len(entries))
    for d, k, r, n in zip(entries.digest, entries.keep_id, entries.keep_row, entries.n, strict=True):
        shard.add(bytes(d), _number(k), int(r), int(n))
    return _frame(int(entries.shard.iloc[0]), shard)


def _update(key: tuple, stored: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    shard = Shard(len(stored) + len(entries))
    for part in (stored, entries):
        for d, k, r, n in zip(part.digest, part.keep_id, part.keep_row, part.n, strict=True):
            if n < 0:
                shard.remove(bytes(d))
            else:
                shard.add(bytes(d), _number(k), int(r), int(n))
    return _frame(int(key[0]), shard)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """(row_key, doc_id, digest): JVM-side SHA-256 of the normalised text. ``key``: a column of row keys, if there is one."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    row = F.col(key) if key else F.monotonically_increasing_id()
    return docs.select(row.alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _entries(rows: DataFrame, n_shards: int) -> DataFrame:
    return (
        rows.groupBy("digest", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).alias("salt"))
        .agg(F.max(F.struct("doc_id", "row_key")).alias("best"), F.count(F.lit(1)).alias("n"))
        .select(F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int").alias("shard"), "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_key").alias("keep_row"), "n")
    )


class DedupIndex:
    """Live digests in shards. Every change returns a new index over a newly staged table."""

    def __init__(self, content: DataFrame, n_shards: int) -> None:
        self.content, self.n_shards = content, n_shards

    @classmethod
    def build(cls, rows: DataFrame, n_rows: int) -> DedupIndex:
        """``rows``: (row_key, doc_id, digest), ``n_rows`` of them."""
        n_shards = max(MIN_SHARDS, -(-n_rows // SHARD_ROWS))
        return cls(staged(_entries(rows, n_shards).groupBy("shard").applyInPandas(_fill, CONTENT), "dedup-content"), n_shards)

    def _changed(self, entries: DataFrame) -> DedupIndex:
        done = self.content.groupBy("shard").cogroup(entries.groupBy("shard")).applyInPandas(_update, CONTENT)
        return DedupIndex(staged(done, "dedup-content"), self.n_shards)

    def _with_room(self, n_live: int) -> DedupIndex:
        """The same index, dealt into twice the shards as often as ``n_live`` digests need it."""
        n_shards = self.n_shards
        while n_live > n_shards * SHARD_ROWS:
            n_shards *= 2
        if n_shards == self.n_shards:
            return self
        dealt = self.content.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int"))
        return DedupIndex(staged(dealt, "dedup-content"), n_shards)

    def insert(self, rows: DataFrame) -> DedupIndex:
        index = self._with_room(self.content.count() + rows.count())
        return index._changed(_entries(rows, index.n_shards))

    def delete(self, rows: DataFrame) -> DedupIndex:
        """Without the digests of ``rows``; digests that are not live change nothing."""
        return self._changed(_entries(rows, self.n_shards).withColumn("n", F.lit(-1).cast("long")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row_key.

    The join back to the rows is a sort-merge join on the digest with unique keys on one side, so adaptive execution
    splits a hot digest's rows. ``key`` names a column of unique row keys to be used as row_key.
    """
    rows = staged(digests(docs, id_col, text_col, key), "dedup-rows")
    index = DedupIndex.build(rows, rows.count())
    return rows.join(index.content.drop("shard"), "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row_key") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row_key"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns stay."""
    key = fresh(docs, "row_key")
    docs = keyed(docs, key)
    gone = staged(exact_dedup(docs, key=key).where(~F.col("kept")).select(F.col("row_key").alias(key)), "dedup-drop")
    return drop_rows(docs, gone, key).drop(key)
