"""Cost-balanced packing of documents into fixed-length training sequences.

A document is its byte-level BPE ids and a closing id. Its attention cost at length n is ``LINEAR * n + QUADRATIC * n^2``.
Blocks of about ``BLOCK_TOKENS`` tokens are packed each on its own as they stream through a task: first a document's
full windows of 2048 go out as sequences of their own, then the rests, longest first, each join the sequence of lowest
cost that has room. The sequences of a block hold exactly its tokens: as many of 2048 as fit, then powers of two for the
remainder, so nothing is padded. A rest that fits nowhere is cut at the largest room left, and what remains takes its
turn by length. Every id lies in exactly one piece.

There is no shuffle: a block is made of consecutive rows of a partition, so a task holds one block at a time however
large the input. Sequence ids carry the partition's number in their upper bits, the same on every retry.

Edge cases: a null or empty text is the closing id alone; long texts span many sequences; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored. Strings of added tokens in a text are single ids.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from columnloom.llm.common import pieces, to_batch

CAPACITY = 2048
#: Weights of the linear and the quadratic part of a document's cost (equal parts at 2048 tokens).
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
BLOCK_TOKENS = 4_000_000
CLOSING_ID = 1
#: Words in a worker's cache, and the length of one in characters; longer ones are encoded each time.
CACHE_WORDS, CACHED_LENGTH = 250_000, 64
#: A single space between words, which starts a pre-token whatever stands around it.
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Letters and the signs behind them are a pre-token each.
_SIGNED = re.compile(r"([^\W\d_]+)([.,;:!?]+)")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: its own if it has a printed form, else one of those from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = itertools.count(256)
    return [chr(b if b in own else next(rest)) for b in range(256)]




class _Units(dict):
    """Little-endian ids of a word behind ``mark``. A full cache starts anew, but what it held is still looked up once more."""

    def __init__(self, mark: str, encode) -> None:
        self.mark, self.encode, self.before = mark, encode, {}

    def __missing__(self, word: str) -> bytes:
        value = self.before.get(word)
        if value is None:
            value = self.encode(self.mark, word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = value
        return value


class ByteBpe:
    """Ids of whole texts, as the tokenizers library gives them. Words that single spaces or line ends part are
    independent, so they come from a cache; what holds other white space goes to the library, up to the next single space.
    """

    #: What breaks that: two such separators in a row, or other white space.
    UNEVEN = ("  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.letters = self.library.model, _byte_letters()
        # Strings of the vocabulary's own added tokens are single ids wherever they stand.
        added = {t.content: k for k, t in self.library.get_added_tokens_decoder().items()}
        self.added = {text: self._bytes([k]) for text, k in added.items()}
        self.parts = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.spaced, self.first = (_Units(mark, self._encode) for mark in (" ", ""))

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, mark: str, word: str) -> bytes:
        """Letters alone are one pre-token, which the library's model splits; anything else takes the library's whole way."""
        if word.isalpha():
            return self._bytes([t.id for t in self.model.tokenize("".join([self.letters[b] for b in (mark + word).encode()]))])
        signed = _SIGNED.fullmatch(word)
        if signed and signed[1].isalpha():
            return (self.spaced if mark else self.first)[signed[1]] + self.first[signed[2]]
        return self._bytes(self.library.encode(mark + word, add_special_tokens=False).ids)

    def _segment(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in self.UNEVEN):
            first, *rest = _GAP.split(text)
            return b"".join([self.first[first], *map(self.spaced.__getitem__, rest)])
        out: list[bytes] = []
        for line in text.split("\n"):
            words = line.split(" ")
            out += (self.first["\n"], self.first[words[0]])
            out.extend(map(self.spaced.__getitem__, words[1:]))
        return b"".join(out[1:])

    def encode(self, text: str) -> bytes:
        if self.parts is None or not any(t in text for t in self.added):
            return self._segment(text)
        return b"".join([self.added[x] if k % 2 else self._segment(x) for k, x in enumerate(self.parts.split(text))])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def _cost(n: np.ndarray | int):
    return LINEAR * n + QUADRATIC * n * n


def plan_block(lengths: list[int], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given lengths."""
    sequence, rests = 0, []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            yield doc, start, capacity, sequence, 0
            sequence += 1
            start += capacity
        if n > start:
            rests.append((start - n, doc, start))
    heapq.heapify(rests)
    total = -sum(r[0] for r in rests)
    rooms = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> k & 1]
    # For each room left: the sequences that have it as a heap by cost, and the lowest cost.
    heaps: list[list] = [[] for _ in range(capacity + 1)]
    lowest = np.full(capacity + 1, np.inf)
    for i, room in enumerate(rooms):
        heaps[room].append((0.0, sequence + i))
        lowest[room] = 0.0
    full = dict(enumerate(rooms, sequence))
    while rests:
        need, doc, start = heapq.heappop(rests)
        need = -need
        room = need + int(np.argmin(lowest[need:]))
        if not np.isfinite(lowest[room]):  # fits nowhere: cut it at the largest room
            room = int(np.flatnonzero(np.isfinite(lowest))[-1])
            heapq.heappush(rests, (room - need, doc, start + room))
            need = room
        cost, at = heapq.heappop(heaps[room])
        lowest[room] = heaps[room][0][0] if heaps[room] else np.inf
        yield doc, start, need, at, full[at] - room
        if room > need:
            heapq.heappush(heaps[room - need], (cost + _cost(need), at))
            lowest[room - need] = heaps[room - need][0][0]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, tokenizer_path: str, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on request, ids."""
    schema = _SCHEMA.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, closing = encoder(tokenizer_path), np.array([CLOSING_ID], "<u4").tobytes()
        base, held, ids, size = TaskContext.get().partitionId() << 36, [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal base
            columns: dict[str, list] = {f.name: [] for f in schema}
            last = -1
            for doc, start, n, sequence, offset in plan_block([len(x) // 4 for x in ids]):
                part = ids[doc][4 * start : 4 * (start + n)]
                row = (held[doc], start, n, zlib.crc32(part), len(ids[doc]) // 4, base + sequence, offset)
                for name, value in zip(columns, (*row, np.frombuffer(part, "<u4").tolist()) if with_ids else row, strict=True):
                    columns[name].append(value)
                last = max(last, sequence)
            base += last + 1
            return to_batch(columns, schema)

        for batch in pieces(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(doc_id)
                ids.append(bpe.encode(text.as_py() or "") + closing)
                size += len(ids[-1]) // 4
                if size >= block_tokens:
                    yield packed()
                    held, ids, size = [], [], 0
        if held:
            yield packed()

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, fields + ", ids array<long>" * with_ids)
