"""BPE encoding and decoding by a backtracking encoder.

An Aho-Corasick automaton finds every vocabulary token in a pre-token. The encoder takes the longest token at each
position and accepts it when the *pair-compatibility* test says that BPE would leave the boundary between it and the
token before it unmerged; else it tries the next shorter one, and with none left marks the position as dead and steps
back one token. A position is marked dead once at most, so the work is linear, and the result is exactly the merges'.
Decoding gathers the bytes of the tokens by an offset table (token i occupies ``blob[offset[i]:offset[i+1]]``).

The vocabulary file is a parameter, a public tokenizer of the *word* kind: NFC, white space dropped, lower case,
pre-token pattern, byte alphabet and a word-end suffix. Special strings in a text are single tokens, as in the
tokenizers library. Pre-tokens never cross white space, so ids are kept per white-space word in a bounded cache.

Edge cases: null counts as empty; an empty text has 0 tokens and decodes to an empty text; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from columnloom.llm.common import pieces, to_batch

#: Words kept by each Python worker; beyond it the cache starts anew.
CACHE_WORDS = 400_000
CACHE_PAIRS = 500_000
_FINAL = 0x10000
#: White space for Python's split() but not for the pattern's \s.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"


def byte_chars() -> list[str]:
    """The byte alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Words(dict):
    """word -> made(word), emptied when full."""

    def __init__(self, make, limit: int) -> None:
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


class OffsetTable:
    """Strings in one blob; string i is ``blob[offset[i]:offset[i + 1]]`` and ends in a space."""

    def __init__(self, strings: list[bytes]) -> None:
        self.offset = np.zeros(len(strings) + 1, np.int64)
        np.cumsum([len(s) for s in strings], out=self.offset[1:])
        self.blob = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The strings of ``ids`` one after the other, without the last space."""
        if not len(ids):
            return b""
        starts = self.offset[ids]
        sizes = self.offset[ids + 1] - starts
        ends = np.cumsum(sizes)
        index = np.repeat(starts - ends + sizes, sizes)
        index += np.arange(ends[-1])
        return self.blob[index].tobytes()[:-1]


class BacktrackingBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.chars = byte_chars()
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = specials
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")")

        # Ranks: single symbols first, then tokens in the order of their merges.
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        symbols = [c for c in self.chars] + [c + self.suffix for c in self.chars]
        rank = {s: i for i, s in enumerate(symbols)}
        self.parts = [(i, i) for i in range(len(symbols))]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            r = len(self.parts)
            whole = a + b if not a.endswith(self.suffix) or not self.suffix else a[: -len(self.suffix)] + b
            pair = (rank[a], rank[b])
            self.parts.append(pair)
            self.merged.setdefault(pair, r)
            rank.setdefault(whole, r)
        self.ids = [0] * len(self.parts)
        self.automaton, keys = ahocorasick.Automaton(), {}
        for token, r in rank.items():
            self.ids[r] = vocab[token]
            key = self._key(token)
            keys[key] = (len(key), r)
            self.automaton.add_word(key, keys[key])
        self.automaton.make_automaton()
        # For each token the next shorter token that is a prefix of it.
        self.shorter: list = [None] * len(self.parts)
        for key, (_, r) in keys.items():
            self.shorter[r] = next((keys[key[:k]] for k in range(len(key) - 1, 0, -1) if key[:k] in keys), None)
        self.compatible = _Words(self._compatible, CACHE_PAIRS)

        size = max([*vocab.values(), *specials.values()]) + 1
        strings = [b""] * size
        for token, i in [*vocab.items(), *specials.items()]:
            strings[i] = token.encode() + b" "
        self.strings = OffsetTable(strings)
        self.decimals = OffsetTable([b"%d " % i for i in range(size)])
        self.word_ids = _Words(lambda w: np.array(self.encode_word(w), "<i4").tobytes(), CACHE_WORDS)

    def _key(self, token: str) -> str:
        """The token over an alphabet where a symbol that ends a word is another letter."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _FINAL)
        return token

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether BPE leaves two tokens that stand side by side as they are.

        Undo their merges from the latest to the earliest; no pair met at the boundary may have a merge that BPE would
        have made before the one just undone.
        """
        left, right = pair
        before = 1 << 60
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < before:
                return False
            right_first, done = left <= right, 0
            for step in (right_first, not right_first):
                if step:
                    part = self.parts[right][0]
                    if part != right:
                        before, right = right + 1, part
                        break
                else:
                    part = self.parts[left][1]
                    if part != left:
                        before, left = left, part
                        break
                done += 1
            if done == 2:
                return True

    def encode_pretoken(self, token: str) -> list[int]:
        body = "".join([self.chars[b] for b in token.encode()])
        if self.suffix:
            body = body[:-1] + chr(ord(body[-1]) + _FINAL)
        n = len(body)
        longest: list = [None] * n
        for end, found in self.automaton.iter(body):
            longest[end + 1 - found[0]] = found  # ends rise, so the longest stays
        token = longest[0]
        if token[0] == n:
            return [self.ids[token[1]]]
        compatible, shorter = self.compatible, self.shorter
        dead: set[int] = set()
        out: list[tuple[int, int]] = []  # (length, rank)
        at, last = 0, -1
        while True:
            while token is not None:
                if (at + token[0] not in dead) and (last < 0 or compatible[last, token[1]]):
                    break
                token = shorter[token[1]]
            if token is not None:
                out.append(token)
                at += token[0]
                if at == n:
                    return [self.ids[r] for _, r in out]
                last, token = token[1], longest[at]
            else:
                dead.add(at)
                size, r = out.pop()
                at -= size
                last, token = out[-1][1] if out else -1, shorter[r]

    def encode_word(self, word: str) -> list[int]:
        if word.isalpha():  # one run of letters, as most words are
            return self.encode_pretoken(word)
        return [i for token in self.pattern.findall(word) for i in self.encode_pretoken(token)]

    def words(self, text: str) -> list[str]:
        """White-space words of one segment after normalisation."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # each letter alone, so no final sigma
        if any(c in text for c in _ODD_SPACE):
            return [w for w in regex.split(r"[^\S\x1c-\x1f]+", text) if w]
        return text.split()

    def encode(self, text: str) -> np.ndarray:
        raw: list[bytes] = []
        for k, part in enumerate(self.special_split.split(text) if "<|" in text else [text]):
            if k % 2:
                raw.append(np.array([self.specials[part]], "<i4").tobytes())
            elif part:
                raw.extend(map(self.word_ids.__getitem__, self.words(part)))
        return np.frombuffer(b"".join(raw), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the token strings joined by one space."""
        return self.strings.join(ids)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded string; with ``digests`` their SHA-256 digests in their place.

    A narrow map over the scan: no shuffle, one slice of a batch in memory. ``vocabulary`` must be readable on every
    executor, as an installed package is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in pieces(batches, "text"):
            n, first, second = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                decoded = bpe.decode(ids)
                n.append(len(ids))
                first.append(hashlib.sha256(bpe.decimals.join(ids)).hexdigest() if digests else ids.tolist())
                second.append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode())
            names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
            yield to_batch({"doc_id": batch.column(0), "n_tokens": n, names[0]: first, names[1]: second}, _DIGEST if digests else _SCHEMA)

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, schema)
