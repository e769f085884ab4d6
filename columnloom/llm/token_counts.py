"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

A pre-token is a white-space word behind the word mark. The best segmentation of a prefix doesn't depend on what
follows, so each trie node, one per distinct prefix, holds the best forward score of its prefix and the number of
pieces behind it, and is computed once for all words that share the prefix. The node where a word ends holds its count.

The vocabulary file is a parameter (a public piece vocabulary). Its pieces are ordered by use but carry ranks instead of
probabilities, so the model's log-probability of a piece is Zipf's: ``-log(rank + 1) - log(H)``. A character that no
piece covers costs one piece per UTF-8 byte at the lowest score. Ties take fewer pieces.

Edge cases: null or empty texts and texts of white space have 0 tokens; repeated rows repeat; an empty table gives an
empty result; other columns are ignored; a word of more than ``LONG_WORD`` characters is counted in lists that last for it
alone, so trie and cache hold at most ``TRIE_NODES`` and ``CACHE_WORDS`` short words' nodes and counts.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from columnloom.llm.common import pieces, to_batch

WORD_MARK = "▁"
#: Nodes of a worker's trie and words in its cache; beyond either both start anew.
TRIE_NODES, CACHE_WORDS = 1_000_000, 400_000
#: A longer word is counted without leaving its nodes in the trie.
LONG_WORD = 200


class UnigramTrie:
    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores))
        self.lowest = min(scores.values()) - 1.0
        self.counts: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}  # (node, next character) -> node
        self.best, self.pieces = [0.0], [0]
        self.counts.clear()

    def insert(self, word: str) -> int:
        """The word's number of pieces; new nodes are made only where no word before shares the prefix."""
        text = WORD_MARK + word
        if len(self.best) >= TRIE_NODES or len(self.counts) >= CACHE_WORDS:
            self._clear()
        child, best, pieces_, get, longest, lowest = self.child, self.best, self.pieces, self.scores.get, self.longest, self.lowest
        node, path, kept, before = 0, [0], len(text) <= LONG_WORD, len(best)
        for end, char in enumerate(text, 1):
            key = node << 21 | ord(char)
            following = child.get(key)
            if following is None:
                # Forward step: the best score and pieces of text[:end]; path[k] is the node of text[:k].
                own = get(char)
                size = 1 if own is not None else len(char.encode("utf-8", "surrogatepass"))
                score, count = best[node] + (own if own is not None else size * lowest), pieces_[node] + size
                for start in range(end - longest if end > longest else 0, end - 1):
                    own = get(text[start:end])
                    if own is not None:
                        s = best[path[start]] + own
                        if s > score or s == score and pieces_[path[start]] + 1 < count:
                            score, count = s, pieces_[path[start]] + 1
                following = len(best)
                best.append(score)
                pieces_.append(count)
                if kept:
                    child[key] = following
            node = following
            path.append(node)
        found = pieces_[node]
        if not kept:
            del best[before:], pieces_[before:]
        return found

    def count(self, word: str) -> int:
        n = self.counts.get(word)
        if n is None:
            n = self.insert(word)
            if len(word) <= LONG_WORD:
                self.counts[word] = n
        return n


@functools.lru_cache(maxsize=2)
def model(path: str) -> UnigramTrie:
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [vocabulary.id_to_piece(i) for i in range(vocabulary.get_piece_size()) if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i))]
    norm = math.log(sum(1 / (k + 1) for k in range(len(names))))
    return UnigramTrie({name: -math.log(k + 1) - norm for k, name in enumerate(names)})


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text, in one narrow map over the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = model(vocabulary)
        for batch in pieces(batches, "text"):
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").split()
                words.append(len(found))
                try:
                    tokens.append(sum(map(trie.counts.__getitem__, found)))
                except KeyError:
                    tokens.append(sum(map(trie.count, found)))
            yield to_batch({"doc_id": batch.column(0), "n_pretokens": words, "n_tokens": tokens}, _SCHEMA)

    return docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
