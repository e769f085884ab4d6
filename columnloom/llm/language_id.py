"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Each language has one model of character n-grams up to ``ORDER``. Text is lower-cased, each run of non-letters is one
space. Discounts are ``n1 / (n1 + 2 n2)`` per order; the highest order counts occurrences, lower ones the distinct
characters before an n-gram, and the last step interpolates with ``1 / ALPHABET``. For scoring, the n-grams of all
languages are merged into one sorted array of 64-bit hashes per order, with the log-probabilities of those languages that
have the n-gram; the others back off. A new n-gram costs two binary searches per order, however many languages there are;
a worker keeps a bounded table of those it has met, which cost one.

A document gets the language of the lowest cross-entropy per character. Its score is a softmax of the negative
cross-entropies at a temperature fitted on a calibration part of the sample. A document is *rejected* when it has no
letter (``und``) or when its cross-entropy exceeds what calibration texts of that language reached by ``REJECT_MARGIN``.

The classifier learns from a bounded sample: at most ``SAMPLE_DOCS`` documents and ``SAMPLE_TEXT`` characters per language
(of all languages ``SAMPLE_TOTAL``), in the order of a hash of the id, from those with a language that are not held out
and have at most ``SAMPLE_CHARS`` characters; where a language has only longer ones, from its shortest. Scoring is one
narrow map over whole texts with a broadcast model. Every language value is learned: the model is about 2 MB per language.

Edge cases: null, empty and letterless texts are ``und`` with score 0; without any learnable row all are; ties take the
first language by name; repeated rows repeat; other columns are ignored by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnloom.llm.common import held_out, pieces, small_side, to_batch

ORDER = 4
ALPHABET = 8192
SAMPLE_DOCS, SAMPLE_CHARS = 300, 30_000
#: Characters of a language's sample; with many languages they share ``SAMPLE_TOTAL``.
SAMPLE_TEXT, SAMPLE_TOTAL = 600_000, 40_000_000
#: N-grams scored at once, so that a long text and many languages need little memory.
ROWS = 20_000
#: What a worker keeps of the n-grams it has met.
MET_BYTES = 32_000_000
#: One document in so many of the sample calibrates instead of counting.
CALIBRATION = 5
#: Nats beyond the worst calibration text; a text of n characters has ``SHORT / sqrt(n)`` more.
REJECT_MARGIN, SHORT = 1.5, 8.0
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(len(table)) if chr(c).isalpha()]] = True
    return table


def codepoints(text: str) -> np.ndarray:
    """Lower-cased letters with one space for each run of anything else, and one at either end."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(raw) + 2, 32, np.uint64)
    letter = _letters()[raw]
    out[1:-1][letter] = raw[letter]
    space = out == 32
    keep = ~space
    keep[0] = True
    keep[1:] |= space[1:] & ~space[:-1]
    return out[keep]


_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(cp: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hashes of the k-grams that end at each position (the text's start is padded by spaces)."""
    padded = np.concatenate([np.full(order - 1, 32, np.uint64), cp])
    n, out = len(cp), []
    h = np.zeros(n, np.uint64)
    for k in range(order):
        start = order - 1 - k
        h = (h ^ (padded[start : start + n] + np.uint64(k * 0x200000))) * _STEP
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


class _Grams:
    """Distinct k-grams of a language: hash, count, and hashes of their suffix and context."""

    def __init__(self, hashes: list[np.ndarray], k: int) -> None:
        own, at = np.unique(hashes[k - 1][1:], return_index=True)
        at += 1
        self.hash, self.at = own, at
        self.suffix = hashes[k - 2][at] if k > 1 else np.zeros(len(own), np.uint64)
        self.context = hashes[k - 2][at - 1] if k > 1 else np.zeros(len(own), np.uint64)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a sorted array, and which are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class KneserNey:
    """One language's model: per order the sorted n-gram hashes with log-probabilities, and the contexts' weights."""

    def __init__(self, texts: list[np.ndarray], order: int = ORDER) -> None:
        hashes = gram_hashes(np.concatenate([*texts, np.full(1, 32, np.uint64)]), order)
        grams = [_Grams(hashes, k) for k in range(1, order + 1)]
        self.grams, self.log_p, self.contexts, self.log_back = grams, [], [], []
        lower = np.full(1, 1.0 / ALPHABET)
        for k in range(1, order + 1):
            g = grams[k - 1]
            if k == order:
                _, counts = np.unique(hashes[k - 1][1:], return_counts=True)
            else:
                counts = np.zeros(len(g.hash), np.int64)
                at, there = _find(g.hash, grams[k].suffix)
                np.add.at(counts, at[there], 1)
                counts = np.maximum(counts, 1)
            n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            contexts, which = np.unique(g.context, return_inverse=True)
            total = np.bincount(which, counts, len(contexts))
            back = discount * np.bincount(which, minlength=len(contexts)) / total
            if k > 1:
                at, _ = _find(grams[k - 2].hash, g.suffix)
                below = lower[at]
            else:
                below = lower[0]
            lower = np.maximum(counts - discount, 0) / total[which] + back[which] * below
            self.log_p.append(np.log(lower))
            self.contexts.append(contexts)
            self.log_back.append(np.log(back))


class _Sparse:
    """Values of (hash, language) pairs: sorted distinct hashes, and for each its languages' values in a row of its own length."""

    def __init__(self, hashes: list[np.ndarray], values: list[np.ndarray]) -> None:
        """``hashes`` and ``values`` of each language in turn."""
        key = np.concatenate(hashes)
        order = np.argsort(key, kind="stable")
        self.language = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])[order]
        self.value = np.concatenate(values).astype(np.float32)[order]
        self.hash, start = np.unique(key[order], return_index=True)
        self.start = np.append(start, len(key))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the keys, language, value) of all that is known of the keys."""
        at, there = _find(self.hash, keys)
        own = np.flatnonzero(there)
        first = self.start[at[own]]
        n = self.start[at[own] + 1] - first
        place = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        return np.repeat(own, n), self.language[place], self.value[place]


class LanguageModels:
    """All languages' n-grams merged for scoring: an entry for each n-gram and context of each language, none for absent ones."""

    def __init__(self, models: dict[str, KneserNey], order: int = ORDER) -> None:
        self.languages, self.order = sorted(models), order
        own = [models[x] for x in self.languages]
        self.log_p = [_Sparse([m.grams[k].hash for m in own], [m.log_p[k] for m in own]) for k in range(order)]
        self.log_back = [_Sparse([m.contexts[k] for m in own], [m.log_back[k] for m in own]) for k in range(order)]
        self.temperature, self.limit = 1.0, np.full(len(own), np.inf)
        self._forget()

    def _forget(self) -> None:
        """Empty the worker's table of n-grams met before: sorted hashes with their rows, and those not sorted in yet."""
        self.met, self.met_rows, self.fresh, self.n_fresh = np.zeros(0, np.uint64), np.zeros((0, len(self.languages)), np.float32), [], 0

    def _met(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """As :func:`_rows`, with the rows of n-grams met before looked up; the table holds ``MET_BYTES`` at most."""
        keys = hashes[-1][at]
        place, there = _find(self.met, keys)
        if there.all():
            return self.met_rows[place]
        out = np.empty((len(at), len(self.languages)), np.float32)
        out[there] = self.met_rows[place[there]]
        new = ~there
        out[new] = rows = self._rows(hashes, at[new], self.order)
        self.fresh.append((keys[new], rows))
        self.n_fresh += len(rows)
        if self.n_fresh >= max(4096, len(self.met) // 4):
            known = [(self.met, self.met_rows), *self.fresh]
            if (len(self.met) + self.n_fresh) * 4 * (2 + len(self.languages)) > MET_BYTES:
                known = known[1:]
            self._forget()
            self.met, first = np.unique(np.concatenate([k for k, _ in known]), return_index=True)
            self.met_rows = np.concatenate([r for _, r in known])[first]
        return out

    def _rows(self, hashes: list[np.ndarray], at: np.ndarray, order: int) -> np.ndarray:
        """Log-probabilities under each language of the n-grams that end at the given positions, from the lowest order up."""
        out = np.full((len(at), len(self.languages)), math.log(1 / ALPHABET), np.float32)
        for k in range(order):
            place, language, value = self.log_back[k].find(hashes[k - 1][at - 1] if k else np.zeros(len(at), np.uint64))
            out[place, language] += value
            place, language, value = self.log_p[k].find(hashes[k][at])
            out[place, language] = value
        return out

    def cross_entropy(self, cp: np.ndarray) -> np.ndarray:
        """Nats per character under each language."""
        hashes = gram_hashes(cp, self.order)
        _, at, counts = np.unique(hashes[-1][1:], return_index=True, return_counts=True)
        total = np.zeros(len(self.languages))
        for start in range(0, len(at), ROWS):
            total -= counts[start : start + ROWS] @ self._met(hashes, at[start : start + ROWS] + 1)
        return total / (len(cp) - 1)

    def calibrate(self, texts: list[np.ndarray], truth: list[str]) -> None:
        """Temperature by likelihood; per language the highest cross-entropy of its calibration texts."""
        entropy = [self.cross_entropy(t) for t in texts]
        for i, language in enumerate(self.languages):
            own = [e[i] - SHORT / math.sqrt(len(t)) for e, t, x in zip(entropy, texts, truth, strict=True) if x == language]
            if own:
                self.limit[i] = max(own) + REJECT_MARGIN
        best = np.inf
        for temperature in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
            loss = -sum(math.log(max(1e-9, self._softmax(e, temperature)[self.languages.index(x)])) for e, x in zip(entropy, truth, strict=True))
            if loss < best - 1e-9:
                best, self.temperature = loss, temperature

    @staticmethod
    def _softmax(entropy: np.ndarray, temperature: float) -> np.ndarray:
        p = np.exp(-temperature * (entropy - entropy.min()))
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, score, cross-entropy, rejected."""
        cp = codepoints(text or "")
        if len(cp) < 2:
            return UNDETERMINED, 0.0, None, True
        entropy = self.cross_entropy(cp)
        best = int(np.argmin(entropy))
        score = float(self._softmax(entropy, self.temperature)[best])
        return self.languages[best], score, float(entropy[best]), bool(entropy[best] - SHORT / math.sqrt(len(cp)) > self.limit[best])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModels | None:
    """Learn from a bounded sample; None if there is nothing to learn from."""
    size = F.length("text")
    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (size >= 1))
    totals = able.groupBy("lang").agg(F.sum((size <= SAMPLE_CHARS).cast("long")).alias("n"), F.min(size).alias("least")).collect()
    if not totals:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20))
    shares = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 1.5 * sample_docs / max(1, r.n)) * (1 << 20)) + 1, max(SAMPLE_CHARS, r.least)) for r in totals], "lang string, share long, longest long")
    drawn = able.join(small_side(shares, len(totals)), "lang").where((draw < F.col("share")) & (size <= F.col("longest"))).select(draw.alias("draw"), "doc_id", "lang", "text")
    # The limit only bounds what repeated rows of one id, or rows without one, could add to the sample.
    few = drawn.orderBy("draw", "doc_id", "text").limit(2 * sample_docs * len(totals))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    room = max(1, min(SAMPLE_TEXT, SAMPLE_TOTAL // len(totals)))
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = few.withColumn("before", before).withColumn("place", F.row_number().over(order)).where((F.col("before") < room) & (F.col("place") <= sample_docs)).collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.place):
        cp = codepoints(r.text)
        if len(cp) > 1:
            by.setdefault(r.lang, []).append(cp)
    if not by:
        return None
    models = LanguageModels({k: KneserNey([t for i, t in enumerate(v) if i % CALIBRATION or len(v) < CALIBRATION]) for k, v in by.items()})
    models.calibrate([t for v in by.values() for t in v[::CALIBRATION]], [k for k, v in by.items() for _ in v[::CALIBRATION]])
    models._forget()
    return models


_ADDED = [("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())]


def _predicted(texts, models: LanguageModels | None) -> dict[str, list]:
    found = [models.predict(t.as_py()) if models else (UNDETERMINED, 0.0, None, True) for t in texts]
    return {name: [f[i] for f in found] for i, (name, _) in enumerate(_ADDED)}


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every row."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_docs))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *_ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield to_batch({"doc_id": batch.column(0), "held_out": batch.column(1), **_predicted(batch.column(2), models.value)}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with all its columns, without the rows whose language is rejected."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not x for x in _predicted(texts, models.value)["rejected"]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
