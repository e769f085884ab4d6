"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words (a fixed seed list, and words and word beginnings learned by smoothed
log-odds), how near they stand to second-person words, capitals, punctuation and obfuscation (digits and signs inside
words, which are also looked up with the signs undone). Trees are boosted on the logistic loss over binned features.
The lexicon and the trees are cross-fitted, so calibration sees out-of-fold scores only.

The classifier learns from a bounded sample: about ``SAMPLE_DOCS`` labelled documents of at most ``SAMPLE_CHARS``
characters that are not held out, drawn by a hash of the id. Exact copies in the sample count once.
Scoring is one narrow map over whole texts; the broadcast model has at most ``LEXICON_SIZE`` entries.

Edge cases: null and empty texts have all features 0 and get that score; without labels, with one class only
or with fewer than eight labelled rows nothing can be learned and every score is 0; repeated rows repeat; a document labelled twice counts as toxic if any
label says so; other columns are ignored by ``toxicity`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.llm.common import held_out, pieces, to_batch

SAMPLE_DOCS, SAMPLE_CHARS = 4000, 30_000
#: An entry stands in so many toxic documents, in such a share of them, and so many times as often as in clean ones.
LEXICON_SIZE, MIN_DOCS, MIN_SHARE, MIN_RATIO = 3000, 3, 0.015, 12.0
PREFIXES = range(4, 8)
FOLDS, TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 4, 60, 3, 0.15, 32, 5, 2.0
THRESHOLD = 0.3
NEAR = 5
CACHE_WORDS = 400_000
#: Common insults, and words that address the reader.
SEEDS = "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown dumb fool jerk imbécile crétin débile ordure minable idiota estúpido imbécil basura dummkopf trottel abschaum".split()
SECOND_PERSON = "you your yours yourself ur u tu te toi ton vous votre vos tú ti usted ustedes vosotros du dich dir dein deine euch ihr sie".split()
#: Signs that stand for letters.
SIGNS = str.maketrans("013457@$!", "oieastasi")
_INNER = re.compile(r"[^\W\d_][\d*@$!#._-]+[^\W\d_]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[*range(65, 91)]] = 1
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_CLASSES[[ord("!"), ord("?")]] = 3
_CLASSES[[*range(48, 58)]] = 4
N_FEATURES = 15


def bare(word: str) -> str:
    """A lower-cased word without signs at its ends."""
    return word if word.isalpha() else _EDGE.sub("", word)


def keys(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its beginnings with ``*`` behind."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


class _Hits(dict):
    """word -> 0 (nothing) or (strength, is_seed, is_learned, second_person, obfuscated, bare word)."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.seeds, self.second = lexicon, set(SEEDS), set(SECOND_PERSON)

    def _look(self, word: str) -> tuple[float, bool]:
        strengths = [self.lexicon[k] for k in keys(word) if k in self.lexicon]
        return max(strengths, default=0.0), word in self.seeds

    def __missing__(self, token: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        word = bare(token)
        strength, seed = self._look(word)
        hidden = bool(not word.isalpha() and _INNER.search(word))
        undone = False
        if hidden and not strength and not seed:
            plain = re.sub(r"[\W_\d]", "", word.translate(SIGNS))
            strength, seed = self._look(plain)
            undone = bool(strength or seed)
        second = word in self.second
        value = self[token] = (strength, seed, strength > 0, second, 1 + undone if hidden else 0, word) if strength or seed or second or hidden else 0
        return value


def features(text: str | None, hits: _Hits) -> list[float]:
    if not text:
        return [0.0] * N_FEATURES
    words = text.lower().split()
    found = [(i, h) for i, h in enumerate(map(hits.__getitem__, words)) if h]
    n = len(words) or 1
    bad = [(i, h) for i, h in found if h[0] or h[1]]
    second = np.array([i for i, h in found if h[3]])
    near = 0
    if len(second) and bad:
        at = np.array([i for i, _ in bad])
        k = np.searchsorted(second, at)
        before, after = second[np.maximum(k - 1, 0)], second[np.minimum(k, len(second) - 1)]
        near = int((np.minimum(np.abs(at - before), np.abs(after - at)) <= NEAR).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASSES[raw], minlength=5) / len(raw)
    strengths = [h[0] for _, h in bad]
    return [
        float(np.log1p(len(bad))), float(len({h[5] for _, h in bad})), 100 * sum(h[1] for _, h in bad) / n, 100 * sum(h[2] for _, h in bad) / n, 100 * sum(strengths) / n,
        max(strengths, default=0.0), 100 * near / n, 100 * len(second) / n, kinds[1], kinds[2], kinds[3], kinds[4],
        100 * sum(h[4] > 0 for _, h in found) / n, float(sum(h[4] > 1 for _, h in found)), float(np.log1p(len(words))),
    ]


def learn_lexicon(documents: list[set[str]], labels: np.ndarray, seen: np.ndarray) -> dict[str, float]:
    """Words and beginnings that toxic documents have far more often; ``documents`` are sets of words."""
    rows = np.flatnonzero(seen)
    toxic, clean = int(labels[rows].sum()), int(len(rows) - labels[rows].sum())
    if not toxic or not clean:
        return {}
    counts: dict[str, int] = {}
    for i in rows[labels[rows] == 1]:
        for k in {k for w in documents[i] for k in keys(w)}:
            counts[k] = counts.get(k, 0) + 1
    counts = {k: c for k, c in counts.items() if c >= max(MIN_DOCS, MIN_SHARE * toxic)}
    against = dict.fromkeys(counts, 0)
    for i in rows[labels[rows] == 0]:
        for k in {k for w in documents[i] for k in keys(w) if k in against}:
            against[k] += 1
    odds = {k: (c / toxic) / ((against[k] + 0.5) / clean) for k, c in counts.items()}
    best = sorted((k for k, x in odds.items() if x >= MIN_RATIO), key=lambda k: (-counts[k] * np.log(odds[k]), k))
    return {k: float(np.log(odds[k])) for k in best[:LEXICON_SIZE]}


class BoostedTrees:
    """Logistic boosting of small binary trees over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        # The first edge parts zero from anything above it, however little.
        self.edges = [np.unique([1e-12, *np.quantile(c[c > 0] if (c > 0).any() else c, np.linspace(0, 1, BINS)[1:-1])]) for c in x.T]
        bins = self._bins(x)
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, y - p, p * (1 - p) + 1e-9, np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += RATE * self._walk(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if depth and len(rows) >= 2 * LEAF:
            for f in range(bins.shape[1]):
                b = bins[rows, f]
                cut = np.cumsum(np.stack([np.bincount(b, w, BINS + 1) for w in (g[rows], h[rows], np.ones(len(rows)))]), 1)[:, :-1]
                gain = cut[0] ** 2 / (cut[1] + RIDGE) + (gs - cut[0]) ** 2 / (hs - cut[1] + RIDGE) - gs**2 / (hs + RIDGE)
                gain[(cut[2] < LEAF) | (len(rows) - cut[2] < LEAF)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] < 0:
            return float(gs / (hs + RIDGE))
        _, f, k = best
        low = bins[rows, f] <= k
        return f, k, self._grow(bins, g, h, rows[low], depth - 1), self._grow(bins, g, h, rows[~low], depth - 1)

    def _walk(self, tree, bins: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(bins), tree)
        f, k, low, high = tree
        return np.where(bins[:, f] <= k, self._walk(low, bins), self._walk(high, bins))

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        return self.base + RATE * sum(self._walk(t, bins) for t in self.trees)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (places, rising values), for linear interpolation."""
    order = np.argsort(score, kind="stable")
    places, first = np.unique(score[order], return_index=True)
    weights = np.diff(np.append(first, len(score))).astype(float)
    blocks: list[list[float]] = []  # value, weight, number of places
    for v, w in zip(np.add.reduceat(y[order].astype(float), first) / weights, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return places, np.concatenate([np.full(int(n), v) for v, _, n in blocks])


class ToxicityModel:
    def __init__(self, texts: list[str], labels: list[int]) -> None:
        pairs = sorted(set(zip(texts, labels, strict=True)))  # copies count once
        texts = [t for t, _ in pairs]
        y = np.array([k for _, k in pairs], np.int64)
        self.trees = None
        self.lexicon: dict[str, float] = {}
        if len(y) < 2 * FOLDS or y.min() == y.max():
            return
        words = [{w for w in map(bare, set(t.lower().split())) if 2 < len(w) < 40} for t in texts]
        fold = np.array([_fold(t) for t in texts])
        x = np.zeros((len(y), N_FEATURES))
        for k in range(FOLDS):
            hits = _Hits(learn_lexicon(words, y, fold != k))
            for i in np.flatnonzero(fold == k):
                x[i] = features(texts[i], hits)
        out = np.zeros(len(y))
        for k in range(FOLDS):
            if (fold == k).any() and len(set(y[fold != k])) == 2:
                out[fold == k] = BoostedTrees(x[fold != k], y[fold != k]).raw(x[fold == k])
        self.places, self.values = isotonic(out, y)
        self.trees = BoostedTrees(x, y)
        self.lexicon = learn_lexicon(words, y, np.ones(len(y), bool))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        return np.clip(np.interp(self.trees.raw(x), self.places, self.values), 0, 1)


def _fold(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Learn from the labelled rows of a bounded sample; only their ids and labels are broadcast to find the texts."""
    able = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    total = able.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20))
    chosen = able.where(draw < int(min(1.0, sample_docs / max(1, total)) * (1 << 20)) + 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    # The limit only bounds what repeated rows of one id could add to the sample.
    drawn = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").orderBy(draw, "doc_id", "text").limit(2 * sample_docs)
    rows = sorted(drawn.collect(), key=lambda r: (r.doc_id, r.text))
    return ToxicityModel([r.text for r in rows], [r.toxic for r in rows])


def _hits(model: ToxicityModel) -> _Hits:
    """The worker's word cache for this model."""
    if not hasattr(model, "hits"):
        model.hits = _Hits(model.lexicon)
    return model.hits


def _scored(texts, model: ToxicityModel) -> np.ndarray:
    hits = _hits(model)
    return model.scores(np.array([features(t.as_py(), hits) for t in texts]).reshape(-1, N_FEATURES))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_docs))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores = _scored(batch.column(2), model.value)
            yield to_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with all its columns, without the rows predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array(_scored(batch.column(batch.schema.get_field_index("text")), model.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
