"""Domains: average-linkage clustering of sources at the threshold with the best silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.operators.vectors import unit_rows

#: One matrix on one task holds the distances, so the number of sources has a limit; beyond it the call fails.
MAX_SOURCES = 4096
SWEEP = (0.05, 0.80, 0.05)


def threshold_sweep(start: float = SWEEP[0], stop: float = SWEEP[1], step: float = SWEEP[2]) -> list[float]:
    """Thresholds from ``start`` up to, not including, ``stop``."""
    n = int(np.ceil((stop - start) / step - 1e-9))
    return [round(start + k * step, 10) for k in range(n)]


def average_linkage(distances: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (i, j, height) with i < j, cluster i absorbing j; of equal heights the smallest pair first."""
    d = distances.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size, merges = np.ones(len(d)), []
    for _ in range(len(d) - 1):
        i, j = divmod(int(np.argmin(d)), len(d))
        i, j = min(i, j), max(i, j)
        merges.append((i, j, float(d[i, j])))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = d[j] = d[:, j] = np.inf
        size[i] += size[j]
    return merges


def cut(n: int, merges: list[tuple[int, int, float]], threshold: float) -> np.ndarray:
    """Cluster numbers after all merges below the threshold, in the order of the smallest members."""
    owner = np.arange(n)
    for i, j, height in merges:
        if height < threshold:
            owner[owner == j] = i
    return np.unique(owner, return_inverse=True)[1]


def silhouette_of(distances: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b); a point alone in its cluster counts 0."""
    kinds, sizes = np.unique(labels, return_counts=True)
    sums = np.stack([distances[:, labels == k].sum(1) for k in kinds], 1)
    own = np.searchsorted(kinds, labels)
    at = np.arange(len(labels))
    a = sums[at, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[at, own] = np.inf
    b = means.min(1)
    most = np.maximum(a, b)
    s = np.where((sizes[own] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0.0)
    return float(s.mean())


def admissible(labels: np.ndarray) -> bool:
    """At least two clusters, fewer than points, none of a single point."""
    sizes = np.bincount(labels)
    return 2 <= len(sizes) < len(labels) and sizes.min() >= 2


def source_cuts(sources: DataFrame, thresholds: list[float], universe: str = "universe") -> DataFrame:
    """universe, threshold, source_id, cluster, k, silhouette for every admissible cut.

    ``sources``: universe, source_id, vector. One task per universe; empty when no cut is admissible.
    """

    def cuts(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("source_id").reset_index(drop=True)
        if len(part) > MAX_SOURCES:
            raise ValueError(f"{len(part)} sources; at most {MAX_SOURCES} can be clustered at once")
        unit = unit_rows(part["vector"].tolist())
        d = np.clip(1 - unit @ unit.T, 0, 2)
        np.fill_diagonal(d, 0)
        merges, out = average_linkage(d), []
        for t in thresholds:
            labels = cut(len(part), merges, t)
            if admissible(labels):
                out.append(pd.DataFrame({universe: part[universe], "threshold": t, "source_id": part["source_id"], "cluster": labels, "k": int(labels.max()) + 1, "silhouette": silhouette_of(d, labels)}))
        names = [universe, "threshold", "source_id", "cluster", "k", "silhouette"]
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    schema = f"{universe} string, threshold double, source_id string, cluster int, k int, silhouette double"
    return sources.select(universe, "source_id", "vector").groupBy(universe).applyInPandas(cuts, schema)


def best_cut(cuts: DataFrame, by: str = "universe", digits: int | None = None) -> DataFrame:
    """by, threshold, silhouette: the highest silhouette; of equals the lowest threshold."""
    score = F.round("silhouette", digits) if digits is not None else F.col("silhouette")
    best = F.max(F.struct(score.alias("silhouette"), (-F.col("threshold")).alias("low")))
    return cuts.groupBy(by).agg(best.alias("best")).select(by, (-F.col("best.low")).alias("threshold"), F.col("best.silhouette").alias("silhouette"))


def domains(sources: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """domain_id, source_id of the best admissible cut; empty where no cut is admissible."""
    cuts = source_cuts(sources, thresholds or threshold_sweep())
    chosen = cuts.join(best_cut(cuts).select("universe", "threshold"), ["universe", "threshold"])
    return chosen.select("universe", F.concat(F.lit("domain_"), F.col("cluster").cast("string")).alias("domain_id"), "source_id")


def cluster_members(assigned: DataFrame, key: str = "domain_id", member: str = "source_id") -> DataFrame:
    return assigned.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))


def cluster_sizes(labels: DataFrame, cut_key: str, cluster: str) -> DataFrame:
    """cut_key, k, n, least, admissible from rows (cut_key, cluster), one per point."""
    sizes = labels.groupBy(cut_key, cluster).agg(F.count(F.lit(1)).alias("size"))
    found = sizes.groupBy(cut_key).agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("n"), F.min("size").alias("least"))
    return found.withColumn("admissible", (F.col("k") >= 2) & (F.col("k") < F.col("n")) & (F.col("least") >= 2))


def silhouette(points: DataFrame, cluster: str, vector: str, max_clusters: int = 20_000) -> DataFrame:
    """One row: n, k, silhouette under cosine distance, in two linear passes.

    The mean cosine distance from a point to a cluster is ``1 - u . m`` with m the mean of the cluster's unit vectors, so
    no pair is formed: only the clusters' means are gathered, and their number is checked.
    """
    spark = points.sparkSession
    rows = points.select(F.col(cluster).cast("string").alias("cluster"), F.col(vector).alias("vector")).where("cluster IS NOT NULL AND vector IS NOT NULL")

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            unit = unit_rows(part["vector"].tolist()) if len(part) else np.zeros((0, 0))
            for name, at in part.groupby("cluster").indices.items():
                yield pd.DataFrame({"cluster": name, "n": len(at), "place": range(unit.shape[1]), "total": unit[at].sum(0)})

    per = rows.mapInPandas(sums, "cluster string, n long, place int, total double").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    k = rows.select("cluster").distinct().count()
    if k > max_clusters:
        raise ValueError(f"{k} clusters; at most {max_clusters} means are shared")
    means: dict[str, tuple] = {}
    for r in per.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "total"))).alias("v")).collect():
        means[r.cluster] = (r.n, np.array([x.total for x in r.v]))
    names = sorted(means)
    count = np.array([means[x][0] for x in names], float)
    centre = spark.sparkContext.broadcast(np.stack([means[x][1] / means[x][0] for x in names]) if names else np.zeros((0, 0)))

    def scores(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            far = 1 - unit_rows(part["vector"].tolist()) @ centre.value.T
            own, at = np.searchsorted(names, part["cluster"].to_numpy()), np.arange(len(part))
            a = far[at, own] * count[own] / np.maximum(count[own] - 1, 1)
            far[at, own] = np.inf
            b = far.min(1)
            most = np.maximum(a, b)
            s = np.where((count[own] > 1) & (most > 0) & np.isfinite(b), (b - a) / np.where(most > 0, most, 1), 0.0)
            yield pd.DataFrame({"s": s})

    return rows.mapInPandas(scores, "s double").agg(F.count(F.lit(1)).alias("n"), F.lit(len(names)).cast("long").alias("k"), F.avg("s").alias("silhouette"))
