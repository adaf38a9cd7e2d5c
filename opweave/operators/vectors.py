"""TF-IDF, cosine neighbours, silhouettes, average linkage and ranking metrics."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def char_ngrams(c: Column, lo: int, hi: int) -> Column:
    """All character n-grams of lengths lo..hi, with repeats."""
    one = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[one(n) for n in range(lo, hi + 1)])


def tfidf(terms: DataFrame, doc: str, term: str, min_df: int = 2, max_df: float = 0.70) -> DataFrame:
    """(doc, term, weight): 1 + ln tf, smooth idf ln((1 + n) / (1 + df)) + 1, rows of unit length.

    ``terms``: one row per occurrence.  Documents left without terms have no row."""
    tf = terms.filter(F.col(term).isNotNull()).groupBy(doc, term).agg(F.count("*").alias("tf"))
    n = tf.agg(F.count_distinct(doc).alias("n_docs")).withColumn("__k", F.lit(1))
    df = tf.groupBy(F.col(term).alias("__t")).agg(F.count("*").alias("df")).withColumn("__k", F.lit(1))
    df = df.join(F.broadcast(n), "__k").filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs")))
    w = tf.join(df, F.col(term) == F.col("__t")).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(F.col(doc).alias("__d")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, F.col(doc) == F.col("__d")).select(doc, term, (F.col("w") / F.col("norm")).alias("weight"))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def cosine_knn(df: DataFrame, queries: DataFrame, key: str, vec: str, k: int, block: int = 2048) -> DataFrame:
    """(query, neighbour, similarity): the k most similar other rows of each query, ties to the lower key.

    Both sides are packed into blocks; a block of queries meets a block of rows as one matrix product,
    and only k candidates a query leave it.  Null vectors are left out; a zero vector is similar to none (0)."""
    pack = lambda x, p: x.filter(F.col(vec).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(_blocks(x, block))).alias(f"{p}b")).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vec).alias("v"))).alias(p))
    kind = df.schema[key].dataType.simpleString()

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, r in zip(b["q"], b["r"]):
                qk, rk = np.array([x["k"] for x in q]), np.array([x["k"] for x in r])
                order = np.argsort(rk, kind="stable")
                rk = rk[order]
                s = _unit(np.array([x["v"] for x in q], float)) @ _unit(np.array([r[i]["v"] for i in order], float)).T
                s = np.round(s, 6)
                s[qk[:, None] == rk[None, :]] = -2
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query": np.repeat(qk, best.shape[1]), "neighbour": rk[best].ravel(), "similarity": np.take_along_axis(s, best, 1).ravel()})

    pairs = pack(queries, "q").crossJoin(pack(df, "r")).select("q", "r")  # blocks of the stated query set against blocks of all rows
    got = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism).mapInPandas(top, f"query {kind}, neighbour {kind}, similarity double").filter("similarity > -2")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return got.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def _blocks(x: DataFrame, block: int) -> int:
    return max(1, -(-x.count() // block))


def unit_vectors(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """(key, label, u): vectors of unit length in double."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.filter(F.col(vec).isNotNull()).withColumn("__n", norm).filter("__n > 0").select(key, label, F.transform(vec, lambda x: x.cast("double") / F.col("__n")).alias("u"))


def class_sums(u: DataFrame, label: str) -> DataFrame:
    """(label, n, total): size and vector sum of each class."""
    x = u.select(label, F.posexplode("u").alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return x.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def silhouette(u: DataFrame, key: str, label: str, block: int = 1024) -> DataFrame:
    """(key, silhouette) by cosine distance, from class sums alone: the mean distance to a class is
    1 - u . sum / n, so no pair of rows is ever formed.  A class of one has silhouette 0.

    Rows and classes meet in packed blocks as one matrix product; neither side is broadcast."""
    s = class_sums(u, label)
    kind = u.schema[key].dataType.simpleString()
    pack = lambda x, p, cols: x.groupBy(F.pmod(F.xxhash64(cols[0]), F.lit(_blocks(x, block))).alias(f"{p}b")).agg(F.collect_list(F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(cols)])).alias(p))

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows, classes in zip(b["r"], b["c"]):
                m, t = np.array([x["f2"] for x in rows], float), np.array([x["f2"] for x in classes], float)
                n = np.array([x["f1"] for x in classes], float)
                dots = m @ t.T
                own = np.array([x["f1"] for x in rows], object)[:, None] == np.array([x["f0"] for x in classes], object)[None, :]
                d = 1 - dots / n
                inner = np.where(n > 1, 1 - (dots - 1) / np.maximum(n - 1, 1), np.nan)
                mine = np.where(own, inner, np.nan)
                a = np.where(own.any(1), np.nanmax(np.where(np.isnan(mine), -np.inf, mine), axis=1), np.nan)
                other = np.where(own, np.inf, d).min(1)
                yield pd.DataFrame({"k": [x["f0"] for x in rows], "a": np.where(np.isinf(a), np.nan, a), "b": np.where(np.isinf(other), np.nan, other)})

    pairs = pack(u, "r", [key, label, "u"]).crossJoin(pack(s, "c", [label, "n", "total"])).select("r", "c")  # blocks of rows against blocks of classes
    got = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism).mapInPandas(distances, f"k {kind}, a double, b double")
    x = got.groupBy(F.col("k").alias(key)).agg(F.max(F.nullif("a", F.lit(float("nan")))).alias("a"), F.min(F.nullif("b", F.lit(float("nan")))).alias("b"))
    return x.select(key, F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("silhouette"))


def average_linkage(dist: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of exact average linkage; new clusters are numbered from n on.

    Ties take the lowest pair.  O(n^2) memory: for up to a few thousand items."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = {i: 1 for i in range(n)}
    ids = list(range(n))
    merges = []
    for step in range(n - 1):
        flat = int(np.argmin(d))
        i, j = sorted(divmod(flat, len(d)))
        h = float(d[i, j])
        a, b = ids[i], ids[j]
        na, nb = size[a], size[b]
        row = (na * d[i] + nb * d[j]) / (na + nb)
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        ids[i] = n + step
        del ids[j]
        size[n + step] = na + nb
        merges.append((a, b, h, na + nb))
    return merges


class Profiles:
    """Vectors of counts for cosine linkage, each distinct direction once, in order of its first item.

    ``of`` gives the direction of each item, ``unit`` its unit vector, ``weight`` the number of its items.
    Items of one direction are at distance 0: average linkage merges them first, in any order.
    Mean distances come from vector sums, so memory is O(n t) for n directions of t terms; no matrix of pairs is held."""

    def __init__(self, counts: np.ndarray):
        m = counts.astype(np.int64)
        m = m // np.maximum(np.gcd.reduce(m, axis=1, initial=0), 1)[:, None]
        seen: dict[bytes, int] = {}
        self.of = np.array([seen.setdefault(r.tobytes(), len(seen)) for r in m], int)
        self.weight = np.bincount(self.of, minlength=len(seen)).astype(float)
        self.unit = _unit(m[np.unique(self.of, return_index=True)[1]].astype(float))

    def reordered(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight and unit vectors of the directions in the order in which they come when the items are in ``order``, and their numbers here."""
        at = self.of[order]
        first = at[np.sort(np.unique(at, return_index=True)[1])]
        return self.unit[first], self.weight[first], first


def cosine_linkage(unit: np.ndarray, weight: np.ndarray, block: int = 4_000_000) -> list[tuple[int, int, float, int]]:
    """``average_linkage`` by cosine distance of weighted unit vectors: the same merges, without the matrix of distances.

    The mean distance of two clusters is 1 - (sum a . sum b) / (|a| |b|).  Each row keeps its nearest later row; one whose
    nearest was merged keeps that distance as a bound (a merged cluster is no nearer than the nearer of its parts) and is looked
    up again when it comes first.  Distances that differ by rounding alone (12 digits) are equal, ties take the lowest pair."""
    n = len(unit)
    total, size, alive, ids = unit * weight[:, None], weight.astype(float).copy(), np.ones(n, bool), list(range(n))
    least, near, stale = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)

    def rows(a: np.ndarray, frm: int) -> np.ndarray:
        d = np.round(np.clip(1 - (total[a] @ total[frm:].T) / (size[a][:, None] * size[frm:]), 0, 2), 12)
        d[:, ~alive[frm:]] = np.inf
        return d

    def look(i: int, d: np.ndarray) -> None:
        stale[i], least[i] = False, np.inf
        if len(d):
            k = int(np.argmin(d))
            least[i], near[i] = d[k], i + 1 + k

    step = max(1, block // max(n, 1))
    for lo in range(0, n - 1, step):
        a = np.arange(lo, min(lo + step, n - 1))
        d = rows(a, lo)
        d[np.arange(n - lo)[None, :] <= (a - lo)[:, None]] = np.inf
        near[a] = lo + d.argmin(1)
        least[a] = d.min(1)
    merges = []
    for k in range(n - 1):
        i = int(np.argmin(least))
        while stale[i]:
            look(i, rows(np.array([i]), i + 1)[0])
            i = int(np.argmin(least))
        j, h = int(near[i]), float(least[i])
        merges.append((ids[i], ids[j], h, int(size[i] + size[j])))
        ids[i] = n + k
        total[i] += total[j]
        size[i] += size[j]
        alive[j], least[j], stale[j] = False, np.inf, False
        stale |= alive & np.isfinite(least) & ((near == j) | (near == i))
        d = rows(np.array([i]), 0)[0]
        look(i, d[i + 1 :])
        # rows before i may be as near to it as to a later one
        up = alive[:i] & ~stale[:i] & ((d[:i] < least[:i]) | (d[:i] == least[:i]) & (i < near[:i]))
        least[:i][up], near[:i][up] = d[:i][up], i
    return merges


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, threshold: float) -> np.ndarray:
    """Cluster number of each item, cutting merges above ``threshold``; numbered by first member."""
    up = list(range(n + len(merges)))
    for k, (a, b, h, _) in enumerate(merges):
        if h <= threshold:
            up[a] = up[b] = n + k

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(i), len(seen)) for i in range(n)])


def adjusted_rand(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Adjusted Rand index of two labelings; 1 for equal partitions.  Only pairs of labels that occur are held."""
    w = np.ones(len(a)) if weight is None else weight
    (_, a), (_, b) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    _, ab = np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)
    c2 = lambda x: (x * (x - 1) / 2).sum()
    tp, p, g, n = (c2(np.bincount(x, w)) for x in (ab, a, b, np.zeros(len(a), int)))
    e = p * g / n if n else 0.0
    return 1.0 if (p + g) / 2 == e else float((tp - e) / ((p + g) / 2 - e))


def tree_silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette from a distance matrix; 0 with fewer than two clusters."""
    k = labels.max() + 1
    if k < 2 or k >= len(labels):
        return 0.0
    onehot = np.eye(k)[labels]
    sums, counts = dist @ onehot, onehot.sum(0)
    own = counts[labels]
    a = np.where(own > 1, sums[np.arange(len(labels)), labels] / np.maximum(own - 1, 1), 0)
    other = sums / counts
    other[np.arange(len(labels)), labels] = np.inf
    b = other.min(1)
    return float(np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def sum_silhouette(unit: np.ndarray, weight: np.ndarray, labels: np.ndarray, block: int = 4_000_000) -> float:
    """``tree_silhouette`` by cosine distance of weighted unit vectors, from cluster sums in blocks of rows."""
    k = int(labels.max()) + 1
    if k < 2 or k >= weight.sum():
        return 0.0
    counts, sums = np.bincount(labels, weight), np.zeros((k, unit.shape[1]))
    np.add.at(sums, labels, unit * weight[:, None])
    total, step = 0.0, max(1, block // k)
    for lo in range(0, len(unit), step):
        lab, at = labels[lo : lo + step], np.arange(len(labels[lo : lo + step]))
        far = np.clip(1 - (unit[lo : lo + step] @ sums.T) / counts, 0, 2)
        own = counts[lab]
        a = far[at, lab] * own / np.maximum(own - 1, 1)
        far[at, lab] = np.inf
        b = far.min(1)
        total += float((weight[lo : lo + step] * np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0)).sum())
    return total / float(weight.sum())


_SWEEP = ["threshold", "k", "silhouette", "singleton_share", "stability", "score", "eligible"]


def threshold_sweep(dist: np.ndarray, thresholds: list[float], lo: int = 2, hi: int = 45, seed: int = 42) -> pd.DataFrame:
    """One linkage tree, cut many times: k, silhouette, singleton share, reorder stability and score of each threshold."""
    order = np.random.RandomState(seed).permutation(len(dist))
    trees = average_linkage(dist), average_linkage(dist[np.ix_(order, order)])
    return _sweep(trees, order, np.ones(len(dist)), lambda lab: tree_silhouette(dist, lab), thresholds, lo, hi)


def cosine_sweep(p: Profiles, thresholds: list[float], lo: int = 2, hi: int = 45, seed: int = 42) -> pd.DataFrame:
    """``threshold_sweep`` by cosine distance of any number of items; no items, no rows."""
    if not len(p.of):
        return pd.DataFrame(columns=_SWEEP)
    unit, weight, order = p.reordered(np.random.RandomState(seed).permutation(len(p.of)))
    trees = cosine_linkage(p.unit, p.weight), cosine_linkage(unit, weight)
    return _sweep(trees, order, p.weight, lambda lab: sum_silhouette(p.unit, p.weight, lab), thresholds, lo, hi)


def _sweep(trees, order: np.ndarray, weight: np.ndarray, silhouette: Callable[[np.ndarray], float], thresholds: list[float], lo: int, hi: int) -> pd.DataFrame:
    rows = []
    for t in thresholds:
        lab = cut_tree(trees[0], len(order), t)
        back = np.empty_like(lab)
        back[order] = cut_tree(trees[1], len(order), t)
        k = int(lab.max()) + 1
        single = float((np.bincount(lab, weight) == 1).sum() / k)
        sil, stab = silhouette(lab), adjusted_rand(lab, back, weight)
        rows.append((t, k, sil, single, stab, sil + 0.10 * stab - 0.20 * single, lo <= k <= hi))
    return pd.DataFrame(rows, columns=_SWEEP)


def ranking_metrics(df: DataFrame, score: str, label: str, bins: int | None = None) -> DataFrame:
    """(n, n_pos, roc_auc, average_precision) of a score: ties share their rank; average precision is the step sum.

    Counts by distinct score come first, so the running sums see distinct scores only."""
    s = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    w = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    t = Window.partitionBy()
    x = s.withColumn("tp", F.sum("p").over(w)).withColumn("seen", F.sum("n").over(w)).withColumn("all_p", F.sum("p").over(t)).withColumn("all_n", F.sum("n").over(t))
    area = F.sum((F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2))
    pos, rows = F.max("all_p"), F.max("all_n")
    ap = F.sum(F.col("p") / F.col("all_p") * F.col("tp") / F.col("seen"))
    return x.agg(rows.alias("n"), pos.alias("n_pos"), F.round(area / (pos * (rows - pos)), 6).alias("roc_auc"), F.round(ap, 6).alias("average_precision"))
