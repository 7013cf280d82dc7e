"""Clustering on similarities: affinity propagation, HDBSCAN, Jaccard sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from .columns import col


def affinity_propagation(s: DataFrame, damping: float = 0.5, rounds: int = 30, preference: float | None = None, every: int = 2, small: int = 1000) -> DataFrame:
    """(node, exemplar) from similarities (i, j, v), by message passing (Frey and Dueck, 2007) on the edges.

    Missing edges are taken as minus infinity; the diagonal is ``preference``, by default
    the median similarity of different nodes. Each round is two combining aggregates per edge
    set; every few rounds the messages are checkpointed. A node whose messages name no
    exemplar joins the most similar one, or itself. Up to ``small`` nodes the same
    messages are passed in numpy on the driver.
    """
    off = s.filter("i <> j").select("i", "j", F.col("v").cast("double").alias("s"))
    if preference is None:
        preference = off.agg(F.percentile_approx("s", 0.5, 10000)).first()[0] or 0.0
    nodes = s.select(F.col("i").alias("n")).unionByName(s.select(F.col("j").alias("n"))).distinct()
    diagonal = nodes.select(F.col("n").alias("i"), F.col("n").alias("j"), F.lit(float(preference)).alias("s"))
    e = off.unionByName(diagonal)
    tie = F.xxhash64("i", "j") / F.lit(float(1 << 63)) * F.lit(1e-9) * (F.abs("s") + 1e-3)
    e = checkpointed(e.withColumn("s", F.col("s") + tie).withColumn("r", F.lit(0.0)).withColumn("a", F.lit(0.0)))
    if nodes.limit(small + 1).count() <= small:
        return _propagate(e, damping, rounds)
    for k in range(rounds):
        sums = e.withColumn("t", F.col("a") + F.col("s"))
        top = sums.groupBy("i").agg(F.max(F.struct("t", "j")).alias("m"))
        second = sums.join(top, "i").filter(F.col("j") != F.col("m.j")).groupBy("i").agg(F.max("t").alias("m2"))
        joined = sums.join(top, "i").join(second, "i", "left")
        limit = F.when(F.col("j") == F.col("m.j"), F.coalesce("m2", F.lit(-1e308))).otherwise(F.col("m.t"))
        e = joined.select("i", "j", "s", "a", (damping * F.col("r") + (1 - damping) * F.greatest(F.col("s") - limit, F.lit(-1e300))).alias("r"))
        col_sum = e.groupBy("j").agg(F.sum(F.when(F.col("i") != F.col("j"), F.greatest("r", F.lit(0.0))).otherwise(0.0)).alias("p"), F.max(F.when(F.col("i") == F.col("j"), F.col("r"))).alias("rk"))
        own = F.when(F.col("i") == F.col("j"), F.col("p")).otherwise(F.least(F.lit(0.0), F.col("rk") + F.col("p") - F.greatest("r", F.lit(0.0))))
        e = e.join(col_sum, "j").select("i", "j", "s", "r", (damping * F.col("a") + (1 - damping) * own).alias("a"))
        if k % every == every - 1:
            e = checkpointed(e)
    e = checkpointed(e)
    exemplars = e.filter("i = j AND r + a > 0").select(F.col("i").alias("x"))
    best = e.join(exemplars, e["j"] == exemplars["x"]).filter("i <> j").groupBy("i").agg(F.max_by("j", F.struct("s", "j")).alias("near"))
    return nodes.join(exemplars, nodes["n"] == exemplars["x"], "left").join(best, nodes["n"] == best["i"], "left").select(F.col("n").alias("node"), F.coalesce("x", "near", "n").alias("exemplar"))


def _propagate(e: DataFrame, damping: float, rounds: int) -> DataFrame:
    """The rounds of :func:`affinity_propagation` on a dense matrix of few nodes."""
    pdf = e.select("i", "j", "s").toPandas()
    names = sorted(set(pdf["i"]) | set(pdf["j"]))
    at = {x: k for k, x in enumerate(names)}
    n = len(names)
    s = np.full((n, n), -1e300)
    s[pdf["i"].map(at).to_numpy(int), pdf["j"].map(at).to_numpy(int)] = pdf["s"]
    known, rows = s > -1e300, np.arange(n)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds if n > 1 else 0):
        t = np.where(known, a + s, -1e300)
        best = t.argmax(1)
        first = t[rows, best]
        t[rows, best] = -1e300
        limit = np.repeat(first[:, None], n, 1)
        limit[rows, best] = t.max(1)
        r = np.where(known, damping * r + (1 - damping) * np.maximum(s - limit, -1e300), 0.0)
        up = np.maximum(r, 0.0)
        np.fill_diagonal(up, 0.0)
        p, own = up.sum(0), r.diagonal()
        new = np.minimum(0.0, own + p - up)
        np.fill_diagonal(new, p)
        a = np.where(known, damping * a + (1 - damping) * new, 0.0)
    chosen = np.flatnonzero((r + a).diagonal() > 0)
    out = []
    for k in range(n):
        near = [x for x in chosen if x != k and known[k, x]]
        out.append((names[k], names[k] if k in chosen or not near else names[max(near, key=lambda x: (s[k, x], x))]))
    kind = e.schema["i"].dataType.simpleString()
    plain = [(x.item() if hasattr(x, "item") else x, y.item() if hasattr(y, "item") else y) for x, y in out]
    return e.sparkSession.createDataFrame(plain, f"node {kind}, exemplar {kind}")


def jaccard_similarities(df: DataFrame, id_col: str, items: str) -> DataFrame:
    """(i, j, v): 1 on the diagonal, else minus the Jaccard distance; disjoint pairs (-1) included, empty sets equal each other.

    Intersections come from an equi-join on items; the full set of pairs is the result.
    """
    from .matrix import in_blocks

    own = df.select(col(id_col).alias("id"), F.array_distinct(col(items)).alias("x"))
    long = own.select("id", F.explode("x").alias("item"))
    met = long.alias("p").join(long.alias("q"), "item").groupBy(F.col("p.id").alias("i"), F.col("q.id").alias("j")).agg(F.count("*").alias("n"))
    sized = own.select("id", F.size("x").alias("k"))
    pairs = in_blocks(sized, "id", None, lambda p: p.select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), (F.col("k_a") + F.col("k_b")).alias("both")))
    both = pairs.join(met, ["i", "j"], "left")
    share = F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("both") - F.coalesce("n", F.lit(0))), F.lit(1.0))
    return both.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(share - 1).alias("v"))


def cluster_sets(df: DataFrame, id_col: str, items: str, **options) -> DataFrame:
    """Affinity propagation over the Jaccard similarity of sets."""
    return affinity_propagation(jaccard_similarities(df, id_col, items), **options)


def hdbscan(d: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None, most: int = 5000) -> DataFrame:
    """(node, cluster, exemplar) from distances (i, j, v); cluster -1 is noise; the exemplar is a node id, the cluster's most central.

    A node counts among its own ``min_samples`` neighbours. Core distances and mutual
    reachability are joins; the spanning tree and the condensed
    tree run on the driver, hence at most ``most`` nodes.
    """
    k = min_samples or min_cluster_size
    edges = d.filter("i <> j").select("i", "j", F.col("v").cast("double").alias("v"))
    both = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).groupBy("i", "j").agg(F.min("v").alias("v"))
    core = both.groupBy("i").agg(F.element_at(F.slice(F.array_sort(F.collect_list("v")), 1, max(k - 1, 1)), -1).alias("core"))  # at most ``most`` values a node
    if core.count() > most:
        raise ValueError(f"over {most} nodes")
    reach = both.filter("i < j").join(core, "i").join(core.select(F.col("i").alias("j"), F.col("core").alias("core_j")), "j").select("i", "j", F.greatest("v", "core", "core_j").alias("w"), "v")
    pdf = reach.toPandas()
    names = sorted(set(pdf["i"]) | set(pdf["j"]))
    at = {n: x for x, n in enumerate(names)}
    labels = _condense(pdf.assign(i=pdf["i"].map(at), j=pdf["j"].map(at)).sort_values(["w", "i", "j"]), len(names), min_cluster_size)
    center: dict[int, int] = {}
    m = np.full((len(names), len(names)), 0.0)
    m[pdf["i"].map(at), pdf["j"].map(at)] = m[pdf["j"].map(at), pdf["i"].map(at)] = pdf["v"]
    for c in set(labels):
        own = np.flatnonzero(labels == c)
        center[c] = int(own[m[np.ix_(own, own)].sum(1).argmin()])
    rows = [(names[x], int(labels[x]), names[center[labels[x]]]) for x in range(len(names))]
    kind = d.schema["i"].dataType.simpleString()
    return d.sparkSession.createDataFrame(rows, f"node {kind}, cluster int, exemplar {kind}")


def _condense(edges: pd.DataFrame, n: int, least: int) -> np.ndarray:
    """Cluster labels from edges by ascending weight: single linkage, condensed by size, chosen by stability."""
    parent = list(range(2 * n))
    kids: dict[int, tuple[int, int, float]] = {}
    size = [1] * n + [0] * n
    new = n

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j, w in zip(edges["i"], edges["j"], edges["w"]):
        a, b = root(i), root(j)
        if a != b:
            kids[new] = (a, b, w)
            size[new] = size[a] + size[b]
            parent[a] = parent[b] = new
            new += 1
    labels = np.full(n, -1)

    def leaves(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += kids[y][:2]
        return out

    def visit(top: int, birth: float) -> tuple[float, list[list[int]]]:
        """(stability, chosen clusters) of the condensed cluster that starts at ``top``."""
        own, node, members = 0.0, top, leaves(top)
        while node >= n:
            a, b, w = kids[node]
            lam = 1 / max(w, 1e-12)
            big = [x for x in (a, b) if size[x] >= least]
            if len(big) == 2:
                own += size[node] * (lam - birth)
                below = [visit(x, lam) for x in big]
                if sum(s for s, _ in below) > own:
                    return sum(s for s, _ in below), [c for _, cs in below for c in cs]
                return own, [members]
            if not big:
                return own + size[node] * (lam - birth), [members]
            own += size[b if big[0] == a else a] * (lam - birth)
            node = big[0]
        return own, [members]

    for top in {root(x) for x in range(n)}:
        if size[top] < least:
            continue
        a, b, w = kids[top]
        chosen = visit(top, 0.0)[1]
        if len(chosen) == 1 and len(chosen[0]) == size[top] and size[top] == n:
            parts = [x for x in (a, b) if size[x] >= least]
            chosen = [c for x in parts for c in visit(x, 1 / max(w, 1e-12))[1]] if len(parts) == 2 else chosen
        for c in chosen:
            labels[c] = labels.max() + 1
    return labels


def partition_clusters(df: DataFrame, features: list[str], k: int, method: str = "kmeans", seed: int = 0) -> DataFrame:
    """Adds ``cluster`` by k-means, bisecting k-means or a Gaussian mixture."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    from pyspark.ml.feature import VectorAssembler

    kinds = {"kmeans": KMeans, "bisecting": BisectingKMeans, "gaussian": GaussianMixture}
    data = VectorAssembler(inputCols=features, outputCol="__v").transform(df)
    model = kinds[method](k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(data)
    return model.transform(data).select(*map(col, df.columns), "cluster")
