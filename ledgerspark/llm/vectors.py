"""Operator 5: embedding near-duplicates by a forest of random-projection trees.

TREES trees split the vectors by random directions at the median; vectors close to a split (SPILL of the node to either
side) go both ways, so that a near pair seldom parts in all trees. The trees are fitted on at most SAMPLE different
vectors, then every vector is sent to its leaves, each leaf compares all its vectors in double precision, and links join by
union. A pair that meets in several leaves is counted in the first of them only, which both vectors' leaf lists tell without
collecting pairs. A leaf of more than BLOCK vectors is compared in blocks, each pair of blocks a task's run.

Vectors that are equal component by component are one class: classes are compared, sizes counted in. Null or zero vectors and
those with null or non-finite components link with nothing, and vectors of different length do not link. Rows that repeat, or
lack a ``vec_id``, count as vectors; a row without ``vec_id`` names no component and is not ``kept``. Only ``vec_id`` and
``embedding`` are read. An empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Shelf, components, runs

COSINE = 0.95
TREES = 8
SAMPLE = 20_000
"""Different vectors that the trees are fitted on."""
LEAF = 1024
"""Vectors that a leaf is meant to hold."""
SPILL = 0.06
BLOCK = 4096
"""Vectors of one side of a comparison."""


def fit_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> list:
    """Nodes (direction, low, high, left, right): left takes projections up to ``high``, right those from ``low``; None is a leaf."""
    nodes: list = []

    def grow(rows: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(rows) <= leaf:
            return at
        for _ in range(3):
            direction = rng.normal(size=x.shape[1]).astype(np.float32)
            place = x[rows] @ direction
            low, high = np.quantile(place, [0.5 - SPILL, 0.5 + SPILL])
            left, right = rows[place <= high], rows[place >= low]
            if max(len(left), len(right)) < 0.8 * len(rows):  # else a dense group that this direction does not part
                nodes[at] = (direction, float(low), float(high), grow(left), grow(right))
                break
        return at

    grow(np.arange(len(x)))
    return nodes


def fit_forest(x: np.ndarray, leaf: int, seed: int = 11) -> list[list]:
    rng = np.random.default_rng(seed)
    return [fit_tree(x, leaf, rng) for _ in range(TREES)]


def leaves_of(forest: list[list], x: np.ndarray) -> list[list[int]]:
    """The leaves of each vector in ascending order; leaf numbers rise from tree to tree."""
    out: list[list[int]] = [[] for _ in range(len(x))]
    base = 0
    for nodes in forest:
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            at, rows = waiting.pop()
            if not len(rows):
                continue
            if nodes[at] is None:
                for i in rows.tolist():
                    out[i].append(base + at)
                continue
            direction, low, high, left, right = nodes[at]
            place = x[rows] @ direction
            waiting += [(left, rows[place <= high]), (right, rows[place >= low])]
        base += len(nodes)
    return [sorted(a) for a in out]


def unit(vectors, width: int | None = None) -> np.ndarray:
    """Rows of length one in double precision."""
    x = np.array([np.asarray(v, np.float64) for v in vectors]) if width is None else np.zeros((len(vectors), width))
    if width is not None:
        for i, v in enumerate(vectors):
            n = min(width, len(v))
            x[i, :n] = v[:n]
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale == 0, 1, scale)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The usable rows (vec_id, embedding) and the other ones (vec_id)."""
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    return rows.where(usable), rows.where(~usable).select("vec_id")


def _compare(forest_leaf: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """For one leaf (or two of its blocks): rows (a, b, n), links of a spanning forest, and with b null what a's links add up to."""
    pdf = pdf.reset_index(drop=True)
    x = unit(pdf["embedding"])
    ids, weight, side = pdf["cid"].to_numpy(), pdf["size"].to_numpy(), pdf["side"].to_numpy()
    lefts, rights = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    most = max(map(len, pdf["leaves"]), default=1)
    lists = np.full((len(pdf), most), -1, np.int64)
    for i, a in enumerate(pdf["leaves"]):
        lists[i, :len(a)] = a
    counts = np.zeros(len(pdf), np.int64)
    root = np.arange(len(pdf))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tied = []
    for begin in range(0, len(lefts), 512):
        own = lefts[begin:begin + 512]
        i, j = np.nonzero(x[own] @ x[rights].T >= COSINE)
        i, j = own[i], rights[j]
        pairs = (i < j) if side.min() == side.max() else np.ones(len(i), bool)
        i, j = i[pairs], j[pairs]
        for k in range(0, len(i), 20_000):
            a, b = i[k:k + 20_000], j[k:k + 20_000]
            common = (lists[a][:, :, None] == lists[b][:, None, :]).any(axis=2) & (lists[a] >= 0)
            mine = np.where(common, lists[a], np.iinfo(np.int64).max).min(axis=1) == forest_leaf
            np.add.at(counts, a[mine], weight[b[mine]])
            np.add.at(counts, b[mine], weight[a[mine]])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            s, t = find(a), find(b)
            if s != t:
                root[max(s, t)] = min(s, t)
                tied.append((ids[a], ids[b], 0))
    told = [(c, None, n) for c, n in zip(ids.tolist(), counts.tolist(), strict=True) if n]
    return pd.DataFrame({"a": pd.Series([r[0] for r in tied + told], dtype="int64"),
                         "b": pd.Series([r[1] for r in tied + told], dtype="Int64"),
                         "n": pd.Series([r[2] for r in tied + told], dtype="int64")})


def link(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    shelf = Shelf(spark)
    usable, other = classes_of(vectors)
    grouped = usable.groupBy("embedding").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first"))
    classes = shelf.put(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    lonely = other.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return _kept(lonely)
    leaf = max(8, LEAF * min(n, SAMPLE) // n)

    def fit(frames):
        rows = [v for pdf in frames for v in pdf["embedding"]]
        width = max(map(len, rows))
        yield pd.DataFrame({"forest": [pickle.dumps((width, fit_forest(unit(rows, width).astype(np.float32), leaf)))]})

    sample = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE)
    forest = spark.sparkContext.broadcast(pickle.loads(bytes(
        sample.coalesce(1).mapInPandas(fit, "forest binary").first()[0])))  # bounded by SAMPLE / leaf nodes a tree

    def route(frames):
        width, trees = forest.value
        for pdf in frames:
            found = leaves_of(trees, unit(pdf["embedding"], width).astype(np.float32)) if len(pdf) else []
            yield pdf.assign(leaves=found)

    routed = shelf.put(classes.drop("first").mapInPandas(
        route, "embedding array<double>, size long, cid long, leaves array<long>"), "routed")
    members = routed.select("*", F.size("embedding").alias("width"), F.explode("leaves").alias("leaf"))
    sizes = members.groupBy("width", "leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    task = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("own", o).alias("x"), F.greatest("own", o).alias("y"),
        F.when(F.col("own") == o, 0).when(F.col("own") < o, -1).otherwise(1).alias("side"))))
    dealt = members.join(sizes.drop("n"), ["width", "leaf"]).withColumn("own", own).select(
        "width", "leaf", "cid", "size", "embedding", "leaves", task.alias("t")).select("*", "t.*").drop("t")
    keys = ["width", "leaf", "x", "y"]

    def compare(frames):
        for key, pdf in runs(frames, keys):
            yield _compare(int(key[1]), pdf)

    met = shelf.put(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long, n long"), "met")
    counts = met.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    named = components(spark, met.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cid")
    found = classes.join(named, "cid", "left").join(counts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = found.groupBy("component").agg(F.min("first").alias("component_id"))
    told = shelf.put(found.join(names, "component").select(
        "embedding", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"), "told")
    return _kept(usable.join(told, "embedding").select("vec_id", "n_links", "component_id").unionByName(lonely))


def _kept(df: DataFrame) -> DataFrame:
    return df.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
