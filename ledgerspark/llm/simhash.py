"""Operator 3: SimHash near-duplicates by the generalised pigeonhole principle (Qin et al. 2018).

Fingerprints: 64 bits over the XXH64 hashes of 4-word shingles. The bits are grouped so that correlated ones
share a part, and the parts get unequal thresholds t_1 + ... + t_m = 4 - m + 1 by dynamic programming on
estimated candidate counts: two fingerprints within 4 bits agree within t_i bits on some part i, and a part
with threshold -1 is never probed. The number of parts is chosen by the same estimate. Candidates that meet
under a probe key are verified on all 64 bits.

Only different fingerprints are probed, and what a probe bucket returns are the links of a spanning forest of
its verified pairs, so neither copies nor a dense group are expanded into pairs. Buckets are compared in
blocks of BLOCK x BLOCK, a larger one as several tasks.

Null and empty texts and texts without words have fingerprint zero and link like any other. Repeated rows
each return a row; rows with a null ``doc_id`` link but do not name a component (the component is the least
``doc_id`` known, null when there is none). Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Shelf, apart, components, release, runs, slices, with_key

SHINGLE = 4
SEED = 42
DISTANCE = 4
BROADCAST_ROWS = 100_000
"""Rows of dropped documents up to which they are sent to all tasks; more are joined by a shuffle."""
BLOCK = 2048
"""Fingerprints that one side of a comparison holds."""


def fingerprint(text: bytes) -> int:
    """Bit b is set when over half of the shingles' hashes have it."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - SHINGLE + 1)
    stops = ends[SHINGLE - 1:] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:k].tolist(), stops.tolist(), strict=True)], ">u8")
    set_bits = np.zeros(64, np.int64)
    for i in range(0, k, 1 << 16):
        set_bits += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > k).tobytes(), "big")


def _fingerprints(batches):
    for whole in batches:
        for batch in slices(whole):
            prints = [fingerprint(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(prints, np.uint64).view(np.int64))],
                names=["doc_id", "_key", "fp"])
    release()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, fp): the 64-bit fingerprint as a signed long, ``_key`` being the hash of the text."""
    return with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(
        _fingerprints, "doc_id long, _key long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _moments(batches):
    """Per task: how many fingerprints, and how often bits a and b are set together (64 x 64)."""
    n, both = 0, np.zeros((64, 64))
    for batch in batches:
        bits = _bits(np.asarray(batch.column(0))).astype(np.float32)
        n += len(bits)
        both += bits.T @ bits
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(64 * 64)), pa.array(both.ravel()), pa.array(np.full(64 * 64, float(n)))], names=["at", "both", "n"])


def group_bits(n: float, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of nearly equal size; each group takes the bit most correlated with it next."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(spread, spread))
    left, groups = set(range(64)), []
    for g in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - g)
        own = [max(sorted(left), key=lambda b: sum(corr[b, c] for c in left if c != b))]
        left.discard(own[0])
        while len(own) < size:
            b = max(sorted(left), key=lambda b: corr[b, own].sum())
            own.append(b)
            left.discard(b)
        groups.append(sorted(own))
    return groups


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds >= -1, one per row of ``costs`` (column t + 1), that sum to ``total`` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for column, extra in enumerate(row):
                key = spent + column
                if key not in now or cost + extra < now[key][0]:
                    now[key] = (cost + extra, [*chosen, column - 1])
        best = now
    return best[total + len(costs)]


def _part_key(bits: list[int]):
    """The part's bits of ``fp`` side by side, as a column."""
    key = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 63 - b).bitwiseAND(F.lit(1)), i))
    return key


def plan_parts(prints: DataFrame) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed; reads statistics of bounded size only."""
    n, both = 0.0, np.zeros((64, 64))
    for at, b, k in prints.select("fp").mapInArrow(_moments, "at long, both double, n double").groupBy("at").agg(
            F.sum("both"), F.sum("n")).collect():
        both[at // 64, at % 64], n = b, k
    if not n:
        return []
    p = np.diag(both) / n
    differ = 2 * p * (1 - p)
    choices = []
    tried = {m: group_bits(n, both, m) for m in range(2, 6)}
    # Pairs that share a part's value: one pass over the fingerprints for all parts of all groupings.
    flat = [(m, i, bits) for m, groups in tried.items() for i, bits in enumerate(groups)]
    keyed = prints.select(F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), _part_key(bits).alias("key")) for j, (_, _, bits) in enumerate(flat)])).alias("s"))
    same = {r[0]: float(r[1]) for r in keyed.groupBy("s.j", "s.key").agg(F.count(F.lit(1)).alias("n")).groupBy("j").agg(
        F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).collect()}
    at = 0
    for m, groups in tried.items():
        costs = []
        for bits in groups:
            pairs, odds = same.get(at, 0.0), [differ[b] / max(1 - differ[b], 0.5) for b in bits]
            at += 1
            row, grown = [0.0], np.array([1.0])
            for o in odds:  # elementary symmetric sums: expected pairs at 1, 2, ... differing bits for each equal pair
                grown = np.convolve(grown, [1.0, o])[:DISTANCE + 1]
            for t in range(DISTANCE + 1):
                # A probe costs as much as comparing some fifty candidates: it is a shuffled row, one for each choice of t bits.
                row.append(pairs * grown[:t + 1].sum() + 50.0 * n * math.comb(len(bits), t) if t < 3 else float("inf"))
            costs.append(row)
        cost, thresholds = allocate(np.array(costs), DISTANCE - m + 1)
        choices.append((cost, m, [(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(choices)[2]


def probes(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): keys such that two fingerprints within a part's threshold share one.

    Threshold 0 has the part's value as its key. For 1 and 2 both sides drop bits: keys are the value with
    each choice of ``threshold`` bits masked out, which two values that differ in at most those bits share.
    A part's value is worked out once a row and the choices are one constant, so the plan, which the driver holds, does not grow with them.
    """
    values = F.array(*[F.struct(F.lit(i).alias("part"), _part_key(bits).alias("value")) for i, (bits, _) in enumerate(parts)])
    masks = [[sum(1 << b for b in masked) for masked in combinations(range(len(bits)), t)] for bits, t in parts]
    constant = F.expr(f"array({', '.join('array(' + ', '.join(f'{m}L' for m in own) + ')' for own in masks)})")
    valued = prints.select("fp", F.explode(values).alias("p")).select("fp", "p.*")
    return valued.select("fp", "part", "value", F.explode(F.element_at(constant, F.col("part") + 1)).alias("masked")).select(
        "fp", "part", "masked", F.col("value").bitwiseAND(F.bitwise_not("masked")).alias("key"))


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a spanning forest of the pairs within DISTANCE in one block pair."""
    fps = pdf["fp"].to_numpy()
    order = np.argsort(fps, kind="stable")
    fps, side = fps[order], pdf["side"].to_numpy()[order]
    lefts, rights = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    values = fps.view(np.uint64)
    for i in lefts.tolist():
        near = rights[np.bitwise_count(values[rights] ^ values[i]) <= DISTANCE]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append((fps[i], fps[j]))
    return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints that connect all that are within DISTANCE of one another."""
    parts = plan_parts(prints)
    if not parts:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    shelf = Shelf(prints.sparkSession)
    keys = ["part", "masked", "key"]
    probed = probes(prints, parts)
    crowd = shelf.put(probed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowd")
    meet = probed.join(crowd, keys)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    meet = meet.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # A bucket of b blocks is b (b + 1) / 2 comparisons; a row goes to the b that its block takes part in.
    task = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("own", o).alias("x"), F.greatest("own", o).alias("y"),
        F.when(F.col("own") == o, 0).when(F.col("own") < o, -1).otherwise(1).alias("side"))))
    dealt = meet.select(*keys, "fp", task.alias("t")).select(*keys, "fp", "t.*")
    # Small buckets travel in bundles: one Python call for many of them.
    bundle = F.pmod(F.xxhash64(*keys, "x", "y"), F.lit(1 << 30))
    return dealt.withColumn("h", bundle).repartition("h").sortWithinPartitions(*keys, "x", "y").select(
        *keys, "x", "y", "side", "fp").mapInPandas(_by_bucket, "a long, b long")


def _by_bucket(frames):
    for _, pdf in runs(frames, ["part", "masked", "key", "x", "y"]):
        yield _forest(pdf)
    release()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, fp, component, component_id): each document with the least ``doc_id`` that links of at most DISTANCE bits reach."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    marked = shelf.put(fingerprints(docs), "prints")
    different = shelf.put(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "different")
    found = shelf.put(links(different), "near")
    classes = components(spark, found)
    named = different.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = shelf.put(named.join(names, "component").select("fp", "component", "component_id"), "classes")
    return marked.join(ids, "fp").select("doc_id", "_key", "fp", "component", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the least ``doc_id`` (rows without one last), of repeated rows one."""
    shelf = Shelf(docs.sparkSession)
    docs, names = apart(docs)
    groups = shelf.put(near_duplicates(docs).groupBy("component", "doc_id", "_key").agg(F.count(F.lit(1)).alias("n")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "_key", "n")
    first = groups.groupBy("component").agg(F.min(order).alias("first")).select("component", "first.*")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_key"] == b["_key"])
    g, f = groups.alias("g"), first.alias("f")
    gone = g.join(f, (F.col("g.component") == F.col("f.component")) & same(groups, first), "left_anti").select(
        F.col("doc_id").alias("_d"), F.col("_key").alias("_k"))
    gone = shelf.put(gone, "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = with_key(docs).join(side, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left_anti")
    twice = first.where("n > 1").select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"))
    if twice.isEmpty():
        return kept.drop("_key").toDF(*names)
    met = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))
    return kept.join(twice, met, "left_anti").unionByName(
        kept.join(twice, met, "left_semi").dropDuplicates(["doc_id", "_key"])).drop("_key").toDF(*names)
