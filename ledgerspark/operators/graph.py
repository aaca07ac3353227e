"""Walks over the address graph, for any number of seeds at once.

Reachability passes a transaction with many inputs and outputs as address -> transaction
-> address, which costs the sum of both sides and not their product. Only the operators
whose result *is* the pairs (edges, path counts) build all address pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.rank import top_per
from ledgerspark.operators.sweep import BITS, Sweep, expanded, folded, listed, number_seeds, sweep
from ledgerspark.session import discard, materialize

SPREAD_ROWS = 8192
"""Labelled addresses of an entity that one task sums."""
PIECE_ADDRESSES = 8192
"""Addresses whose path counts, for all seeds of a block, one task holds, about."""


def spenders(inputs: DataFrame) -> DataFrame:
    return inputs.where(F.col("address").isNotNull()).select("address", "txid")


def receivers(outputs: DataFrame) -> DataFrame:
    return outputs.where(F.col("address").isNotNull()).select("txid", "address")


def address_edges(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """G1: distinct (src, dst) address pairs of the transactions, without self loops."""
    src = spenders(inputs).distinct().withColumnRenamed("address", "src")
    dst = receivers(outputs).distinct().withColumnRenamed("address", "dst")
    return src.join(dst, "txid").where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def address_tx_projection(inputs: DataFrame) -> DataFrame:
    """Distinct (address)-[spent in]->(transaction)."""
    return spenders(inputs).distinct()


def reach(seeds: DataFrame, inputs: DataFrame, outputs: DataFrame, max_hops: int = 3) -> Sweep:
    """G3 as levels of bits, for callers that look at them before they become rows."""
    return sweep(seeds, spenders(inputs), receivers(outputs), max_hops)


def reachable(seeds: DataFrame, inputs: DataFrame, outputs: DataFrame, max_hops: int = 3) -> DataFrame:
    """(seed, address, min_hop), breadth first; the seed itself has hop 0."""
    found = reach(seeds, inputs, outputs, max_hops)
    return reduce(DataFrame.unionByName, [
        expanded(level, found.seeds, "address").select("seed", "address", F.lit(hop).alias("min_hop"))
        for hop, level in enumerate(found.levels)])


def bounded_walk(seeds: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """Every simple path of at most ``max_hops`` edges: (seed, address, hop, path)."""
    first = seeds.select("seed").distinct().select(
        "seed", F.col("seed").alias("address"), F.lit(0).alias("hop"), F.array("seed").alias("path"))
    levels = [materialize(first, "walk")]
    for hop in range(1, max_hops + 1):
        levels.append(materialize(_extend(levels[-1], edges, hop), "walk"))
    return reduce(DataFrame.unionByName, levels)


def _extend(paths: DataFrame, edges: DataFrame, hop: int) -> DataFrame:
    return (
        paths.join(edges, F.col("address") == F.col("src"))
        .where(~F.array_contains("path", F.col("dst")))
        .select("seed", F.col("dst").alias("address"), F.lit(hop).alias("hop"),
                F.array_append("path", F.col("dst")).alias("path"))
    )


def k_hop_exposure(
    seeds: DataFrame, inputs: DataFrame, outputs: DataFrame, max_hops: int = 3, limit: int | None = None,
) -> DataFrame:
    """Per seed the nearest addresses with the number of simple paths to them; ``limit`` keeps the first of each seed.

    Up to three hops no path is listed: walks are counted by joining counts with edges, and those that come back are taken away. A
    walk of two edges comes back at the seed only. One of three edges that avoids the seed comes back at its first address c,
    as often as c has partners with edges both ways, the seed aside. Such an address is one hop away, so its distance is known. Addresses are
    numbers in their order meanwhile.
    """
    if max_hops > 3:
        return _listed_exposure(seeds, inputs, outputs, max_hops, limit)
    pairs = materialize(address_edges(inputs, outputs), "pairs")
    wanted = seeds.select(F.col("seed").alias("address")).where("address IS NOT NULL").distinct()
    names = pairs.select(F.col("src").alias("address")).union(pairs.select("dst")).union(wanted).distinct()
    # Sorted and written, so that numbers follow the order of the addresses and stay as they are.
    names = materialize(names.orderBy("address").withColumn("id", F.monotonically_increasing_id()), "names")
    number = lambda df, column, out: df.join(names.select(F.col("address").alias(column), F.col("id").alias(out)), column)
    edges = materialize(number(number(pairs, "src", "a"), "dst", "b").select("a", "b"), "edges")
    discard(pairs)
    start = number(wanted.withColumnRenamed("address", "seed"), "seed", "s").select("s")
    counted = lambda rows: rows.where("s <> c").groupBy("s", "c").agg(F.sum("paths").alias("paths"))
    step = lambda rows: rows.join(edges, F.col("c") == F.col("a")).select("s", F.col("b").alias("c"), "paths")
    one = F.lit(1).cast("bigint")
    first = materialize(start.join(edges, F.col("s") == F.col("a")).select("s", F.col("b").alias("c"), one.alias("paths")), "one-hop")
    parts = [first.withColumn("hop", F.lit(1))]
    if max_hops > 1:
        second = materialize(counted(step(first)), "two-hops")
        parts.append(second.withColumn("hop", F.lit(2)))
    if max_hops > 2:
        mutual = edges.join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
        partners = mutual.groupBy(F.col("a").alias("c")).agg(F.count(F.lit(1)).alias("n"))
        own = mutual.select(F.col("a").alias("c"), F.col("b").alias("s"), one.alias("own"))
        returns = first.join(partners, "c").join(own, ["s", "c"], "left").select(
            "s", "c", (F.coalesce("own", F.lit(0)) - F.col("n")).alias("paths"), F.lit(3).alias("hop"))
        parts.append(returns)
    exposure = reduce(DataFrame.unionByName, parts).groupBy("s", "c").agg(F.min("hop").alias("min_hop"), F.sum("paths").alias("path_count"))
    if max_hops > 2:
        paid = listed(edges.select(F.col("a").alias("x"), F.col("b").alias("y")), "pays")
        blocks = number_seeds(wanted.withColumnRenamed("address", "seed"), names, paid, max_hops)
        blocks = materialize(number(blocks, "seed", "s").select("s", "block", F.col("bit").cast("long").alias("bit")), "blocks")
        exposure = last_hop(materialize(exposure, "nearer"), second, edges, blocks, max_hops, limit)
    ranked = top_per(exposure, ["s"], [F.col("min_hop"), F.col("path_count").desc(), F.col("c")], limit)
    return ranked.join(names.select(F.col("id").alias("s"), F.col("address").alias("seed")), "s").join(
        names.select(F.col("id").alias("c"), "address"), "c").select("seed", "address", "min_hop", "path_count", "rank")


def _add_walks(hop: int):
    """Counts of a piece, rows sorted by kind and address: what is known of (bit, address), then per address its walks and whom it pays.

    Rows are (block, piece, kind, x, xs, ys): 0 known at x (bits, counts), 1 walks to x (bits, counts), 2 payees of x (xs), 3 the distances
    of kind 0 (bits, distances), 4 (bits) whose farther addresses nobody wants.
    """
    def run(batches):
        group = None
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(4)]
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(4), batch.column(5))]
            for i in range(batch.num_rows):
                key = int(cols[0][i]), int(cols[1][i])
                if key != group:
                    if group is not None:
                        yield from out(group, sums, hops, at, closed)
                    group, sums, at, closed = key, np.zeros((64, BITS), dtype=np.int64), {}, None
                    hops, walks_of = np.zeros((64, BITS), dtype=np.int8), None
                kind, x = int(cols[2][i]), int(cols[3][i])
                xs, ys = (v[o[i]:o[i + 1]] for o, v in lists)
                if kind == 4:
                    closed = xs.copy()
                elif kind == 1:
                    walks_of, bits, paths = x, xs.copy(), ys.copy()
                elif kind != 2 or walks_of == x:
                    to = np.array([at.setdefault(v, len(at)) for v in ([x] if kind in (0, 3) else xs.tolist())])
                    while len(at) > len(sums):
                        sums, hops = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([hops, np.zeros_like(hops)])
                    if kind == 0:
                        sums[to[0], xs] += ys
                    elif kind == 3:
                        hops[to[0], xs] = ys
                    else:
                        sums[to[:, None], bits[None, :]] += paths[None, :]
        if group is not None:
            yield from out(group, sums, hops, at, closed)

    def out(group, sums, hops, at, closed):
        ids = np.fromiter(at, dtype=np.int64, count=len(at))
        for first in range(0, len(ids), 256):
            part, near = sums[first:min(first + 256, len(ids))], hops[first:min(first + 256, len(ids))]
            wanted = (part != 0) | (near != 0)
            if closed is not None:
                wanted[:, closed] &= near[:, closed] != 0
            row, bit = np.nonzero(wanted)
            dist = near[row, bit]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(row), group[0])), pa.array(bit), pa.array(ids[first + row]),
                pa.array(np.where(dist == 0, hop, dist).astype(np.int32)), pa.array(part[row, bit])], names=["block", "bit", "c", "min_hop", "path_count"])
    return run


def last_hop(nearer: DataFrame, walks: DataFrame, edges: DataFrame, blocks: DataFrame, hop: int, limit: int | None) -> DataFrame:
    """``nearer`` (s, c, min_hop, path_count) with the walks of one more edge added: ``walks`` (s, c, paths) over ``edges`` (a, b).

    Walks are never rows: those of a block of seeds stay where they are and the edges they take come to them, once a block and not once a
    walk. Addresses of a block are dealt to pieces of some PIECE_ADDRESSES, whose counts a task holds. A seed with ``limit`` nearer addresses keeps no
    farther one, so those are left out for it.
    """
    packed = lambda rows, x, kind, value: rows.join(blocks, "s").groupBy("block", F.col(x).alias("x")).agg(
        F.collect_list(F.struct("bit", F.col(value).cast("long").alias("v"))).alias("l")).select(
        "block", F.lit(kind).alias("kind"), "x", F.col("l.bit").alias("xs"), F.col("l.v").alias("ys"))
    vectors = materialize(packed(walks, "c", 1, "paths"), "walks")
    near = packed(nearer, "c", 0, "path_count").unionByName(packed(nearer, "c", 3, "min_hop"))
    paid = materialize(vectors.select("block", F.col("x").alias("a")).join(edges, "a").select("block", "a", "b"), "paid")
    pieces = paid.groupBy("block").agg(F.ceil(F.approx_count_distinct("b") / PIECE_ADDRESSES).cast("long").alias("pieces"))
    pieces = materialize(blocks.select("block").distinct().join(pieces, "block", "left").select(
        "block", F.coalesce("pieces", F.lit(1).cast("long")).alias("pieces")), "pieces")
    piece = lambda c: F.pmod(F.xxhash64(c), "pieces").alias("piece")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")
    none = F.array().cast("array<bigint>")
    columns = ["block", "piece", "kind", "x", "xs", "ys"]
    payees = paid.join(pieces, "block").select("block", piece("b"), F.col("a").alias("x"), "b").groupBy("block", "piece", "x").agg(
        F.collect_list("b").alias("xs")).select("block", "piece", F.lit(2).alias("kind"), "x", "xs", none.alias("ys"))
    rows = near.join(pieces, "block").select("*", piece("x")).select(*columns).unionByName(
        vectors.join(pieces, "block").select("*", every).select(*columns)).unionByName(payees)
    if limit is not None:
        full = nearer.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).join(blocks, "s").groupBy("block").agg(
            F.collect_list("bit").alias("xs"))
        rows = rows.unionByName(full.join(pieces, "block").select("block", every, F.lit(4).alias("kind"), F.lit(-1).cast("long").alias("x"), "xs", none.alias("ys")))
    # What is known and what is unwanted come first, then each address's walks before its payees.
    dealt = rows.repartition("block", "piece").sortWithinPartitions(
        "block", "piece", F.col("kind").isin(1, 2), "x", "kind")
    counts = dealt.select(*[F.col(c).cast("long") for c in columns[:4]], "xs", "ys").mapInArrow(
        _add_walks(hop), "block long, bit long, c long, min_hop int, path_count long")
    return counts.join(blocks, ["block", "bit"]).where(F.col("s") != F.col("c")).select("s", "c", "min_hop", "path_count")


def _listed_exposure(seeds: DataFrame, inputs: DataFrame, outputs: DataFrame, max_hops: int, limit: int | None) -> DataFrame:
    """G4 beyond three hops.

    Paths are listed only up to ``max_hops - 1``. The last hop is counted: walks that add
    one edge to a path, less those that step back onto the path. A seed with ``limit``
    nearer addresses can keep none that is first reached by the last hop, so for it that hop
    is counted only towards the nearer ones. Without a limit all are kept.
    """
    inner = reachable(seeds, inputs, outputs, max_hops - 1)
    sources = inner.select("address").distinct()
    edges = materialize(address_edges(inputs.join(sources, "address", "left_semi"), outputs), "edges")
    walks = bounded_walk(seeds, edges, max_hops - 1)
    counts = materialize(walks.where(F.col("hop") > 0).groupBy("seed", "address").agg(
        F.count(F.lit(1)).alias("paths"), F.min("hop").alias("hop")), "near-counts")
    full = counts.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= limit if limit else F.lit(False)).select("seed")
    last = walks.where(F.col("hop") == max_hops - 1)
    ends = last.groupBy("seed", "address").agg(F.count(F.lit(1)).alias("paths"))
    step = lambda df: df.join(edges, F.col("address") == F.col("src")).select(
        "seed", F.col("dst").alias("address"), "paths")
    near = counts.select("seed", "address")
    steps = step(ends.join(full, "seed", "left_semi")).join(near, ["seed", "address"], "left_semi").unionByName(
        step(ends.join(full, "seed", "left_anti")))
    back = (
        last.select("seed", F.col("address").alias("src"), F.explode("path").alias("dst"))
        .join(edges, ["src", "dst"], "left_semi")
        .select("seed", F.col("dst").alias("address"), F.lit(-1).cast("bigint").alias("paths"))
    )
    final = (
        steps.unionByName(back).groupBy("seed", "address").agg(F.sum("paths").alias("paths"))
        .where(F.col("paths") > 0).withColumn("hop", F.lit(max_hops))
    )
    exposure = counts.unionByName(final).groupBy("seed", "address").agg(
        F.min("hop").alias("min_hop"), F.sum("paths").alias("path_count"))
    order = [F.col("min_hop"), F.col("path_count").desc(), F.col("address")]
    return top_per(exposure, ["seed"], order, limit)


def entity_exposure(reach: DataFrame, links: DataFrame, entities: DataFrame, limit: int | None = None) -> DataFrame:
    """Entities behind reached addresses, weighted by link confidence over distance.

    ``reach`` (seed, address, min_hop) may hold labelled addresses only; for many seeds see :func:`sweep_exposure`.
    """
    term = (F.col("confidence").cast("double") / (F.col("min_hop") + 1)).cast("decimal(28,10)")
    per_entity = (
        reach.where(F.col("min_hop") > 0)
        .join(links.select("address", "entity_id", "confidence"), "address")
        .groupBy("seed", "entity_id")
        .agg(F.min("min_hop").alias("min_hop"),
             F.round(F.max("confidence"), 3).cast("double").alias("max_link_confidence"),
             F.round(F.sum(term), 3).cast("double").alias("weighted_exposure"))
        .join(entities.select("entity_id", "name", "category"), "entity_id")
    )
    order = [F.col("weighted_exposure").desc(), F.col("min_hop"), F.col("name"), F.col("entity_id")]
    return top_per(per_entity, ["seed"], order, limit)


def sweep_exposure(found: Sweep, links: DataFrame, entities: DataFrame, limit: int | None = None) -> DataFrame:
    """G5 from a sweep: as :func:`entity_exposure`, summed over bits without a row per seed and address.

    Whole numbers carry the sums: ten-thousand-millionths of the weighted terms, thousandths of the confidence.
    """
    sizes = links.groupBy("entity_id").agg(F.ceil(F.count(F.lit(1)) / SPREAD_ROWS).alias("spread"))
    labels = links.join(sizes, "entity_id").join(found.nodes, "address").select(
        "id", F.col("entity_id").alias("g"), F.col("confidence").alias("c"), "spread")
    labels = materialize(labels, "labels")
    parts = []
    for hop, level in enumerate(found.marks[1:], 1):
        term = (F.col("c").cast("double") / (hop + 1)).cast("decimal(28,10)")
        parts.append(level.join(labels, "id").withColumns({
            "hop": F.lit(hop), "w": (term * F.lit(10**10)).cast("long"), "top": (F.col("c") * 1000).cast("long")}).drop("id", "c"))
    if not parts:
        parts = [found.marks[0].join(labels, "id").withColumns({c: F.lit(0) for c in ("hop", "w", "top")}).drop("id", "c").limit(0)]
    sums = folded(reduce(DataFrame.unionByName, parts))
    per_entity = sums.select(
        "block", "bit", F.col("g").alias("entity_id"), F.col("hop").alias("min_hop"), (F.col("top") / 1000.0).alias("max_link_confidence"),
        (F.expr("(total + 5000000) div 10000000") / 1000.0).alias("weighted_exposure"))
    named = per_entity.join(entities.select("entity_id", "name", "category"), "entity_id")
    order = [F.col("weighted_exposure").desc(), F.col("min_hop"), F.col("name"), F.col("entity_id")]
    return top_per(named, ["block", "bit"], order, limit).join(found.seeds, ["block", "bit"]).select(
        "seed", "entity_id", "min_hop", "max_link_confidence", "weighted_exposure", "name", "category", "rank")


def tx_stats(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Shape of every transaction; one without inputs or outputs counts zero."""
    spent = inputs.groupBy("txid").agg(
        F.count(F.lit(1)).alias("vin_count"), F.count_distinct("address").alias("input_addr_count"))
    paid = outputs.groupBy("txid").agg(
        F.count(F.lit(1)).alias("vout_count"), F.count_distinct("address").alias("output_addr_count"),
        F.sum("amount_sats").alias("total_output_sats"), F.max("amount_sats").alias("max_output_sats"))
    zero = F.lit(0).cast("bigint")
    columns = ["input_addr_count", "output_addr_count", "vin_count", "vout_count",
               "total_output_sats", "max_output_sats"]
    return (
        transactions.select("txid").join(spent, "txid", "left").join(paid, "txid", "left")
        .select("txid", *[F.coalesce(c, zero).alias(c) for c in columns])
    )
