"""Breadth-first search from many seeds at once.

Seeds are numbered in blocks of 512; a row (block, address) carries one bit per seed of the block, in
eight longs. Addresses and transactions are numbers meanwhile, and whom an address pays is a list beside it. A hop sends a
row once with its list to the task of its block, which unites the bits of all rows there, so bits move once per address and
not once per edge. Transactions are looked at when all levels are known: one is as near as the nearest of its senders.
Bits are turned into rows only after the join with what the caller wants to know (labels, matching transactions).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import discard, materialize

WORDS = 8
BITS = 64 * WORDS
MASKS = [f"m{i}" for i in range(WORDS)]
PLACED_ROWS = 1024
"""Rows whose bits a task holds as numbers at a time."""
WIDE = 16
"""Outputs of a transaction above which its senders are not paired with its receivers: it is a node between them."""
PIECE_EDGES = 1 << 20
"""Edges of a block that one task holds, about; more are dealt by the end they lead to."""
CHUNK = 1 << 18
"""Edges whose bits a task gathers at a time."""


@dataclass(frozen=True)
class Links:
    """The graph in numbers: ``nodes`` (address, id), ``txs`` (txid, id, is_wide), and lists (id, ys, n).

    ``pays`` has whom an address pays; a number below zero is a transaction with many outputs, whose receivers ``wide`` has. ``spends`` has
    the transactions an address spends in; an odd number is one that the caller wants to see.
    """

    nodes: DataFrame
    txs: DataFrame
    pays: DataFrame
    wide: DataFrame | None
    spends: DataFrame | None


@dataclass(frozen=True)
class Sweep:
    """``seeds`` (seed, block, bit), ``levels[h]`` (block, address, masks) first reached at hop h, and ``transactions[h]``
    (block, txid, masks) first spent from at hop h; level 0 spends nothing. ``marks`` are the levels by the numbers of ``nodes`` (address, id),
    ``near`` (block, bit, n) counts the transactions of each seed, those too that the caller did not want to see."""

    seeds: DataFrame
    levels: list[DataFrame]
    transactions: list[DataFrame]
    marks: list[DataFrame]
    nodes: DataFrame
    near: DataFrame | None


def _neighbourhoods(nodes: DataFrame, lists: DataFrame, max_hops: int) -> DataFrame:
    """(address, id, s0 .. s<max_hops>): the least hash of what an address pays within so many hops; that of like neighbourhoods is likely the same.

    s0 is the hash of the address itself. Lists have the first hop; once a hop changes nothing, those after it are the same. A transaction with
    many receivers stands for them.
    """
    first = lists.groupBy("id").agg(F.min(F.array_min(F.transform("ys", lambda y: F.xxhash64(y)))).alias("s1"))
    near = materialize(nodes.select("address", "id", F.xxhash64("id").alias("s0")).join(first, "id", "left"), "near")
    pairs = lists.select(F.col("id").alias("x"), F.explode("ys").alias("id"))
    for hop in range(2, max_hops + 1):
        within = near.select("id", F.least("s0", F.col(f"s{hop - 1}")).alias("least"))
        paid = pairs.join(within, "id").groupBy(F.col("x").alias("id")).agg(F.min("least").alias(f"s{hop}"))
        old, near = near, materialize(near.join(paid, "id", "left"), "near")
        discard(old)
        if near.where(~F.col(f"s{hop}").eqNullSafe(F.col(f"s{hop - 1}"))).isEmpty():
            return near.withColumns({f"s{later}": F.col(f"s{hop}") for later in range(hop + 1, max_hops + 1)})
    return near


def number_seeds(seeds: DataFrame, nodes: DataFrame, lists: DataFrame, max_hops: int) -> DataFrame:
    """(seed, block, bit): blocks of at most BITS seeds; ``nodes`` (address, id) and ``lists`` (id, ys) of whom an address pays.

    Seeds that reach much the same lie in one block, as a row of a level then carries many of its bits: they are sorted by the least
    hash of what they reach, the farthest first. The sort is written, so numbers stay as they are; a partition begins a block.
    """
    different = seeds.select("seed").where(F.col("seed").isNotNull()).distinct()
    near = _neighbourhoods(nodes, lists, max_hops)
    placed = materialize(different.join(near.withColumnRenamed("address", "seed"), "seed", "left"), "places")
    order = [f"s{hop}" for hop in range(max_hops, -1, -1)]
    sorted_seeds = materialize(placed.orderBy(*order, "seed").select("seed", F.monotonically_increasing_id().alias("n")), "seeds")
    discard(near, placed)
    return sorted_seeds.select("seed", F.expr(f"n div {BITS}").alias("block"), (F.col("n") % BITS).cast("int").alias("bit"))


def _listed(batches):
    """Lists of the second numbers beside each first one, rows sorted by both; a list ends with its batch at the latest."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.asarray(batch.column(i)) for i in range(2))
        new = np.concatenate([[(x[0], y[0]) != last], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        last = x[-1], y[-1]
        x, y = x[new], y[new]
        if not len(x):
            continue
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        ends = np.append(first, len(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[first]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(y)), pa.array(np.diff(ends))], names=["id", "ys", "n"])


def listed(pairs: DataFrame, name: str) -> DataFrame:
    """(id, ys, n) of ``pairs`` (x, y), each pair once; an x has several lists if it has many y."""
    rows = pairs.select("x", "y").repartition("x").sortWithinPartitions("x", "y")
    return materialize(rows.mapInArrow(_listed, "id long, ys array<long>, n long"), name)


def _links(seeds: DataFrame, spends: DataFrame, pays: DataFrame, spent_from: bool, only: DataFrame | None) -> Links:
    sent, paid = (df.where("address IS NOT NULL AND txid IS NOT NULL") for df in (spends, pays))
    names = sent.select("address").union(paid.select("address")).union(seeds.select("seed")).distinct()
    nodes = materialize(names.select("address", F.monotonically_increasing_id().alias("id")), "nodes")
    txs = sent.select("txid").distinct().join(paid.groupBy("txid").agg(F.count(F.lit(1)).alias("n")), "txid", "left")
    wanted = F.lit(1)
    if only is not None:
        txs, wanted = txs.join(only.select("txid", F.lit(1).alias("wanted")).distinct(), "txid", "left"), F.coalesce("wanted", F.lit(0))
    txs = materialize(txs.select("txid", wanted.alias("w"), (F.coalesce("n", F.lit(0)) > WIDE).alias("is_wide")).select(
        "txid", (F.monotonically_increasing_id() * 2 + F.col("w")).alias("id"), "is_wide"), "txs")
    t = txs.withColumnRenamed("id", "t")
    sent = materialize(sent.join(t, "txid").join(nodes, "address").select(F.col("id").alias("x"), "t", "is_wide"), "sent")
    paid = materialize(paid.join(t, "txid").join(nodes, "address").select("t", F.col("id").alias("y"), "is_wide"), "paid")
    narrow = lambda df: df.where("NOT is_wide").drop("is_wide")
    pairs, wide = narrow(sent).join(narrow(paid), "t").where("x <> y").select("x", "y"), None
    if not txs.where("is_wide").isEmpty():
        pairs = pairs.unionByName(sent.where("is_wide").select("x", (-1 - F.col("t")).alias("y")))
        wide = listed(paid.where("is_wide").select((-1 - F.col("t")).alias("x"), "y"), "wide")
    lists = listed(pairs, "pays")
    spent = listed(sent.select("x", F.col("t").alias("y")), "spends") if spent_from else None
    discard(sent, paid)
    return Links(nodes, txs, lists, wide, spent)


def _pieces(batches):
    """(block, batches) of each piece, rows (block, piece, hop, masks, ys) sorted by the first two."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(i)) for i in range(2)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(k[:, a].tolist())
            if held and now != key:
                yield key[0], held
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key[0], held


def _held(held: list):
    """The hops and masks of a piece's rows, and of each edge its end and row."""
    hops = np.concatenate([np.asarray(b.column(2)) for b in held])
    masks = np.concatenate([np.stack([np.asarray(b.column(3 + i)) for i in range(WORDS)], axis=1) for b in held]).view(np.uint64)
    ys = np.concatenate([np.asarray(b.column(3 + WORDS).flatten()) for b in held])
    lengths = np.concatenate([np.asarray(pc.list_value_length(b.column(3 + WORDS))) for b in held])
    return hops, masks, ys, np.repeat(np.arange(len(hops)), lengths)


def _unite(from_hop: int, counted: bool):
    """Unites the bits of rows that lead to the same end, rows (block, piece, hop, masks, ys) sorted by the first three.

    An end has its bits at the least hop that brings them; those of hops before ``from_hop`` are only taken away. If ``counted``, ends of even number are
    counted and not returned; a row with a number below zero has the count of the bit -1 - number.
    """
    def run(batches):
        for block, held in _pieces(batches):
            yield from out(block, held)

    def out(block, held):
        hops, masks, ys, at = _held(held)
        order = np.argsort(ys, kind="stable")  # rows come by hop, so those of an end are in the order of hops
        ys, at = ys[order], at[order]
        new_end = np.concatenate([[True], ys[1:] != ys[:-1]])
        new = new_end | np.concatenate([[True], hops[at[1:]] != hops[at[:-1]]])
        group = np.cumsum(new) - 1
        ends, hop, end = ys[new], hops[at[new]], np.cumsum(new_end)[new] - 1
        bits = np.zeros((len(ends), WORDS), dtype=np.uint64)
        for a in range(0, len(ys), CHUNK):
            own = group[a:a + CHUNK]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            bits[own[first]] |= np.bitwise_or.reduceat(masks[at[a:a + CHUNK]], first, axis=0)
        if hop.min() != hop.max():
            known = np.zeros((end[-1] + 1, WORDS), dtype=np.uint64)
            for h in np.unique(hop).tolist():
                rows = np.flatnonzero(hop == h)
                fresh = bits[rows] & ~known[end[rows]]
                known[end[rows]] |= bits[rows]
                bits[rows] = fresh
        kept = np.flatnonzero((hop >= from_hop) & bits.any(axis=1))
        if counted:
            total = np.zeros(BITS, dtype=np.int64)
            for a in range(0, len(kept), PLACED_ROWS):
                total += np.unpackbits(bits[kept[a:a + PLACED_ROWS]].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            some = np.flatnonzero(total)
            counts = np.zeros((len(some), WORDS), dtype=np.uint64)
            counts[:, 0] = total[some]
            yield rows_of(block, -1 - some, np.zeros(len(some), dtype=np.int32), counts)
            kept = kept[ends[kept] % 2 == 1]
        for a in range(0, len(kept), CHUNK):
            part = kept[a:a + CHUNK]
            yield rows_of(block, ends[part], hop[part], bits[part])

    def rows_of(block, ids, hop, bits):
        signed = bits.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), block)), pa.array(ids.astype(np.int64)), pa.array(hop.astype(np.int32)),
             *[pa.array(np.ascontiguousarray(signed[:, i])) for i in range(WORDS)]], names=["block", "id", "hop", *MASKS])
    return run


def _dealt(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` (block, id, hop, masks) with their lists as (block, piece, hop, masks, ys), where a task has the rows of a piece in the order of hops.

    A row moves with its list to the task of its block. A block with many edges is dealt to pieces by the end, so an end lies in one.
    """
    pieces = rows.select("block", "id").join(lists.select("id", "n"), "id").groupBy("block").agg(
        F.ceil(F.sum("n") / PIECE_EDGES).cast("int").alias("pieces"))
    pieces = materialize(pieces, "pieces")
    of = lambda p: F.filter("ys", lambda y: F.pmod(F.xxhash64(y), F.col("pieces")) == p)
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.col("ys").alias("ys")))
    split = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: F.struct(p.alias("piece"), of(p).alias("ys")))
    own = F.explode(F.when(F.col("pieces") == 1, whole).otherwise(F.filter(split, lambda d: F.size(d["ys"]) > 0))).alias("d")
    dealt = rows.join(lists.select("id", "ys"), "id").join(pieces, "block").select("block", "hop", *MASKS, own).select(
        "block", F.col("d.piece").cast("long").alias("piece"), "hop", *MASKS, "d.ys")
    return dealt.repartition("block", "piece").sortWithinPartitions("block", "piece", "hop")


def _spread(rows: DataFrame, lists: DataFrame, from_hop: int = 0, counted: bool = False) -> DataFrame:
    """(block, id, hop, masks) of the ends that ``lists`` lead to from ``rows`` (block, id, hop, masks), see :func:`_unite`."""
    return _dealt(rows, lists).mapInArrow(
        _unite(from_hop, counted), "block long, id long, hop int, " + ", ".join(f"{m} long" for m in MASKS))


def _count_ways(out, block: int, held: list):
    """Per end and bit, by how many rows of hop 0 the end is led to, where it has the bit itself (its own row is of hop 1) and there are several."""
    hops, masks, ys, at = _held(held)
    order = np.argsort(ys, kind="stable")
    ys, at = ys[order], at[order]
    own = hops[at] == 1
    ends, end_masks = ys[own], masks[at[own]]
    ways = np.isin(ys, ends) & ~own
    ys, at = ys[ways], at[ways]
    first = np.flatnonzero(np.concatenate([[True], ys[1:] != ys[:-1]])) if len(ys) else np.zeros(0, dtype=np.int64)
    stops = np.append(first, len(ys))
    unpacked = lambda m: np.unpackbits(np.ascontiguousarray(m).view(np.uint8), axis=1, bitorder="little")
    begin = 0
    while begin < len(first):
        # Some ends of together about PLACED_ROWS rows; one of more rows is summed in slices.
        stop = max(begin + 1, int(np.searchsorted(stops, stops[begin] + PLACED_ROWS, "right")) - 1)
        n = np.zeros((stop - begin, BITS), dtype=np.int64)
        group = np.repeat(np.arange(stop - begin), np.diff(stops[begin:stop + 1]))
        for a in range(0, len(group), PLACED_ROWS):
            part = group[a:a + PLACED_ROWS]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            lo = stops[begin] + a
            n[part[cuts]] += np.add.reduceat(unpacked(masks[at[lo:lo + len(part)]]), cuts, axis=0, dtype=np.int64)
        to = ys[first[begin:stop]]
        n *= unpacked(end_masks[np.searchsorted(ends, to)])
        row, bit = np.nonzero(n > 1)
        yield out(block, bit, to[row], n[row, bit])
        begin = stop


def _ways(batches):
    out = lambda block, bit, ids, n: pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), block)), pa.array(bit.astype(np.int32)), pa.array(ids), pa.array(n)], names=["block", "bit", "id", "n"])
    for block, held in _pieces(batches):
        yield from _count_ways(out, block, held)


def several_ways(found: Sweep, edges: DataFrame) -> DataFrame:
    """(seed, address, hop, n): addresses that several (n) addresses one hop nearer pay, by ``edges`` (src, dst), different pairs.

    Bits are counted in the task of their block, so no row of a seed and edge is made. Only the seed is nearer than the first hop.
    """
    number = lambda df, column, out: df.join(found.nodes.select(F.col("address").alias(column), F.col("id").alias(out)), column)
    lists = listed(number(number(edges, "src", "x"), "dst", "y").select("x", "y"), "edges")
    parts = []
    for hop in range(2, len(found.marks)):
        level = found.marks[hop].withColumn("hop", F.lit(1))
        own = found.nodes.select("id", F.array("id").alias("ys"), F.lit(1).cast("long").alias("n"))
        # A row of hop 1 has no list but itself; to deal both alike, numbers of ends are told from those of senders by their sign.
        senders = found.marks[hop - 1].withColumn("hop", F.lit(0))
        ends = level.withColumn("id", -1 - F.col("id"))
        both = lists.unionByName(own.withColumn("id", -1 - F.col("id")))
        parts.append(_dealt(senders.unionByName(ends), both).mapInArrow(_ways, "block long, bit int, id long, n long").withColumn("hop", F.lit(hop)))
    if not parts:
        return found.seeds.select("seed", F.lit("").alias("address"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("n")).limit(0)
    return reduce(DataFrame.unionByName, parts).join(found.seeds, ["block", "bit"]).join(found.nodes, "id").select("seed", "address", "hop", "n")


_SEEN = [f"k{m}" for m in MASKS]
_ANY = " OR ".join(f"{m} <> 0" for m in MASKS)


def _next_level(last: DataFrame, marks: list[DataFrame], links: Links) -> DataFrame:
    """(block, id, masks): what ``last`` leads to, without the bits that ``marks`` have."""
    zeros = lambda columns: [F.lit(0).cast("long").alias(c) for c in columns]
    reached = _spread(last.withColumn("hop", F.lit(0)), links.pays)
    if links.wide is not None:
        reached = materialize(reached, "reached")
        reached = reached.where("id >= 0").unionByName(_spread(reached.where("id < 0"), links.wide))
    seen = reduce(DataFrame.unionByName, marks)
    rows = reached.select("block", "id", *MASKS, *zeros(_SEEN)).unionByName(
        seen.select("block", "id", *zeros(MASKS), *[F.col(m).alias(k) for m, k in zip(MASKS, _SEEN, strict=True)]))
    united = rows.groupBy("block", "id").agg(*[F.bit_or(c).alias(c) for c in (*MASKS, *_SEEN)])
    return materialize(united.select("block", "id", *[
        F.col(m).bitwiseAND(F.bitwise_not(k)).alias(m) for m, k in zip(MASKS, _SEEN, strict=True)]).where(_ANY), "reach")


def _by_hop(marks: list[DataFrame]) -> DataFrame:
    """The levels that spend, all but the first, under their hop."""
    return reduce(DataFrame.unionByName, [level.withColumn("hop", F.lit(hop)) for hop, level in enumerate(marks) if hop])


def _counts(spent: list[DataFrame]) -> DataFrame:
    """(block, bit, n) of what :func:`_unite` counted."""
    rows = reduce(DataFrame.unionByName, spent).where("id < 0")
    return rows.groupBy("block", (-1 - F.col("id")).cast("int").alias("bit")).agg(F.sum("m0").alias("n"))


def _hungry(level: DataFrame, counts: DataFrame, enough: int) -> DataFrame:
    """``level`` without the bits of seeds that have ``enough`` transactions by now."""
    words = materialize(counts.where(F.col("n") >= enough).groupBy("block").agg(*[
        F.bit_or(F.expr(f"CASE WHEN bit DIV 64 = {i} THEN shiftleft(1L, bit % 64) ELSE 0L END")).alias(k) for i, k in enumerate(_SEEN)]), "full")
    return level.join(words, "block", "left").select("block", "id", *[
        F.col(m).bitwiseAND(F.bitwise_not(F.coalesce(k, F.lit(0).cast("long")))).alias(m) for m, k in zip(MASKS, _SEEN, strict=True)]).where(_ANY)


def sweep(
    seeds: DataFrame, spends: DataFrame, pays: DataFrame, max_hops: int, spent_from: bool = False, enough: int | None = None,
    only: DataFrame | None = None,
) -> Sweep:
    """Levels of all seeds over ``spends`` (address, txid) and ``pays`` (txid, address), which may repeat rows: bits are united.

    With ``spent_from`` also the transactions with a sender at hop 1 .. max_hops; ``only`` (txid) are returned if given, all are counted. A seed that
    has ``enough`` transactions, if given, is followed no farther: the caller wants no more of them, the nearest first.
    """
    links = _links(seeds.where("seed IS NOT NULL"), spends, pays, spent_from, only)
    placed = number_seeds(seeds, links.nodes, links.pays, max_hops)
    one = [F.expr(f"CASE WHEN bit DIV 64 = {i} THEN shiftleft(1L, bit % 64) ELSE 0L END").alias(m) for i, m in enumerate(MASKS)]
    marks = [materialize(placed.join(links.nodes, F.col("seed") == F.col("address")).select("block", "id", *one), "reach")]
    spent, last = [], marks[0]
    for hop in range(1, max_hops + 1):
        marks.append(_next_level(last, marks, links))
        last = marks[-1]
        if enough is not None:
            spent.append(materialize(_spread(_by_hop(marks), links.spends, hop, True), "spent"))
            last = _hungry(last, _counts(spent), enough)
        if marks[-1].isEmpty():
            break
    if spent_from and enough is None:
        spent = [materialize(_spread(_by_hop(marks), links.spends, 1, True), "spent")]
    named = lambda level: level.join(links.nodes, "id").select("block", "address", *MASKS)
    transactions = [
        part.where((F.col("hop") == hop) & (F.col("id") >= 0)).join(links.txs, "id").select("block", "txid", *MASKS)
        for hop in range(1, len(marks)) for part in (spent if enough is None else spent[hop - 1:hop])]
    return Sweep(placed, [named(level) for level in marks], transactions, marks, links.nodes, _counts(spent) if spent else None)


def expanded(marked: DataFrame, seeds: DataFrame, *columns: str) -> DataFrame:
    """One row per set bit: ``seed`` beside ``columns``. A block's seeds, at most BITS, join the rows of bits, which are few; nothing moves after."""
    names = seeds.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bit", "seed"))).alias("names"))
    names = names.select("block", F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.try_element_at("names", b)).alias("names"))
    words = marked.join(names, "block").select(
        *columns, F.expr(f"explode(filter(transform(array({', '.join(MASKS)}), (m, i) -> struct(m, slice(names, i * 64 + 1, 64) AS names)), w -> w.m <> 0))").alias("w"))
    return words.select(*columns, F.expr(
        "explode(filter(transform(w.names, (s, b) -> IF((shiftrightunsigned(w.m, b) & 1L) = 1L, s, NULL)), s -> s IS NOT NULL))").alias("seed"))


def _count_bits(batches):
    """Set bits by block, slice and position, summed over the task."""
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(i)) for i in range(2)])
        masks = np.stack([np.asarray(batch.column(i + 2)).view(np.uint64) for i in range(WORDS)], axis=1)
        for key in np.unique(keys, axis=1).T:
            own = masks[(keys == key[:, None]).all(axis=0)]
            bits = np.unpackbits(np.ascontiguousarray(own).view(np.uint8), axis=1, bitorder="little")
            sums[tuple(key.tolist())] = sums.get(tuple(key.tolist()), 0) + bits.sum(axis=0, dtype=np.int64)
    for (block, piece), counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), block)), pa.array(np.full(len(at), piece)), pa.array(at.astype(np.int32)), pa.array(counts[at])],
            names=["block", "slice", "bit", "n"])


def _bits(marked: DataFrame, slice_: Column) -> DataFrame:
    """(block, slice, bit, n): in how many rows of a slice each bit is set."""
    rows = marked.select("block", slice_.cast("long").alias("slice"), *MASKS)
    return rows.mapInArrow(_count_bits, "block long, slice long, bit int, n long").groupBy("block", "slice", "bit").agg(F.sum("n").alias("n"))


def bits_per_seed(marked: list[DataFrame], seeds: DataFrame, out: str) -> DataFrame:
    """(seed, ``out``): in how many rows each seed's bit is set; seeds without any are left out."""
    counted = _bits(reduce(DataFrame.unionByName, [df.select("block", *MASKS) for df in marked]), F.lit(0))
    return counted.join(seeds, ["block", "bit"]).select("seed", F.col("n").alias(out))


def _places(columns: list[str], limit: int | None):
    """Gives each set bit its place among its seed's rows; a slice begins with a head that names its seeds and how many rows each has before."""
    def run(batches):
        names = before = None
        for batch in batches:
            heads = batch.column("entries")
            first = 0
            for stop in [*np.flatnonzero(np.asarray(heads.is_valid())).tolist(), batch.num_rows]:
                for at in range(first, stop, PLACED_ROWS):
                    part = batch.slice(at, min(PLACED_ROWS, stop - at))
                    masks = np.stack([np.asarray(part.column(m)).astype(np.int64).view(np.uint64) for m in MASKS], axis=1)
                    bits = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1, bitorder="little").astype(bool)
                    places = before + np.cumsum(bits, axis=0)
                    before = places[-1]
                    if limit is not None:
                        bits &= places <= limit
                    n = bits.sum(axis=1)
                    rows = np.flatnonzero(n)
                    ends = pa.array(np.concatenate([[0], np.cumsum(n[rows])]).astype(np.int32))
                    kept = part.select(columns).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.ListArray.from_arrays(ends, names.take(pa.array(np.nonzero(bits)[1]))),
                         pa.ListArray.from_arrays(ends, pa.array(places[bits].astype(np.int32)))], names=[*columns, "seeds", "places"])
                if stop < batch.num_rows:
                    entries = {e["bit"]: e for e in heads[stop].as_py()}
                    names = pa.array([entries[b]["seed"] if b in entries else None for b in range(BITS)], pa.string())
                    before = np.array([entries[b]["before"] if b in entries else 0 for b in range(BITS)], dtype=np.int64)
                first = stop + 1
    return run


def numbered(marked: DataFrame, seeds: DataFrame, order: list[Column], out: str, limit: int | None = None) -> DataFrame:
    """One row per set bit: ``seed``, the other columns of ``marked`` and ``out``, the row's place from 1 among those of its seed in ``order``,
    which must tell rows apart; ``limit`` keeps the first of each seed.

    All seeds of a block share one order, so its rows are sorted once and places are running sums of bits: no row per seed is sorted or moved.
    Sorted rows are cut into slices as Spark's sort deals them, however large a block is, and a slice begins with the sums before it.
    """
    columns = [c for c in marked.columns if c != "block" and c not in MASKS]
    if not marked.columns or marked.isEmpty():
        return expanded(marked, seeds, *columns).withColumn(out, F.lit(0)).limit(0)
    cut = materialize(marked.orderBy("block", *order).withColumn("slice", F.spark_partition_id().cast("long")), "sliced")
    counts = materialize(_bits(cut, F.col("slice")), "slice-bits")
    before = Window.partitionBy("block", "bit").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        counts.select("block", "slice").distinct().join(seeds, "block").join(counts, ["block", "slice", "bit"], "left")
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .groupBy("block", "slice").agg(F.collect_list(F.struct("bit", "seed", "before")).alias("entries")))
    whole = cut.unionByName(heads, allowMissingColumns=True).repartition("block", "slice").sortWithinPartitions(
        "block", "slice", F.col("entries").isNull(), *order)
    types = {f.name: f.dataType.simpleString() for f in cut.schema}
    placed = whole.select(*columns, *MASKS, "entries").mapInArrow(
        _places(columns, limit), ", ".join([*[f"{c} {types[c]}" for c in columns], "seeds array<string>", "places array<int>"]))
    return placed.select(*columns, F.inline(F.arrays_zip("seeds", "places"))).withColumnsRenamed({"seeds": "seed", "places": out})


def _fold(batches):
    """Per block, group and seed of some rows: their number, sum of ``w``, largest ``top`` and least ``hop``."""
    far = 1 << 30
    for batch in batches:
        columns = [np.asarray(batch.column(i)) for i in range(5)]
        masks = np.stack([np.asarray(batch.column(i + 5)).view(np.uint64) for i in range(WORDS)], axis=1)
        for first in range(0, batch.num_rows, 512):
            block, group, hop, w, top = (c[first:first + 512] for c in columns)
            cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (group[1:] != group[:-1])]))
            bits = np.unpackbits(np.ascontiguousarray(masks[first:first + 512]).view(np.uint8), axis=1, bitorder="little").astype(bool)
            n = np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
            g, at = np.nonzero(n)
            total = np.add.reduceat(np.where(bits, w[:, None], 0), cuts, axis=0)
            most = np.maximum.reduceat(np.where(bits, top[:, None], -1), cuts, axis=0)
            least = np.minimum.reduceat(np.where(bits, hop[:, None], far), cuts, axis=0)
            values = (block[cuts][g], group[cuts][g], at.astype(np.int32), n[g, at], total[g, at], most[g, at], least[g, at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["block", "g", "bit", "n", "total", "top", "hop"])


def folded(marked: DataFrame) -> DataFrame:
    """(block, bit, g, n, total, top, hop): what :func:`_fold` sums, over all rows (block, g, hop, w, top, spread, masks).

    Bits are summed as columns, so no row per seed and row of ``marked`` is ever made. A group is dealt to ``spread`` tasks, which should be 1
    unless it has far more rows than a block has seeds: each task returns a row per seed. Sums of a seed meet in one task, where they stay.
    """
    cast = {"block": "long", "g": "long", "hop": "int", "w": "long", "top": "long"}
    rows = marked.select(*[F.col(c).cast(t).alias(c) for c, t in cast.items()], *MASKS, F.pmod(F.xxhash64(*MASKS), "spread").alias("piece"))
    dealt = rows.repartition("block", "g", "piece").sortWithinPartitions("block", "g").drop("piece")
    sums = dealt.mapInArrow(_fold, "block long, g long, bit int, n long, total long, top long, hop int").repartition("block", "bit")
    return sums.groupBy("block", "bit", "g").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"), F.min("hop").alias("hop"))
