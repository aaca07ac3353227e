"""Operator 13: removal of repeated word passages by prefix-partitioned suffix trees.

The suffixes of all documents, one for each word with LENGTH words ahead in its document, are split by their first words into
groups that fit a task; a group's suffixes are sorted into a tree whose edges span the words between LEVELS, and nodes that
are LENGTH words deep are the repeated windows. Every occurrence of such a node is removed, the first one too.

Suffixes that cannot repeat never travel: a window's anchor is the leftmost gram of GRAM words in it with the least hash, so equal
windows have equal anchors, and windows whose anchor gram occurs once in the corpus end their search there. The length of the
prefix that decides a suffix's group follows from how often its anchor occurs: LEVELS[0] words for most, more for those under a
frequent anchor, up to the whole window. Equal windows share their anchor and thus their group, and a frequent line with
many continuations is spread. Windows that repeat inside a slice of a task are known there: one of them stands for all in the tree, so
a passage of a third of all documents sends one suffix for each slice.

Words are runs without ASCII white space, compared byte for byte by hashes (64 bits for anchors, 96 for windows). A null or empty
text has no words and an empty kept text. Rows with equal ``doc_id`` are documents of their own, so repeated rows remove each
other; a null ``doc_id`` is kept. A very long text is read in one piece and its suffixes travel in groups like all others. Only
``doc_id`` and ``text`` are read, whatever other columns are called. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Shelf, slices, with_key

LENGTH = 35
GRAM = 8
WIDTH = LENGTH - GRAM + 1
LEVELS = (8, 16, LENGTH)
"""Words from the root at which tree edges end."""
FREQUENT = (2_000, 100_000)
"""Occurrences of an anchor beyond which the prefix that decides the group reaches the next level."""
GROUP = 2_000_000
"""Suffixes of one group, about."""
SLICE = 2 << 20
NOBODY = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BYTE = np.random.default_rng(13).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretch of a sequence, from running sums of its symbols times powers of an odd base."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        if len(_powers[0]) <= n:
            for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _powers[0][:n], out=self.total[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scramble((self.total[end] - self.total[begin]) * _powers[1][begin] + (end - begin).astype(np.uint64))


class Words:
    """The words of documents laid end to end: their hashes, documents, and where each document's words begin."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.binary())
        texts = texts.fill_null(b"") if texts.null_count else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0]:offsets[-1]]
        starts = offsets - offsets[0]
        inside = _WORD[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        full = np.diff(starts) > 0
        for marks, at in ((opens, starts[:-1][full]), (closes, starts[1:][full] - 1)):
            marks[at] = inside[at]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(begin, starts)  # of each document, with a last end
        self.document = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = Rolling(Rolling(_BYTE[data])(begin, end))

    def windows(self) -> np.ndarray:
        """Words that have LENGTH words of their document ahead of them, themselves included."""
        at = np.arange(max(0, len(self.document) - LENGTH + 1))
        return at[at + LENGTH <= self.first[self.document[at] + 1]]


def anchors(words: Words) -> tuple[np.ndarray, ...]:
    """(anchor, document, low, high): windows [low, high) of a document, counted in its words, that share an anchor."""
    at = words.windows()
    if not len(at):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    n = len(words.document)
    gram = np.arange(n - GRAM + 1)
    hashes = words.hashes(gram, gram + GRAM)
    place = np.uint64((1 << n.bit_length()) - 1)
    least = (hashes & ~place) | gram.astype(np.uint64)
    span = 1
    while 2 * span <= WIDTH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WIDTH:
        least = np.minimum(least[:span - WIDTH], least[WIDTH - span:])
    anchor, document = (least[at] & place).astype(np.int64), words.document[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])]))
    low = at[new] - words.first[document[new]]
    return hashes[anchor[new]], document[new], low, low + np.diff(np.append(new, len(at)))


def _anchored(batches):
    for whole in batches:
        for batch in slices(whole, most=SLICE):
            anchor, document, low, high = anchors(Words(batch.column(2)))
            ids, keys = (np.asarray(batch.column(i))[document] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(ids), pa.array(keys), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                names=["anchor", "id", "_key", "low", "high"])


_GROUPED = "grp long, ids binary, keys binary, sizes binary, places binary, labels binary, known binary"


def _packed(group: int, ids, keys, document, place, labels=None, known=None) -> tuple:
    """One row for suffixes sorted by document: each document once, with the number of its suffixes."""
    cut = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
    sizes = np.diff(np.append(cut, len(document))).astype(np.uint32)
    place = place.astype(np.uint32)
    planes = np.concatenate([place & np.uint32(0xFFFF), place >> np.uint32(16)]).astype(np.uint16)
    return (group, ids[document[cut]].tobytes(), keys[document[cut]].tobytes(), sizes.tobytes(), planes.tobytes(),
            None if labels is None else labels.tobytes(), None if known is None else np.packbits(known).tobytes())


def _places(planes: bytes) -> np.ndarray:
    low, high = np.frombuffer(planes, np.uint16).reshape(2, -1).astype(np.int64)
    return low | (high << 16)


def _suffixes(groups: int):
    """Rows of suffixes for each group, and rows of those that are known to repeat (with a group below zero)."""

    def emit(batches):
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                names = batch.schema.names
                words = Words(batch.column(names.index("text")))
                ids, keys = (np.asarray(batch.column(names.index(n))) for n in ("id", "_key"))
                found = batch.column(names.index("found"))
                n = np.diff(np.asarray(found.offsets))
                flat = found.flatten()
                low, high, often = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
                size, owner = high - low, np.repeat(np.arange(len(n)), n)
                first = words.first[owner] + low
                at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                # A repeated row meets its ranges twice.
                at, pick = np.unique(at, return_index=True)
                often = np.repeat(often, size)[pick]
                document = words.document[at]
                place = at - words.first[document]
                deep = [words.hashes(at, at + k) for k in LEVELS]
                edges, above = [], 0
                for k, h in zip(LEVELS, deep, strict=True):
                    edges.append((_scramble(words.hashes(at + above, at + k)) >> np.uint64(32)).astype(np.uint32))
                    above = k
                prefix = np.where(often > FREQUENT[1], deep[2], np.where(often > FREQUENT[0], deep[1], deep[0]))
                group = (prefix % np.uint64(groups)).astype(np.int64)
                # Windows that repeat in this slice are known; the first of each goes on for all.
                order = np.argsort(deep[-1], kind="stable")
                same = deep[-1][order]
                twin = np.zeros(len(order), bool)
                twin[1:] = same[1:] == same[:-1]
                known, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
                later[order] = twin
                twin[:-1] |= twin[1:].copy()
                known[order] = twin
                rows = []
                if known.any():
                    mine = np.flatnonzero(known)
                    rows.append(_packed(-1 - int(keys[document[mine[0]]] % groups), ids, keys, document[mine], place[mine]))
                sent = np.flatnonzero(~later)
                sent = sent[np.argsort(group[sent], kind="stable")]
                cuts = np.flatnonzero(np.concatenate([[True], group[sent][1:] != group[sent][:-1]])) if len(sent) else []
                for a, b in zip(cuts, [*cuts[1:], len(sent)], strict=True):
                    some = sent[a:b]
                    rows.append(_packed(int(group[some[0]]), ids, keys, document[some], place[some],
                                        np.stack([e[some] for e in edges]), known[some]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] + [pa.binary()] * 6, strict=True)],
                        names=[c.split()[0] for c in _GROUPED.split(", ")])

    return emit


def deep_nodes(labels: np.ndarray) -> np.ndarray:
    """Which suffixes lie under a node LENGTH words deep; a row of ``labels`` holds one edge of every suffix.

    The sorted suffixes are the tree's leaves; neighbours part at their first different edge, and a run of neighbours that do not
    part at all is the deepest inner node.
    """
    order = np.lexsort(labels[::-1])
    apart = np.zeros(max(0, len(order) - 1), bool)
    for edge in labels:
        e = edge[order]
        apart |= e[1:] != e[:-1]
    under = np.zeros(len(order), bool)
    under[order[1:]] |= ~apart
    under[order[:-1]] |= ~apart
    return under


_ANSWER = "bucket long, ids binary, keys binary, sizes binary, places binary"


def _subtrees(buckets: int):
    """Builds each group's tree and gives the suffixes under its deep nodes, one row for each bucket of documents."""

    def answer(ids, keys, document, place):
        bucket = keys[document].view(np.uint64) % np.uint64(buckets)
        order = np.lexsort((place, document, bucket))
        bucket, document, place = bucket[order].astype(np.int64), document[order], place[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
        out = [_packed(int(bucket[a]), ids, keys, document[a:b], place[a:b])[:5]
               for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] + [pa.binary()] * 4, strict=True)],
            names=[c.split()[0] for c in _ANSWER.split(", ")])

    def grown(rows):
        ids, keys, document, place = _unpacked(rows)
        if rows[0][4] is None:
            return answer(ids, keys, document, place)
        labels = np.concatenate([np.frombuffer(r[4], np.uint32).reshape(len(LEVELS), -1) for r in rows], axis=1)
        known = np.concatenate([np.unpackbits(np.frombuffer(r[5], np.uint8), count=int(np.frombuffer(r[2], np.uint32).sum())) for r in rows])
        # What a slice knows already has been told; it stands in the tree for others.
        hit = np.flatnonzero(deep_nodes(labels) & (known == 0))
        return answer(ids, keys, document[hit], place[hit]) if len(hit) else None

    def build(batches):
        held, now = [], None
        for batch in batches:
            for group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (group != now or group < 0):
                    if (found := grown(held)) is not None:
                        yield found
                    held = []
                now = group
                held.append(row)
        if held and (found := grown(held)) is not None:
            yield found

    return build


def _unpacked(rows: list[list]) -> tuple[np.ndarray, ...]:
    """(ids, keys, document, place) of packed rows end to end."""
    ids, keys, sizes = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((0, np.int64), (1, np.int64), (2, np.uint32)))
    return ids, keys, np.repeat(np.arange(len(sizes)), sizes), np.concatenate([_places(r[3]) for r in rows])


def _by_document(batches):
    """(id, _key, places) of each document of a bucket, from the bucket's rows of all groups."""

    def told(rows):
        ids, keys, document, place = _unpacked(rows)
        same = np.unique(np.stack([ids, keys]), axis=1, return_inverse=True)
        (ids, keys), document = same[0], same[1].ravel()[document]
        order = np.lexsort((place, document))
        document, place = document[order], place[order].astype(np.uint32)
        cut = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]])).tolist()
        out = [place[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(document)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids[document[cut]]), pa.array(keys[document[cut]]), pa.array(out, pa.binary())],
                                          names=["id", "_key", "places"])

    held, now = [], None
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and bucket != now:
                yield told(held)
                held = []
            now = bucket
            held.append(row)
    if held:
        yield told(held)


def _kept(batches):
    for whole in batches:
        for batch in slices(whole, most=SLICE):
            names = batch.schema.names
            out = []
            for text, places in zip(batch.column(names.index("text")).cast(pa.binary()).to_pylist(),
                                    batch.column(names.index("places")).to_pylist(), strict=True):
                words = (text or b"").split()
                spans = []
                if places:
                    at = np.frombuffer(places, np.uint32).astype(np.int64)
                    cut = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + LENGTH]))
                    spans = list(zip(at[cut].tolist(), (at[np.append(cut[1:], len(at)) - 1] + LENGTH).tolist(), strict=True))
                kept, last = [], 0
                for a, b in spans:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                out.append((len(words), len(words) - len(kept), [{"low": a, "high": b} for a, b in spans], b" ".join(kept)))
            if out:
                n, gone, spans, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index("doc_id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def repeated_windows(rows: DataFrame, shelf: Shelf) -> DataFrame:
    """(id, _key, places): first words of windows that also start elsewhere, as 32-bit numbers in order."""
    found = shelf.put(rows.mapInArrow(_anchored, "anchor long, id long, _key long, low int, high int"), "anchors")
    # Written, so that both sides of the join are plain shuffles, whose skewed parts Spark can split.
    often = shelf.put(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    ranges = shelf.put(found.join(often, "anchor").select("id", "_key", "low", "high", "often"), "ranges")
    shelf.drop(found, often)
    total = ranges.agg(F.sum(F.col("high") - F.col("low"))).first()[0] or 0
    groups = max(1, -(-total // GROUP))
    wanted = ranges.groupBy("id", "_key").agg(F.collect_list(F.struct("low", "high", "often")).alias("found"))
    suffixes = rows.join(wanted, ["id", "_key"]).mapInArrow(_suffixes(groups), _GROUPED)
    answers = suffixes.repartition(groups, "grp").sortWithinPartitions("grp").mapInArrow(_subtrees(groups), _ANSWER)
    return shelf.put(answers.repartition(groups, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _by_document, "id long, _key long, places binary"), "windows")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: its words, how many lie in repeated windows, these as ``spans`` of words, and the ``kept`` text."""
    shelf = Shelf(docs.sparkSession)
    rows = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select(
        F.coalesce("doc_id", F.lit(NOBODY)).alias("id"), "_key", "text", "doc_id")
    places = repeated_windows(rows.drop("doc_id"), shelf)
    return rows.join(places, ["id", "_key"], "left").select("doc_id", "text", "places").mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, spans array<struct<low:long,high:long>>, kept string")
