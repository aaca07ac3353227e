"""Operator 8: multipart credential linking.

Certain spans (keyword assignments, access identifiers, long hex runs) stand on their own. Weak
candidates (bare identifiers, unlabelled keys, endpoints) are reported only when the parts that complete
them occur within the same scope: an interval join of identifiers, secrets and endpoints in one document.

Null and empty texts have no spans. Offsets are code points, the end exclusive. Rows that repeat are
judged one by one and alike; a null ``doc_id`` is kept. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Shelf, apart, release, slices

SCOPE = 400
"""Code points that two parts of one credential may lie apart."""

KINDS = ["assign", "access", "hex", "identifier", "key", "endpoint"]

_ASSIGN = re.compile(
    r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# Weak parts: kind, pattern.
_IDENTIFIER = re.compile(
    r"""(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}|(?ai:\b(?:client_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,})""")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,88}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(
    r"""(?a:\b(?:https?|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,}|\b(?:[a-z0-9-]+\.)+amazonaws\.com\b|\b\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}\b)""")
# What a text must hold before the patterns above can match.
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{16}")
_PORT = re.compile(r"[0-9]:[0-9]")
_KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
_NAMES = ["client", "user", "login", "account"]

_SPAN = pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32())])


def _random_like(word: str) -> bool:
    """Digits beside letters of both cases, and at least 3.5 bits a character."""
    if not (re.search("[0-9]", word) and re.search("[a-z]", word) and re.search("[A-Z]", word)):
        return False
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values()) >= 3.5


def parts_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the spans that need no partner, and of the weak candidates that overlap none of them.

    Plain substring tests come first: most texts hold nothing that a pattern could match.
    """
    low = text.lower()
    long_run = bool(_LONG_RUN.search(text))
    certain, weak = [], []
    if any(word in low for word in _KEYWORDS):
        certain += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if long_run:
        certain += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        certain += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        weak += [(m.start(), 4, m.end()) for m in _KEY.finditer(text) if _random_like(m.group())]
    if long_run or any(word in low for word in _NAMES):
        weak += [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)]
    if "://" in text or ".amazonaws.com" in text or _PORT.search(text):
        weak += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    certain.sort()
    return certain, [x for x in sorted(weak) if not any(a < x[2] and x[0] < b for a, _, b in certain)]


_SCANNED = ("row long, doc_id long, digest string, certain string, n_assign long, n_access long, n_hex long, "
            "base_sha256 string, parts array<struct<kind:tinyint,start:int,end:int>>, weak boolean")
_FIELDS = {"row": pa.int64(), "doc_id": pa.int64(), "digest": pa.string(), "certain": pa.string(), "n_assign": pa.int64(),
           "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "parts": pa.list_(_SPAN), "weak": pa.bool_()}


def _scan(batches):
    row = TaskContext.get().partitionId() << 33
    for whole in batches:
        for batch in slices(whole):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                certain, weak = parts_of(text)
                kinds = [k for _, k, _ in certain]
                said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in certain)
                parts = [{"kind": k, "start": s, "end": e} for s, k, e in sorted(certain + weak)] if weak else []
                out.append((row, doc_id, hashlib.md5(text.encode(errors="replace")).hexdigest(), said, kinds.count(0), kinds.count(1),
                            kinds.count(2), hashlib.sha256(said.encode()).hexdigest(), parts, bool(weak)))
                row += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FIELDS.values(), strict=True)], names=list(_FIELDS))
    release()


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: certain spans as text, and all parts where the document holds a weak candidate."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan, _SCANNED)


def linked_spans(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end) of weak parts whose complement lies within :data:`SCOPE`.

    An identifier needs a secret, a key an identifier, an endpoint both. The join is on the document and
    a bin of SCOPE code points, of which a long part has several; a bin holds few parts, as parts of one kind do not overlap.
    """
    parts = scanned.where("weak").select("row", F.explode("parts").alias("p")).select("row", "p.*").withColumn(
        "role", F.when(F.col("kind").isin(1, 3), "identifier").when(F.col("kind").isin(0, 2, 4), "secret").otherwise("endpoint"))
    near = parts.select(
        F.col("row"), F.col("role").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"),
        F.explode(F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE))).alias("bin"))
    mine = parts.where("kind >= 3").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))))
    met = mine.join(near, ["row", "bin"]).where(
        (F.col("role") != F.col("other")) & (F.col("s") <= F.col("end") + SCOPE) & (F.col("e") >= F.col("start") - SCOPE))
    return (
        met.groupBy("row", "kind", "start", "end")
        .agg(F.bool_or(F.col("other") == "identifier").alias("i"), F.bool_or(F.col("other") == "secret").alias("s"))
        .where("(kind = 3 AND s) OR (kind = 4 AND i) OR (kind = 5 AND i AND s)")
        .select("row", "kind", "start", "end"))


def _written(parts: Column) -> Column:
    kind = lambda p: F.element_at(F.array(*[F.lit(k) for k in KINDS]), p["kind"].cast("int") + 1)
    return F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat_ws(
        ":", kind(p), p["start"].cast("string"), p["end"].cast("string"))), ",")


def with_links(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``spans`` (all, written ``kind:start:end``) and ``n_linked``, how many of them partners brought in."""
    part = lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))
    added = linked_spans(scanned).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    certain = F.transform(F.filter("parts", lambda p: p["kind"] < 3), part)
    return scanned.join(added, "row", "left").select(
        *scanned.columns,
        F.when(F.col("added").isNull(), F.col("certain")).otherwise(_written(F.concat(certain, "added"))).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_linked"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with its spans; what :func:`with_links` returns."""
    return with_links(Shelf(docs.sparkSession).put(scan(docs), "secrets"))


BROADCAST_ROWS = 100_000
"""Rows of (digest, spans) up to which they are sent to all tasks; more are joined by a shuffle."""


def _redact(batches):
    for batch in batches:
        texts, at = [], batch.schema.get_field_index("text")
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
            if text and spans:
                cuts = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(","))]
                out, done = [], 0
                for s, e, k in cuts:
                    if s >= done:
                        out += [text[done:s], f"[{k}]"]
                    done = max(done, e)
                text = "".join([*out, text[done:]])
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "_spans"]
        yield pa.RecordBatch.from_arrays([columns[i] for i in keep], names=[batch.schema.names[i] for i in keep])
    release()


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each reported span replaced by its kind in brackets; all rows and columns stay."""
    docs, names = apart(docs)
    found = find_secrets(docs).where("spans <> ''").groupBy("digest").agg(F.min("spans").alias("_spans"))
    found = Shelf(docs.sparkSession).put(found, "spans")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    joined = docs.withColumn("_digest", digest).join(side.withColumnRenamed("digest", "_digest"), "_digest", "left")
    return joined.select(*docs.columns, "_spans").mapInArrow(_redact, docs.schema).toDF(*names)
