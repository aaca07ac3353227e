"""Operator 10: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input has a word channel (how surely the word itself marks toxic texts) and three character
channels (the surest of its character 3-, 4- and 5-grams, word ends marked), all measured on the training
sample. Two gated recurrent layers read a window of WINDOW words forwards and backwards, attention pools
their states, and a logistic unit scores the pooled state. Every text is scored whole: windows overlap by half,
and a document's score is that of its worst window. In training a toxic document counts through its worst
window so far, a clean one through all that look worst.

The sample is bounded: SAMPLE documents of either label, those with the least hashes of ``doc_id`` among
rows that may be learnt from (crc32 of ``doc_id`` mod 4 is not 2). One task trains on it; scoring is spread.

Null and empty texts are windows without words and get the score of such a window. A null ``doc_id`` is scored and
counts as not held out. Repeated rows are scored alike. Only ``doc_id`` and ``text`` are read. Without labels of both
kinds every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import apart, release, slices

WINDOW = 32
STRIDE = 16
HIDDEN = 8
ATTENTION = 8
SAMPLE = 3000
"""Training documents of either label."""
THRESHOLD = 0.3
BATCH = 128
EPOCHS, STEPS = 12, 900
"""Training goes on for so many rounds over the sample, and so many steps, at least."""
REMEMBERED = 300_000
"""Words whose inputs a task remembers."""

_WORD = re.compile(r"\w+")
GRAMS = (3, 4, 5)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Weights, and how sure each word and character n-gram is (channel 0: words, 1..: GRAMS)."""

    weights: dict[str, np.ndarray]
    sure: list[dict[str, float]]
    ids: dict[str, int] = field(default_factory=dict)
    table: list[tuple[float, ...]] = field(default_factory=lambda: [(0.0,) * (1 + len(GRAMS))])
    rows: dict[tuple[float, ...], int] = field(default_factory=lambda: {(0.0,) * (1 + len(GRAMS)): 0})

    def input_of(self, word: str) -> tuple[float, ...]:
        return (self.sure[0].get(word, 0.0),
                *(max((g.get(x, 0.0) for x in _grams(word, n)), default=0.0) for n, g in zip(GRAMS, self.sure[1:], strict=True)))

    def encode(self, words: list[str]) -> np.ndarray:
        """Each word as the number of its input; words with equal inputs share one, 0 for none of the channels."""
        ids = self.ids
        for word in set(words).difference(ids):
            x = self.input_of(word)
            if x not in self.rows:
                self.rows[x] = len(self.table)
                self.table.append(x)
            ids[word] = self.rows[x]
        return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))

    def forget(self) -> None:
        """Drop what was remembered of words; numbers given out before are void."""
        self.ids.clear()
        del self.table[1:]
        self.rows.clear()
        self.rows[self.table[0]] = 0

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        return np.array(self.table, np.float32)[ids]


def blocks_of(ids: np.ndarray) -> np.ndarray:
    """The words in rows of STRIDE, two rows at least, zeros after the last; two rows in turn make a window."""
    n = max(2, -(-len(ids) // STRIDE))
    out = np.zeros(n * STRIDE, np.int32)
    out[:len(ids)] = ids
    return out.reshape(n, STRIDE)


def initial(rng: np.random.Generator, width: int) -> dict[str, np.ndarray]:
    w = {}
    for side in "fb":
        w[f"x{side}"] = rng.normal(0, 0.5, (width, 3 * HIDDEN))
        w[f"h{side}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        w[f"c{side}"] = np.zeros(3 * HIDDEN)
    w["a"] = rng.normal(0, 0.5, (2 * HIDDEN, ATTENTION))
    w["v"] = rng.normal(0, 0.5, ATTENTION)
    w["o"] = rng.normal(0, 0.5, 2 * HIDDEN)
    w["k"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w: dict[str, np.ndarray], side: str, x: np.ndarray, keep: list | None) -> np.ndarray:
    """States (batch, time, HIDDEN) of one direction; ``keep`` gets what the backward pass needs."""
    at = x @ w[f"x{side}"] + w[f"c{side}"]
    u, h = w[f"h{side}"], np.zeros((len(x), HIDDEN), np.float32)
    out = np.empty((*x.shape[:2], HIDDEN), np.float32)
    for t in range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1):
        gates = _sigmoid(at[:, t, :2 * HIDDEN] + h @ u[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(at[:, t, 2 * HIDDEN:] + (r * h) @ u[:, 2 * HIDDEN:])
        if keep is not None:
            keep.append((t, h, z, r, n))
        h = h + z * (n - h)
        out[:, t] = h
    return out


def forward(w: dict[str, np.ndarray], x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window of inputs (batch, time, channel)."""
    runs: dict[str, list | None] = {s: [] if keep is not None else None for s in "fb"}
    states = np.concatenate([_run(w, s, x, runs[s]) for s in "fb"], axis=2)
    u = np.tanh(states @ w["a"])
    e = u @ w["v"]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    alpha = e / e.sum(axis=1, keepdims=True)
    pooled = (alpha[:, :, None] * states).sum(axis=1)
    if keep is not None:
        keep.update(runs=runs, states=states, u=u, alpha=alpha, pooled=pooled)
    return pooled @ w["o"] + w["k"]


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0
              ) -> tuple[float, dict[str, np.ndarray]]:
    """Mean weighted logistic loss and its gradient by backpropagation through time."""
    keep: dict = {}
    logit = forward(w, x, keep)
    p = _sigmoid(logit)
    loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
    d = (weight * (p - y) / len(y)).astype(np.float32)
    states, u, alpha, pooled = (keep[k] for k in ("states", "u", "alpha", "pooled"))
    g = {"o": pooled.T @ d, "k": np.array([d.sum()])}
    dpool = d[:, None] * w["o"]
    dstates = alpha[:, :, None] * dpool[:, None, :]
    dalpha = (states * dpool[:, None, :]).sum(axis=2)
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("bt,btk->k", de, u)
    du = de[:, :, None] * w["v"] * (1 - u * u)
    g["a"] = np.einsum("bth,btk->hk", states, du)
    dstates = dstates + du @ w["a"].T
    for i, side in enumerate("fb"):
        wh = w[f"h{side}"]
        gx, gh, gc = (np.zeros_like(w[f"{k}{side}"]) for k in "xhc")
        dh = np.zeros((len(x), HIDDEN), np.float32)
        for t, h, z, r, n in reversed(keep["runs"][side]):
            dh = dh + dstates[:, t, i * HIDDEN:(i + 1) * HIDDEN]
            dn = dh * z * (1 - n * n)
            drh = dn @ wh[:, 2 * HIDDEN:].T
            dgates = np.concatenate([dh * (n - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
            gh[:, :2 * HIDDEN] += h.T @ dgates
            gh[:, 2 * HIDDEN:] += (r * h).T @ dn
            both = np.concatenate([dgates, dn], axis=1)
            gx += x[:, t].T @ both
            gc += both.sum(axis=0)
            dh = dh * (1 - z) + drh * r + dgates @ wh[:, :2 * HIDDEN].T
        g |= {f"x{side}": gx, f"h{side}": gh, f"c{side}": gc}
    return loss, g


def _sureness(docs: list[tuple[set[str], int]]) -> list[dict[str, float]]:
    """Per channel: a cautious log odds (2.5 standard errors less) of being in a toxic text, where above zero."""
    out = []
    for n in (0, *GRAMS):
        seen = (Counter(), Counter())
        for words, y in docs:
            seen[y].update(words if not n else {g for x in words for g in _grams(x, n)})
        total = [max(1, sum(y == k for _, y in docs)) for k in (0, 1)]
        scale = math.log(total[0] / total[1])
        sure = {}
        for item, p in seen[1].items():
            q = seen[0][item]
            s = math.log((p + 0.5) / (q + 0.5)) + scale - 2.5 * math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
            if s > 0:
                sure[item] = s
        out.append(sure)
    return out


def train(texts: list[str | None], toxic: list[int], seed: int = 7) -> Network | None:
    """A network fitted to labelled texts; None when a label is missing."""
    if len(set(toxic)) < 2:
        return None
    split = [words_of(t) for t in texts]
    net = Network({}, _sureness([(set(x), y) for x, y in zip(split, toxic, strict=True)]))
    blocks = [blocks_of(net.encode(x)) for x in split]
    windows = [np.concatenate([b[:-1], b[1:]], axis=1) for b in blocks]
    table = np.array(net.table, np.float32)
    rng = np.random.default_rng(seed)
    w = net.weights = initial(rng, table.shape[1])
    y = np.array(toxic, np.float32)
    chosen = [a[np.argmax(table[a].sum(axis=(1, 2)))] for a in windows]
    m, s, step = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2)), {}, 0
    m, s = m
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(y)))
    weight = len(y) / 2 / np.array([(y == 0).sum(), (y == 1).sum()], np.float32)  # either label counts for half
    for epoch in range(epochs):
        if epoch in (epochs // 3, 2 * epochs // 3):  # the worst window by the network so far
            flat = np.concatenate(windows)
            busy = np.flatnonzero(flat.any(axis=1))
            logit = np.full(len(flat), float(forward(w, table[np.zeros((1, WINDOW), int)])[0]), np.float32)
            for i in range(0, len(busy), 8192):
                logit[busy[i:i + 8192]] = forward(w, table[flat[busy[i:i + 8192]]])
            at = np.concatenate([[0], np.cumsum([len(a) for a in windows])])
            chosen = [flat[a + int(np.argmax(logit[a:b]))] for a, b in zip(at[:-1], at[1:], strict=True)]
        x = np.array(chosen)
        # A window without any marked word stands for the many that clean texts have.
        x, labels = np.concatenate([x, np.zeros((max(1, len(x) // 20), WINDOW), x.dtype)]), np.concatenate(
            [y, np.zeros(max(1, len(x) // 20), np.float32)])
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            some = order[i:i + BATCH]
            _, g = gradients(w, table[x[some]], labels[some], weight[labels[some].astype(int)])
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - 0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def score_texts(net: Network | None, texts: list[str | None]) -> np.ndarray:
    """The worst window's score of each text. Windows of words that no channel knows have one common score, computed once."""
    if net is None:
        return np.zeros(len(texts))
    if len(net.ids) > REMEMBERED:
        net.forget()
    split = [words_of(t) for t in texts]
    ids = net.encode([x for words in split for x in words])
    ends = np.cumsum([len(x) for x in split])
    blocks = [blocks_of(ids[e - len(x):e]) for e, x in zip(ends.tolist(), split, strict=True)]
    table = np.array(net.table, np.float32)
    out = np.full(len(texts), float(_sigmoid(forward(net.weights, table[np.zeros((1, WINDOW), int)]))[0]))
    rows, owner = [], []
    for i, b in enumerate(blocks):
        marked = b.any(axis=1)
        if marked.any():
            at = np.flatnonzero(marked[:-1] | marked[1:])
            quiet = len(at) < len(b) - 1
            rows.append(np.concatenate([b[at], b[at + 1]], axis=1))
            owner.append(np.full(len(at), i))
            if not quiet:
                out[i] = 0.0
    if rows:
        flat, own = np.concatenate(rows), np.concatenate(owner)
        for i in range(0, len(flat), 8192):
            np.maximum.at(out, own[i:i + 8192], _sigmoid(forward(net.weights, table[flat[i:i + 8192]])).astype(float))
    return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network of a bounded labelled sample, trained in one task; what comes back has a size of its own, not the data's."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = marks.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").where(~held_out(F.col("doc_id")))
    rank = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        some = usable.where(F.col("toxic") == y).orderBy(rank, "doc_id").limit(SAMPLE)
        picked = some if picked is None else picked.unionByName(some)
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(frames):
        pdf = pd.concat(list(frames)).sort_values("doc_id")
        net = pickle.dumps(train(pdf["text"].tolist(), pdf["toxic"].tolist()))
        del pdf
        yield pd.DataFrame({"net": [net]})
        release()

    got = sample.coalesce(1).mapInPandas(run, "net binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else None


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with ``score`` (double) beside their columns; the rest of a row passes through untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    fields = docs.select("*", F.lit(0.0).alias("_score")).schema

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                scores = score_texts(shared.value, batch.column(batch.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "_score"])
        if shared.value is not None:
            shared.value.forget()  # the worker goes on to other tasks
        release()

    return docs.mapInArrow(run, fields)


def keep_clean(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` without those that score THRESHOLD or more."""
    docs, names = apart(docs)
    return score(docs, net).where(F.col("_score") < THRESHOLD).drop("_score").toDF(*names)
