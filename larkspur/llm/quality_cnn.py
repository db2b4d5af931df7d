"""A byte-level convolutional quality classifier in numpy.

Bytes fall into 128 classes (ASCII as it is, others folded). Filters of ``WIDTH`` bytes slide over every position of the whole
document; positions are taken in chunks that overlap by a filter's width, so no window is lost. Each filter is max-pooled within its
chunk; the maximum over chunks and the mean over chunks are combined by a logistic unit into one probability. A
convolution is four lookups of rows in tables indexed by pairs of classes.

Two thirds of the filters start as byte strings that tell the classes apart in the training sample, the others at random, and all are
learned by back-propagation through the maxima. The sample is bounded: at most ``TRAIN_DOCS`` labelled documents,
taken in the order of a hash of their id, and of their strings the ``STRINGS`` that tell most are looked at. A document is good if its quality is 1
and it isn't toxic. One task trains on the sample; only the weights, some 200 kB, go to the driver and from there to all tasks.

Defined results: null and empty texts have the probability 0 and are not kept; labels that are null or without document are not
used; of repeated labels of a document any bad one makes it bad; of documents with one id at most ``TRAIN_DOCS`` rows are trained on; without labelled
documents of both kinds every document with text has the probability 0.5 and is kept; other columns pass through, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name
from .words import text_buffers

WIDTH, FILTERS, CHUNK, CLASSES = 8, 48, 512, 128
TRAIN_DOCS, EPOCHS, BATCH, RATE, SEED_LENGTH, STRINGS = 3000, 6, 32, 0.01, 5, 6000
#: The strings of the sample are counted in so many parts, so that only a part of them is sorted at once.
SORTED_PARTS = 8
#: A document is kept at this probability or above.
KEEP = 0.4

_CLASS = np.array([b if b < 128 else 14 + b % 18 for b in range(256)], np.int32)


def chunks_of(length: int) -> list[tuple[int, int]]:
    """Ranges of positions; the windows of one overlap those of the next."""
    return [(a, min(a + CHUNK, length)) for a in range(0, length, CHUNK)]


def brevity(length: int) -> np.ndarray:
    """1, and how far short of a chunk the document falls: a few words can't fire many filters."""
    x = max(0.0, 1 - length / CHUNK)
    return np.array([1, x, x**4, x**16], np.float32)


class Model:
    """Filters w of shape (WIDTH, CLASSES, FILTERS), their biases, and the weights of the two pooled vectors and of brevity."""

    def __init__(self, w: np.ndarray, bias: np.ndarray, top: np.ndarray, mean: np.ndarray, short: np.ndarray, constant: bool = False) -> None:
        self.w, self.bias, self.top, self.mean, self.short, self.constant = w, bias, top, mean, short, constant
        self._pairs: list[np.ndarray] | None = None

    def pairs(self) -> list[np.ndarray]:
        if self._pairs is None:
            self._pairs = [(self.w[j][:, None] + self.w[j + 1][None]).reshape(CLASSES * CLASSES, -1) for j in range(0, WIDTH, 2)]
            self._pairs[0] = self._pairs[0] + self.bias
        return self._pairs

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pairs": None}

    def pooled(self, raw: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The maxima of each chunk, and with ``where`` their positions."""
        tables = self.pairs()
        cls = np.zeros(len(raw) + WIDTH, np.int32)
        cls[: len(raw)] = _CLASS[raw]
        pair = cls[:-1] * CLASSES + cls[1:]
        parts = chunks_of(len(raw))
        best = np.empty((len(parts), self.w.shape[2]), np.float32)
        at = np.empty(best.shape, np.int64) if where else None
        for k, (a, b) in enumerate(parts):
            out = tables[0].take(pair[a:b], 0)
            for j in (1, 2, 3):
                out += tables[j].take(pair[a + 2 * j : b + 2 * j], 0)
            if where:
                p = out.argmax(0)
                at[k] = p + a
                best[k] = out[p, np.arange(out.shape[1])]
            else:
                out.max(0, out=best[k])
        return np.maximum(best, 0), at

    def probability(self, raw: np.ndarray) -> float:
        if not len(raw):
            return 0.0
        if self.constant:
            return 0.5
        best, _ = self.pooled(raw)
        z = float(best.max(0) @ self.top + best.mean(0) @ self.mean + brevity(len(raw)) @ self.short)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _tellers(texts: list[np.ndarray], good: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the strings that tell bad documents from good ones best, their worth, and which of the bad documents have them."""
    power = (np.uint64(CLASSES) ** np.arange(length, dtype=np.uint64))[::-1]
    parts: list[list[np.ndarray]] = [[] for _ in range(SORTED_PARTS)]
    owners: list[list[np.ndarray]] = [[] for _ in range(SORTED_PARTS)]
    for d, raw in enumerate(texts):
        c = _CLASS[raw].astype(np.uint64)
        if len(c) >= length:
            u = np.unique(sum(c[j : len(c) - length + 1 + j] * power[j] for j in range(length)))
            part = u % np.uint64(SORTED_PARTS)
            for p in range(SORTED_PARTS):
                own = u[part == p]
                parts[p].append(own)
                owners[p].append(np.full(len(own), d, np.int32))
    n_bad, n_good = int((~good).sum()), int(good.sum())
    best: list[tuple[np.ndarray, ...]] = []
    has: list[tuple[np.ndarray, np.ndarray]] = []
    for p in range(SORTED_PARTS):
        code, owner = np.concatenate([np.zeros(0, np.uint64), *parts[p]]), np.concatenate([np.zeros(0, np.int32), *owners[p]])
        parts[p] = owners[p] = []
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        if not len(begin):
            continue
        g = np.add.reduceat(good[owner].astype(np.int64), begin)
        b = np.diff(np.append(begin, len(code))) - g
        rate_b, rate_g = (b + 0.2) / (n_bad + 1), (g + 0.2) / (n_good + 1)
        worth = np.log(rate_b / rate_g)
        score = np.where(b * (n_good + 1) > g * (n_bad + 1), (rate_b - rate_g) * worth, -1.0)
        pick = np.argsort(-score, kind="stable")[:most]
        pick = pick[score[pick] > 0]
        best.append((code[begin[pick]], worth[pick], score[pick]))
        has += [(owner[begin[k] : begin[k] + b[k] + g[k]].copy(), code[begin[k]]) for k in pick]
    if not best:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, n_bad), bool)
    codes, worth, score = (np.concatenate(x) for x in zip(*best, strict=True))
    pick = np.lexsort((codes, -score))[:most]
    of_bad, there = np.where(good, -1, np.cumsum(~good) - 1), np.zeros((len(pick), n_bad), bool)
    for row, k in enumerate(pick):
        at = of_bad[has[k][0]]
        there[row, at[at >= 0]] = True
    return codes[pick], worth[pick], there


def seeds(texts: list[np.ndarray], good: np.ndarray, many: int, length: int = SEED_LENGTH, most: int = STRINGS) -> list[bytes]:
    """Byte strings that tell bad documents from good ones, chosen one by one to cover bad documents that the others don't."""
    codes, worth, has = _tellers(texts, good, length, most)
    if not len(codes):
        return []
    need, out = np.ones(has.shape[1]), []
    covers = np.concatenate([has[a : a + 256] @ need for a in range(0, len(has), 256)])  # in parts: a product makes doubles of its bits
    while len(out) < min(many, len(codes)):
        gain = covers * worth
        k = int(gain.argmax())
        if gain[k] <= 0:
            break
        touched = np.flatnonzero(has[k])
        for a in range(0, len(has), 256):
            covers[a : a + 256] -= has[a : a + 256, touched] @ (need[touched] * 0.5)
        need[touched] *= 0.5
        worth[k] = 0
        s = bytes(int(codes[k] // np.uint64(CLASSES) ** np.uint64(j) % np.uint64(CLASSES)) for j in reversed(range(length)))
        if not any(s[i:] == o[: length - i] or o[i:] == s[: length - i] for o in out for i in (0, 1, 2)):
            out.append(s)
    return out


def train(texts: list[np.ndarray], good: np.ndarray, epochs: int = EPOCHS, filters: int = FILTERS, seed: int = 1) -> Model:
    """Adam over small batches of whole documents; gradients flow through the positions of the maxima."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 0.15, (WIDTH, CLASSES, filters)).astype(np.float32)
    bias = np.zeros(filters, np.float32)
    top, mean = np.zeros(filters, np.float32), np.zeros(filters, np.float32)
    for f, s in enumerate(seeds(texts, good, filters * 2 // 3)):
        w[:, :, f] *= 0.1
        for j, c in enumerate(s):
            w[j + 1, c, f] = 1
        bias[f] = 1.5 - len(s)
        top[f] = -1
    short = np.array([2, 0, 0, 0], np.float32)
    model = Model(w, bias, top, mean, short, constant=not good.any() or good.all())
    if model.constant:
        return model
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (~good).mean()) ** 0.5
    params = {"w": w, "bias": bias, "top": top, "mean": mean, "short": short}
    m1, m2, t = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    fs = np.arange(filters)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(order), BATCH):
            grad = {k: np.zeros_like(v) for k, v in params.items()}
            for d in order[a : a + BATCH]:
                raw = texts[d]
                if not len(raw):
                    continue
                best, at = model.pooled(raw, where=True)
                k = best.argmax(0)
                m, mu = best[k, fs], best.mean(0)
                z = float(m @ top + mu @ mean + brevity(len(raw)) @ short)
                dz = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - good[d]) * weight[d] / BATCH
                grad["top"] += dz * m
                grad["mean"] += dz * mu
                grad["short"] += dz * brevity(len(raw))
                flow = np.broadcast_to(dz * mean / len(best), best.shape).copy()
                flow[k, fs] += dz * top
                flow *= best > 0
                grad["bias"] += flow.sum(0)
                cls = np.zeros(len(raw) + WIDTH, np.int32)
                cls[: len(raw)] = _CLASS[raw]
                for j in range(WIDTH):
                    index = cls[at + j] * filters + fs
                    grad["w"][j] += np.bincount(index.ravel(), flow.ravel(), CLASSES * filters).reshape(CLASSES, filters).astype(np.float32)
            t += 1
            for k, v in params.items():
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.99 * m2[k] + 0.01 * grad[k] ** 2
                v -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)
            model = Model(w, bias, top, mean, short)
    return model


def _trained(epochs: int):
    """One row with the weights, or none without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, t, bad) for b in batches for d, t, bad in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if rows:
            model = train([np.frombuffer(t.encode(), np.uint8) for _, t, _ in rows], np.array([not bad for _, _, bad in rows], bool), epochs)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, epochs: int = EPOCHS) -> Model:
    """Train on at most ``most`` labelled documents, chosen by a hash of their id, in one task."""
    sure = labels.where("doc_id is not null and quality is not null")
    bad = F.max(((F.col("quality") != 1) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int"))
    first = [F.xxhash64("doc_id"), "doc_id"]
    chosen = sure.groupBy("doc_id").agg(bad.alias("bad")).orderBy(*first).limit(most)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").orderBy(*first, "text").limit(most)
    found = rows.select("doc_id", "text", "bad").mapInArrow(_trained(epochs), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros(0, bool))


def score(docs: DataFrame, model: Model, name: str = "probability") -> DataFrame:
    """The documents with their probability of being good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        at, raw = text_buffers(column)
        return pa.array([shared.value.probability(raw[at[k] : at[k + 1]]) for k in range(len(column))], pa.float64())

    return docs.withColumn(name, probability(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, probability, kept) of every document."""
    return score(docs.select("doc_id", "text"), fit(docs, labels, most)).select("doc_id", "probability", (F.col("probability") >= keep).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, most: int = TRAIN_DOCS) -> DataFrame:
    """The documents of at least that probability, with all their columns."""
    name = free_name(docs, "probability")
    return score(docs, fit(docs, labels, most), name).where(F.col(name) >= keep).select(*docs.columns)
