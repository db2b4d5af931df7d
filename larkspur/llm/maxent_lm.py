"""A hashed maximum-entropy language model with a class-factored softmax, and counts of all rarer words below it.

Outcomes are the most frequent words of the corpus and buckets of the hashes of all other words, in classes of equal size by frequency; the
probability of an outcome is that of its class times that of the outcome in its class. Both are softmaxes over sums of rows of
hashed features: bias, last word, the word before it (skip), the last two words, and the last with the third last (skip). Words are counted
exactly over all documents.

A bucket is divided into cells by hash, more of them the larger the corpus. A word in a bucket has the bucket's probability times the cell's share of
the bucket's words times its own probability in the cell. That is interpolated from counts after the last two words, after the last word
and without context; one is taken off each count after a context, so what occurs once in the corpus predicts nothing, and what is taken off goes to the shorter context.
All words that occur in the corpus, and their contexts, count. Cells are kept apart: each is counted, and its words scored, by one task, and nothing of
them is broadcast but their sizes. In a cell, words and contexts are told apart by 32 bits of their hashes. Words that the corpus doesn't have share the probability of one occurrence.

Training goes over all documents once, in ``ROUNDS`` parts. In each, every task, one for each partition of the table, updates its own copy of the weights by sparse
gradient steps over batches of words and gives the rows it touched, with their squared gradients. Row by row, in blocks, these are averaged by the squared
gradients of the tasks that have the row, so what few tasks have seen isn't thinned out by the others, and the weights are sent out again: 6.3 MB, whatever the input.
Scoring adds log probabilities in sparse batches.

Defined results: null texts and texts without words have no words, the log probability 0 and a null perplexity; a null id is an id; rows that
repeat are scored each; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import buckets
from .words import U64, Words, mix, words_of

CLASSES, PER_CLASS, OTHER = 32, 32, 64
OUTCOMES = CLASSES * PER_CLASS
START = OUTCOMES
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 15
ROUNDS, STEP, BATCH = 3, 0.6, 8192
CELL_BYTES = 1 << 24
#: Words in buckets that a task gathers before it sends them to their cells.
HELD = 1 << 22
#: Words whose sums of rows fit a core's cache, sums of which no exponential leaves the range of floats, and how many words of a batch are few for a row.
CHUNK, SAFE, FEW = 1 << 11, 80, 4
#: Rows of a table that are averaged together, and what else a task gives: the words by bucket.
BLOCK_ROWS, BUCKETS = 512, -1


def _count(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        held = 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            u, c = np.unique(np.concatenate(waiting), return_counts=True)
            every, at = np.unique(np.concatenate([values, u]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([counts, c]), len(every)).astype(np.int64)

        for b in batches:
            for w in words_of(b.column(0)):
                waiting.append(w.hashes)
                held += len(w.hashes)
                if held > 4_000_000:
                    values, counts = fold()
                    waiting, held = [], 0
        if held:
            values, counts = fold()
        bucket = (values % U64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            o = order[edges[k] : edges[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([values[o].tobytes()], pa.binary()), pa.array([counts[o].tobytes()], pa.binary())], names=["bucket", "words", "counts"])

    return run


def _frequent(most: int):
    def run(table: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts")])
        order = np.argsort(words, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(words[order]) > 0))
        words, counts = words[order][begin], np.add.reduceat(counts[order], begin)
        top = np.lexsort((words, -counts))[:most]
        return pa.table({"word": pa.array(words[top].view(np.int64)), "n": pa.array(counts[top])})

    return run


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def vocabulary(docs: DataFrame, most: int = OUTCOMES - OTHER, size: int | None = None) -> np.ndarray:
    """The hashes of the most frequent words, most frequent first, from exact counts over all documents."""
    n = buckets(docs.sparkSession, text_bytes(docs) if size is None else size)
    counted = docs.select("text").mapInArrow(_count(n), "bucket int, words binary, counts binary")
    top = counted.groupBy("bucket").applyInArrow(_frequent(most), "word long, n long").orderBy(F.desc("n"), "word").limit(most)
    return np.array([r["word"] for r in top.collect()], np.int64).view(np.uint64)


class Outcomes:
    """From word hashes to outcomes. The last 16 bits of a hash give the only word it can be, but for words that share them with another."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.sorted = words, np.sort(words)
        self.first_other = OUTCOMES - OTHER
        self.slots = np.zeros(1 << 16, np.int16)
        self.slots[self._slot(words)] = np.arange(len(words))
        self.late = np.flatnonzero(self.slots[self._slot(words)] != np.arange(len(words)))

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes & U64(0xFFFF)).view(np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = self.first_other + (hashes & U64(OTHER - 1)).view(np.int64)  # a power of two
        if not len(self.words):
            return out
        word = self.slots.take(self._slot(hashes))
        np.copyto(out, word, where=self.words.take(word) == hashes)
        for k in self.late:
            out[hashes == self.words[k]] = k
        return out


def contexts(w: Words, outcome: np.ndarray) -> list[np.ndarray]:
    """The outcomes one, two and three words back; START before a document's first word."""
    place = np.arange(len(outcome)) - np.repeat(w.word_at[:-1], np.diff(w.word_at))
    out = []
    for k in (1, 2, 3):
        back = np.full(len(outcome), START)
        back[k:] = outcome[:-k] if len(outcome) > k else back[k:]
        out.append(np.where(place >= k, back, START))
    return out


def _row(parts: list[np.ndarray], salt: int, rows: int) -> np.ndarray:
    x = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        x = x * U64(1_000_003) + p.astype(np.uint64)
    return (mix(x) & U64(rows - 1)).view(np.int64)  # a power of two


@cache
def _rows_after_one(salt: int, rows: int, classes: int = 1) -> np.ndarray:
    """Rows of a feature of an outcome, or of an outcome and a class."""
    one, cls = np.divmod(np.arange((OUTCOMES + 1) * classes), classes)
    return _row([one, cls] if classes > 1 else [one], salt, rows)


def features(back: list[np.ndarray], cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class table and of the word table, one row of numbers for each word."""
    one, two, three = back
    single = [_rows_after_one(s, CLASS_ROWS) for s in (1, 2, 3)]
    paired = [_rows_after_one(s, WORD_ROWS, CLASSES) for s in (11, 12, 13)]
    a = [np.full(len(one), single[0][0]), single[1].take(one), single[2].take(two), *(_row(p, s, CLASS_ROWS) for s, p in ((4, [one, two]), (5, [one, three])))]
    b = [paired[0].take(cls), paired[1].take(one * CLASSES + cls), paired[2].take(two * CLASSES + cls), _row([one, two, cls], 14, WORD_ROWS)]
    return np.stack(a).T, np.stack(b).T


def _raised(z: np.ndarray, table: np.ndarray, rows: np.ndarray, safe: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What probabilities are in proportion to, and its totals, from the sums of the first rows, in place, and the other rows. Unless no sum is beyond SAFE, they are shifted first."""
    for j in range(rows.shape[1]):
        z += table.take(rows[:, j], 0)
    if safe is None:
        safe = max(z.max(initial=0), -z.min(initial=0)) <= SAFE
    if not safe:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z, np.einsum("ij->i", z)


def _probabilities(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), table.shape[1]), np.float32)
    for a in range(0, len(rows), CHUNK):
        own = rows[a : a + CHUNK]
        z, total = _raised(table.take(own[:, 0], 0), table, own[:, 1:])
        np.divide(z, total[:, None], out=out[a : a + CHUNK])
    return out


def _softmax(table: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and the logs of the targets'."""
    p = _probabilities(table, rows)
    return p, np.log(np.maximum(p[np.arange(len(p)), target], 1e-30))


def _sums(gradient: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of rows, which the order puts together: of those from each beginning to the next."""
    size = np.diff(np.append(begin, len(order)))
    total = gradient.take(order.take(begin), 0)
    at = np.flatnonzero((size > 1) & (size <= FEW))
    for k in range(1, FEW):
        total[at] += gradient.take(order.take(begin.take(at) + k), 0)
        at = at[size.take(at) > k + 1]
    many = np.flatnonzero(size > FEW)
    if len(many):
        o = order if len(many) == len(size) else order[np.repeat(size > FEW, size)]
        end = np.cumsum(size[many])
        total[many] = np.add.reduceat(gradient.take(o, 0).view(np.complex64), end - size[many], axis=0).view(np.float32)  # two numbers at a time
    return total


def _update(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray, step: float) -> None:
    """An adaptive step on the rows of each feature: its gradients are added up, and divided by the root of what it saw so far."""
    for j in range(rows.shape[1]):
        r = rows[:, j].astype(np.uint16)  # radix sort
        order = np.argsort(r, kind="stable")
        r = r.take(order)
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        total = _sums(gradient, order, begin)
        at = r[begin]
        seen = squares.take(at) + np.einsum("ij,ij->i", total, total)
        squares[at] = seen
        total *= (step / np.sqrt(seen + 1e-6))[:, None]
        table[at] = np.subtract(table.take(at, 0), total, out=total)


def steps(w: Words, outcome: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of (last outcome of each word, class, word in class, features)."""
    back = contexts(w, outcome)
    for a in range(0, len(outcome), most):
        cls, word = np.divmod(outcome[a : a + most], PER_CLASS)
        yield back[0][a : a + most], cls, word, *features([b[a : a + most] for b in back], cls)


def fresh() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, PER_CLASS), np.float32)


def train_on(columns: Iterator[pa.Array], outcomes: Outcomes, a: np.ndarray, b: np.ndarray, step: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradient steps on a copy of the weights, in place; returns the words by bucket and the squared gradients by row of each table."""
    rare, seen = np.zeros(OTHER, np.int64), [np.zeros(len(t), np.float32) for t in (a, b)]
    for column in columns:
        for w in words_of(column):
            o = outcomes.of(w.hashes)
            rare += np.bincount(o[o >= outcomes.first_other] - outcomes.first_other, minlength=OTHER)
            for _, cls, word, fa, fb in steps(w, o, BATCH):
                for table, squares, rows, target in ((a, seen[0], fa, cls), (b, seen[1], fb, word)):
                    p = _probabilities(table, rows)
                    p[np.arange(len(p)), target] -= 1
                    _update(table, squares, rows, p, step)
    return rare, seen


def _learn(shared, step: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, a0, b0 = shared.value
        a, b = a0.copy(), b0.copy()
        rare, seen = train_on((x.column(0) for x in batches), Outcomes(words), a, b, step)
        yield _given(BUCKETS, 0, rare, np.zeros(0), np.zeros(0))
        for part, (new, old, squares) in enumerate(((a, a0, seen[0]), (b, b0, seen[1]))):
            for block in range(len(new) // BLOCK_ROWS):
                own = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
                rows = np.flatnonzero(squares[own] > 0)
                if len(rows):
                    yield _given(part, block, rows.astype(np.uint16), squares[own][rows], (new[own][rows] - old[own][rows]).astype(np.float16))

    return run


def _given(part: int, block: int, rows: np.ndarray, weight: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in (("rows", rows), ("weight", weight), ("change", change))}})


def averaged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int, width: int) -> np.ndarray:
    """Of (rows, weights, changes of them) the mean change of each row, by the weights of those that have it."""
    total, weight = np.zeros((rows, width), np.float32), np.zeros(rows, np.float32)
    for at, w, change in parts:
        total[at] += w[:, None] * change
        weight[at] += w
    return total / np.where(weight > 0, weight, 1)[:, None]


def _average(width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        read = sorted(zip(*(table.column(c).to_pylist() for c in ("rows", "weight", "change")), strict=True))  # in one order, so that equal runs give equal sums
        if part == BUCKETS:
            out = sum(np.frombuffer(r, np.int64) for r, _, _ in read)
        else:
            out = averaged([(np.frombuffer(r, np.uint16), np.frombuffer(w, np.float32), np.frombuffer(c, np.float16).astype(np.float32).reshape(-1, width)) for r, w, c in read], BLOCK_ROWS, width)
        return pa.table({"part": pa.array([part], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "change": pa.array([out.tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, DataFrame]:
    """(word hashes, class table, word table, words by bucket, cells, the texts, from which the cells are counted when they are used), from all documents."""
    spark, texts = docs.sparkSession, docs.select("text")
    size = text_bytes(docs)
    words = vocabulary(docs, size=size)
    cells = OTHER * (size // (CELL_BYTES * OTHER) + 1)
    a, b = fresh()
    rare = np.zeros(OTHER, np.int64)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((words, a, b))
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        given = part.mapInArrow(_learn(shared, STEP / (1 + k / 2)), "part int, block int, rows binary, weight binary, change binary")
        for r in given.groupBy("part", "block").applyInArrow(_average(PER_CLASS), "part int, block int, change binary").collect():
            if r["part"] == BUCKETS:
                rare += np.frombuffer(r["change"], np.int64)
                continue
            at = r["block"] * BLOCK_ROWS
            (b if r["part"] else a)[at : at + BLOCK_ROWS] += np.frombuffer(r["change"], np.float32).reshape(BLOCK_ROWS, -1)
        shared.destroy()
    return words, a, b, rare, cells, texts


class Scorer:
    """Log probabilities of outcomes. What a word's first two rows add up to, by its last word and class, is added up beforehand; a word's sums don't depend on the words around it."""

    def __init__(self, outcomes: Outcomes, a: np.ndarray, b: np.ndarray) -> None:
        one, cls = np.divmod(np.arange((OUTCOMES + 1) * CLASSES), CLASSES)
        fa, fb = features([one] * 3, cls)
        fa = fa[::CLASSES]
        self.outcomes, self.tables = outcomes, (a, b)
        self.first = a.take(fa[:, 0], 0) + a.take(fa[:, 1], 0), b.take(fb[:, 0], 0) + b.take(fb[:, 1], 0)
        self.safe = [f.shape[1] * float(np.abs(t).max()) <= SAFE for f, t in ((fa, a), (fb, b))]

    def of(self, column: pa.Array, rare: Callable[[Words, np.ndarray], None] = lambda w, o: None) -> tuple[np.ndarray, np.ndarray]:
        """The words and the log probability of the outcomes of each text; rare gets the words and their outcomes."""
        n, total = np.zeros(len(column), np.int64), np.zeros(len(column))
        for w in words_of(column):
            o = self.outcomes.of(w.hashes)
            n[w.first : w.first + w.rows] = np.diff(w.word_at)
            if len(o):
                logs = np.concatenate([self._logs(*step) for step in steps(w, o, CHUNK)])
                total[w.first : w.first + w.rows] = np.bincount(w.row_of_word(), logs, w.rows)
            rare(w, o)
        return n, total

    def _logs(self, one: np.ndarray, cls: np.ndarray, word: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
        logs = np.zeros(len(one), np.float32)
        for k, (at, rows, target) in enumerate(((one, fa, cls), (one * CLASSES + cls, fb, word))):
            z, total = _raised(self.first[k].take(at, 0), self.tables[k], rows[:, 2:], self.safe[k])
            logs += np.log(np.maximum(z[np.arange(len(z)), target] / total, 1e-30))
        return logs


def log_probabilities(column: pa.Array, outcomes: Outcomes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words and the log probability of the outcomes of each text."""
    return Scorer(outcomes, a, b).of(column)


def rare_words(w: Words, outcome: np.ndarray, first_row: int = 0) -> tuple[np.ndarray, ...]:
    """Of each word in a bucket its hash, its text, and 32 bits of the hashes of the word and of the contexts of one and two words."""
    place = np.arange(len(w.hashes)) - np.repeat(w.word_at[:-1], np.diff(w.word_at))
    rare = np.flatnonzero(outcome >= OUTCOMES - OTHER)
    place, word = place[rare], w.hashes[rare]
    one, two = (np.where(place >= k, w.hashes[np.maximum(rare - k, 0)], U64(0)) for k in (1, 2))
    both = mix(one * U64(1_000_003) + two)
    return word, (first_row + w.first + w.row_of_word()[rare]).astype(np.uint32), np.stack([x >> U64(32) for x in (word, one, both)]).astype(np.uint32)


def in_cells(found: list[tuple[np.ndarray, ...]], cells: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    """(cell, its texts, the number of its words in each, the words with their contexts) of each cell of some words."""
    if not any(len(f[0]) for f in found):
        return
    hashes, row, values = (np.concatenate(x, -1) for x in zip(*found, strict=True))
    cell = (hashes % U64(cells)).astype(np.min_scalar_type(cells))  # radix sort, up to 2^16
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    for a, z in zip(begin.tolist(), np.append(begin, len(order))[1:].tolist(), strict=True):
        o = order[a:z]
        own = row[o]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        yield int(cell[a]), own[first], np.diff(np.append(first, len(o))).astype(np.uint32), values.take(o, 1).tobytes()


def _after(context: np.ndarray, word: np.ndarray, n: int, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of words after contexts, of which the first n are counted; those without the context are given."""
    key = context.astype(np.uint64) << U64(32) | word
    known, at, count = np.unique(key, return_inverse=True, return_counts=True)
    if n < len(key):
        count = np.bincount(at[:n], minlength=len(known))
    group = known >> U64(32)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    length = np.diff(np.append(begin, len(known)))
    total, kinds = np.add.reduceat(count, begin), np.add.reduceat((count > 0).astype(np.int64), begin)
    left = np.repeat(np.where(total > 0, kinds / np.maximum(total, 1), 1.0), length)
    own = np.maximum(count - 1, 0) / np.maximum(np.repeat(total, length), 1)
    return own[at[len(key) - len(shorter) :]] + left[at[len(key) - len(shorter) :]] * shorter


def in_cell(counted: np.ndarray, scored: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities in their cell of the words scored, those counted unless given; both have rows of words, last words and last two words."""
    n = counted.shape[1]
    word, one, both = counted if scored is None else np.concatenate([counted, scored], 1)
    m = n if scored is None else scored.shape[1]
    known, at = np.unique(word, return_inverse=True)
    p = np.maximum(np.bincount(at[:n], minlength=len(known)), 1)[at[len(at) - m :]] / (n + 1)
    for context in (one, both):
        p = _after(context, word, n, p)
    return np.log(p)


def _values(blocks: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros((3, 0), np.uint32), *(np.frombuffer(x.as_buffer(), np.uint32).reshape(3, -1) for x in blocks)], 1)


def _score_cell(own: bool, rare: np.ndarray, cells: int):
    """From the words of a cell to sums of their log probabilities in their bucket by text; own: the texts scored are those counted. Rows of texts go by."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names = ["batch", "place", "doc_id", "n_words", "log_prob", "rows", "sums"]
        if key[0].as_py() < 0:
            return table.rename_columns({"words": "sums"}).select(names)
        counted = None if own else _values(table.filter(pc.is_null(table.column("rows"))).column("words"))
        table = table.filter(pc.is_valid(table.column("rows")))
        sums: list[bytes] = []
        if table.num_rows:
            scored = _values(table.column("words"))
            n = (scored if own else counted).shape[1]
            share = np.log((n + 1) / (rare[key[0].as_py() % OTHER] + cells // OTHER))
            logs, at = share + (in_cell(scored) if own else in_cell(counted, scored)), 0
            for x in table.column("counts"):
                size = np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64)
                end = np.cumsum(size)
                sums.append(np.add.reduceat(logs[at : at + end[-1]], end - size).tobytes())
                at += int(end[-1])
        none = {c: pa.nulls(table.num_rows, table.schema.field(c).type) for c in ("place", "doc_id", "n_words", "log_prob")}
        return pa.table({"batch": table.column("batch")} | none | {"rows": table.column("rows"), "sums": pa.array(sums, pa.binary())})

    return run


def _add(table: pa.Table) -> pa.Table:
    """The texts of a batch with what their cells gave."""
    texts = table.filter(pc.is_valid(table.column("place"))).combine_chunks()
    given = table.filter(pc.is_null(table.column("place")))
    place = texts.column("place").to_numpy()
    total = np.zeros(int(place.max()) + 1)
    for rows, sums in sorted(zip(given.column("rows").to_pylist(), given.column("sums").to_pylist(), strict=True)):  # in one order, so that equal runs give equal sums
        total[np.frombuffer(rows, np.uint32)] += np.frombuffer(sums)
    return pa.table({"doc_id": texts.column("doc_id"), "n_words": texts.column("n_words"), "log_prob": pa.array(texts.column("log_prob").to_numpy() + total[place])})


def score(docs: DataFrame, model: tuple | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every document, by a model trained on all of them unless one is given."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = model is None
    words, a, b, rare, cells, corpus = train(slim) if own else model
    shared = docs.sparkSession.sparkContext.broadcast((words, a, b))
    doc_kind = slim.schema["doc_id"].dataType.simpleString()
    kind = f"cell int, batch long, place int, doc_id {doc_kind}, n_words long, log_prob double, rows binary, counts binary, words binary"
    names = ["cell", "batch", "place", "doc_id", "n_words", "log_prob", "rows", "counts", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, a, b = shared.value
        scorer = Scorer(Outcomes(words), a, b)
        batch, rows, held = TaskContext.get().partitionId() << 32, 0, 0
        found: list[tuple[np.ndarray, ...]] = []
        aside = lambda n: [pa.nulls(n, pa.binary())] * 3

        def keep(w: Words, outcome: np.ndarray) -> None:
            nonlocal held
            found.append(rare_words(w, outcome, rows))
            held += len(found[-1][0])

        for x in batches:
            n, total = scorer.of(x.column(1), keep)
            m = x.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, -1 - batch % cells), pa.int32()), pa.array(np.full(m, batch)), pa.array(np.arange(rows, rows + m), pa.int32()), x.column(0), pa.array(n), pa.array(total), *aside(m)], names=names)
            rows += m
            if held >= HELD:
                yield from sent(found, batch)
                batch, rows, held, found = batch + 1, 0, 0, []
        if held:
            yield from sent(found, batch)

    def sent(found: list[tuple[np.ndarray, ...]], batch: int) -> Iterator[pa.RecordBatch]:
        for cell, rows, counts, values in in_cells(found, cells):
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([batch]), pa.nulls(1, pa.int32()), pa.nulls(1, id_kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), *(pa.array([c], pa.binary()) for c in (rows.tobytes(), counts.tobytes(), values))], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outcomes = Outcomes(shared.value[0])
        for x in batches:
            found = [rare_words(w, outcomes.of(w.hashes)) for w in words_of(x.column(0))]
            for cell, _, _, values in in_cells(found, cells):
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([values], pa.binary())], names=["cell", "words"])

    id_kind = to_arrow_type(slim.schema["doc_id"].dataType)
    parts = slim.mapInArrow(run, kind)
    if not own:
        parts = parts.unionByName(corpus.mapInArrow(count, "cell int, words binary"), allowMissingColumns=True)
    sums = parts.groupBy("cell").applyInArrow(_score_cell(own, rare, cells), f"batch long, place int, doc_id {doc_kind}, n_words long, log_prob double, rows binary, sums binary")
    scored = sums.groupBy("batch").applyInArrow(_add, f"doc_id {doc_kind}, n_words long, log_prob double")
    return scored.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_prob") / F.col("n_words"))))
