"""Substring deduplication: windows of words that occur more than once, found behind a count-min prefilter.

Every window of ``window`` consecutive words of every document counts. A window's key is the least hash of the
``window - span + 1`` runs of ``span`` words in it, so equal windows have equal keys, and consecutive windows mostly share
one. Pass 1 sketches how often each key is selected. Keys are spread over buckets by hash, as many as the corpus needs; in each the sketches of all partitions are added
up, with ``CELLS_PER_KEY`` cells for each key of the bucket, and tell which of its keys are estimated at two or more. So nothing of the sketch is broadcast or on the driver,
and it filters as well at any size. Sketches only overestimate, and all
ties of a least hash are counted, so a window that repeats anywhere has a key estimated at two or more: none is lost.
Pass 2 joins the places of such keys to their documents, reads the windows there and groups them by 96 bits of hash of their words. Windows repeated
within one map task are settled there, and only the first of each goes on, so that a passage in very many documents
sends no more than one row a task.

The first occurrence of a window, by (doc_id, hash of text, position), is kept, every other one is a repeat. Defined results:
null and empty texts and texts of fewer words than a window have no windows; a null doc_id sorts first and is one with the least long; ids that aren't integers are a TypeError; rows equal in both
doc_id and text count as one document; of text that repeats itself with some period, one period stays; other columns are ignored by
:func:`repeated_spans` and passed through by :func:`remove_repeats`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import NULL_ID, buckets, discard, free_name, integer_id, store
from .words import U64, mix, sliding, words_of

WINDOW, SPAN = 50, 26
#: Cells for each key in a row of the sketch, and its rows.
CELLS_PER_KEY, ROWS = 8, 2
#: Runs of windows that a task gathers before it sends them.
RUNS = 1 << 21
_B2 = 0xA24BAED4963EE407

SPAN_TYPE = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("kept", pa.bool_()), ("s", pa.int32()), ("e", pa.int32())])


def _keys(w, window: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window, and whether the window lies in one row."""
    whole = w.whole(window)
    if not whole.any():
        return np.zeros(len(whole), np.uint64), whole
    return sliding(w.grams(span), window - span + 1, np.minimum), whole


def _selected(w, keys: np.ndarray, whole: np.ndarray, window: int, span: int) -> np.ndarray:
    """The hashes of the selected runs of words, once for each place where one is the least of some window."""
    grams, width = w.grams(span), window - span + 1
    most = np.where(whole, keys, U64(0))
    pad = np.zeros(width - 1, np.uint64)
    cover = sliding(np.concatenate([pad, most, pad]), width, np.maximum)
    return grams[(cover == grams) & (cover > 0)]


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(keys ^ U64(0x5851F42D4C957F2D * (row + 1) & (1 << 64) - 1)) >> U64(64 - bits)


def _by_bucket(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and where each bucket begins in it."""
    bucket = (mix(keys) % U64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


KEY_SCHEMA = "bucket int, keys binary, many binary, run_key binary, run_doc binary, run_pos binary, run_n binary, ids binary, ths binary"


def _keys_and_runs(window: int, span: int, n_buckets: int):
    """For each bucket the keys selected in a partition, with whether more than once, and the runs of windows (key, document, first window, windows)."""

    def sent(selected: list[np.ndarray], runs: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(selected), return_counts=True)
        key, ids, ths, pos, n = (np.concatenate(x) for x in zip(*runs, strict=True))
        order, edges = _by_bucket(values, n_buckets)
        r_order, r_edges = _by_bucket(key, n_buckets)
        for k in np.flatnonzero(np.diff(edges)):
            o, r = order[edges[k] : edges[k + 1]], r_order[r_edges[k] : r_edges[k + 1]]
            docs, doc = np.unique(np.stack([ids[r], ths[r]]), axis=1, return_inverse=True)
            cols = (values[o], counts[o] > 1, key[r], doc.ravel().astype(np.uint32), pos[r], n[r], docs[0], docs[1])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=[x.split()[0] for x in KEY_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selected: list[np.ndarray] = []
        runs: list[tuple[np.ndarray, ...]] = []
        held = 0
        for b in batches:
            ids, ths = b.column(1).to_numpy(), b.column(2).to_numpy()
            for w in words_of(b.column(0)):
                keys, whole = _keys(w, window, span)
                at = np.flatnonzero(whole)
                if not len(at):
                    continue
                selected.append(_selected(w, keys, whole, window, span))
                row, key = w.row_of_word()[at], keys[at]
                begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
                doc = w.first + row[begin]
                runs.append((key[begin], ids[doc], ths[doc], (at[begin] - w.word_at[row[begin]]).astype(np.int32), np.diff(np.append(begin, len(at))).astype(np.int32)))
                held += len(begin)
                if held >= RUNS:
                    yield from sent(selected, runs)
                    selected, runs, held = [], [], 0
        if held:
            yield from sent(selected, runs)

    return run


def _estimated(table: pa.Table) -> pa.Table:
    """Of a bucket the runs of windows (doc, th, pos, n, key) whose key the added sketches of all partitions estimate at two or more."""
    read = lambda column, k, kind: np.frombuffer(table.column(column)[k].as_buffer(), kind)
    parts = [(read("keys", k, np.uint64), read("many", k, bool)) for k in range(table.num_rows)]
    bits = max(10, int(np.ceil(np.log2(CELLS_PER_KEY * sum(len(x) for x, _ in parts)))))
    total = np.zeros((ROWS, 1 << bits), np.uint8)
    for keys, many in parts:
        for row in range(ROWS):
            cells, at = np.unique(_cells(keys, row, bits), return_inverse=True)
            own = np.minimum(np.bincount(at, 1 + many, len(cells)), 2).astype(np.uint8)
            total[row, cells] = np.minimum(total[row, cells] + own, 2)
    out = []
    for k in range(table.num_rows):
        key, doc, pos, n, ids, ths = (read(c, k, t) for c, t in (("run_key", np.uint64), ("run_doc", np.uint32), ("run_pos", np.int32), ("run_n", np.int32), ("ids", np.int64), ("ths", np.int64)))
        there = np.logical_and.reduce([total[row, _cells(key, row, bits)] >= 2 for row in range(ROWS)])
        out.append((ids[doc[there]], ths[doc[there]], pos[there], n[there], key[there].view(np.int64)))
    return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("doc", "th", "pos", "n", "key"), zip(*out, strict=True), strict=True)})


class _Parts:
    """Windows gathered by a task: two hashes, bucket, document (its number in tables of ids and text hashes) and position."""

    def __init__(self) -> None:
        self.h, self.g, self.key, self.doc, self.pos, self.ids, self.ths, self.docs = [], [], [], [], [], [], [], 0

    def join(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((self.h, np.uint64), (self.g, np.uint32), (self.key, np.uint64), (self.doc, np.int64), (self.pos, np.int32), (self.ids, np.int64), (self.ths, np.int64)))


def _spans(ids: np.ndarray, ths: np.ndarray, doc: np.ndarray, pos: np.ndarray, kept: bool, window: int) -> pa.RecordBatch:
    """Runs of consecutive windows of a document as rows."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(doc)) - 1 if len(a) else a
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[doc[a]]), pa.array(ths[doc[a]]), pa.array(np.full(len(a), kept)), pa.array(pos[a].astype(np.int32)), pa.array((pos[b] + window).astype(np.int32))], schema=SPAN_TYPE
    )


def _firsts(h: np.ndarray, g: np.ndarray, i: np.ndarray, t: np.ndarray, pos: np.ndarray, dup: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, id, text hash and position; which of the ordered windows is the first of its hash, and whether it has others. Equal rows count once."""
    order = np.lexsort((pos, t, i, g, h))
    h, g, i, t, pos = h[order], g[order], i[order], t[order], pos[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    again = same.copy()
    again[1:] &= (i[1:] == i[:-1]) & (t[1:] == t[:-1]) & (pos[1:] == pos[:-1])
    first = ~same
    group = np.cumsum(first) - 1
    more = np.bincount(group, same & ~again) > 0 if len(h) else np.zeros(0, bool)
    if dup is not None and len(h):
        more |= np.bincount(group, dup[order]) > 0
    return order[~again], first[~again], more[group][~again]


GATHERED = "bucket int, h binary, g binary, doc_more binary, pos binary, ids binary, ths binary, doc long, th long, kept boolean, s int, e int"


def _gather(window: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts()
        for b in batches:
            ids, ths, runs = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)
            run_at = runs.offsets.to_numpy()
            pos, n, key = (runs.values.field(c).to_numpy() for c in range(3))
            for w in words_of(b.column(0)):
                mine = slice(run_at[w.first], run_at[w.first + w.rows])
                row = np.repeat(np.arange(w.rows), np.diff(run_at[w.first : w.first + w.rows + 1]))
                size = n[mine]
                first = w.word_at[row] + pos[mine]
                at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                row = np.repeat(row, size)
                parts.h.append(w.grams(window)[at])
                parts.g.append((w.grams(window, _B2)[at] >> U64(32)).astype(np.uint32))
                parts.key.append(np.repeat(key[mine], size).view(np.uint64))
                parts.doc.append(row + parts.docs)
                parts.pos.append((at - w.word_at[row]).astype(np.int32))
                parts.ids.append(ids[w.first : w.first + w.rows])
                parts.ths.append(ths[w.first : w.first + w.rows])
                parts.docs += w.rows
        h, g, key, doc, pos, ids, ths = parts.join()
        if not len(h):
            return
        order, first, more = _firsts(h, g, ids[doc], ths[doc], pos, None)
        h, g, key, doc, pos = (x[order] for x in (h, g, key, doc, pos))
        names = [x.split()[0] for x in GATHERED.split(", ")]
        spans = _spans(ids, ths, doc[~first], pos[~first], False, window)
        # spans need no bucket, but go by: spread over as many groups as there are
        aside = pa.array((-1 - (spans.column(0).to_numpy() % n_buckets)).astype(np.int32))
        for a in range(0, len(spans), 10_000):
            part = spans.slice(a, 10_000)
            yield pa.RecordBatch.from_arrays([aside.slice(a, 10_000), *[pa.nulls(len(part), pa.binary())] * 6, *part.columns], names=names)
        h, g, key, doc, pos, more = (x[first] for x in (h, g, key, doc, pos, more))
        order, edges = _by_bucket(key, n_buckets)
        for k in np.flatnonzero(np.diff(edges)):
            o = order[edges[k] : edges[k + 1]]
            used, local = np.unique(doc[o], return_inverse=True)
            cols = (h[o], g[o], local.astype(np.uint32) << np.uint32(1) | more[o], pos[o], ids[used], ths[used])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols), *[pa.nulls(1, f.type) for f in SPAN_TYPE]], names=names)

    return run


def _settle(window: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(SPAN_TYPE.names)
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for b in table.to_batches():
            for r in range(len(b)):
                h, g, dm, p, i, t = (np.frombuffer(b.column(c)[r].as_buffer(), k) for c, k in (("h", np.uint64), ("g", np.uint32), ("doc_more", np.uint32), ("pos", np.int32), ("ids", np.int64), ("ths", np.int64)))
                local = dm >> np.uint32(1)
                for x, y in zip(parts, (h, g, (dm & np.uint32(1)).astype(bool), p, i[local], t[local]), strict=True):
                    x.append(y)
        h, g, d, p, i, t = (np.concatenate(x) for x in parts)
        order, first, more = _firsts(h, g, i, t, p, d)
        i, t, p = i[order], t[order], p[order]
        order = np.lexsort((t, i))
        new = np.ones(len(i), bool)
        new[1:] = (i[order][1:] != i[order][:-1]) | (t[order][1:] != t[order][:-1])
        doc = np.empty(len(i), np.int64)
        doc[order] = np.cumsum(new) - 1
        ids, ths = i[order][new], t[order][new]
        return pa.Table.from_batches([_spans(ids, ths, doc[pick], p[pick], kept, window) for kept, pick in ((False, ~first), (True, first & more))], SPAN_TYPE)

    return run


def _spans_frame(docs: DataFrame, window: int, span: int, text: str, doc_id: str) -> DataFrame:
    """Rows (doc, th, kept, s, e), with overlapping spans of a document united; kept tells first occurrences from repeats."""
    spark = docs.sparkSession
    if not 0 < span <= window:
        raise ValueError("span must be between 1 and window")
    slim = docs.select(F.col(text).alias("text"), integer_id(docs, doc_id).alias("doc_id"), F.xxhash64(text).alias("th"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = buckets(spark, size / 6 * 2 / (window - span + 2) * 40)
    runs = slim.select("text", "doc_id", "th").mapInArrow(_keys_and_runs(window, span, n), KEY_SCHEMA).groupBy("bucket").applyInArrow(_estimated, "doc long, th long, pos int, n int, key long")
    places, path = store(runs.groupBy("doc", "th").agg(F.collect_set(F.struct("pos", "n", "key")).alias("runs")))
    windows = places.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda x, r: x + r["n"]))).first()[0] or 0
    n = buckets(spark, windows * 24.0)
    joined = slim.join(places, (slim["doc_id"] == places["doc"]) & (slim["th"] == places["th"])).select("text", "doc", slim["th"], "runs")
    settled = joined.mapInArrow(_gather(window, n), GATHERED).groupBy("bucket").applyInArrow(_settle(window), "doc long, th long, kept boolean, s int, e int")
    result = store(_united(settled))[0]
    discard(spark, path)
    return result


def _united(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document united."""
    by = Window.partitionBy("doc", "th", "kept").orderBy("s", "e")
    new = F.coalesce((F.col("s") > F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    return (
        spans.withColumn("new", new)
        .withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc", "th", "kept", "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("island")
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW, span: int = SPAN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Maximal spans of words covered by repeated windows: (doc_id, kept, first_word, end_word).

    ``kept`` is true for spans of first occurrences and false for those of repeats; a span may overlap one of the other
    kind. A document without repeated windows has no row."""
    found = _spans_frame(docs, window, span, text, doc_id)
    return found.select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "kept", F.col("s").alias("first_word"), F.col("e").alias("end_word"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, out = b.column(1).to_pylist(), []
        for w in words_of(b.column(0)):
            for d in range(w.rows):
                raw = w.data[w.at[d] : w.at[d + 1]].tobytes()
                begin = [*(w.starts[w.word_at[d] : w.word_at[d + 1]] - w.at[d]), len(raw)]
                keep, at = [], 0
                for x in sorted(spans[w.first + d], key=lambda x: x["s"]):
                    keep.append(raw[at : begin[x["s"]]])
                    at = begin[x["e"]]
                out.append(b"".join([*keep, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *b.columns[2:]], names=["text", *b.schema.names[2:]])


def remove_repeats(docs: DataFrame, window: int = WINDOW, span: int = SPAN, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents without the words of repeats, with all their columns.

    A cut runs from the first repeated word to the word after the last one. ``n_chars``, if there, is counted anew
    for documents that were cut; documents of which no word is left go, all others stay as they are."""
    spans = _spans_frame(docs, window, span, text, doc_id).where("not kept").groupBy("doc", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    doc, th, cuts = (free_name(docs, x) for x in ("cut_doc", "cut_th", "cut_spans"))
    spans = spans.toDF(doc, th, cuts)
    keyed = docs.withColumn(th, F.xxhash64(text))
    key = integer_id(keyed, doc_id)
    joined = keyed.join(spans, (key == spans[doc]) & (keyed[th] == spans[th]), "left").select(*[keyed[c] for c in docs.columns], spans[cuts])
    order = [text, cuts, *[c for c in docs.columns if c != text]]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [text, *order[2:]])
    changed = joined.where(F.col(cuts).isNotNull()).select(*order).mapInArrow(_cut, schema).where(F.length(F.btrim(text)) > 0)
    if n_chars in docs.columns:
        changed = changed.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return joined.where(F.col(cuts).isNull()).select(*docs.columns).union(changed.select(*docs.columns))
