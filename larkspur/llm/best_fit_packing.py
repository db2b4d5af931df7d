"""Bulk-synchronous best-fit packing of documents into sequences of fixed capacity.

Lengths are bytes of UTF-8 text. A document longer than the capacity fills sequences of its own and leaves a remainder; all
remainders are packed in rounds. In a round, remainders and gaps are range-sorted together by size, largest first. A sweep over
this order pairs every remainder with the least gap that is not smaller and not taken yet: gaps go on a stack, a remainder
takes the top. Partitions sweep on their own; what they leave is counted, and their counts tell, by rank, which gap of which
earlier partition each left remainder takes. So a round gives every gap to one remainder at most and is exact over the
whole table. Gaps are then updated. When a round places few of the remainders, as many empty sequences as the
rest needs at least are opened, unless no more than ``TAIL`` are left: these few, too large for any gap but some, are packed into sequences of their own by one task, largest first
into the least gap that is not smaller. Each round is written to the shared folder.

Defined results: null and empty texts occupy nothing and have no row; rows that repeat are packed each; among equal sizes the order
is that of the internal row numbers; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, small, store

CAPACITY = 8192
#: New sequences are opened after a round that placed less than one in so many of the remainders.
FEW = 20
#: Remainders and gaps for each partition of a sweep.
ITEMS = 200_000
#: Remainders that one task packs at the end.
TAIL = 10_000


def sweep(size: np.ndarray, is_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of items in order: the documents matched and their gaps, the documents left and the gaps left, as positions."""
    stack: list[int] = []
    docs, gaps, left = [], [], []
    for at, doc in enumerate(is_doc.tolist()):
        if not doc:
            stack.append(at)
        elif stack:
            docs.append(at)
            gaps.append(stack.pop())
        else:
            left.append(at)
    return tuple(np.array(x, np.int64) for x in (docs, gaps, left, stack))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if len(b)]
    if not parts:
        return
    doc, size, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((key, doc, -size))
    doc, size, key = doc[order].astype(bool), size[order], key[order]
    d, g, left, free = sweep(size, doc)
    part = TaskContext.get().partitionId()

    def rows(what: int, uid: np.ndarray, bin_: np.ndarray, size: np.ndarray, gap: np.ndarray) -> pa.RecordBatch:
        n = len(size)
        cols = [np.full(n, what, np.int32), np.full(n, part, np.int32), np.arange(n), uid, bin_, size, gap]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["what", "part", "rank", "uid", "bin", "size", "gap"])

    for b in (
        rows(0, key[d], key[g], size[d], size[g]),
        rows(1, key[left], np.zeros(len(left), np.int64), size[left], np.zeros(len(left), np.int64)),
        rows(2, np.zeros(len(free), np.int64), key[free], np.zeros(len(free), np.int64), size[free]),
    ):
        if len(b):
            yield b


def ranks_across(counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """From the numbers of documents (1) and gaps (2) left by partition: (partition, first rank, ranks, gap's partition, rank of the first gap), gap ranks falling."""
    stack: list[list[int]] = []
    out = []
    for p in sorted({p for _, p in counts}):
        at, need = 0, counts.get((1, p), 0)
        while need and stack:
            q, have = stack[-1]
            n = min(need, have)
            out.append((p, at, n, q, have - 1))
            at, need = at + n, need - n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if counts.get((2, p)):
            stack.append([p, counts[2, p]])
    return out


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, start) of each size, in order, each into the least gap that is not smaller."""
    gaps: list[tuple[int, int]] = []
    out, opened = [], 0
    for size in sizes:
        k = bisect_left(gaps, (size, -1))
        if k < len(gaps):
            gap, number = gaps.pop(k)
        else:
            gap, number, opened = capacity, opened, opened + 1
        out.append((number, capacity - gap))
        if gap > size:
            insort(gaps, (gap - size, number))
    return out


def _tail(capacity: int, opened: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((-size, uid) for b in batches for uid, size in zip(*(c.to_pylist() for c in b.columns), strict=True)))
        if rows:
            found = best_fit([-size for size, _ in rows], capacity)
            cols = ([uid for _, uid in rows], [opened + number for number, _ in found], [start for _, start in found])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["uid", "bin", "bin_start"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(bin_id, bin_start, doc_id, doc_start, n_bytes): which bytes of which document lie where in which sequence."""
    spark = docs.sparkSession
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(text).cast("long").alias("n")).where("n > 0")
    known, p_known = store(sized.withColumn("uid", F.monotonically_increasing_id()))
    rest = known.select("uid", (F.col("n") % capacity).alias("size")).where("size > 0")
    n_todo, todo_bytes = rest.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    opened, old = 0, []
    state, placed = rest.select(F.lit(True).alias("doc"), "size", F.col("uid").alias("key")), []
    opening = True
    rounds = 0
    while n_todo:
        rounds += 1
        items = state
        if opening:
            new = -(-todo_bytes // capacity)
            items = items.union(spark.range(opened, opened + new).select(F.lit(False), F.lit(capacity).cast("long"), "id"))
            opened += new
        n = (n_todo + opened) // ITEMS + 1
        swept, p_swept = store(items.repartitionByRange(n, F.desc("size"), F.asc("doc"), F.asc("key")).mapInArrow(_local, "what int, part int, rank long, uid long, bin long, size long, gap long"))
        counts = {(r["what"], r["part"]): r["n"] for r in swept.where("what > 0").groupBy("what", "part").agg(F.count("*").alias("n")).collect()}
        across = ranks_across(counts)
        left, free = swept.where("what = 1").select("part", "rank", "uid", "size"), swept.where("what = 2").select("part", "rank", "bin", "gap")
        if across:
            spans = spark.createDataFrame(across, "p int, at long, n long, q int, top long")
            inside = (F.col("part") == F.col("p")) & (F.col("rank") >= F.col("at")) & (F.col("rank") < F.col("at") + F.col("n"))
            left = left.join(small(spans, len(across), 36), inside, "left").select("uid", "size", "q", (F.col("top") - F.col("rank") + F.col("at")).alias("g"))
            both = left.join(free, (F.col("q") == F.col("part")) & (F.col("g") == F.col("rank")), "full")
        else:
            none = F.lit(None).cast("long")
            both = left.select("uid", "size", none.alias("bin"), none.alias("gap")).union(free.select(none, none, "bin", "gap"))
        pairs = swept.where("what = 0").select("uid", "size", "bin", "gap").union(both.select("uid", "size", "bin", "gap"))
        settled, p_settled = store(pairs)
        discard(spark, p_swept, *old)
        old = [p_settled]
        fits = settled.where("uid is not null and bin is not null")
        done, p_done = store(fits.select("uid", "bin", (F.lit(capacity) - F.col("gap")).alias("bin_start")))
        placed.append((done, p_done))
        state = settled.where("bin is null").select(F.lit(True).alias("doc"), "size", F.col("uid").alias("key")).union(
            settled.where("bin is not null and gap > coalesce(size, 0)").select(F.lit(False), F.col("gap") - F.coalesce("size", F.lit(0)), "bin")
        )
        before = n_todo
        n_todo, todo_bytes = settled.where("bin is null").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        opening = (before - n_todo) * FEW < before
        if opening and 0 < n_todo <= TAIL:
            last, p_last = store(settled.where("bin is null").select("uid", "size").coalesce(1).mapInArrow(_tail(capacity, opened), "uid long, bin long, bin_start long"))
            placed.append((last, p_last))
            opened, n_todo = last.agg(F.max("bin")).first()[0] + 1, 0
    columns = ["bin_id", "bin_start", "doc_id", "doc_start", "n_bytes"]
    whole = known.where(F.col("n") >= capacity).select("doc_id", "uid", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {capacity} - 1"))).alias("k"))
    whole, p_whole = store(whole.withColumn("bin_id", F.monotonically_increasing_id() + opened))
    out = whole.select("bin_id", F.lit(0).cast("long").alias("bin_start"), "doc_id", (F.col("k") * capacity).alias("doc_start"), F.lit(capacity).cast("long").alias("n_bytes"))
    if placed:
        every = placed[0][0]
        for more, _ in placed[1:]:
            every = every.union(more)
        rest = known.join(every, "uid").select(F.col("bin").alias("bin_id"), "bin_start", "doc_id", (F.col("n") - F.col("n") % capacity).alias("doc_start"), (F.col("n") % capacity).alias("n_bytes"))
        out = out.union(rest)
    result, _ = store(out.select(*columns))
    discard(spark, p_known, p_whole, *old, *(p for _, p in placed))
    return result
