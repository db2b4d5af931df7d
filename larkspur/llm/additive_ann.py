"""Approximate nearest neighbours of a set of query vectors among all vectors, by additive quantisation.

Codebooks hold full-dimensional codewords; a vector is near the sum of one codeword of each. They are trained one after another on
residuals, by Lloyd rounds over a bounded sample: at most ``TRAIN_VECTORS`` vectors of ``TRAIN_BYTES`` together, in the order of a hash, in one task; only the codebooks
go to the driver. Every vector is then encoded, by a beam search that keeps the best partial sums. The squared distance of a query to a code is, but for a constant,
the code's stored norm less twice the sum of one table entry for each codebook; of each block of items the best codes, ``RERANK`` of 16384 and ``FEWEST`` at least, are compared exactly.
Blocks of queries meet blocks of items, so no side is broadcast; a task merges the lists of the blocks it has, and lists
of all tasks are merged at the end. All codes are scored, since on vectors without clusters no partition of them keeps the recall, which is 0.98 of ten
neighbours among 50,000 vectors of 64 dimensions without any clusters.

Defined results: null vectors, those of another length than most and those with null or not finite elements are neither queries nor items; a null
id is an id, and stands for the least long; ids that aren't integers are a TypeError; equal distances go by id; rows that repeat are neighbours of each other, but a row isn't its
own; with fewer than k others all are returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, discard, integer_id, store

NEIGHBOURS, CODEBOOKS, CODEWORDS, BEAM, ROUNDS, RERANK, FEWEST = 10, 8, 256, 4, 3, 600, 100
TRAIN_VECTORS, TRAIN_BYTES = 1 << 14, 64 << 20
ITEM_BLOCK, QUERY_BLOCK, LUT_QUERIES, BLOCKS_A_TASK = 16384, 1024, 64, 8


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].astype(np.float32).reshape(-1, dim)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1) - 2 * (x @ book.T)).argmin(1)


def residuals(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    for b in books:
        x = x - b[nearest(x, b)]
    return x


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, codebooks) found by beam search, and the squared norms of the sums they stand for."""
    n, dim = x.shape
    codes = np.zeros((n, 1, 0), np.uint8)
    rest, every = x[:, None, :], np.arange(n)
    for b in books:
        cost = (rest.reshape(-1, dim) @ (b.T * np.float32(-2))).reshape(n, rest.shape[1], len(b))
        cost += (rest**2).sum(2)[:, :, None]
        cost += (b**2).sum(1)
        flat = cost.reshape(n, -1)
        best = np.empty((n, min(beam, flat.shape[1])), np.int64)
        for k in range(best.shape[1]):
            best[:, k] = flat.argmin(1)
            flat[every, best[:, k]] = np.inf
        parent, word = best // len(b), best % len(b)
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - b[word]
    k = (rest**2).sum(2).argmin(1)
    codes = codes[every, k]
    sums = sum(b[codes[:, m]] for m, b in enumerate(books))
    return codes, (sums**2).sum(1)


def train(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks from a sample. Each starts from the residuals of the first vectors; codewords that nothing is near stay."""
    rest, books = x, []
    for m in range(codebooks):
        book = residuals(x[:codewords], books) * np.float32(0.7 if m else 1)  # means of several residuals are shorter than one
        for _ in range(rounds):
            near = nearest(rest, book)
            order = np.argsort(near, kind="stable")
            begin = np.flatnonzero(np.diff(near[order], prepend=-1))
            book[near[order][begin]] = np.add.reduceat(rest[order].astype(np.float64), begin, axis=0) / np.diff(np.append(begin, len(rest)))[:, None]
        books.append(book)
        rest = rest - book[nearest(rest, book)]
    return books


def _train(dim: int, codebooks: int, codewords: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_vectors(b.column("x"), dim) for b in batches if len(b)]
        if parts:
            books = train(np.concatenate(parts), codebooks, codewords, rounds)
            yield pa.record_batch({"book": pa.array(np.arange(len(books), dtype=np.int32)), "words": pa.array([b.astype(np.float32).tobytes() for b in books], pa.binary())})

    return run


def _packed(dim: int, most: int, books: list[np.ndarray] | None, beam: int):
    """Rows of up to so many vectors: items with their codes if there are codebooks, otherwise queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        n = 0

        def block() -> pa.RecordBatch:
            uid, ids, x = (np.concatenate(c) for c in zip(*waiting, strict=True))
            cols = {"uid": uid, "id": ids, "x": x}
            if books:
                codes, norms = (np.concatenate(p) for p in zip(*(encode(x[a : a + 512], books, beam) for a in range(0, len(x), 512)), strict=True))
                cols |= {"codes": np.ascontiguousarray(codes.T), "norms": norms.astype(np.float32)}
            return pa.record_batch({("i_" if books else "q_") + k: pa.array([c.tobytes()], pa.binary()) for k, c in cols.items()})

        for b in batches:
            for a in range(0, len(b), most):
                part = b.slice(a, most)
                if n and n + len(part) > most:
                    yield block()
                    waiting, n = [], 0
                waiting.append((part.column("uid").to_numpy(), part.column("id").to_numpy(), _vectors(part.column("x"), dim)))
                n += len(part)
        if n:
            yield block()

    return run


def search(q: np.ndarray, q_uid: np.ndarray, x: np.ndarray, uid: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: list[np.ndarray], k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and squared distances of its nearest items but itself, from the best codes by table lookups."""
    n = len(x)
    squares = (x.astype(np.float64) ** 2).sum(1)
    for a in range(0, len(q), LUT_QUERIES):
        part = q[a : a + LUT_QUERIES]
        score = np.repeat(norms[:, None], len(part), 1)
        for m, b in enumerate(books):
            score += (-2 * (b @ part.T)).take(codes[m], 0)
        score = np.ascontiguousarray(score.T)
        top = min(n, rerank + 1)
        best = np.argpartition(score, top - 1, axis=1)[:, :top] if top < n else np.broadcast_to(np.arange(n), score.shape)
        for r in range(len(part)):
            c = best[r]
            c = c[uid[c] != q_uid[a + r]]
            v = part[r].astype(np.float64)
            d = np.maximum(squares[c] - 2 * (x[c].astype(np.float64) @ v) + v @ v, 0)
            o = np.lexsort((uid[c], ids[c], d))[:k]
            yield c[o], d[o]


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of lists (distances, ids, uids) of one query the k nearest."""
    d, i, u = (np.concatenate(x) for x in zip(*found, strict=True))
    o = np.lexsort((u, i, d))[:k]
    return d[o], i[o], u[o]


def _meet(books: list[np.ndarray], dim: int, k: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: bytes | None = None
        q_uid = q_id = np.zeros(0, np.int64)
        lists: list[list[tuple[np.ndarray, ...]]] = []

        def merged() -> pa.RecordBatch:
            best = [_best(x, k) for x in lists]
            at = pa.array(np.cumsum([0, *(len(d) for d, _, _ in best)]).astype(np.int32))
            cols = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(c))) for c in zip(*best, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(q_uid), pa.array(q_id), *cols], names=["uid", "id", "ds", "ids", "uids"])

        for b in batches:
            for r in range(len(b)):
                read = lambda name, t: np.frombuffer(b.column(name)[r].as_buffer(), t)  # noqa: B023, E731
                name = b.column("q_uid")[r].as_py()
                if name != held:  # pairs come query block by query block
                    if held is not None:
                        yield merged()
                    held, q_uid, q_id = name, read("q_uid", np.int64).copy(), read("q_id", np.int64).copy()
                    lists = [[] for _ in q_uid]
                q = read("q_x", np.float32).reshape(-1, dim)
                uid, ids, x = read("i_uid", np.int64), read("i_id", np.int64), read("i_x", np.float32).reshape(-1, dim)
                codes, norms = read("i_codes", np.uint8).reshape(len(books), -1), read("i_norms", np.float32)
                most = max(FEWEST, k, -(-rerank * len(x) // ITEM_BLOCK))
                for own, (c, d) in zip(lists, search(q, q_uid, x, uid, ids, codes, norms, books, k, most), strict=True):
                    own.append((d, ids[c], uid[c]))
        if held is not None:
            yield merged()

    return run


def nearest_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, vec_id: str = "vec_id", embedding: str = "embedding", queries: Column | None = None, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, beam: int = BEAM, rounds: int = ROUNDS, rerank: int = RERANK) -> DataFrame:
    """(vec_id, neighbours, distances) of the rows for which ``queries`` holds, all if it isn't given: ids of the k nearest other vectors, nearest first, with their Euclidean distances."""
    spark = vectors.sparkSession
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    slim = vectors.select(integer_id(vectors, vec_id).alias("id"), F.col(embedding).cast("array<float>").alias("x"), asked.alias("asked"))
    sizes = slim.where("size(x) > 0").groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "vec_id long, neighbours array<long>, distances array<double>"
    if sizes is None:
        return spark.createDataFrame([], out)
    dim = sizes["n"]
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    known, p1 = store(slim.where((F.size("x") == dim) & finite).withColumn("uid", F.monotonically_increasing_id()))
    n, n_asked = known.agg(F.count("*"), F.count_if("asked")).first()
    if not n_asked:
        discard(spark, p1)
        return spark.createDataFrame([], out)
    sample = known.select("x", "id").orderBy(F.xxhash64("x", "id"), "id").limit(max(codewords, min(TRAIN_VECTORS, TRAIN_BYTES // (4 * dim))))
    trained = sample.select("x").mapInArrow(_train(dim, codebooks, codewords, rounds), "book int, words binary").collect()
    books = [np.frombuffer(r["words"], np.float32).reshape(-1, dim) for r in sorted(trained, key=lambda r: r["book"])]
    binary = lambda names: ", ".join(f"{c} binary" for c in names.split())
    items, p2 = store(known.mapInArrow(_packed(dim, ITEM_BLOCK, books, beam), binary("i_uid i_id i_x i_codes i_norms")))
    asking, p3 = store(known.where("asked").select("uid", "id", "x").coalesce(max(1, min(known.rdd.getNumPartitions(), n_asked // QUERY_BLOCK))).mapInArrow(_packed(dim, QUERY_BLOCK, None, beam), binary("q_uid q_id q_x")))
    n_items, n_queries = items.count(), asking.count()
    n_tasks = max(-(-n_items // BLOCKS_A_TASK), min(n_items, spark.sparkContext.defaultParallelism))
    pairs = asking.repartition(n_queries).crossJoin(items.repartition(n_tasks).hint("shuffle_replicate_nl"))
    met = pairs.mapInArrow(_meet(books, dim, k, rerank), "uid long, id long, ds array<double>, ids array<long>, uids array<long>")
    every = met.select("uid", "id", F.arrays_zip(F.col("ds").alias("d"), F.col("ids").alias("i"), F.col("uids").alias("u")).alias("z"))
    best = every.groupBy("uid", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("z"))), 1, k).alias("z"))
    result, _ = store(best.select(F.nullif("id", F.lit(NULL_ID)).alias("vec_id"), F.transform("z", lambda z: F.nullif(z["i"], F.lit(NULL_ID))).alias("neighbours"), F.transform("z", lambda z: F.sqrt(z["d"])).alias("distances")))
    discard(spark, p1, p2, p3)
    return result
