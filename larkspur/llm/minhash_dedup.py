"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification and connected groups.

A document's set is that of its runs of ``shingle`` words (or all its words, if fewer). The signature uses two permutations of
a universe of 2**20 bins only: the first spreads the bins of the set, the second is read circularly, and coordinate k is the
least value of the second permutation shifted by k over the set. All coordinates of one element are thus neighbours in
memory, and a signature is a minimum of rows.

Documents with equal sets are one node, so copies cost nothing. Nodes that share a band are candidates. In each bucket the
least node is first compared with all others whose sizes allow it. Where this leaves nodes of a bucket in different groups, their sets go, once for each
different bucket, to tasks that compare nodes of different groups in memory, and a bucket of many sets goes in blocks, each pair of blocks to a task of its own. Such a
task returns only the pairs that join groups. Every candidate pair is thus compared exactly or already known to be in one group; no bucket is capped, and no
table of all pairs of a bucket is made.

Defined results: null and texts without words have no set and are never duplicates; texts of fewer words than a shingle
match only texts of the same words; a null doc_id sorts first and is one with the least long; ids that aren't integers are a TypeError; of a group, the document with the least (doc_id, hash of text) stays, and of rows
equal in both, one; other columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, buckets, discard, free_name, integer_id, small, store
from .words import U64, Words, mix, words_of

SHINGLE, BANDS, BAND_ROWS, THRESHOLD = 3, 50, 4, 0.5
UNIVERSE_BITS = 20
#: Elements of the sets of a bucket that are compared in one block.
BLOCK_ELEMENTS = 1 << 19
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the circular shifts of the second: row i holds its values from i on."""
    if coordinates not in _tables:
        rng = np.random.default_rng(7)
        n = 1 << UNIVERSE_BITS
        spread, second = rng.permutation(n).astype(np.int32), rng.permutation(n).astype(np.int32)
        ring = np.concatenate([second, second[:coordinates]])
        _tables[coordinates] = spread, np.lib.stride_tricks.sliding_window_view(ring, coordinates)
    return _tables[coordinates]


def signature(elements: np.ndarray, coordinates: int) -> np.ndarray:
    spread, ring = permutations(coordinates)
    at = spread[(elements >> U64(64 - UNIVERSE_BITS)).astype(np.int64)]
    least = np.full(coordinates, 1 << UNIVERSE_BITS, np.int32)
    for a in range(0, len(at), 1024):
        np.minimum(least, ring[at[a : a + 1024]].min(0), out=least)
    return least


def sets_of(w: Words, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of the runs of words) of rows that have words."""
    grams = w.grams(shingle)
    for d in range(w.rows):
        a, b = w.word_at[d], w.word_at[d + 1]
        if b - a >= shingle:
            yield w.first + d, np.unique(grams[a : b - shingle + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = mix(whole * U64(31) + w.hashes[k : k + 1])
            yield w.first + d, whole


def node_of(elements: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        x = mix(elements * U64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) ^ U64(len(elements))
    return int(mix(np.array([x])).view(np.int64)[0])


def _sign(shingle: int, bands: int, rows: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        factor = mix(np.arange(1000, 1000 + rows, dtype=np.uint64)) | U64(1)
        known: set[int] = set()
        nodes, keys, sizes = [], [], []
        for b in batches:
            ids, ths = b.column(1).to_numpy(), b.column(2).to_numpy()
            node = np.zeros(len(b), np.int64)
            there = np.zeros(len(b), bool)
            for w in words_of(b.column(0)):
                for r, s in sets_of(w, shingle):
                    node[r], there[r] = node_of(s), True
                    n = int(node[r])
                    if n not in known:
                        known.add(n)
                        sig = signature(s, bands * rows).reshape(bands, rows).astype(np.uint64)
                        nodes.append(n)
                        sizes.append(len(s))
                        keys.append(mix((sig * factor).sum(1, dtype=np.uint64) ^ salt))
            k = np.flatnonzero(there)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int32()), *[pa.nulls(len(k), pa.binary())] * 3, pa.array(ids[k]), pa.array(ths[k]), pa.array(node[k])], names=names)
        if not nodes:
            return
        own, size, key = np.repeat(np.array(nodes, np.int64), bands), np.repeat(np.array(sizes, np.int32), bands), np.concatenate(keys)
        bucket = (key % U64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            o = order[edges[k] : edges[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([key[o].tobytes()], pa.binary()), pa.array([own[o].tobytes()], pa.binary()), pa.array([size[o].tobytes()], pa.binary()), *[pa.nulls(1, pa.int64())] * 3], names=names)

    names = ["bucket", "keys", "nodes", "sizes", "doc", "th", "node"]
    return run


def _collide(table: pa.Table) -> pa.Table:
    """The members of bands that two nodes or more share, with the sizes of their sets and the least node: (key, node, n, hub, hub_n)."""
    key, node, size = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("keys", np.uint64), ("nodes", np.int64), ("sizes", np.int32)))
    order = np.lexsort((node, key))
    key, node, size = key[order], node[order], size[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, size = key[fresh], node[fresh], size[fresh]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    group = np.cumsum(start) - 1
    shared = np.bincount(group)[group] > 1
    hub, hub_n = node[start][group], size[start][group]
    cols = {"key": key.view(np.int64), "node": node, "n": size, "hub": hub, "hub_n": hub_n}
    return pa.table({c: pa.array(x[shared]) for c, x in cols.items()})


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(1).to_numpy(zero_copy_only=False)
            for w in words_of(b.column(0)):
                rows, sets = [], []
                for r, s in sets_of(w, shingle):
                    rows.append(node[r])
                    sets.append(s.view(np.int64))
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["node", "els"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with their exact Jaccard similarity, of those that reach the threshold."""
    one, two = sets.toDF("a", "els_a"), sets.toDF("b", "els_b")
    common = F.size(F.array_intersect("els_a", "els_b"))
    return (
        pairs.join(two, "b").join(one, "a")
        .select("a", "b", (common / (F.size("els_a") + F.size("els_b") - common)).alias("jaccard"))
        .where(F.col("jaccard") >= threshold)
    )


def joining(nodes: np.ndarray, labels: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of nodes that reach the threshold and join two groups. Of two blocks only pairs across them count, of one all."""
    group = np.unique(labels, return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    across = len(np.unique(blocks)) > 1
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    for a in range(len(nodes) - 1):
        other = np.arange(a + 1, len(nodes))
        other = other[(group[other] != group[a]) & (np.minimum(size[other], size[a]) >= threshold * np.maximum(size[other], size[a]))]
        if across:
            other = other[blocks[other] != blocks[a]]
        if not len(other):
            continue
        n = size[other]
        begin = np.cumsum(n) - n
        own = flat[np.repeat(at[other] - begin, n) + np.arange(n.sum())]
        place = np.minimum(np.searchsorted(sets[a], own), size[a] - 1)
        common = np.add.reduceat((sets[a][place] == own).astype(np.int64), begin)
        for b in other[common >= threshold * (size[a] + n - common)]:
            if group[b] != group[a]:
                yield int(nodes[a]), int(nodes[b])
                group[group == group[b]] = group[a]


def _join_groups(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(c).to_numpy() for c in ("node", "j", "i", "key")])
        key, i, j, block, node, label = (table.column(c).to_numpy()[order] for c in ("key", "i", "j", "block", "node", "label"))
        els = table.column("els").combine_chunks()
        flat, at = els.values.to_numpy().view(np.uint64), els.offsets.to_numpy()
        edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        found = [
            pair
            for a, z in zip(edges, [*edges[1:], len(key)], strict=True)
            if (i[a] == j[a] or i[a] in block[a:z] and j[a] in block[a:z])
            for pair in joining(node[a:z], label[a:z], block[a:z], [flat[at[k] : at[k + 1]] for k in order[a:z]], threshold)
        ]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float, block_elements: int) -> tuple[DataFrame, str]:
    """Pairs (a, b) that join groups of nodes that share a bucket. Buckets of the same nodes count once."""
    spark = members.sparkSession
    tagged = members.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    same = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "node"), 24)).alias("y")]
    each = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("total"), *same).where("lo <> hi")
    open_ = each.groupBy("m", "x", "y", "total").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("total") / block_elements).cast("int").alias("nb"))
    placed, path = store(tagged.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")))
    size = placed.agg(F.sum(F.col("n") * F.col("nb"))).first()[0] or 0
    tasks = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "label")
    slot = F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets(spark, size * 8.0))).cast("int").alias("slot")
    found = store(tasks.join(sets, "node").select(slot, "key", "i", "j", "block", "node", "label", "els").groupBy("slot").applyInArrow(_join_groups(threshold), "a long, b long"))
    discard(spark, path)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of undirected edges (a, b), label being the least node of its component.

    Large-star and small-star steps by turns until no edge changes; each round is written to the shared folder. Stars are
    formed by joins with the least neighbour of a node, so a node of very many edges isn't collected anywhere."""
    spark = edges.sparkSession
    current, path = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = store(stars)
        discard(spark, path)
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        current, path = new, new_path
        if mark == before and mark[0] == mark[2]:
            break
        before = mark
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(current.select("v", "v").distinct())


def _grouped(docs: DataFrame, text: str, doc_id: str, shingle: int, bands: int, band_rows: int, threshold: float, block_elements: int = BLOCK_ELEMENTS) -> tuple[DataFrame, list[str]]:
    """(doc, th, label) of the documents of groups of two rows or more."""
    spark = docs.sparkSession
    slim = docs.select(F.col(text).alias("text"), integer_id(docs, doc_id).alias("doc_id"), F.xxhash64(text).alias("th"))
    rows = slim.count()
    n = buckets(spark, rows * bands * 20.0)
    signed, p1 = store(slim.mapInArrow(_sign(shingle, bands, band_rows, n), "bucket int, keys binary, nodes binary, sizes binary, doc long, th long, node long"))
    named = signed.where("bucket is null").select("doc", "th", "node")
    members, p2 = store(signed.where("bucket is not null").select("bucket", "keys", "nodes", "sizes").groupBy("bucket").applyInArrow(_collide, "key long, node long, n int, hub long, hub_n int"))
    fits = F.least("n", "hub_n") >= F.lit(threshold) * F.greatest("n", "hub_n")
    pairs, p3 = store(members.where("node <> hub").where(fits).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())

    candidates = members.select("node").distinct()
    chosen = named.join(candidates, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc", "th")).alias("x")).select("node", F.col("x.doc").alias("doc"), F.col("x.th").alias("th"))
    chosen, p4 = store(chosen)
    hashed = slim.withColumnRenamed("doc_id", "doc")
    pick = hashed.join(small(chosen, chosen.count(), 24), ["doc", "th"]).select("text", "node")
    sets, p5 = store(pick.mapInArrow(_sets(shingle), "node long, els array<long>").dropDuplicates(["node"]))

    edges, p6 = store(_verified(pairs, sets, threshold))
    labels, p7 = store(components(edges))
    more, p8 = _across(members, labels, sets, threshold, block_elements)
    labels, p9 = store(components(edges.select("a", "b").union(more)))

    labelled = named.join(labels, "node", "left").select("doc", "th", F.coalesce("label", "node").alias("label"))
    twice = labelled.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th")).alias("keep")).where("n > 1")
    result, p10 = store(labelled.join(twice, "label").select("doc", "th", F.col("keep.doc").alias("keep_doc"), F.col("keep.th").alias("keep_th")))
    discard(spark, p1, p2, p3, p4, p5, p6, p7, p8, p9)
    return result, [p10]


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id, kept) for each document of a group of two or more; documents without near copies have no row."""
    found, _ = _grouped(docs, text, doc_id, shingle, bands, band_rows, threshold)
    kept = (F.col("doc") == F.col("keep_doc")) & (F.col("th") == F.col("keep_th"))
    return found.select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), F.nullif("keep_doc", F.lit(NULL_ID)).alias("kept_doc_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, of each group of near copies only the one that stays; all columns."""
    found, _ = _grouped(docs, text, doc_id, shingle, bands, band_rows, threshold)
    kept = (F.col("doc") == F.col("keep_doc")) & (F.col("th") == F.col("keep_th"))
    gone = found.where(~kept).select("doc", "th").distinct()
    again = found.where(kept).groupBy("doc", "th").count().where("count > 1").select("doc", "th")
    doc, th = free_name(docs, "near_doc"), free_name(docs, "near_th")
    keyed = docs.withColumn(th, F.xxhash64(text)).withColumn(doc, integer_id(docs, doc_id))
    left = keyed.join(small(gone.toDF(doc, th), gone.count(), 16), [doc, th], "left_anti")
    repeats = again.count()
    if repeats:
        twice = small(again.toDF(doc, th), repeats, 16)
        left = left.join(twice, [doc, th], "left_anti").unionByName(left.join(twice, [doc, th], "left_semi").dropDuplicates([doc, th]))
    return left.select(*docs.columns)
