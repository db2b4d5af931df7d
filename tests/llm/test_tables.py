"""Duplicates, packing, neighbours, shards, films and the pipeline against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm import additive_ann, best_fit_packing, histogram_sharding, minhash_dedup, mjpeg, substring_dedup


def documents(spark, texts, extra=""):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return df.selectExpr("*", "cast(length(text) as long) AS n_chars", *[f"'{c}' AS {c}" for c in extra.split()])


def prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def united(places, window):
    out = []
    for p in sorted(places):
        if out and p <= out[-1][1]:
            out[-1][1] = p + window
        else:
            out.append([p, p + window])
    return [tuple(x) for x in out]


def brute_spans(texts, window):
    places = defaultdict(list)
    for d, t in enumerate(texts):
        w = (t or "").split()
        for p in range(len(w) - window + 1):
            places[tuple(w[p : p + window])].append((d, p))
    by = defaultdict(list)
    for found in places.values():
        if len(found) > 1:
            found.sort()
            by[found[0][0], True].append(found[0][1])
            for d, p in found[1:]:
                by[d, False].append(p)
    return sorted((d, kept, a, b) for (d, kept), ps in by.items() for a, b in united(ps, window))


def test_repeated_spans_equal_brute_force(spark):
    rng = random.Random(2)
    shared = [prose(rng, 30) for _ in range(6)]
    texts = []
    for _ in range(120):
        w = prose(rng, rng.randrange(60))
        for s in rng.sample(shared, rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k:k] = s
        texts.append(" ".join(w))
    texts += ["", None, "a b a b a b a b a b a b a b", "x " * 3000]
    out = substring_dedup.repeated_spans(documents(spark, texts, "th doc kept s e"), window=8, span=5).collect()
    assert sorted(map(tuple, out)) == brute_spans(texts, 8)


def test_a_passage_of_very_many_documents_stays_once(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"own{k} {passage} end{k}" for k in range(800)]
    out = substring_dedup.remove_repeats(documents(spark, texts)).orderBy("doc_id").collect()
    assert out[0]["text"] == texts[0] and all(r["text"] == f"own{r['doc_id']} end{r['doc_id']}" and r["n_chars"] == len(r["text"]) for r in out[1:]) and len(out) == 800


def test_cutting_repeats_keeps_columns_and_other_documents(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = documents(spark, [None, "", "short", passage, passage], "cut_doc cut_th cut_spans th doc")
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect())) == [0, 1, 2, 3]
    twice = docs.where("doc_id = 3").union(docs.where("doc_id = 3"))
    assert substring_dedup.remove_repeats(twice).count() == 2
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0 and substring_dedup.repeated_spans(docs.limit(0)).count() == 0


def shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def test_near_duplicates(spark):
    rng = random.Random(4)
    texts = [" ".join(prose(rng, 80, 3000)) for _ in range(60)]
    for k in range(20):  # a few words changed
        w = texts[k].split()
        for _ in range(4):
            w[rng.randrange(len(w))] = "new"
        texts.append(" ".join(w))
    texts += [texts[30]] * 50 + [None, "", "  ", "one two", "one two", "one"]
    out = minhash_dedup.near_duplicates(documents(spark, texts, "th doc node label key")).collect()
    kept = {r["doc_id"]: r["kept_doc_id"] for r in out}
    for k in range(20):
        assert kept[k] == k and kept[60 + k] == k
    assert all(kept[80 + k] == 30 for k in range(50))
    assert kept[len(texts) - 2] == kept[len(texts) - 3] == len(texts) - 3
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    sets = [shingles(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for d in range(len(texts)):
        groups[find(d)].append(d)
    assert {d for g in groups.values() if len(g) > 1 for d in g} == set(kept)


@pytest.mark.parametrize("block", [1 << 19, 30])
def test_groups_in_a_hot_bucket(spark, monkeypatch, block):
    """Many documents that share bands with one another but belong to several groups, compared in one block or in many."""
    monkeypatch.setattr(minhash_dedup._grouped, "__defaults__", (block,))
    rng = random.Random(12)
    base = prose(rng, 60, 5000)
    texts = []
    for _ in range(12):
        own = base[:30] + prose(rng, 40, 5000)
        for _ in range(6):
            w = list(own)
            for _ in range(rng.randrange(14)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    out = {r["doc_id"]: r["kept_doc_id"] for r in minhash_dedup.near_duplicates(documents(spark, texts), bands=200, band_rows=1).collect()}
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    groups = defaultdict(list)
    for d in range(len(texts)):
        groups[find(d)].append(d)
    assert out == {d: g for g, ds in groups.items() if len(ds) > 1 for d in ds} and len(groups) > 8


def test_one_of_each_group_stays(spark):
    texts = [None, None, "", "a b c d", "a b c d", "e f g"]
    docs = documents(spark, texts, "near_doc near_th")
    out = minhash_dedup.keep_one(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3, 5]
    same = docs.where("doc_id = 3").union(docs.where("doc_id = 3")).union(docs.where("doc_id = 3").selectExpr("cast(null as long) doc_id", "text", "n_chars", "near_doc", "near_th"))
    assert [r["doc_id"] for r in minhash_dedup.keep_one(same).collect()] == [None]
    assert minhash_dedup.keep_one(docs.limit(0)).count() == 0 and minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r["label"] for r in minhash_dedup.components(edges).collect()} == {0}


@pytest.mark.parametrize("items", [200_000, 40])
def test_packing_is_whole_and_close_to_best_fit(spark, monkeypatch, items):
    monkeypatch.setattr(best_fit_packing, "ITEMS", items)
    rng = random.Random(6)
    sizes = [rng.choice([rng.randrange(1, 100), rng.randrange(1, 400)]) for _ in range(400)] + [100, 100, 250, 0]
    texts = ["x" * n for n in sizes] + [None, "é" * 120]
    out = best_fit_packing.pack(documents(spark, texts, "uid bin size gap"), capacity=100).collect()
    covered, bins = defaultdict(list), defaultdict(list)
    for r in out:
        covered[r["doc_id"]].append((r["doc_start"], r["doc_start"] + r["n_bytes"]))
        bins[r["bin_id"]].append((r["bin_start"], r["bin_start"] + r["n_bytes"]))
    for d, t in enumerate(texts):
        at = 0
        for a, b in sorted(covered.get(d, [])):
            assert a == at
            at = b
        assert at == len((t or "").encode())
    for parts in bins.values():
        at = 0
        for a, b in sorted(parts):
            assert a == at
            at = b
        assert at <= 100
    gaps: list[int] = []
    for n in sorted((len((t or "").encode()) % 100 for t in texts), reverse=True):
        if n:
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - n)
            else:
                gaps.append(100 - n)
    whole = sum(len((t or "").encode()) // 100 for t in texts)
    assert len(bins) <= 1.1 * (len(gaps) + whole) + 1


def test_the_tail_is_packed_by_best_fit():
    rng = random.Random(13)
    sizes = sorted((rng.randrange(1, 100) for _ in range(300)), reverse=True)
    found = best_fit_packing.best_fit(sizes, 100)
    free: dict[int, int] = {}
    for size, (number, start) in zip(sizes, found, strict=True):
        fit = [g for g in free.values() if g >= size]
        assert free.get(number, 100) == 100 - start and (free[number] == min(fit) if fit else number == len(free))
        free[number] = 100 - start - size
        assert free[number] >= 0


def test_packing_of_nothing(spark):
    assert best_fit_packing.pack(documents(spark, [None, ""])).count() == 0
    assert best_fit_packing.pack(documents(spark, ["a"]).limit(0)).count() == 0


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 24)).astype(np.float32)
    x[5] = x[6]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").selectExpr("*", "1 AS uid", "2 AS block", "3 AS z", "4 AS asked")
    out = {r["vec_id"]: r for r in additive_ann.nearest_neighbours(df, queries=additive_ann.F.expr("vec_id % 20 = 0 or vec_id < 10")).collect()}
    asked = [k for k in range(6000) if k % 20 == 0 or k < 10]
    assert sorted(out) == asked
    d = ((x[asked].astype(np.float64) ** 2).sum(1)[:, None] - 2 * x[asked].astype(np.float64) @ x.T.astype(np.float64)) + (x.astype(np.float64) ** 2).sum(1)
    d[np.arange(len(asked)), asked] = np.inf
    best = np.argsort(d, 1)[:, :10]
    # of a block's 6000 items 220 are compared exactly, so the codes must tell
    assert np.mean([len(set(out[k]["neighbours"]) & set(b)) / 10 for k, b in zip(asked, best, strict=True)]) > 0.95
    assert out[5]["neighbours"][0] == 6 and out[5]["distances"][0] == pytest.approx(0, abs=1e-3)
    assert all(r["distances"] == sorted(r["distances"]) and k not in r["neighbours"] for k, r in out.items())


def test_codes_stand_for_their_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    books = additive_ann.train(x, 4, 64)
    codes, norms = additive_ann.encode(x, books)
    sums = sum(b[codes[:, m]] for m, b in enumerate(books))
    assert np.allclose(norms, (sums**2).sum(1), rtol=1e-4)
    greedy = additive_ann.residuals(x, books)
    assert ((x - sums) ** 2).sum() < (greedy**2).sum() < 0.4 * (x**2).sum()


def test_ids_must_be_integers(spark):
    docs = spark.createDataFrame([("a", "some text", [1.0])], "doc_id string, text string, v array<float>")
    for call in (lambda: substring_dedup.repeated_spans(docs), lambda: substring_dedup.remove_repeats(docs), lambda: minhash_dedup.near_duplicates(docs), lambda: minhash_dedup.keep_one(docs), lambda: additive_ann.nearest_neighbours(docs, vec_id="doc_id", embedding="v")):
        with pytest.raises(TypeError):
            call()


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (None, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [1.0, None]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = additive_ann.nearest_neighbours(df).collect()
    assert sorted((r["vec_id"] or 0, tuple(n or 0 for n in r["neighbours"])) for r in out) == [(0, (1, 1)), (1, (1, 0)), (1, (1, 0))]
    assert additive_ann.nearest_neighbours(df.limit(0)).count() == 0


def test_shards_are_ranges_of_even_bytes(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, "hot" if rng.random() < 0.7 else f"s{rng.randrange(9)}", "x" * rng.randrange(200)) for k in range(3000)], "doc_id long, source string, text string").selectExpr("*", "0 AS shard", "1 AS shard_key", "2 AS key")
    out = histogram_sharding.shard(docs, ["source", "doc_id"], shard_bytes=20_000)
    rows = out.collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r[-1]].append(r)
    total = sum(len(r["text"]) for r in rows)
    order = [(r["source"], r["doc_id"]) for k in sorted(by) for r in sorted(by[k], key=lambda r: (r["source"], r["doc_id"]))]
    assert order == sorted(order)
    assert all(abs(sum(len(r["text"]) for r in g) - total / len(by)) <= 2 * 0.01 * total / len(by) + 200 for g in by.values())


def test_shards_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "a", None), (1, "a", "t"), (1, "a", "t"), (-5, "é", "")], "doc_id long, source string, text string")
    assert histogram_sharding.shard(docs, ["source", "doc_id"], shard_bytes=1).count() == 5
    assert histogram_sharding.shard(docs.limit(0), ["doc_id"]).count() == 0
    many = spark.createDataFrame([(1, "same")] * 300 + [(2, "b" * 50)] * 3, "doc_id long, text string")
    assert histogram_sharding.shard(many, ["doc_id"], shard_bytes=300).where("doc_id = 1").select("shard").distinct().count() == 1


def test_splitters_of_very_many_shards_need_little_of_the_driver():
    import time

    n = 100_000
    keys = [f"{k:08d}" for k in range(4 * n)]
    below = np.arange(4 * n, dtype=np.int64) * 10
    goals = np.array([40 * n * i // n for i in range(1, n)])
    chosen = [None] * len(goals)
    began = time.perf_counter()
    left = histogram_sharding.narrowed(histogram_sharding.Interval("", 0, "", 40 * n, 0, len(goals)), keys[1::8], below[1::8], goals, 5.0, chosen)
    for x in left:
        a, z = int(x.low or -1) + 1, int(x.high or 4 * n)
        assert not histogram_sharding.narrowed(x, keys[a:z], below[a:z], goals, 5.0, chosen)
    assert time.perf_counter() - began < 30
    assert all(abs(10 * int(c) - g) <= 5 for c, g in zip(chosen, goals.tolist(), strict=True))


def film(index=True):
    rng = np.random.default_rng(0)
    dark, light = rng.integers(0, 60, (16, 16)), rng.integers(190, 255, (16, 16))
    return mjpeg.write_avi([mjpeg.encode_jpeg(np.clip(f + rng.integers(-3, 4, (16, 16)), 0, 255).astype(np.uint8)) for f in [dark] * 12 + [light] * 8], fps=10, index=index)


def test_frames_survive_coding():
    gray = np.add.outer(np.arange(24) * 5, np.arange(16) * 3).astype(np.uint8)
    for tables in (True, False):
        for restart in (0, 1):
            assert np.abs(mjpeg.decode_jpeg(mjpeg.encode_jpeg(gray, tables, restart)).reshape(24, 16, -1)[:, :, 0].astype(int) - gray).mean() < 4


def test_clips_of_films(spark):
    raw = film()
    rows = [(1, raw), (2, film(index=False)), (3, None), (4, b""), (5, raw[:40]), (6, b"junk" * 20), (7, raw[:-700]), (1, raw)]
    df = spark.createDataFrame(rows, "media_id long, media binary").selectExpr("*", "1 AS clip", "2 AS start_s")
    out = defaultdict(list)
    for r in mjpeg.clips(df).collect():
        out[r["media_id"]].append((r["clip"], r["first_frame"], r["end_frame"], round(r["start_s"], 6), round(r["end_s"], 6)))
    expected = [(0, 0, 12, 0.0, 1.2), (1, 12, 20, 1.2, 2.0)]
    assert sorted(out[1]) == sorted(expected * 2) and sorted(out[2]) == expected
    assert not {3, 4, 5, 6} & set(out)
    assert mjpeg.clips(df.limit(0)).count() == 0


def test_cuts_between_shots_of_like_brightness():
    rng = np.random.default_rng(8)
    tiles = {"one": [60, 80, 100, 120, 140] * 13, "other": [60, 80, 100, 120, 180] * 13}  # four fifths of the samples are alike
    order = rng.permutation(64)
    frames = [np.kron(np.array(tiles[s])[order].reshape(8, 8), np.ones((8, 8))) + rng.integers(-2, 3, (64, 64)) for s in ["one"] * 10 + ["other"] * 9]
    raw = mjpeg.write_avi([mjpeg.encode_jpeg(f) for f in frames], width=64, height=64)
    assert [r[1:3] for r in mjpeg.clips_of([raw])[0]] == [(0, 10), (10, 19)]


def colour(rng, level, size=32):
    planes = [120 + rng.integers(-3, 4, (size, size)), level + rng.integers(-3, 4, (size // 2, size // 2)), 128 + rng.integers(-3, 4, (size // 2, size // 2))]
    return mjpeg.encode_jpeg(planes, sampling=[(2, 2), (1, 1), (1, 1)], restart=int(rng.integers(0, 3)))


def test_cuts_of_colour_only():
    rng = np.random.default_rng(5)
    raw = mjpeg.write_avi([colour(rng, 90 if k >= 17 else 160) for k in range(36)])
    assert [r[1:3] for r in mjpeg.clips_of([raw])[0]] == [(0, 17), (17, 36)]


def test_side_by_side_decoding_equals_the_plain_one():
    rng = np.random.default_rng(6)
    frames = [mjpeg.encode_jpeg(rng.integers(0, 256, (24, 16)), tables=bool(k % 2), restart=k % 3) for k in range(120)]
    frames += [mjpeg.encode_jpeg([rng.integers(90, 160, (32, 32)), *rng.integers(60, 200, (2, 16, 32))], sampling=[(1, 2), (1, 1), (1, 1)], restart=2 * (k % 2)) for k in range(60)]
    for k in range(0, 180, 4):  # broken and cut ones
        f = bytearray(frames[k])
        for _ in range(3):
            f[int(rng.integers(300 if k % 2 else 620, len(f)) if len(f) > 700 else len(f) - 20)] ^= 1 << int(rng.integers(8))
        frames[k] = bytes(f[: int(rng.integers(len(f) - 40, len(f)))])
    hist, sizes, good = mjpeg.histograms(frames)
    n_good = 0
    for k, f in enumerate(frames):
        try:
            picture = mjpeg.decode_jpeg(f)
        except (ValueError, IndexError, KeyError):
            assert not good[k]
            continue
        n_good += 1
        assert good[k] and sizes[k] == picture.shape[0] * picture.shape[1]
        for c in range(picture.shape[2]):
            assert np.allclose(hist[k, c], np.bincount(picture[:, :, c].ravel(), minlength=256) @ mjpeg._SHARE / sizes[k])
    assert 135 <= n_good < 180


def test_colours_survive_coding():
    x, y = np.meshgrid(np.arange(32), np.arange(32))
    planes = [(x * 3 + y * 2 + 40), (x[:16, :16] * 4 + 60), (y[:16, :16] * 5 + 50)]
    for sampling in ([(2, 2), (1, 1), (1, 1)],):
        out = mjpeg.decode_jpeg(mjpeg.encode_jpeg(planes, sampling=sampling)).astype(int)
        assert out.shape == (32, 32, 3) and all(np.abs(out[:, :, c] - (p if c == 0 else p.repeat(2, 0).repeat(2, 1))).mean() < 5 for c, p in enumerate(planes))


def test_many_films_are_coded_like_single_ones_and_cut_as_planned():
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.125, (60, 64))
    gray = np.clip(rng.normal(128, 60, (7, 16, 24)), 0, 255)
    assert mjpeg.encode_many(gray, np.arange(7) % 2 == 0) == [mjpeg.encode_jpeg(g, tables=k % 2 == 0) for k, g in enumerate(gray)]
    for found, v in zip(mjpeg.clips_of(mjpeg.films_of(vectors)), vectors, strict=True):
        ends = np.cumsum(mjpeg.plan_of(v)).tolist()
        assert [r[1:3] for r in found] == list(zip([0, *ends[:-1]], ends, strict=True))


def test_slices_of_frames_give_the_same_cuts(monkeypatch):
    rng = np.random.default_rng(9)
    films = [*mjpeg.films_of(rng.normal(0, 0.125, (20, 64))), film(), None, b"RIFF", film(index=False)]
    whole = mjpeg.clips_of(films)
    monkeypatch.setattr(mjpeg, "FRAMES", 7)
    assert mjpeg.clips_of(films) == whole


def opendml(frames):
    """A film of two RIFF parts, the frames found through standard indexes only."""
    from struct import pack

    chunk = lambda name, body: name + pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    first = mjpeg.write_avi(frames, fps=10, index=False)
    head = first[12 : 12 + 8 + int.from_bytes(first[16:20], "little")]
    out = b""
    for riff, half in ((b"AVI ", frames[: len(frames) // 2]), (b"AVIX", frames[len(frames) // 2 :])):
        lead = head if riff == b"AVI " else b""
        base = len(out) + 12 + len(lead) + 12
        data, entries = b"", b""
        for f in half:
            entries += pack("<II", len(data) + 8, len(f))
            data += chunk(b"00xx", f)  # not the usual name, so that only the index finds it
        index = chunk(b"ix00", pack("<HBBI4sQI", 2, 0, 1, len(half), b"00dc", base, 0) + entries)
        out += chunk(b"RIFF", riff + lead + chunk(b"LIST", b"movi" + data + index))
    return out


def test_frames_are_found_through_opendml_and_file_offsets():
    raw = film()
    video = mjpeg.parse_avi(raw)
    frames = [raw[a : a + n] for a, n in video.frames]
    found = mjpeg.clips_of([raw])[0]
    assert mjpeg.clips_of([opendml(frames)])[0] == found
    at = raw.index(b"idx1") + 8
    movi = raw.index(b"movi")
    entries = np.frombuffer(raw[at:], np.uint32).reshape(-1, 4).copy()
    entries[:, 2] += movi
    assert mjpeg.clips_of([raw[:at] + entries.tobytes()])[0] == found


def test_hostile_files(spark):
    frame = bytearray(mjpeg.encode_jpeg(np.full((16, 16), 90.0)))
    sof = frame.index(b"\xff\xc0")
    wide, flat = bytearray(frame), bytearray(frame)
    wide[sof + 5 : sof + 9] = b"\xff" * 4
    flat[sof + 11] = 0
    two = bytearray(mjpeg.encode_jpeg([np.full((16, 16), 90.0)] * 2, sampling=[(1, 1), (1, 1)]))
    two[two.index(b"\xff\xc0") + 14] = 0x03
    nested = b"".join(b"LIST" + (12 * (3000 - k)).to_bytes(4, "little") + b"rec " for k in range(3000))
    chunk = lambda name, body: name + len(body).to_bytes(4, "little") + body
    raw = film()
    deep = raw[: raw.index(b"LIST", raw.index(b"strl"))] + chunk(b"LIST", b"movi" + nested)
    rows = [(k, mjpeg.write_avi([bytes(x)] * n)) for k, x in enumerate((wide, flat, two)) for n in (1, 20)] + [(9, b"RIFF" + bytes(4) + deep[8:])]
    df = spark.createDataFrame(rows, "x long, media binary")
    out = mjpeg.clips(df, key="x").collect()
    assert sorted({(r["x"], r["clip"], r["first_frame"]) for r in out}) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
    with pytest.raises(ValueError):
        mjpeg.clips(df.withColumnRenamed("x", "clip"), key="clip")


def frames_of(raw):
    return [raw[a : a + n] for a, n in mjpeg.parse_avi(raw).frames]


@pytest.mark.parametrize("failure", [MemoryError, IndexError, ValueError])
@pytest.mark.parametrize("step", ["coefficients", "plain_coefficients", "_counted"])
def test_failures_that_frames_did_not_cause_are_raised(monkeypatch, step, failure):
    def fails(*_):
        raise failure

    raw = film()
    if step == "plain_coefficients":
        raw = mjpeg.write_avi(frames_of(raw)[6:18])  # too few to be decoded side by side
    monkeypatch.setattr(mjpeg, step, fails)
    with pytest.raises(failure):
        mjpeg.clips_of([raw])


def test_bad_frames_are_counted_in_their_clip(spark, monkeypatch):
    frames = frames_of(film())
    other = [f.replace(b"\xff\xc0", b"\xff\xc2") for f in frames]  # progressive
    mixed = [other[0], *frames[1:5], frames[5][:-9], *frames[6:12], *frames[12:15], b"", *other[16:18], *frames[18:]]
    beyond = bytearray(mjpeg.write_avi(frames))
    beyond[-8:-4] = (1 << 30).to_bytes(4, "little")  # the place of the last frame
    rows = [(0, mjpeg.write_avi(frames)), (1, mjpeg.write_avi(other)), (2, mjpeg.write_avi(mixed)), (3, bytes(beyond)), (4, mjpeg.write_avi([b""] * 3)), (5, mjpeg.write_avi(frames, index=False)[:-1000])]
    found = defaultdict(list)
    for r in sorted(mjpeg.clips(spark.createDataFrame(rows, "media_id long, media binary")).collect()):
        found[r["media_id"]].append((r["first_frame"], r["end_frame"], r["bad_frames"]))
    assert found[0] == [(0, 12, 0), (12, 20, 0)]
    assert found[1] == [(0, 20, 20)]
    assert found[2] == [(0, 12, 2), (12, 20, 2)]
    assert found[3] == [(0, 12, 0), (12, 20, 1)]
    assert found[4] == [(0, 3, 0)]
    assert sum(r[2] for r in found[5]) == 1
    whole = mjpeg.clips_of([raw for _, raw in rows])
    monkeypatch.setattr(mjpeg, "FRAMES", 7)
    assert mjpeg.clips_of([raw for _, raw in rows]) == whole


def test_scans_that_lack_data_are_bad():
    gray = np.random.default_rng(1).integers(60, 200, (64, 64))
    whole = mjpeg.encode_jpeg(gray, restart=4)
    seg = lambda mark, body: bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body
    table = bytes([2] + [0] * 15) + b"\0\1"  # the code of ones only is one, so that what comes beyond the end can be read
    small = mjpeg._head(16, 16, [(1, 1)], False, 0)
    at = small.index(b"\xff\xda")
    head = lambda t: small[:at] + seg(0xC4, b"\0" + t) + seg(0xC4, b"\x10" + t) + small[at:]
    assert mjpeg.decode_jpeg(head(table) + b"\xdb\x6f\xff\xd9").shape == (16, 16, 1)
    cases = {
        "whole": (whole, True),
        "an interval less": (whole[: whole.index(b"\xff\xd3")], False),
        "a whole one of its own table": (head(table) + b"\xdb\x6f\xff\xd9", True),
        "a byte less": (head(table) + b"\xdb\xff\xd9", False),
        "symbols less": (head(table[:-1]) + b"\xdb\x6f\xff\xd9", False),
        "codes too many": (head(bytes([3] + [0] * 15) + b"\0\1\2") + b"\xdb\x6f\xff\xd9", False),
    }
    for name, (raw, fit) in cases.items():
        for n in (1, 20):
            assert mjpeg.histograms([raw] * n)[2].tolist() == [fit] * n, name
        if not fit:
            with pytest.raises(ValueError):
                mjpeg.decode_jpeg(raw)
    mixed = [cases["an interval less"][0], whole] * 12  # of the same header
    assert mjpeg.histograms(mixed)[2].tolist() == [False, True] * 12
    assert np.allclose(mjpeg.histograms(mixed)[0][1::2], mjpeg.histograms([whole])[0])


def test_large_pictures_are_counted_in_strips(monkeypatch):
    rng = np.random.default_rng(2)
    planes = [rng.integers(0, 256, (96, 64)), *rng.integers(0, 256, (2, 48, 32))]
    frames = [mjpeg.encode_jpeg(planes, sampling=[(2, 2), (1, 1), (1, 1)], restart=r) for r in (0, 1, 5)]
    frames += [f.replace(bytes([0, 96, 0, 64]), bytes([0, 90, 0, 61])) for f in frames]
    whole = mjpeg.histograms(frames)
    monkeypatch.setattr(mjpeg, "BLOCKS", 20)
    tops = []
    real = mjpeg.samples
    monkeypatch.setattr(mjpeg, "samples", lambda *a: (tops.append(x[1].shape[1]) or x for x in real(*a)))
    for a, b in zip(mjpeg.histograms(frames), whole, strict=True):
        assert np.allclose(a, b)
    assert whole[2].all() and max(tops) == 16


def test_registered_queries_and_pipeline(spark):
    import __spark_entry__
    import corpus_pipeline

    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in found} and "pipeline" in found
    sf = "/root/testdata/sf0.001"
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    from larkspur.llm import shared

    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = shared.store(stage(spark, docs, sf))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] < 200
    sizes = {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()}
    packed = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        packed[r["doc_id"]] += r["n_bytes"]
    assert packed == {d: n for d, n in sizes.items() if n}


def cut_by_hand(texts, window=50):
    """Texts by id without the words of windows that an earlier (id, place) has, the white space after a cut going with it."""
    first, gone = {}, defaultdict(set)
    words = {d: t.split(" ") for d, t in texts.items()}
    for d in sorted(words):
        for p in range(len(words[d]) - window + 1):
            key = tuple(words[d][p : p + window])
            if first.setdefault(key, (d, p)) != (d, p):
                gone[d] |= set(range(p, p + window))
    return {d: " ".join(w for p, w in enumerate(ws) if p not in gone[d]) for d, ws in words.items()}


def test_pipeline_equals_its_steps_by_hand(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    passage = prose(rng, 60, 10**6)
    texts = {d: " ".join(prose(rng, rng.randrange(5, 200), 10**6)) for d in range(1, 60)}
    for d in range(10, 20):  # near copies of 1 to 10
        w = texts[d - 9].split(" ")
        w[len(w) // 2] = "changed"
        texts[d] = " ".join(w)
    for d in range(30, 40):
        w = texts[d].split(" ") * (5 if len(texts[d].split(" ")) < 150 else 2)
        texts[d] = " ".join(f"{x}_{k}" for k, x in enumerate(w[:200])) + " " + " ".join(passage)
    rows = [(d, t, "en", "s", len(t), "extra") for d, t in texts.items()]
    rows += [rows[0], rows[5], (None, texts[45] + " of nobody", None, None, None, None), (70, None, "en", "s", 0, "x"), (71, "", "en", "s", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, probability string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 0), (1, None, 1), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    all_texts = texts | {-1: texts[45] + " of nobody"}  # a null id sorts first
    sets, keep = {d: shingles(t) for d, t in all_texts.items()}, {}
    for d in sorted(all_texts):
        if not any(len(sets[d] & sets[e]) >= 0.5 * len(sets[d] | sets[e]) for e in keep):
            keep[d] = all_texts[d]
    expected = {d: len(t.encode()) for d, t in cut_by_hand(keep).items() if t}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sums, starts = defaultdict(int), set()
    for r in out:
        sums[-1 if r["doc_id"] is None else r["doc_id"]] += r["n_bytes"]
        starts.add((r["bin_id"], r["bin_start"]))
    assert {d: n for d, n in sums.items()} == pytest.approx(expected, abs=1) and len(starts) == len(out)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
