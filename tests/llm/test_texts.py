"""Tokens, quality, language model and chats against exact versions, other libraries and held-out texts."""

import json
import random

import duckdb
import numpy as np
import pytest
import tiktoken

from larkspur.llm import bpe, chat_tools, maxent_lm, quality_cnn

DATA = "/root/testdata/sf0.001"
HARD = ["", " ", "  a  b\n\n c ", "x  y 　 z", "don't  you're 'tis--ok?!  \t\n x", "\x1c a\x1d b", "naïve — “quoted”, 中文 字。", "a\r\n b\n", "\u0085 x", "aaaa" * 3000, "🎉🎉 é"]


def documents(spark, texts, extra=""):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", *[f"'{c}' AS {c}" for c in extra.split()])


@pytest.fixture(scope="module")
def exact():
    tokens = bpe.read_ranks(bpe.VOCABULARY)
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_tokens_are_those_of_the_merges(spark, exact):
    rng = random.Random(1)
    noise = ["".join(rng.choice("ab cdé'\n.,1 中 ") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts = HARD + noise
    out = {r["doc_id"]: r for r in bpe.round_trip(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert out[k]["tokens"] == exact.encode_ordinary(t), t
        assert out[k]["decoded"] == t and out[k]["n_tokens"] == len(out[k]["tokens"])


def test_tokens_of_nulls_clashing_columns_and_no_rows(spark):
    docs = documents(spark, [None, "a", "a"], "tokens decoded n_tokens")
    out = bpe.round_trip(docs).collect()
    assert [r["tokens"] for r in sorted(out, key=lambda r: r["doc_id"])] == [None, [64], [64]]
    assert out[0]["decoded"] is None or out[0]["doc_id"] != 0
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_collisions_of_hashes_are_seen(exact, monkeypatch):
    e = bpe.Encoder(exact._mergeable_ranks and bpe.read_ranks(bpe.VOCABULARY))
    monkeypatch.setattr(bpe, "mix", lambda x: x * np.uint64(0))
    raw = np.frombuffer(b"one two three", np.uint8)
    at, ids = e.encode_rows(np.array([0, 7, 13]), raw)
    assert ids[at[0] : at[1]].tolist() == exact.encode_ordinary("one two") and ids[at[1] :].tolist() == exact.encode_ordinary(" three")


def test_classifier_on_held_out_documents(spark):
    con = duckdb.connect()
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    found = {r["doc_id"]: r["kept"] for r in quality_cnn.classify(docs, half).collect()}
    assert len(found) == docs.count()
    truth = con.execute("SELECT doc_id, min(quality = 1 AND coalesce(toxic, 0) = 0) FROM '/root/testdata/sf0.01/labels.parquet' WHERE doc_id % 2 = 1 GROUP BY 1").fetchall()
    assert np.mean([found[d] == good for d, good in truth]) > 0.85


def test_classifier_edge_cases(spark):
    docs = documents(spark, [None, "", "fine words " * 50, "fine words " * 50, "x" * 400_000], "probability kept")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_cnn.classify(docs, none).collect()}
    assert [out[k]["probability"] for k in range(5)] == [0, 0, 0.5, 0.5, 0.5] and [out[k]["kept"] for k in range(5)] == [False, False, True, True, True]
    kept = quality_cnn.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 3
    odd = spark.createDataFrame([(2, 1, None), (2, 0, None), (4, 1, None), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert quality_cnn.classify(docs, odd).count() == 5
    assert quality_cnn.classify(docs.limit(0), odd).count() == 0


def test_classifier_covers_the_whole_document():
    rng = np.random.default_rng(3)
    model = quality_cnn.Model(rng.normal(0, 1, (quality_cnn.WIDTH, quality_cnn.CLASSES, 4)).astype(np.float32), np.zeros(4, np.float32), np.ones(4, np.float32), np.zeros(4, np.float32), np.zeros(4, np.float32))
    raw = rng.integers(0, 256, 3 * quality_cnn.CHUNK + 17).astype(np.uint8)
    best, _ = model.pooled(raw)
    cls = np.concatenate([quality_cnn._CLASS[raw], np.zeros(quality_cnn.WIDTH, np.int32)])
    every = np.array([sum(model.w[j, cls[p + j]] for j in range(quality_cnn.WIDTH)) for p in range(len(raw))])
    assert np.allclose(best.max(0), np.maximum(every.max(0), 0), atol=1e-4)


def test_language_model_prefers_texts_to_shuffled_ones(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = maxent_lm.train(docs.select("text"))
    rng, texts = random.Random(5), [r["text"] for r in docs.collect() if len(r["text"].split()) > 50]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    score = lambda ts: sum(r["log_prob"] for r in maxent_lm.score(documents(spark, ts), model).collect())
    assert score(texts) > score(mixed)


def test_language_model_edge_cases(spark):
    docs = documents(spark, [None, "", "  \n", "a b a b", "a b a b", "w " * 200_000], "n_words log_prob perplexity")
    out = {r["doc_id"]: r for r in maxent_lm.score(docs).collect()}
    assert [out[k]["n_words"] for k in range(6)] == [0, 0, 0, 4, 4, 200_000]
    assert out[0]["log_prob"] == 0 and out[0]["perplexity"] is None and out[3]["log_prob"] == out[4]["log_prob"] < 0
    assert maxent_lm.score(docs.limit(0)).count() == 0


def test_language_model_is_a_distribution(spark):
    words = maxent_lm.vocabulary(documents(spark, ["a b c d a b a"]))
    outcomes = maxent_lm.Outcomes(words)
    a, b = maxent_lm.fresh()
    rng = np.random.default_rng(0)
    a += rng.normal(0, 0.1, a.shape)
    b += rng.normal(0, 0.1, b.shape)
    back = [np.array([3]), np.array([1]), np.array([2])]
    total = 0.0
    for c in range(maxent_lm.CLASSES):
        fa, fb = maxent_lm.features(back, np.array([c]))
        pa, _ = maxent_lm._softmax(a, fa, np.array([c]))
        pb, _ = maxent_lm._softmax(b, fb, np.array([0]))
        total += pa[0, c] * pb.sum()
    assert total == pytest.approx(1, abs=1e-4) and len(outcomes.sorted) == 4



def test_words_of_a_bucket_have_probabilities_of_their_own(spark):
    often = [f"often{k}" for k in range(960)]
    texts = [" ".join(often * 5)] * 2 + [" ".join(["ahead gold"] * 3 + [f"rare{k}" for k in range(3000)])]
    model = maxent_lm.train(documents(spark, texts))
    rare = [f"rare{k}" for k in range(3000)] + ["gold", "ahead"]
    p = {w: np.exp(r["log_prob"]) for w, r in zip(rare, sorted(maxent_lm.score(documents(spark, rare), model).collect(), key=lambda r: r["doc_id"]), strict=True)}
    assert sum(p.values()) < 1 and p["gold"] == pytest.approx(3 * min(p[w] for w in rare if maxent_lm_bucket(w) == maxent_lm_bucket("gold")), rel=1e-6)


def maxent_lm_bucket(word):
    (w,) = maxent_lm.words_of(maxent_lm.pa.array([word]))
    return int(w.hashes[0] % np.uint64(maxent_lm.OTHER))


def test_probabilities_in_a_cell_add_up_to_one():
    rng = np.random.default_rng(1)
    counted = rng.integers(0, 6, (3, 200)).astype(np.uint32)
    for one, both in ((1, 2), (3, 77), (99, 99)):
        scored = np.array([[w, one, both] for w in [*range(6), 1000]], np.uint32).T
        assert np.exp(maxent_lm.in_cell(counted, scored)).sum() == pytest.approx(1)
    assert np.allclose(maxent_lm.in_cell(counted), maxent_lm.in_cell(counted, counted))


def test_language_model_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "CELL_BYTES", 256)
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(40)]
    twice = texts + texts[:4]
    out = {}
    for r in maxent_lm.score(documents(spark, twice)).collect():
        out[r["doc_id"]] = r["perplexity"]
    assert len(out) == 44 and maxent_lm.train(documents(spark, twice))[4] > maxent_lm.train(documents(spark, texts[:4]))[4]
    assert max(out[k] for k in (0, 1, 2, 3, 40, 41, 42, 43)) < 0.5 * min(out[k] for k in range(4, 40))


def test_language_model_hashes_and_looks_up_each_word_once(monkeypatch):
    texts = maxent_lm.pa.array(["a b c d", "a b", None, "e"])
    of, words_of, looked_up, hashed = maxent_lm.Outcomes.of, maxent_lm.words_of, [], []
    monkeypatch.setattr(maxent_lm.Outcomes, "of", lambda self, h: looked_up.append(len(h)) or of(self, h))
    monkeypatch.setattr(maxent_lm, "words_of", lambda c: hashed.append(len(c)) or words_of(c))
    outcomes, weights, kept = maxent_lm.Outcomes(np.array([3, 4], np.uint64)), maxent_lm.fresh(), []
    rare, _ = maxent_lm.train_on(iter([texts]), outcomes, *weights, 0.5)
    assert looked_up == [7] and hashed == [4] and rare.sum() == 7
    n, _ = maxent_lm.Scorer(outcomes, *weights).of(texts, lambda w, o: kept.append(maxent_lm.rare_words(w, o, 10)))
    assert looked_up == [7, 7] and hashed == [4, 4] and n.tolist() == [4, 2, 0, 1]
    assert kept[0][1].tolist() == [10, 10, 10, 10, 11, 11, 13] and kept[0][2][1].tolist()[::4] == [0, 0]


def test_outcomes_of_words_that_share_their_last_bits():
    words = np.array([5, 5 + (1 << 20), 7, 0], np.uint64)
    asked = np.array([7, 5 + (1 << 20), 5, 5 + (1 << 21), 0, 1 << 16], np.uint64)
    assert maxent_lm.Outcomes(words).of(asked).tolist() == [2, 1, 0, 960 + 5, 3, 960]
    assert maxent_lm.Outcomes(words[:0]).of(asked[:1]).tolist() == [960 + 7]


@pytest.mark.parametrize("scale", [1, 40, 400])
def test_probabilities_of_small_and_large_weights_wherever_a_text_stands(scale):
    rng = np.random.default_rng(8)
    a, b = ((scale * rng.normal(size=t.shape)).astype(np.float32) for t in maxent_lm.fresh())
    outcomes, texts = maxent_lm.Outcomes(np.zeros(0, np.uint64)), [" ".join(f"w{k}" for k in rng.integers(0, 999, 700)) for _ in range(9)]
    texts = maxent_lm.pa.array([t for x in texts for t in (x, texts[0])])
    _, found = maxent_lm.log_probabilities(texts, outcomes, a, b)
    assert len(set(found[1::2])) == 1
    plain = np.zeros(len(texts))
    for w in maxent_lm.words_of(texts):
        for _, cls, word, *rows in maxent_lm.steps(w, outcomes.of(w.hashes), 10**6):
            for table, at, target in zip((a, b), rows, (cls, word), strict=True):
                z = table.astype(float)[at].sum(1)
                z -= np.logaddexp.reduce(z, 1)[:, None]
                assert np.allclose(maxent_lm._probabilities(table, at), np.exp(z), rtol=1e-2, atol=1e-4)
                plain += np.bincount(w.row_of_word(), np.maximum(z[np.arange(len(z)), target], np.log(1e-30)), len(texts))
    assert np.allclose(found, plain, rtol=1e-4)


def test_sums_of_rows_that_few_and_many_words_have():
    rng = np.random.default_rng(9)
    for r in (rng.integers(0, 3000, 2000), np.minimum(rng.zipf(1.5, 2000), 400), np.zeros(50, int), np.arange(7)):
        gradient, expected = rng.normal(size=(len(r), 32)).astype(np.float32), np.zeros((r.max() + 1, 32))
        np.add.at(expected, r, gradient)
        order = np.argsort(r, kind="stable")
        at, begin = np.unique(r[order], return_index=True)
        assert np.allclose(maxent_lm._sums(gradient, order, begin), expected[at], atol=1e-4)


SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1}}}}


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "2 AS status", "3 AS nth", "4 AS json")


def test_calls_are_linked_ordered_and_validated(spark):
    calls = {"tool_calls": [{"id": "a", "name": "f", "arguments": {"z": 1, "x": 1, "y": {"$ref": "b"}}}, {"id": "b", "name": "f", "arguments": {"x": 0}}, {"id": "c", "name": "g", "arguments": {}}, {"id": "a", "name": "f", "arguments": {"x": 2}}]}
    rows = [(1, 0, "assistant", json.dumps(calls)), (1, 1, "tool", json.dumps({"tool_call_id": "b", "content": "é"})), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "again"})), (1, 3, "tool", json.dumps({"tool_call_id": "q", "content": "lost"}))]
    out = sorted(chat_tools.link(chat(spark, rows), SCHEMAS).collect(), key=lambda r: r["position"])
    assert [(r["call_id"], r["status"]) for r in out] == [("b", "linked"), ("a", "unanswered"), ("c", "unanswered"), ("a", "duplicate"), ("b", "extra"), ("q", "orphan")]
    assert out[0]["errors"] == ["$.x: below minimum"] and out[1]["valid"] and out[2]["errors"] == ["$: no such tool"]
    assert out[1]["json"] == '{"arguments":{"x":1,"y":{"$ref":"b"},"z":1},"id":"a","name":"f","result":null}'


def test_calls_of_odd_messages(spark):
    cycle = {"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1, "y": {"$ref": "b"}}}, {"id": "b", "name": "f", "arguments": {"x": 1, "y": {"$ref": "a"}}}, {"id": "d", "name": "f", "arguments": {"x": 1, "y": {"$ref": "zz"}}}]}
    rows = [(None, 0, "assistant", json.dumps(cycle)), (2, None, "assistant", None), (3, 0, "assistant", "not json"), (4, 0, None, "x"), (5, 0, "tool", "{}"), (6, 0, "assistant", "")]
    out = chat_tools.link(chat(spark, rows), SCHEMAS).collect()
    assert {r["conv_id"] for r in out} == {None} and not any(r["valid"] for r in out) and len(out) == 3
    assert chat_tools.link(chat(spark, []), SCHEMAS).count() == 0


def test_conversations_equal_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    mine = chat_tools.link(chat_tools.exchanges(spark.read.parquet(f"{DATA}/conversations.parquet")), chat_tools.REPLY)
    names = sorted(mine.columns)
    cursor = con.execute(chat_tools.ORACLE)
    at = [[d[0] for d in cursor.description].index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in mine.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def test_ids_out_of_the_vocabulary_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, [64, -1, None, 10**9, 64]), (2, []), (3, None)], "doc_id long, tokens array<int>").selectExpr("*", "'mine' AS decoded")
    out = {r["doc_id"]: r for r in bpe.decode(rows).collect()}
    assert out[1]["decoded_"] == "a���a" and out[2]["decoded_"] == "" and out[3]["decoded_"] is None and out[1]["decoded"] == "mine"
    docs = documents(spark, ["a"], "tokens")
    (r,) = bpe.encode(docs).collect()
    assert r["tokens"] == "tokens" and r["tokens_"] == [64]


def test_long_texts_are_cut_where_parts_end(exact, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 64)
    e = bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))
    rng = random.Random(9)
    texts = ["".join(rng.choice(["word ", "x", "\n", "é", " 中", ", ", "  ", "a's ", "longerword"]) for _ in range(400)) for _ in range(20)] + ["z" * 500]
    at, ids = e.encode_column(bpe.pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [exact.encode_ordinary(t) for t in texts]


def test_words_of_long_texts_are_those_of_short_ones(monkeypatch):
    from larkspur.llm import words

    text = "  some words of  a text\n" * 40 + "one" * 200 + " end"
    (whole,) = words.words_of(words.pa.array([text]))
    monkeypatch.setattr(words, "SLICE_BYTES", 50)
    (parts,) = words.words_of(words.pa.array([text]))
    assert all(np.array_equal(getattr(whole, c), getattr(parts, c)) for c in ("starts", "ends", "hashes", "word_at"))


def test_odd_arguments_and_schemas():
    call = lambda text: {"turn": 0, "place": 0, "call_id": "a", "name": "f", "arguments": text, "result": None, "status": "unanswered"}
    one = lambda text: chat_tools.order_calls([call(text)], {"f": {}})[0]
    for text, error in (("[" * 200_000, "nested too deep"), ("[" * 150 + "]" * 150, "nested too deep"), ('{"x": NaN}', "not JSON"), ("[1e999]", "not JSON"), ("{", "not JSON")):
        assert one(text)["errors"] == [f"$: {error}"] and '"arguments":null' in one(text)["json"]
    lone = one('{"\\ud800": "\\udfff", "b": 1.0}')
    assert json.loads(lone["json"])["arguments"] == {"\ud800": "\udfff", "b": 1.0} and lone["json"].encode() and lone["valid"]
    v = chat_tools.violations
    assert v(True, {"enum": [1]}) and not v(1.0, {"enum": [1]}) and v("abc", {"pattern": "^z"}) and v(3, {"exclusiveMaximum": 3}) and not v(3, {"exclusiveMinimum": 2})
    assert v(1, {"oneOf": [{"type": "integer"}, {"minimum": 0}]}) and not v(1, {"anyOf": [{"type": "string"}, {"minimum": 0}]}) and v(1, {"not": {"type": "integer"}}) and v("é", {"allOf": [{"maxLength": 0}]})
    for schema in ({"type": "text"}, {"properties": {"x": {"dependentRequired": {}}}}, {"items": {"type": ["string", "whole"]}}):
        with pytest.raises(ValueError):
            chat_tools.check_schema(schema)


def plain_model(spark, texts):
    """Outcomes of words, and probabilities of a whole vocabulary by dictionaries and plain sums."""
    words = [[w for w in t.split()] for t in texts]
    (hashed,) = maxent_lm.words_of(maxent_lm.pa.array([" ".join(x for t in words for x in t)]))
    return words, dict(zip((x for t in words for x in t), hashed.hashes, strict=True))


def test_probabilities_and_gradient_steps_equal_plain_sums(spark):
    texts = ["a b c a b d a", "b c", "d d d a"]
    words, hashes = plain_model(spark, texts)
    outcomes = maxent_lm.Outcomes(maxent_lm.vocabulary(documents(spark, texts)))
    rng = np.random.default_rng(4)
    a, b = maxent_lm.fresh()
    a += rng.normal(0, 0.3, a.shape).astype(np.float32)
    b += rng.normal(0, 0.3, b.shape).astype(np.float32)
    number = {w: int(outcomes.of(np.array([h]))[0]) for w, h in hashes.items()}

    def rows_of(history, cls):
        one, two, three = ([maxent_lm.START] * 3 + history)[-1:-4:-1]
        back = [np.array([x]) for x in (one, two, three)]
        fa, fb = maxent_lm.features(back, np.array([cls]))
        return fa[0].tolist(), fb[0].tolist()

    def softmax(table, rows):
        z = [sum(float(table[r][k]) for r in rows) for k in range(table.shape[1])]
        e = [np.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    n, found = maxent_lm.log_probabilities(maxent_lm.pa.array(texts), outcomes, a, b)
    sums = [[np.zeros(a.shape), np.zeros(b.shape)], [np.zeros(len(a)), np.zeros(len(b))]]
    touched: list[list[dict]] = [[{} for _ in range(5)], [{} for _ in range(4)]]
    for t, text in enumerate(words):
        history, total = [], 0.0
        for w in text:
            o = number[w]
            cls, inside = divmod(o, maxent_lm.PER_CLASS)
            fa, fb = rows_of(history, cls)
            for k, (table, rows, target) in enumerate(((a, fa, cls), (b, fb, inside))):
                p = softmax(table, rows)
                total += np.log(p[target])
                gradient = np.array(p) - (np.arange(len(p)) == target)
                for j, r in enumerate(rows):
                    touched[k][j][r] = touched[k][j].get(r, 0) + gradient
            history.append(o)
        assert n[t] == len(text) and found[t] == pytest.approx(total, abs=1e-4)
    new_a, new_b = a.copy(), b.copy()
    rare, seen = maxent_lm.train_on(iter([maxent_lm.pa.array(texts)]), outcomes, new_a, new_b, 0.5)
    assert rare.sum() == 0
    for k, (old, new) in enumerate(((a, new_a), (b, new_b))):
        expected, squares = old.astype(float).copy(), np.zeros(len(old))
        for feature in touched[k]:  # one batch: feature by feature
            for r, g in feature.items():
                squares[r] += (g**2).sum()
                expected[r] -= 0.5 / np.sqrt(squares[r] + 1e-6) * g
        assert np.allclose(new, expected, atol=1e-4) and np.allclose(seen[k], squares, atol=1e-4)


def test_rows_are_averaged_by_those_that_have_them():
    one = (np.array([0, 2]), np.array([1.0, 3.0]), np.array([[1.0, 2.0], [4.0, 4.0]]))
    two = (np.array([2]), np.array([1.0]), np.array([[0.0, 8.0]]))
    assert maxent_lm.averaged([one, two], 4, 2).tolist() == [[1, 2], [0, 0], [3, 5], [0, 0]]


def test_conversations_by_ranges_and_as_graphs_equal_plain_ordering(spark):
    rng = random.Random(3)
    rows, plain = [], {}
    for conv in (None, 1, 2, 3, 4):
        back_only = conv in (1, 2)
        ids = [f"c{k}" for k in range(60 if conv == 1 else 14)]
        calls, turn = [], 0
        for k, i in enumerate(ids):
            refs = [{"$ref": rng.choice(ids[:k] if back_only else [*ids, "gone"])} for _ in range(rng.randrange(3) if k else 0)] if rng.random() < 0.5 else []
            calls.append((turn, {"id": rng.choice([i, i, i, None]) if not back_only else i, "name": "f", "arguments": {"x": rng.randrange(3), "y": refs}}))
            turn += rng.randrange(2)
        for t in sorted({t for t, _ in calls}):
            rows.append((conv, t, "assistant", json.dumps({"tool_calls": [c for u, c in calls if u == t]})))
        for k in range(10):
            rows.append((conv, 100 + k // 2, "tool", json.dumps({"tool_call_id": rng.choice([*ids, None]), "content": f"r{k % 7}"})))
    rng.shuffle(rows)
    linked, _ = chat_tools._linked(chat(spark, rows), "conv_id", "turn", "role", "text")
    for r in linked.collect():
        plain.setdefault(r["conv_id"], []).append(r.asDict())
    expected = sorted(((conv, *o.values()) for conv, group in plain.items() for o in chat_tools.order_calls(group, SCHEMAS)), key=repr)
    out = chat_tools.link(chat(spark, rows), SCHEMAS)
    assert out.columns == ["conv_id", "position", "call_id", "name", "status", "valid", "errors", "json"]
    assert sorted(map(tuple, out.collect()), key=repr) == expected
