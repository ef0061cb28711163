"""The intent classifier's features."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from turnlytics.functions import text_features as X
from turnlytics.operators import intent


def test_texts_without_known_words_are_told_by_their_characters(spark):
    """Labels of texts without spaces, and of texts whose words are all new, follow from characters only."""
    rows = [(i, f"今日は天気がいいですね{chr(0x4E00 + i)}" if i % 2 else f"人工智能正在改变世界{chr(0x5E00 + i)}", "ja" if i % 2 else "zh") for i in range(60)]
    rows += [(100 + i, f"running{i}ing walking{i}ing" if i % 2 else f"unhappy{i}xo unkind{i}xo", "ing" if i % 2 else "un") for i in range(60)]
    rows += [(200 + i, "plain words that come again", "plain") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = intent.train_and_predict(frame).where("is_test").collect()
    assert len(got) > 10 and {r["label"] for r in got} == {"ja", "zh", "ing", "un", "plain"}
    assert all(r["pred"] == r["label"] for r in got)


def test_character_terms_are_n_grams_within_padded_words(spark):
    frame = spark.createDataFrame([(1, "Ab c"), (2, None), (3, " ")], "id long, text string")
    got = sorted(r["term"] for r in intent.character_terms(frame, "id", "text").collect())
    assert got == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])


def brute_terms(text):
    text = (text or "").lower()
    words = re.findall(r"\w{2,}", text)
    out = Counter(("word", w) for w in words)
    out.update(("word", f"{a} {b}") for a, b in zip(words, words[1:], strict=False))
    for w in text.split():
        p = f" {w} "
        for n in (2, 3, 4):
            out.update(("char", p[i : i + n]) for i in range(len(p) - n + 1))
    return out


TEXTS = ["Ab c ab", None, "", " ", "日本 日本 東京", "one two one two x_1 é9", "The river. The RIVER! the river bank", "a" * 500 + " b"] + [f"word{k % 7} other{k % 3} the end {k}" for k in range(60)]


def test_codes_name_the_terms_of_texts():
    t = X.Terms(TEXTS)
    for i, text in enumerate(TEXTS):
        mine = t.row == i
        got = dict(zip(t.codes[t.term[mine]].tolist(), t.count[mine].tolist(), strict=True))
        assert got == {X.term_code(*k): n for k, n in brute_terms(text).items()}
    names = X.named(TEXTS, t.codes)
    assert set(names.values()) == {k for text in TEXTS for k in brute_terms(text)} and all(X.term_code(*v) == c for c, v in names.items())
    few = np.sort(t.codes[::3])
    part = X.Terms(TEXTS, few)
    whole = {(int(r), int(c)): int(n) for r, c, n in zip(t.row, t.codes[t.term], t.count, strict=True)}
    assert {(int(r), int(c)): int(n) for r, c, n in zip(part.row, few[part.term], part.count, strict=True)} == {k: n for k, n in whole.items() if k[1] in set(few.tolist())}


def test_counts_beyond_a_packed_number():
    assert [x.tolist() for x in X._summed(np.array([1, 0, 1]), np.array([2, 0, 2]), np.array([1 << 21, 3, 5]), 3)] == [[0, 1], [0, 2], [3, (1 << 21) + 5]]


def test_vocabulary_and_features_are_sublinear_tfidf(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string").repartition(3)
    codes, block, idf = intent.vocabulary(frame)
    df = Counter(k for t in TEXTS for k in brute_terms(t))
    kept = {k for k, n in df.items() if n >= 2}
    assert set(codes.tolist()) == {X.term_code(*k) for k in kept}
    place = {X.term_code(*k): k for k in kept}
    for c, b, w in zip(codes.tolist(), block.tolist(), idf.tolist(), strict=True):
        assert (X.BLOCKS[b], round(w, 9)) == (place[c][0], round(math.log((1 + len(TEXTS)) / (1 + df[place[c]])) + 1, 9))
    for r in intent.features(frame, codes, block, idf).collect():
        want = {}
        for name in X.BLOCKS:
            x = {k: (1 + math.log(n)) * (math.log((1 + len(TEXTS)) / (1 + df[k])) + 1) for k, n in brute_terms(TEXTS[r["id"]]).items() if k in kept and k[0] == name}
            length = math.sqrt(sum(v * v for v in x.values()))
            want |= {k: v / length for k, v in x.items()}
        got = {place[int(codes[i])]: v for i, v in zip(r["indices"], r["values"], strict=True)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(intent.vocabulary(frame, word_features=5, character_features=9)[0]) == 14


def test_fit_reaches_the_optimum(spark):
    """The loss of the fitted weights is no higher than that of plain gradient descent on the same features."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice([f"{c}{k}" for k in range(9)], 6)), c) for i, c in enumerate(rng.choice(["alpha", "beta", "gamma"], 120))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = intent.fit_sample(frame, "doc_id", 10_000)
    x = np.zeros((len(rows), len(model.codes)))
    for r in intent.features(frame.select("doc_id", "text"), model.codes, model.block, model.idf).collect():
        x[r["doc_id"], r["indices"]] = r["values"]
    y = np.array([model.classes.index(r[2]) for r in rows])

    def loss(w, b):
        z = x @ w + b
        z = z - z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        return -np.log(p[np.arange(len(y)), y]).sum() + (w * w).sum() / (2 * 4.0), p

    w, b = np.zeros_like(model.weights), np.zeros(3)
    for _ in range(3000):
        _, p = loss(w, b)
        p[np.arange(len(y)), y] -= 1
        w -= 0.02 * (x.T @ p + w / 4.0)
        b -= 0.02 * p.sum(axis=0)
    assert loss(model.weights, model.intercepts)[0] <= loss(w, b)[0] * 1.01
    assert (x @ model.weights + model.intercepts).argmax(axis=1).tolist() == y.tolist()


def test_exported_weights_predict_like_the_model(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "lang AS label")
    rows = given.unionByName(spark.createDataFrame([(10**6, None, None), (10**6 + 1, "ab", None), (10**6 + 2, "zzzzzz qqqqqq", None)], given.schema))
    usable = rows.where("label IS NOT NULL AND text IS NOT NULL")
    model = intent.fit_sample(usable, "doc_id", 1000, word_features=3000, character_features=3000)
    by = lambda frame: {r["doc_id"]: (r["pred"], round(r["proba_max"], 5)) for r in frame.collect()}
    want = by(intent.predict(rows.drop("label"), model))
    table = model.table(usable)
    assert table.count() == len(model.codes) == 6000
    assert by(intent.softmax_scores(rows, table, model.classes, model.intercepts.tolist())) == want
    assert by(intent.softmax_scores(rows, table, model.classes, model.intercepts.tolist(), part_bytes=100_000)) == want  # several parts of the model
    assert want[10**6] == want[10**6 + 1] == (None, 0.0) and len(want) == rows.count()
    assert by(intent.predict(rows.drop("label").limit(0), model)) == {}


def test_prediction_exchanges_no_terms(spark):
    rows = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    model = intent.IntentModel(np.array([5], np.uint64), np.array([0]), np.array([1.0]), np.array([[1.0, 2.0]]), ["a", "b"], np.array([0.0, 0.5]))
    assert "Exchange" not in intent.predict(rows, model)._jdf.queryExecution().executedPlan().toString()
    one = intent.IntentModel(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 1)), ["only"], np.array([0.0]))
    assert [r["pred"] for r in intent.predict(rows, one).collect()] == ["only"]


def test_shards_keep_their_names_and_empty_inputs_get_no_intent(spark):
    rows = spark.createDataFrame([(1, "s1", "write the code please", False), (2, "s1", "write the code please", True), (3, "s2", None, False)], "conv_id long, shard string, intent_text string, has_empty_user_input boolean")
    model = intent.IntentModel.read(spark.createDataFrame([("word", "code", 1.0, [1.0, -1.0])], "block string, term string, idf double, weights array<double>"), ["coding", "other"], [0.0, 0.0])
    got = {r["conv_id"]: (r["intent"], round(r["proba_max"], 4), r["shard"]) for r in intent.predict_shards(rows, model).collect()}
    assert got == {1: ("coding", round(math.exp(1) / (math.exp(1) + math.exp(-1)), 4), "s1"), 2: (None, 0.0, "s1"), 3: (None, 0.0, "s2")}


def test_probabilities_are_not_rounded_to_floats(spark):
    """A float in between would turn the fifth decimal of some."""
    rows = spark.createDataFrame([(1, "code"), (2, "x"), (3, "other words")], "doc_id long, text string")
    low = math.log(1 / 0.7000050001 - 1)  # 0.7000050001 rounds up; the nearest float lies below 0.700005
    weights = spark.createDataFrame([("word", "code", 1.0, [-low, 0.0])], "block string, term string, idf double, weights array<double>")
    got = {r["doc_id"]: r["proba_max"] for r in intent.softmax_scores(rows, weights, ["a", "b"], [0.0, 0.0], least=2).collect()}
    assert abs(got[1] - 0.7000050001) < 1e-12 and got[2] == 0.0 and got[3] == 0.5
    assert round(got[1], 5) != round(float(np.float32(got[1])), 5)


def test_tfidf_moves_terms_per_chunk_not_per_document(spark, monkeypatch):
    """Repeated and null ids, texts without terms; only chunks of texts and their distinct terms are exchanged."""
    rows = [(k % 50, f"the river {k % 7} bank {k % 3} word{k}") for k in range(60)] + [(None, "the river"), (70, None), (71, ""), (72, "x")]
    frame = spark.createDataFrame(rows, "id long, text string")
    monkeypatch.setattr(intent, "CHUNK_CHARS", 200)
    out = intent.tfidf(frame, "id", "text", intent.word_list)
    got = {(r["id"], r["term"]): r["weight"] for r in out.collect()}
    tf = Counter()
    for ident, text in rows:
        words = re.findall(r"\w{2,}", (text or "").lower())
        tf.update((ident, t) for t in [*words, *map(" ".join, zip(words, words[1:], strict=False))])
    df, docs = Counter(t for _, t in tf), len({i for i, _ in tf})
    x = {(i, t): (1 + math.log(n)) * (math.log((1 + docs) / (1 + df[t])) + 1) for (i, t), n in tf.items() if df[t] > 1}
    norm = Counter()
    for (i, _), v in x.items():
        norm[i] += v * v
    assert got.keys() == x.keys() and all(abs(got[k] - v / math.sqrt(norm[k[0]])) < 1e-9 for k, v in x.items())
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text and "Window" not in text and "Exchange hashpartitioning(id" not in text


def test_solver_keeps_equal_rows_once_and_ends_soon():
    """Loss and gradient equal those of all rows in a dense matrix; labels that hardly follow from the rows, and features of unlike
    frequency, take few steps."""
    rng = np.random.default_rng(5)
    n, features, classes = 400, 300, 3
    chance = np.geomspace(0.004, 0.9, features)
    distinct = (rng.random((50, features)) < chance) * rng.uniform(0.5, 5, features)
    distinct /= np.maximum(np.linalg.norm(distinct, axis=1, keepdims=True), 1e-9)
    x, label = distinct[rng.integers(0, 50, n)], rng.integers(0, classes, n)
    row, index = np.nonzero(x)
    problem = intent.Softmax(np.bincount(row, minlength=n), index, x[row, index], label, features, classes, 4.0)
    assert len(problem.seen) == 50 and problem.seen.sum() == n and 0 < len(problem.often) < features
    w = rng.normal(size=(features + 1, classes))
    z = x @ w[:-1] + w[-1]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    error = p - np.eye(classes)[label]
    loss, gradient = problem(w.ravel())
    assert abs(loss - (-np.log(p[np.arange(n), label]).sum() + (w[:-1] ** 2).sum() / 8)) < 1e-3
    assert np.abs(gradient - np.concatenate([x.T @ error + w[:-1] / 4, error.sum(axis=0, keepdims=True)]).ravel()).max() < 1e-3
    far = problem(intent.minimise(problem, np.zeros(w.size), 3000, 1e-9))[0]
    steps = []
    problem.__class__ = type("Counted", (intent.Softmax,), {"__call__": lambda self, y: steps.append(1) or intent.Softmax.__call__(self, y)})
    found = problem.fitted(3000, 1e-5)
    assert len(steps) < 60 and problem(found.ravel())[0] <= far * (1 + 1e-3)


def test_repeated_texts_are_scored_alike(spark):
    texts = ["alpha alpha beta", "gamma delta", None, "abc", "alpha delta x"]
    rows = [(i, texts[i * 7 % 5]) for i in range(450)]
    model = intent.IntentModel.read(spark.createDataFrame([("word", "alpha", 1.5, [1.0, -1.0]), ("word", "delta", 1.0, [-2.0, 2.0]), ("char", " d", 1.0, [-0.5, 0.5])], "block string, term string, idf double, weights array<double>"), ["a", "d"], [0.1, -0.1])
    got = {r["doc_id"]: (r["pred"], r["proba_max"]) for r in intent.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    alone = {t: next((r["pred"], r["proba_max"]) for r in intent.predict(spark.createDataFrame([(0, t)], "doc_id long, text string"), model).collect()) for t in texts}
    assert got == {i: alone[t] for i, t in rows} and alone[None] == (None, 0.0) == alone["abc"] and alone[texts[0]][0] == "a" and alone[texts[1]][0] == "d"


def test_all_rows_are_fitted_equal_texts_once(spark, monkeypatch):
    """The fit is that of every row: loss and weights equal those of all rows in a dense matrix, over several blocks and slices."""
    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice([f"{c}{k}" for k in range(9)], 3)) if i % 4 else "same words again", str(rng.choice([c, "alpha"]))) for i, c in enumerate(rng.choice(["alpha", "beta", "gamma"], 300))] + [(None, "beta"), ("", "beta"), ("x", None)]
    frame = spark.createDataFrame(rows, "text string, label string").repartition(3)
    for name, value in (("BLOCK_TEXTS", 40), ("SLICE", 100), ("BLOCK_SHARE", 0.1)):
        monkeypatch.setattr(intent, name, value)
    model = intent.fit(frame, tolerance=1e-9)
    kept = [(t, k) for t, k in rows if k]
    codes, block, idf = intent.vocabulary(spark.createDataFrame(kept, "text string, label string"))
    assert model.classes == ["alpha", "beta", "gamma"] and (model.codes == codes).all() and np.allclose(model.idf, idf)
    x = np.zeros((len(kept), len(codes)))
    for r in intent.features(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(kept)], "i long, text string"), codes, block, idf).collect():
        x[r["i"], r["indices"]] = r["values"]
    label = np.array([model.classes.index(k) for _, k in kept])
    row, index = np.nonzero(x)
    problem = intent.Softmax(np.bincount(row, minlength=len(x)), index, x[row, index], label, len(codes), 3, 4.0)
    whole, mine = problem.fitted(3000, 1e-9), np.vstack([model.weights, model.intercepts])
    assert abs(problem(mine.ravel())[0] / problem(whole.ravel())[0] - 1) < 1e-5 and np.abs((x @ (mine - whole)[:-1])).max() < 0.02


def test_shards_are_predicted_without_a_sample(spark, monkeypatch):
    from turnlytics.plans import labelling

    def never(*args):
        raise AssertionError("a sample was drawn")

    monkeypatch.setattr(intent, "sampled", never)
    assert labelling.QUERIES["intent_by_shard"](spark, "/root/testdata/sf0.001").count() == 800


def test_tfidf_moves_codes_not_terms(spark, monkeypatch):
    """No term is exchanged or written on the way, and a chunk gives the same order of codes whatever the order of its terms."""

    def never(*args):
        raise AssertionError("terms were written")

    monkeypatch.setattr(intent, "shared_folder", never)
    monkeypatch.setattr(intent, "CHUNK_CHARS", 300)
    frame = spark.createDataFrame([(k, f"the river {k % 7} bank {k % 3} word{k}") for k in range(60)], "id long, text string")
    out = intent.tfidf(frame, "id", "text", intent.word_list)
    assert "hashpartitioning(term" not in out._jdf.queryExecution().executedPlan().toString() and out.where("term = 'the river'").count() == 60
    names = pa.array([f"word{k}" for k in range(200)])
    order, codes, edge = intent._coded(names, 7)
    mixed = np.random.default_rng(1).permutation(200)
    again, same, edges = intent._coded(names.take(pa.array(mixed)), 7)
    assert (codes == same).all() and (edge == edges).all() and (mixed[again] == order).all() and edge[0] == 0 and edge[-1] == 200
