import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlytics.llm import components, embedding_dedup, minhash, substring_dedup
from turnlytics.llm.common import Scratch, hash_runs, mix, sliding_min

SPACE = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def sets_of(rows, n):
    out = {}
    for doc, text, _ in rows:
        w = SPACE.findall((text or "").translate(LOWER))
        out[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_minhash_equals_all_pairs(documents, rows, shingle, percent):
    sets = sets_of(rows, shingle)
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = classes(sets, links)
    got = minhash.near_duplicates(documents, shingle, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_minhash_large_group_of_near_copies(spark):
    """A family whose members differ from each other too much, but not from their origin, which has the largest id."""
    rng = random.Random(3)
    origin = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(260):
        w = list(origin)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 4, 6, 9])):
            w[k] = f"e{i}x{k}"
        if i % 5 == 0:
            w = w[: 150 - 3 * (i % 7)]
        rows.append((i, " ".join(w), None))
    rows.append((999, " ".join(origin), None))
    sets = sets_of(rows, 3)
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = classes(sets, links)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), 3, 85).collect()}
    assert got == want


def test_minhash_null_id_and_empty_table(spark, no_documents):
    assert minhash.near_duplicates(no_documents).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, None, False), (1, 1, True), (2, 1, False)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:850], np.unique(rng.integers(0, 2**63, 150).astype(np.uint64))])
    s = minhash.signatures([a, b], 1000)
    assert abs((s[0] == s[1]).mean() - 850 / 1150) < 0.04


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(1000, 1200)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7)] + [(rng.randrange(9000, 9100), rng.randrange(9000, 9100)) for _ in range(60)]
    nodes = {n for link in links if link[0] != link[1] for n in link}
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"))
    assert {r["node"]: r["component_id"] for r in got.collect()} == classes(nodes, [x for x in links if x[0] != x[1]])
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def windows_removed(rows, n):
    words = {}
    for doc, text, _ in rows:
        words[doc] = SPACE.findall(text or "")
    first = {}
    for doc in sorted(words):
        w = words[doc]
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), doc)
    out = {}
    for doc, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < doc:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 20])
def test_substring_dedup_equals_all_windows(documents, rows, window):
    every, changed = substring_dedup.duplicate_passages(documents, window=window, gram=8)
    got = every.join(changed, ["doc_id", "text_key"], "left").withColumn("sha", F.coalesce(F.sha2("kept_text", 256), "digest")).collect()
    want = windows_removed(rows, window)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"] or 0, r["sha"]) for r in got} == want
    texts = {d: SPACE.findall(t or "") for d, t, _ in rows}
    for r in changed.collect():  # every factor stands in its reference, an earlier document
        for f in r["factors"]:
            part = texts[r["doc_id"]][f["first_word"] : f["first_word"] + f["words"]]
            assert len(part) == f["words"] >= window and f["source"] < r["doc_id"]
            assert " ".join(part) in " ".join(texts[f["source"]])


def factors_of(words, references, window):
    made = substring_dedup.parse([str(w).encode() for w in words], [(source, place, [str(w).encode() for w in part]) for source, place, part in references], window)
    return [(f["first_word"], f["words"], f["source"], f["source_word"]) for f in made]


def test_parse_is_greedy_and_checks_boundaries():
    a = list(range(100, 140))
    # one reference goes on past the start of another, smaller one: the longer match is the factor
    assert factors_of([1, *a, 2], [(5, 0, a[:12]), (6, 7, a)], 10) == [(1, 40, 6, 7)]
    # the second factor starts inside the first one: windows that straddle its end are looked up
    assert factors_of([*a[:30], 9], [(5, 0, a[:20]), (6, 0, a[15:30])], 10) == [(0, 20, 5, 0), (15, 15, 6, 0)]
    # between two references nothing of a window's length is shared
    assert factors_of([*a[:10], 7, *a[10:20]], [(5, 0, a[:20])], 10) == [(0, 10, 5, 0), (11, 10, 5, 10)]
    assert factors_of(a[:9], [(5, 0, a)], 10) == factors_of(a, [], 10) == factors_of([], [], 10) == []
    # repetitions, and equal matches: the first place of the smallest reference
    assert factors_of([3] * 25, [(5, 0, [3] * 12), (6, 0, [3] * 12)], 10) == [(0, 12, 5, 0), (3, 12, 5, 0), (6, 12, 5, 0), (9, 12, 5, 0), (12, 12, 5, 0), (15, 10, 5, 0)]


def test_parse_covers_what_all_windows_cover():
    rng = random.Random(5)
    for _ in range(300):
        n, window = rng.randrange(0, 60), rng.randrange(2, 6)
        words, references = [rng.randrange(3) for _ in range(n)], [(k, 0, [rng.randrange(3) for _ in range(rng.randrange(0, 25))]) for k in range(3)]
        held = {tuple(r[i : i + window]) for _, _, r in references for i in range(len(r) - window + 1)}
        want = {i + k for i in range(n - window + 1) if tuple(words[i : i + window]) in held for k in range(window)}
        assert {i + k for i, size, _, _ in factors_of(words, references, window) for k in range(size)} == want


def test_parse_compares_words_not_hashes(monkeypatch):
    monkeypatch.setattr(substring_dedup, "hash_words", lambda data, starts, ends: np.ones(len(starts), np.uint64))
    assert factors_of([1, 2, 3, 4, 5], [(0, 0, [1, 2, 3, 9]), (1, 0, [7, 7, 7, 7])], 3) == [(0, 3, 0, 0)]


def test_blocks_of_one_text_join():
    words = [f"w{i}" for i in range(40)]
    block = lambda k: {"source": 1, "number": k, "words": " ".join(words[k * 8 : k * 8 + 8 + 4])}
    got = substring_dedup.joined_blocks([block(3), block(0), block(1)], 5, 8)
    assert [(s, p, [w.decode() for w in part]) for s, p, part in got] == [(1, 0, words[:20]), (1, 24, words[24:36])]


def test_substring_dedup_string_ids_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [("d1", a), ("d2", b + " " + a), ("d2", c), ("d3", c + " x"), ("d3", c + " x"), (None, a), ("d4", None), ("d5", "")]
    _, changed = substring_dedup.duplicate_passages(spark.createDataFrame(rows, "doc_id string, text string"))
    got = sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in changed.collect())
    assert got == [("d2", 80, b), ("d3", 80, "x")]


def test_substring_dedup_empty_table(no_documents):
    every, changed = substring_dedup.duplicate_passages(no_documents)
    assert every.count() == changed.count() == 0


def test_sliding_min_and_runs():
    x = np.random.default_rng(0).integers(0, 2**62, 200).astype(np.uint64)
    for n in (1, 2, 5, 39):
        assert (sliding_min(x, n) == np.array([x[i : i + n].min() for i in range(len(x) - n + 1)])).all()
    same = np.concatenate([x[:50], mix(x[:3]), x[:50]])
    runs = hash_runs(same, 20)
    assert (runs[:31] == runs[53:]).all() and len(np.unique(runs)) == len(runs) - 31


def vectors(spark):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for label in range(3):
        for _ in range(60):
            v = rng.standard_normal(32)
            for k in range(rng.integers(1, 4)):
                noise = rng.standard_normal(32) * rng.choice([0.02, 0.1, 0.3])
                rows.append((n, [float(y) for y in v + noise * (k > 0)], label))
                n += 1
    centre = rng.standard_normal(32)
    for _ in range(400):  # a hot group of near copies
        rows.append((n, [float(y) for y in centre + rng.standard_normal(32) * 0.15], 1))
        n += 1
    for _ in range(5):
        rows.append((n, rows[3][1], rows[3][2]))  # equal vectors
        n += 1
    for odd in (None, [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] * 32, [1.0, 2.0], []):
        rows.append((n, odd, 1))
        n += 1
    rows += [(n, rows[0][1], None), rows[0]]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize(("recall", "element"), [(0.99, "double"), (0.99, "float")])
def test_embedding_dedup_equals_all_pairs(spark, recall, element):
    """At the recall that the query uses, too; single-precision vectors are compared in double precision."""
    rows, frame = vectors(spark)
    if element == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame = frame.withColumns({c: F.lit(1) for c in ("id", "keys", "unit", "tab", "n", "copies")})
    good = {}
    for i, v, label in rows:
        if v and len(v) == 32 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v))
    links = set()
    for a, b in itertools.combinations(sorted(good), 2):
        if good[a][0] == good[b][0]:
            x, y = good[a][1], good[b][1]
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links.add((a, b))
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_duplicates(frame, recall=recall).collect()}
    assert set(got) == {r[0] for r in rows}
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    found = sum(got[i]["n_links"] for i in got)
    assert all(got[i]["n_links"] <= degree[i] for i in got)  # none below the threshold
    assert found >= 0.99 * 2 * len(links)  # recall against brute force
    want = classes(got, links)
    assert sum(got[i]["component_id"] == want[i] for i in got) >= 0.99 * len(got)
    for i in got:
        assert got[i]["kept"] == (got[i]["component_id"] == i)


def test_embedding_dedup_empty_and_single(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_duplicates(empty).count() == 0
    one = spark.createDataFrame([(4, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in embedding_dedup.embedding_duplicates(one).collect()] == [(4, 0, 4, True)]


def test_rotations_balance_bits():
    x = np.random.default_rng(0).standard_normal((3000, 24)) * np.linspace(0.2, 3, 24)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, p = embedding_dedup.fit_rotations(x, 2)
    share = ((x - mean) @ p >= 0).mean(axis=0)
    assert p.shape == (24, 48) and (abs(share - 0.5) < 0.1).all()
