import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from turnlytics.llm import repeated_bytes
from turnlytics.llm.queries import repeated_bytes_query


def brute(texts, length):
    """By listing every window of every text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def noise(seed, n=400):
    return "".join(random.Random(seed).choices("abcdefg", k=n))


def found(docs, **options):
    every, changed = repeated_bytes.repeated_bytes(docs, **options)
    rows = every.join(changed, "digest", "left").collect()
    out = []
    for r in rows:
        kept = (r["text"] or "").encode() if r["kept"] is None else bytes(r["kept"])
        out.append((r["doc_id"], (r["n_bytes"], r["n_removed"] or 0, len(r["spans"] or []), hashlib.sha256(kept).hexdigest())))
        assert all(a < z for a, z in r["spans"] or []) and sum(z - a for a, z in r["spans"] or []) == (r["n_removed"] or 0)
    return sorted(out, key=str)


def some_texts():
    """Copies, near copies, passages one byte short of a window, runs, periods, repeats within a text."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("the of river stone cloud gärden 窓 yellow".split()) + str(rng.randrange(30)) for _ in range(n))
    base = prose(300)
    texts = [None, "", "x", base, base, prose(100) + base[400:600] + prose(90), prose(20) + base[700:899] + prose(30), prose(10) + base[700:900] + "!"]
    for k in (1, 3, 9, 30):
        near = list(base)
        for i in rng.sample(range(len(near)), k):
            near[i] = "#"
        texts.append("".join(near))
    texts += ["a" * 199, "b" * 200, "c" * 201, "d" * 5000, "ab" * 2500, "abc" * 90 + "x", "\x00" * 300, prose(8) + "e" * 260 + prose(5), "e" * 230]
    once = prose(60)
    texts += [once + "|" + once, prose(40), base[:200], base[:199], "z" + base[:200], base[-200:] + "z"]
    texts += [prose(12) + base[900:1110] + prose(12) for _ in range(25)]
    texts += [prose(3) + base[1000:1000 + n] for n in range(195, 290, 7)]
    return texts


@pytest.mark.parametrize("options", [{}, {"crowded": 3}, {"length": 90}, {"length": 333, "crowded": 0}])
def test_equal_to_all_windows(spark, options):
    texts = some_texts()
    docs = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in enumerate(texts)], "doc_id int, text string, core string, key string, n int").repartition(6)
    assert found(docs, **options) == sorted(enumerate(brute(texts, options.get("length", 200))), key=str)


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    texts = [long + long[3000:3600], long[5000:5900], "q" * 3000]
    got = []
    for segment in (500, 1 << 22):
        monkeypatch.setattr(repeated_bytes, "SEGMENT", segment)
        data = np.frombuffer(texts[0].encode(), np.uint8)
        t = repeated_bytes.parse(data, np.array([0, len(data)]), 200)
        windows = sorted((int(p - d)) for p, a, z in zip(t[1], t[2], t[3], strict=True) for d in range(a, z + 1))
        assert windows == list(range(len(data) - 199))
        assert all(data[p : p + 137].tobytes() == texts[0].encode()[p : p + 137] for p in t[1].tolist())
        got.append({int(p - d): int(p) for p, a, z in zip(t[1], t[2], t[3], strict=True) for d in range(a, z + 1)})
    assert got[0] == got[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs) == sorted(enumerate(brute(texts, 200)), key=str)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = noise(1)
    rows = [(None, text), (None, text), (1, text[:300] + "?"), (1, text[:300] + "?"), (2, "w" * 150), (2, "w" * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == sorted(zip([r[0] for r in rows], brute([r[1] for r in rows], 200), strict=True), key=str)
    every, changed = repeated_bytes.repeated_bytes(docs.limit(0))
    assert every.count() == 0 and changed.count() == 0
    alone = spark.createDataFrame([(5, text)] * 2 + [(6, text[100:] + "!")], "doc_id long, text string")
    assert [r[1][1] for r in found(alone)] == [400, 400, 300]


def test_texts_of_one_row_repeat_nothing(spark):
    """A row is no copy of itself, however often its id stands elsewhere."""
    docs = spark.createDataFrame([(1, noise(k)) for k in range(3)], "doc_id long, text string")
    assert all(r[1][1] == 0 for r in found(docs))


def test_triggers_depend_on_the_bytes_alone():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 105, 700).astype(np.uint8)
    places = []
    for before in (0, 33, 250):
        data = np.concatenate([rng.integers(97, 105, before).astype(np.uint8), shared])
        _, t, low, high = repeated_bytes.parse(data, np.array([0, len(data)]), 200)
        places.append({int(p - d) - before: int(p) - before for p, a, z in zip(t, low, high, strict=True) for d in range(a, z + 1) if p - d >= before})
        assert high.max() < repeated_bytes.REACH
    assert places[0] == places[1] == places[2]


def test_orders_are_suffix_orders():
    rng = np.random.default_rng(6)
    rows, core = rng.integers(97, 99, (300, 64)).astype(np.uint8), rng.integers(0, 4, 300)
    order, common = repeated_bytes.neighbours(rows, core)
    keys = [(int(core[k]), rows[k].tobytes()) for k in order]
    assert keys == sorted(keys)
    for a, b, n in zip(keys, keys[1:], common[1:].tolist(), strict=False):
        assert n == (-1 if a[0] != b[0] else next((i for i in range(64) if a[1][i] != b[1][i]), 64))


def test_query_equals_all_windows_on_given_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in repeated_bytes_query(spark, sf).collect())
    want = sorted(zip([r[0] for r in docs], brute([r[1] for r in docs], 200), strict=True))
    assert got == want
