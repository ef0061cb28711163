import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnlytics.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, key string, number string"


def brute(rows, anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    """By lists of Python numbers, row by row."""
    good = [(i, [max(-(2**53), min(2**53, int(np.floor(scale * x)))) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, c in (r for r in good if anchor(r[0])):
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), j, d) for j, w, d in good if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == c][:positives]:
            fit = [x for x in scored if x[2] != c and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, **options).collect())


@pytest.fixture(scope="module")
def vectors():
    """Copies, ties, few distinct values, one label with a third of the rows, and every odd row."""
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) + rng.choice([0, 0.003]) for _ in range(6)], 0 if i % 3 == 0 else rng.randrange(1, 5)) for i in range(400)]
    rows += [(1000 + i, rows[20][1], i % 2) for i in range(150)]
    rows += [(2000, None, 1), (2010, [0.5, None, 0.1, 0.1, 0.1, 0.1], 1), (2020, [float("nan")] * 6, 1), (2030, [float("inf")] * 6, 2), (2040, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    rows += [(3000, [0.5, 0.5], 1), (3001, [0.5, 0.25], 1), (3002, [0.5, 0.25], 2), (3010, [], 1), (3011, [], 1), (3012, [], 2), (4000, [0.5] * 6, 99), (5000, [0.0] * 6, 1)]
    return rows


def test_equal_to_lists_of_numbers(spark, vectors):
    want = brute(vectors, lambda i: i % 10 == 0)
    assert len(want) > 300 and any(r[4] == r[5] for r in want)
    assert mined(spark, vectors) == want
    assert mined(spark, vectors, block_bytes=1200) == want  # several blocks of anchors
    assert mined(spark, vectors, positives=2, negatives=3, low=50, high=90) == brute(vectors, lambda i: i % 10 == 0, 2, 3, 50, 90)


def test_repeated_rows_fill_places(spark):
    rows = [(10, [0.5], 1), (11, [0.5], 1), (11, [0.5], 1)] + [(12, [0.5], 2)] * 3 + [(13, [0.5], 2)]
    want = [(10, 11, 1 + k, 12 if k < 3 else 13, 128 * 128, 128 * 128) for k in range(4)]
    assert mined(spark, rows) == sorted(want * 2)


def test_numbers_beyond_the_exact_range(spark):
    rows = [(10, [1e300, -3.0], 1), (11, [1e300, 1.0], 1), (12, [1e18, 1.0], 2), (20, [2.0**40, 1.5], 1), (21, [2.0**41, 2.5], 2), (22, [1e9, 1.0], 2)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_keys_sort_as_their_parts():
    rng = np.random.default_rng(3)
    number, negative = rng.integers(0, 3, 300), rng.integers(0, 2, 300).astype(bool)
    score = rng.choice([-(2**62), -5, 0, 7, 2**62], 300)
    ident = rng.choice([-(2**63), -1, 0, 1, 2**63 - 1], 300)
    keys = hard_negatives.pack_keys(number, score, negative, ident).to_pylist()
    parts = list(zip(number.tolist(), (-score).tolist(), negative.tolist(), ident.tolist(), strict=True))
    assert [p for _, p in sorted(zip(keys, parts, strict=True))] == sorted(parts)
    assert [hard_negatives.unpack_key(k)[1:] for k in keys] == [(-s, n, i) for _, s, n, i in parts]


def test_iterator_holds_windows_only(spark):
    """A batch ends within an anchor; the windows go on."""
    number, score = np.zeros(7, np.int64), np.array([100, 100, 90, 90, 85, 80, 79])
    keys = hard_negatives.pack_keys(number, score, np.array([0, 1, 0, 1, 1, 1, 1], bool), np.arange(7))
    batches = [pa.RecordBatch.from_arrays([pa.array([5] * n), keys.slice(a, n)], ["anchor_id", "key"]) for a, n in ((0, 2), (2, 3), (5, 2))]
    got = [tuple(r.values()) for b in hard_negatives.emit_negatives(iter(batches), 3, 80, 100) for r in b.to_pylist()]
    assert sorted(got) == [(5, 0, 1, 1, 100, 100), (5, 0, 2, 3, 100, 90), (5, 0, 3, 4, 100, 85), (5, 2, 1, 3, 90, 90), (5, 2, 2, 4, 90, 85), (5, 2, 3, 5, 90, 80)]


def test_what_is_shuffled_follows_anchors_not_rows(spark):
    """A third of the rows are copies that all lie in the windows; only a few of them reach the exchange."""
    rows = [(i, [0.5, 0.5], i % 2) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    block = hard_negatives.Anchors(np.array([0]), np.array([0]), np.array([0]), [0], np.full((1, 2), 128.0), 256.0, np.array([[True]]), np.array([[2 * 128**2]]))
    kept = hard_negatives._scan(frame.withColumnRenamed("vec_id", "id"), block, hard_negatives.best_negatives, 5, 80, 100)
    assert kept.count() == 20
