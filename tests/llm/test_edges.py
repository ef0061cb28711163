"""Types and sizes that operators must bear."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnlytics.llm import decontaminate, embedding_dedup, minhash, mixing


@pytest.mark.parametrize("kind", ["int", "smallint", "long", "string", "date", "decimal(10,2)"])
def test_item_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "none of it")], "doc_id int, text string")
    value = "DATE '2024-03-04'" if kind == "date" else f"CAST(7 AS {kind})"
    items = spark.sql(f"SELECT {value} AS item_id, 'beta gamma delta epsilon zeta' AS text UNION ALL SELECT CAST(NULL AS {kind}), 'zeta eta theta alpha'")
    got = decontaminate.find_leaks(docs, items)
    assert got.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert got.where("doc_id = 1").select("item_id").distinct().count() >= 1 and got.where("doc_id = 2").count() == 0
    assert got.where(F.col("item_id").isNotNull()).first()["item_id"] == items.where("item_id IS NOT NULL").first()["item_id"]
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_every_item_removes_unless_told_otherwise(spark):
    docs = spark.createDataFrame([(1, "two words stand in a long text of some more words"), (2, "two words"), (3, "clean")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "two words")], "item_id int, text string")
    kept = lambda **o: sorted(r["doc_id"] for r in decontaminate.remove_leaks(docs, items, **o).collect())
    assert kept() == [3] and kept(short_words=4) == [1, 3]


def test_mixture_of_documents_with_maps(spark):
    rows = [(k, "one two three", "ab"[k % 2], {"x": k, "y": None}, [{"m": {"z": k}}]) for k in range(30)] + [(5, "one two three", "b", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,int>, deep array<struct<m:map<string,int>>>")
    got = mixing.draw_copies(docs).collect()
    want = mixing.draw_copies(docs.drop("tags", "deep")).groupBy("doc_id").count().collect()
    count = {}
    for r in got:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
        assert r["tags"] in ({"x": r["doc_id"], "y": None}, None)
    assert sum(count.values()) == sum(r["count"] for r in want)


def test_hashes_of_maps_do_not_follow_the_order_of_entries(spark):
    rows = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('a', 2, 'b', 1) UNION ALL SELECT NULL")
    got = [r[0] for r in rows.select(F.xxhash64(mixing.hashable(F.col("m"), rows.schema["m"].dataType))).collect()]
    assert got[0] == got[1] != got[2]


def test_cells_of_tiny_sets_stay_small():
    """2,000 outliers and 8,000 other members of three shingles each, as a full cell holds them."""
    rng, n = np.random.default_rng(1), 10_000
    items = rng.integers(0, 40_000, (n, 3))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(np.full(n, 3)), pa.array(np.arange(n) < 2000), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 3), pa.array(items.ravel()))],
        ["id", "part", "can_share", "outlier", "items"],
    )
    tracemalloc.start()
    got = minhash._compare_cell([batch], 80)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    sets = [set(r) for r in items.tolist()]
    by = {}
    for k in range(2000, n):
        by.setdefault(frozenset(sets[k]), []).append(k)
    want = {(k, j) for k in range(2000) for j in by.get(frozenset(sets[k]), [])}
    assert set(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True)) == want


def test_vectors_with_null_ids_text_labels_and_a_pair_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (3, [1.0, 0.0], "y"), (4, [3.0, 4.0], "z"), (5, [4.0, 3.0], "z"), (6, [1.0, 0.0], None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    of = lambda t: {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_duplicates(docs, threshold=t).collect()}
    got = of(0.96)  # (3, 4) and (4, 3) have a cosine of just 24 / 25
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, False), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True)}
    assert of(0.9601)[5] == (0, 5, True)
