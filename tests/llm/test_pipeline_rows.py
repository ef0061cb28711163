"""The pipeline's stages on rows with null and repeated ids, exact repeats, clashing names, long and empty texts, and empty tables."""

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from turnlytics.llm import mixing

from .conftest import prose
from .test_duplicates import classes, sets_of, windows_removed

CLASHES = ["copies", "copy", "__kept", "n", "row_number", "number", "kept", "held_out", "size", "row", "text_key", "component_id", "tie", "key_1", "equal", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(17)
    base = [prose(rng, 150) for _ in range(8)]
    rows: list = []

    def add(doc_id, text, lang="en", source="a"):
        rows.append((doc_id, text, lang, source, None if text is None else len(text)))

    for i, b in enumerate(base):
        add(100 - i, b)  # ids fall as rows arrive
        w = b.split()
        w[70] = "changed"
        add(50 + i, " ".join(w), source="b")
        add(None, " ".join(w[:149]), source=None)
        add(None, b)
        add(7, prose(rng, 80), source="b")  # one id, many texts
        add(200 + i, prose(rng, 30) + " " + " ".join(base[0].split()[20:90]) + " " + prose(rng, 30))
    for _ in range(3):
        add(31, prose(random.Random(1), 60))  # a row three times
    for odd in (None, "", " \t", "12 !!", "\u00a0", "one"):
        add(300, odd)
    add(301, prose(rng, 20_000), source="long")
    add(None, None, None, None)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture
def sf(tmp_path, spark):
    spark.createDataFrame([(1, prose(random.Random(3), 20))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_language_keeps_rows_as_they_are(spark, table, sf):
    got = P.language(spark, table, sf)
    assert got.columns == table.columns
    kept = {str(r) for r in got.collect()}
    assert kept <= set(rows_of(table)) and not any(r["text"] in (None, "", " \t", "12 !!", "\u00a0") for r in got.collect())
    assert got.where("doc_id IS NULL").count() > 0


def test_near_duplicates_decide_on_rows(spark, table, sf):
    given = [(i, r["text"], r["doc_id"]) for i, r in enumerate(table.collect())]
    sets = sets_of([(i, t, None) for i, t, _ in given], 5)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups: dict = {}
    for n, c in classes(sets, links).items():
        groups.setdefault(c, []).append(n)
    ids = {i: d for i, _, d in given}
    want = sorted(str(min((ids[n] for n in g), key=lambda d: (d is None, d))) for g in groups.values())
    got = P.near_duplicates(spark, table, sf)
    assert got.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == want
    assert got.where("doc_id = 31").count() == 1


def test_passages_go_by_row(spark, table, sf):
    got = P.repeated_passages(spark, table, sf)
    assert got.columns == table.columns
    given = [r for r in table.collect()]
    after = got.collect()
    assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in given)  # rows without an id stay
    single = [r for r in given if r["doc_id"] is not None and r["doc_id"] not in (7, 31, 300)]
    removed = windows_removed([(r["doc_id"], r["text"], None) for r in given if r["doc_id"] not in (None, 31, 300, 7)], 50)
    by = {r["doc_id"]: r for r in after if r["doc_id"] is not None}
    for r in single:
        n, gone, _ = removed[r["doc_id"]]
        if n and gone == n:
            assert r["doc_id"] not in by
        else:
            assert len(by[r["doc_id"]]["text"].split()) == n - gone
            assert by[r["doc_id"]]["n_chars"] == len(by[r["doc_id"]]["text"])
    for i in (7, 31, 300):
        assert sorted(str(r["text"]) for r in after if r["doc_id"] == i) == sorted(str(r["text"]) for r in given if r["doc_id"] == i)


def test_leaks_and_mixture_keep_rows(spark, table, sf):
    assert rows_of(P.benchmark_leaks(spark, table, sf)) == rows_of(table)
    got = P.mixture(spark, table, sf)
    assert got.columns == [*table.columns, "copy_"]
    counts = mixing.mix_sources(table).collect()
    assert got.count() == sum(r["copies"] for r in counts)
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    taken = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    largest = {r["source"]: r["n"] for r in table.groupBy("source").agg(F.max(size).alias("n")).collect()}
    for source, target in {(r["source"], r["target"]) for r in counts}:
        assert abs(taken.get(source, 0) - target) <= largest[source] + 1
    assert rows_of(got) == rows_of(P.mixture(spark, table.repartition(7), sf))


def test_a_null_id_that_is_not_drawn_stays_out(spark, sf):
    frame = spark.createDataFrame([(None, f"w{i} " * 10, "en", "s", 40) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.draw_copies(frame, total=0.5)
    assert got.count() == 3 and got.select("text").distinct().count() == 3


def test_empty_tables_pass(spark, table, sf):
    none = table.limit(0)
    for name, stage in P.STAGES:
        got = stage(spark, none, sf)
        assert got.count() == 0, name
        assert got.columns[: len(table.columns)] == table.columns


def test_ids_may_be_texts(spark, table, sf):
    named = table.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    for name, stage in P.STAGES:
        if name not in ("language", "mixture"):  # the fold that is learned from follows from the id
            assert rows_of(stage(spark, named, sf)) == rows_of(stage(spark, table, sf).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))), name
