import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from turnlytics.llm import decontaminate, mixing
from turnlytics.llm.common import Scratch

from .test_duplicates import classes, sets_of, windows_removed


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the result of each stage."""
    sf, scratch = "/root/testdata/sf0.001", Scratch(spark, "t")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(scratch.table(stage(spark, out[-1], sf), name))
    return out


def rows(frame):
    return [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]


def test_stages_keep_columns(stages):
    for s in stages[1:-1]:
        assert s.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "copy"]


def test_language_stage_rejects_only_letterless(stages):
    assert {r[0] for r in rows(stages[1])} == {r[0] for r in rows(stages[0]) if re.search(r"[^\W\d_]", r[1] or "")}


def test_near_duplicate_stage_equals_all_pairs(stages):
    sets = sets_of(rows(stages[1]), 5)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(r[0] for r in rows(stages[2])) == sorted(n for n, c in classes(ids, links).items() if n == c)


def test_passage_stage_equals_all_windows(stages):
    before, after = rows(stages[2]), {r[0]: r[1] for r in rows(stages[3])}
    for doc, (n_words, n_removed, _) in windows_removed(before, 50).items():
        if n_removed == n_words and n_removed:
            assert doc not in after
        else:
            assert len(after[doc].split()) == n_words - n_removed


def test_leak_stage_removes_what_is_found(spark, stages):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(stages[3], bench).collect()}
    assert {r[0] for r in rows(stages[4])} == {r[0] for r in rows(stages[3])} - leaks


def test_mixture_stage_takes_words_near_targets(stages):
    n = F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+"))
    target = {r["source"]: r["target"] for r in mixing.mix_sources(stages[4]).collect()}
    largest = {r["source"]: r["n"] for r in stages[4].groupBy("source").agg(F.max(n).alias("n")).collect()}
    taken = {r["source"]: r["n"] for r in stages[5].groupBy("source").agg(F.sum(n).alias("n")).collect()}
    for source, aim in target.items():  # within one document of each target
        assert abs(taken.get(source, 0) - aim) <= largest[source] + 1
    assert stages[5].agg(F.max("copy")).first()[0] <= 3


def test_run_gives_the_last_stage(spark, stages):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert sorted((r["doc_id"], r["copy"]) for r in got.collect()) == sorted((r["doc_id"], r["copy"]) for r in stages[5].collect())
