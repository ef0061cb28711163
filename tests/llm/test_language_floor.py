"""The language stage rejects texts that are in no learned language."""

import random

import pytest
from pyspark.sql import functions as F

from turnlytics.llm import language_id, queries

SCRIPTS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщыэюя", "han": "".join(chr(c) for c in range(0x4E00, 0x5200))}


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(queries.held_out(docs).where("NOT held_out").select("doc_id", "text", "lang"))
    rng = random.Random(3)
    junk = [(-(1 + i * 100 + k), " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 10))) for _ in range(n)), s) for i, (s, letters) in enumerate(SCRIPTS.items()) for k, n in enumerate((20, 200, 2000, 10_000))]
    clean = docs.select((F.col("doc_id") * 10).alias("doc_id"), "text", "lang")
    parts = docs.select((F.col("doc_id") * 10 + 1).alias("doc_id"), F.concat_ws(" ", F.slice(F.split("text", " "), 1, 10)).alias("text"), "lang")
    rows = clean.unionAll(parts).where(r"text rlike '\\p{L}'").unionAll(spark.createDataFrame(junk, "doc_id long, text string, lang string")).persist()
    return rows.count() - len(junk), {r["doc_id"] for r in language_id.reject_unidentified(rows, model).select("doc_id").collect()}


def test_no_junk_passes(kept):
    assert not [x for x in kept[1] if x < 0]


def test_clean_texts_stay(kept):
    n, ids = kept
    assert sum(x >= 0 for x in ids) >= 0.999 * n > 100
