"""Rows keep the order of files and lines, whatever tasks read them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnlytics.sources import chats, order


@pytest.fixture
def files(tmp_path):
    """Files of unequal sizes, the largest last, so that it is packed first."""
    rng, lines, n = random.Random(1), [], 0
    for k, size in enumerate((3, 1, 400, 0, 25, 2000)):
        part = []
        for _ in range(size):
            part.append({"conv_id": str(n % 7), "role": "user", "text": f"m{n:05d}" + "x" * rng.randrange(30)})
            n += 1
        (tmp_path / f"f{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in part))
        lines += part
    return f"file://{tmp_path}", lines


def with_splits(spark, size, f):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        return f()
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("size", ["2k", "11k", "1m"])
def test_numbers_are_those_of_the_lines(spark, files, size):
    path, lines = files

    def numbers():
        rows = spark.read.schema("conv_id string, text string").json(path)
        return sorted((r["row_number"], r["text"]) for r in order.numbered(rows).select("row_number", "text").collect())

    assert with_splits(spark, size, numbers) == [(k, r["text"]) for k, r in enumerate(lines)]


@pytest.mark.parametrize("size", ["2k", "1m"])
def test_messages_over_files_and_splits_come_in_order(spark, files, size):
    path, lines = files
    read = lambda: {r["id"]: [m["content"] for m in r["messages"]] for r in chats.turn_rows(spark.read.schema("conv_id string, role string, text string").json(path)).collect()}
    assert with_splits(spark, size, read) == {str(c): [r["text"] for r in lines if r["conv_id"] == str(c)] for c in range(7)}


def test_large_files_do_not_come_first(spark, tmp_path):
    (tmp_path / "a.csv").write_text("conv_id,role,text\n1,user,first\n")
    (tmp_path / "b.csv").write_text("conv_id,role,text\n1,user,second\n" + "".join(f"9,user,{'y' * 90}\n" for _ in range(500)))
    got = {r["id"]: r for r in chats.read_turn_rows(spark, f"file://{tmp_path}").collect()}
    assert [m["content"] for m in got["1"]["messages"]] == ["first", "second"]


def test_ids_of_nameless_objects_do_not_change(spark, tmp_path):
    lines = [{"messages": [{"role": "user", "content": f"q{k}"}]} | ({"id": "own"} if k == 4 else {}) for k in range(300)]
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("\n".join(json.dumps(x) for x in lines[k * 100 : k * 100 + 100]))
    ids = lambda: {r["messages"][0]["content"]: r["id"] for r in chats.read_chat_objects(spark, f"file://{tmp_path}").collect()}
    want = {f"q{k}": "own" if k == 4 else f"row:{k}" for k in range(300)}
    assert with_splits(spark, "1k", ids) == with_splits(spark, "1m", ids) == want


def test_only_spoken_rows_count(spark):
    rows = [("1", "system", "s", "sysmodel", "sysuser", "v0", "1700000000"), ("1", "user", "q", "asked", None, None, "1709510500"), ("1", "assistant", "a", None, "u", None, None), ("1", "assistant", "b", "m", "w", "v1", "1709510400"), ("2", "tool", "t", "toolmodel", "x", "v", "1709510400")]
    frame = spark.createDataFrame(rows, "conv_id string, role string, text string, model string, user string, version string, time string").coalesce(1)
    pick = lambda got: {r["id"]: (r["user"], r["model"], r["version"], str(r["ts"]), len(r["messages"])) for r in got.collect()}
    assert pick(chats.turn_rows(frame)) == {"1": ("u", "m", "v1", "2024-03-04 00:00:00", 3), "2": (None, None, None, "None", 0)}
    assert pick(chats.turn_rows(frame, seed=True)) == {"1": ("sysuser", "sysmodel", "v1", "2023-11-14 22:13:20", 3), "2": ("x", "toolmodel", None, "2024-03-04 00:00:00", 0)}


def test_an_order_value_that_is_no_number_counts_as_the_rows_number(spark):
    rows = [("1", "2", "user", "c"), ("1", "1", "user", "a"), ("1", "x", "user", "d"), ("1", None, "user", "z")]
    frame = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string").coalesce(1)
    assert [m["content"] for m in chats.turn_rows(frame).first()["messages"]] == ["z", "a", "c", "d"]


def test_an_exchange_of_rows_is_not_needed_for_places(spark, files):
    rows = order.placed(spark.read.schema("text string").json(files[0]))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert order.placed(spark.range(3).where(F.lit(True))).select("place.file").distinct().count() == 1
