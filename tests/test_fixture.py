"""The chat tables are made within the row: only the given conversations are exchanged, not their repetitions."""

from turnlytics.operators import turns as T
from turnlytics.plans import core
from turnlytics.plans.fixtures import chat

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_repetitions_are_not_exchanged(spark):
    x = core.Chat(spark, SF)
    text = plan(chat.nested(spark, SF))
    assert text.count("Exchange hashpartitioning(cid") == 1 and text.count("Exchange") == 1
    for frame in (T.nested_turns(x.shards(x.nested)), x.attributes(T.nested_roll_up(x.shards(x.nested)).select(*core.ROLLED_UP)), x.shards(x.nested, own_responders=False)):
        assert "Exchange hashpartitioning" not in plan(frame)


def test_tables_equal_those_of_message_rows(spark):
    x = core.Chat(spark, SF)
    key = lambda f, c: sorted(tuple(map(str, r)) for r in f.select(*c).collect())
    turns = x.attributed()
    assert key(x.turns, core.FLAT_TURNS) == key(turns, core.FLAT_TURNS)
    rolled = x.rolled_up(turns)
    assert sorted(rolled.columns) == sorted(x.conversations.columns) and key(x.conversations, rolled.columns) == key(rolled, rolled.columns)


def test_rules_turn_into_rules_on_fields():
    assert chat.of_message("CASE WHEN role = 'user text' AND idx > k THEN concat(pu, 'it''s idx') END") == "CASE WHEN x.role = 'user text' AND x.idx > k THEN concat(x.pu, 'it''s idx') END"


def test_repeated_texts_are_written_once_per_file(spark):
    """Three times Parquet's usual dictionary, each text repeated: the file holds little more than the texts once, in pages that name them."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    texts = spark.range(0, 3000, 1, 1).select("id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.md5(F.concat_ws("-", "id", i))), "").alias("text"))
    made = chat.written(spark, "repeated texts", "layout", lambda: texts)
    (path,) = {f.removeprefix("file://") for f in made.inputFiles()}
    (path,) = glob.glob(path)
    group = pq.ParquetFile(path).metadata.row_group(0)
    column = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "text")
    assert column.total_uncompressed_size < 1.2 * 3000 * 1024
    assert made.count() == 30_000
