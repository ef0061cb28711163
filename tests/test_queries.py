"""A cross-section of the registered queries against their SQL on the smallest tables; the plans' shape."""

import importlib.util
import math

import duckdb
import pytest

import __spark_entry__ as entry
from turnlytics.plans import core, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [
    "flatten_conversations", "flatten_turns", "volume_weekly_country", "intensity_weekly", "intensity_weekly_model", "friction_weekly", "friction_by_intent_model_era", "friction_by_responder", "friction_all_and_models",
    "failure_reasons", "backlog_themes", "routing_policies", "weighted_score", "pair_comparison", "before_after", "rate_gaps", "overview_tiles", "recent_vs_prior", "orders_zero_filled",
    "sample_draw", "label_parse", "proxy_precision", "classification_report", "tfidf_words", "otlp_traces", "chat_export_thread", "turn_rows_csv", "incremental_ingest", "events_stream_weekly",
    "chat_objects", "chat_objects_without_ids", "chat_objects_coverage", "turn_rows_arrival", "log_facts", "consistency_checks", "published_tables", "label_prompts", "eval_case_export", "poisson_bootstrap",
    "turn_rows_many_files", "ingest_same_names", "live_friction_weekly", "unpaired_change", "intent_softmax_fixed", "turn_attribution", "conversation_roll_up",
]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 8) + 0.0) if isinstance(v, float) else str(v)


def rows(table, columns):
    return sorted(tuple(plain(v) for v in r) for r in zip(*(table.column(c).to_pylist() for c in columns)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = con.execute(entry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows(got, columns) == rows(want, columns)


def test_gaps_are_there_to_be_compared(spark):
    assert entry.queries()["rate_gaps"](spark, SF).count() > 0


def test_reconciliation_reads_cells_only(spark):
    text = plan(entry.queries()["consistency_checks"](spark, SF))
    assert "chat-conversations" not in text and "chat-turns" not in text and "chat-messages" not in text


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(registry.queries()) > 100
    if importlib.util.find_spec("turnlytics.llm") is not None:
        assert sum(name.startswith("op") for name in queries) >= 10


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_reconciliation(spark):
    bad = entry.queries()["consistency_checks"](spark, SF).where("NOT ok").collect()
    assert [(r["label"], r["got"]) for r in bad] == [("responders that are no model's name", 3.0)]  # the fixture's three agents


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_turn_windows_and_roll_up_share_one_exchange(spark):
    text = plain(plan(core.T.roll_up(core.Chat(spark, SF).attributed())))
    assert text.count("Exchange hashpartitioning(conv_id") == 1


def test_no_python_and_no_cartesian_product_in_metrics(spark):
    for name in ("friction_weekly", "intensity_weekly", "friction_by_responder", "pair_comparison", "failure_reasons"):
        text = plan(entry.queries()[name](spark, SF))
        assert "Python" not in text and "CartesianProduct" not in text, name


def test_nested_roll_up_moves_nothing(spark):
    x = core.Chat(spark, SF)
    path = core.T.nested_roll_up(spark.createDataFrame([], x.raw.schema))
    assert "Exchange" not in plan(path)


def test_nested_turns_move_nothing_and_equal_windows(spark):
    raw = core.Chat(spark, SF).raw
    assert "Exchange" not in plan(core.T.nested_turns(spark.createDataFrame([], raw.schema)))
    rows = [
        (1, [("user", "a", None), ("assistant", "b", "p"), ("user", "a", None), ("user", "no, c", None), ("assistant", "d", ""), ("assistant", None, "q"), ("user", None, None)], "m"),
        (2, [("assistant", "hi", None), ("user", "x", None)], None), (3, [], "m"), (4, [("assistant", "z", None), ("assistant", "y", "w"), ("assistant", "x", None), ("user", "u", None)], None),
    ]
    nested = spark.createDataFrame([(m, "s", [(i, *x, "en", False) for x in c]) for i, c, m in rows], "model string, shard string, conversation array<struct<turn_identifier:long,role:string,content:string,responder:string,language:string,redacted:boolean>>")
    messages = spark.createDataFrame([(i, k, *x, m) for i, c, m in rows for k, x in enumerate(c, 1)], "conv_id long, idx int, role string, content string, responder string, model string")
    columns = ["conv_id", "idx", "role", "content", "prev_user", "last_reply", "attributed_to", "users_before", "content_len", "is_empty", "repeats_prev_user", "is_correction", "is_refusal"]
    got, want = core.T.nested_turns(nested), core.T.attribute_turns(messages, core.F.col("model"))
    key = lambda f: sorted(tuple(map(str, r)) for r in f.select(*columns).collect())
    assert key(got) == key(want)


def test_scans_read_only_what_they_need(spark):
    text = plan(entry.queries()["orders_intensity_weekly"](spark, SF))
    assert "o_comment" not in text and "o_totalprice" not in text
