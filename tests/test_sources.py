import json

from pyspark.sql import functions as F

from turnlytics.operators import turns as T
from turnlytics.sources import chats


def write(tmp_path, name, objects):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps(o) for o in objects))
    return f"file://{path}"


def messages(frame):
    return {r["id"]: [(m["role"], m["content"], m["responder"]) for m in r["messages"]] for r in frame.collect()}


def test_objects_with_parts_and_fallbacks(spark, tmp_path):
    objects = [
        {"thread_id": "a", "turns": [{"author": {"role": "human"}, "content": [{"text": "one"}, {"text": "two"}], "user_id": "u"}, {"author": {"role": "bot"}, "content": [{"content": "yes"}], "agent": "planner"}, {"author": {"role": "tool"}, "content": [{"text": "hidden"}]}]},
        {"thread_id": "b", "user": "v", "created_at": "2024-03-04T10:00:00Z", "model": "m", "release": "7", "turns": [{"author": {"role": "prompt"}, "content": []}]},
        {"thread_id": "c", "turns": []},
    ]
    got = chats.read_chat_objects(spark, write(tmp_path, "o.json", objects))
    assert messages(got) == {"a": [("user", "one\ntwo", None), ("assistant", "yes", "planner")], "b": [("user", "", None)], "c": []}
    rows = {r["id"]: (r["user"], r["model"], r["version"], str(r["ts"])) for r in got.collect()}
    assert rows == {"a": ("u", "planner", None, "None"), "b": ("v", "m", "7", "2024-03-04 10:00:00"), "c": (None, None, None, "None")}
    r = chats.coverage(got).first()
    assert (r["conversations"], round(r["user_coverage"], 3), r["notes"]) == (3, 0.667, "no_weeks")


def test_objects_without_ids_are_conversations_of_their_own(spark, tmp_path):
    objects = [{"messages": [{"role": "user", "content": "same"}]} for _ in range(5)]
    rows = chats.read_chat_objects(spark, write(tmp_path, "n.json", objects))
    assert len({r["id"] for r in rows.collect()}) == 5
    rolled = T.roll_up(T.attribute_turns(chats.as_messages(rows), F.lit("m"))).collect()
    assert [(r["n_turns"], r["repeated_request"]) for r in rolled] == [(1, False)] * 5
    facts = chats.log_facts(rows).collect()
    assert len({r["user"] for r in facts}) == 5 and all(r["user"].startswith("conv:row:") for r in facts)


def test_time_comes_from_the_first_spoken_message_that_has_one(spark, tmp_path):
    m = lambda role, **more: {"role": role, "content": "x", **more}
    objects = [{"id": "a", "messages": [m("system", time=1709510300), m("user"), m("assistant", time="2024-03-04T00:00:07Z"), m("user", time=1709510499000)]}, {"id": "b", "time": "no time", "messages": [m("user", time="1709510400000000000")]}, {"id": "c", "messages": [m("user")]}]
    got = {r["id"]: str(r["ts"]) for r in chats.read_chat_objects(spark, write(tmp_path, "t.json", objects)).collect()}
    assert got == {"a": "2024-03-04 00:00:07", "b": "2024-03-04 00:00:00", "c": "None"}


def test_turn_rows_keep_arrival_order_without_an_order_column(spark, tmp_path):
    lines = ["conv_id,role,text,user,time"] + [f"{i % 2},{'user' if i % 4 < 2 else 'assistant'},m{i},{'' if i < 4 else f'u{i}'},{1709510400 - i}" for i in range(20)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    rows = chats.read_turn_rows(spark, f"file://{tmp_path}/a.csv")
    got = {r["id"]: r for r in rows.collect()}
    assert [m["content"] for m in got["1"]["messages"]] == [f"m{i}" for i in range(1, 20, 2)]
    assert (got["0"]["user"], got["1"]["user"], str(got["0"]["ts"])) == ("u4", "u5", "2024-03-03 23:59:42")


def test_threads_of_any_length_come_whole(spark, tmp_path):
    node = lambda i: {"id": f"n{i}", "parent": f"n{i - 1}" if i else None, "message": {"author": {"role": "user" if i % 2 == 0 else "assistant"}, "content": {"content_type": "text", "parts": [f"t{i}"]}}}
    for n in (5000, 10_000):
        tree = {"conversation_id": "x", "current_node": f"n{n - 1}", "mapping": {f"n{i}": node(i) for i in range(n)}}
        got = chats.export_threads(spark.read.schema(chats.EXPORT).json(write(tmp_path, f"{n}.json", [tree]))).first()
        assert [m["content"] for m in got["messages"]] == [f"t{i}" for i in range(n)]


def test_results_labels_and_progress(spark, tmp_path):
    from turnlytics.sources import results

    (tmp_path / "r.csv").write_text("intent,score\ncoding,0.5\ncoding,\nother,none\n")
    (tmp_path / "l.csv").write_text("conv_id,intent\n1,coding\n2, \nx,other\n")
    (tmp_path / "p.jsonl").write_text('{"conv_id": 1, "answer": "a", "attempt": 1}\n{"conv_id": 2, "ans')
    at = lambda name: f"file://{tmp_path}/{name}"
    assert sorted(map(tuple, results.read_results(spark, at("r.csv")).collect()), key=str) == sorted([("coding", 0.5), ("coding", None), ("other", None)], key=str)
    assert [tuple(r) for r in results.read_labels(spark, at("l.csv")).collect()] == [(1, "coding")]
    assert [tuple(r) for r in results.read_progress(spark, at("p.jsonl")).collect()] == [(1, "a", 1)]


def test_exports_are_read_back(spark, tmp_path):
    fixes = spark.createDataFrame([("coding", 10, 5, 0.5, 0.8, 1), ("other, too", 4, 1, 0.25, 0.2, 2)], "intent string, conversations long, flagged long, rate double, share_of_flagged double, rank int")
    chats.write_fix_list(fixes, f"file://{tmp_path}/fixes")
    got = spark.read.csv(f"file://{tmp_path}/fixes", header=True).orderBy("rank").collect()
    assert [r["title"] for r in got] == ["Fewer repeats and corrections in coding (50.0% of conversations)", "Fewer repeats and corrections in other, too (25.0% of conversations)"]
    cases = spark.createDataFrame([(1, "no\nline", 'say "x"')], "conv_id long, user_feedback string, bad_reply string")
    chats.write_failure_cases(cases, f"file://{tmp_path}/cases")
    assert [tuple(r) for r in spark.read.schema(cases.schema).json(f"file://{tmp_path}/cases").collect()] == [(1, "no\nline", 'say "x"')]


def test_csv_rows_with_line_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('conv_id,turn,role,text\n1,2,assistant,"a ""quoted""\nreply"\n1,1,user,hello\n2,1,user,\n')
    got = chats.read_turn_rows(spark, f"file://{tmp_path}/t.csv")
    assert messages(got) == {"1": [("user", "hello", None), ("assistant", 'a "quoted"\nreply', None)], "2": [("user", "", None)]}


def test_export_leaves_abandoned_and_hidden_nodes_out(spark, tmp_path):
    node = lambda k, parent, role, text, **more: {"id": k, "parent": parent, "message": {"author": {"role": role}, "content": {"content_type": "text", "parts": [text]}, **more} if role else None}
    nodes = [node("r", None, None, ""), node("s", "r", "system", "s"), node("1", "s", "user", "ask"), node("2", "1", "assistant", "old"), node("3", "1", "assistant", "new"), node("4", "3", "user", "h", metadata={"is_visually_hidden_from_conversation": True}), node("5", "4", "assistant", "call", recipient="python"), node("6", "5", "assistant", "end")]
    tree = {"conversation_id": "x", "create_time": 1709510400.5, "current_node": "6", "mapping": {n["id"]: n for n in nodes}}
    broken = {"conversation_id": "y", "current_node": "gone", "mapping": {"a": node("a", "a", "user", "self")}}
    loop = {"conversation_id": "z", "current_node": "a", "mapping": {"a": node("a", "a", "user", "self")}}
    got = chats.export_threads(spark.read.schema(chats.EXPORT).json(write(tmp_path, "e.json", [tree, broken, loop])))
    assert messages(got) == {"x": [("user", "ask", None), ("assistant", "new", None), ("assistant", "end", None)], "y": [], "z": [("user", "self", None)]}


def test_traces_count_a_repeated_question_once(spark, tmp_path):
    text = lambda k, v: {"key": k, "value": {"stringValue": v}}
    span = lambda trace, n, asked, told, agent: {"traceId": trace, "spanId": str(n), "name": "chat", "startTimeUnixNano": str(1709510400 * 10**9 + n), "attributes": [text("gen_ai.request.model", "m"), text("gen_ai.agent.name", agent), text("gen_ai.input.messages", json.dumps([{"role": "user", "content": asked}])), text("gen_ai.output.messages", json.dumps([{"role": "assistant", "content": told}]))]}
    plain = {"traceId": "t", "spanId": "9", "name": "db", "startTimeUnixNano": "1", "attributes": [text("db.name", "x")]}
    spans = [span("t", 2, "q", "b", "writer"), span("t", 1, "q", "a", "planner"), span("t", 3, "r", "c", "writer"), plain]
    files = [{"resourceSpans": [{"resource": {"attributes": [text("service.version", "v2"), text("user.id", "u")]}, "scopeSpans": [{"spans": spans}]}]}]
    got = chats.read_traces(spark, write(tmp_path, "t.json", files))
    assert messages(got) == {"t": [("user", "q", None), ("assistant", "a", "planner"), ("assistant", "b", "writer"), ("user", "r", None), ("assistant", "c", "writer")]}
    r = got.first()
    assert (r["user"], r["model"], r["version"], str(r["ts"])) == ("u", "m", "v2", "2024-03-04 00:00:00")


def test_messages_feed_the_turn_operators(spark, tmp_path):
    path = write(tmp_path, "o.json", [{"id": "a", "messages": [{"role": "user", "content": "sum the list"}, {"role": "assistant", "content": "ok", "name": "p"}, {"role": "user", "content": "no, that is wrong"}]}])
    rows = chats.as_messages(chats.read_chat_objects(spark, path))
    got = T.first_failures(T.attribute_turns(rows, F.coalesce("model", F.lit("assistant")))).first()
    assert (got["conv_id"], got["failure"], got["attributed_to"], got["bad_reply"]) == ("a", "correction", "p", "ok")


def test_formats_are_told_apart(spark):
    kind = lambda ddl: chats.detect_format(spark.createDataFrame([], ddl).schema)
    assert [kind("resourceSpans string"), kind("mapping string, id string"), kind("chat_messages string"), kind("messages string"), kind("role string, text string")] == ["traces", "export", "senders", "objects", "turns"]
