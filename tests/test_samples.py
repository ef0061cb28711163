"""Samples carry the texts of drawn conversations only."""

from turnlytics.plans import core, labelling

SF = "/root/testdata/sf0.001"


def test_samples_carry_texts_of_drawn_conversations_only(spark, monkeypatch):
    x, seen = core.Chat(spark, SF), {}
    write = x.written
    monkeypatch.setattr(x, "written", lambda rows, name: seen.setdefault(name, write(rows, name)))
    got = labelling.drawn(x)
    assert seen["strata"].columns == ["conv_id", "model_family", "lang_bucket", "quarter"]
    texts = {r["conv_id"]: r["intent_text"] for r in x.conversations.collect()}
    rows = got.collect()
    assert rows and all(texts[r["conv_id"]] == r["intent_text"] for r in rows) and len({r["conv_id"] for r in rows}) == len(rows)
