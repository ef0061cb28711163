import random

import pytest

WORDS = "the of and to in river stone cloud garden paper window yellow market silent copper distant harbor velvet thunder meadow".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Texts with copies, near copies, shared passages, and every odd case; columns clash with names that operators use."""
    rng = random.Random(5)
    base = [prose(rng, 220) for _ in range(6)]
    rows: list = []

    def add(text, lang="en", source="a"):
        rows.append((len(rows), text, lang, source, len(text or "")))

    for b in base:
        add(b)
        words = b.split()
        for k in (1, 2, 4, 8, 14):  # near copies
            w = list(words)
            for i in rng.sample(range(len(w)), k):
                w[i] = prose(rng, 1)
            add(" ".join(w), source=rng.choice(["a", "b", None]))
        add(b)  # exact copy
        add("\t" + b.replace(" ", "  ").upper() + "\n", source="c")  # other spacing and case
        add(" ".join(words[:70]) + " " + prose(rng, 60), source="b")  # shared passage
        add(prose(rng, 20) + " " + " ".join(words[100:149]) + " " + prose(rng, 20), source="b")  # one word short of a window
        add(prose(rng, 20) + " " + " ".join(words[100:150]) + " " + prose(rng, 20), source="b")  # just a window
    passage = prose(rng, 60)
    for _ in range(12):
        add(prose(rng, 30) + " " + passage + " " + prose(rng, 30), source="hot")
    for odd in (None, "", " \t ", "one", "two words", "One", "three short words", "日本語 テキスト", "12 345 !!", "\u00a0", "a\x00b c"):
        add(odd, source=None)
    add(prose(rng, 20_000), source="long")
    for _ in range(30):
        add(prose(rng, rng.randrange(1, 90)), lang=rng.choice(["en", "fr", None]), source=rng.choice("ab"))
    rows.append(rows[0])  # a repeated row
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    names = ["id", "size", "copies", "bucket", "n", "component_id", "anchors", "window", "start", "score", "rank", "range", "digest"]
    return frame.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def rows(documents):
    return [(r["doc_id"], r["text"], r["source"]) for r in documents.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
