import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from turnlytics.llm import token_alignment
from turnlytics.llm.queries import BYTE_VOCABULARY, VOCABULARY

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  ", "foo ", " foo", "\n", "a\nb", "foo\n  bar", "foo \n bar", "foo　 bar", "x▁y", "a\x00b", "tab\t tab", "日本語 テキスト", "<|endoftext|> x", "<s> </s> <unk>", "don't 's", "\x1c a \x1d b", "a\u0085 b", "\r\n \r\n x", "😀 😀😀  z", "<0x41>"]


@pytest.fixture(scope="module")
def tokenizers():
    return token_alignment.Tokenizers.load(BYTE_VOCABULARY, VOCABULARY)


def whole(tokenizers, text):
    """Groups of a text by the libraries' own encoders over the whole text, token by token."""
    if not text:
        return []
    ids = tokenizers.a.encode(" " + text, add_special_tokens=False).ids, tokenizers.b.encode(text)
    given = (" " + text).encode()
    ends = []
    for x, table in zip(ids, (tokenizers.a_bytes, tokenizers.b_bytes), strict=True):
        if b"".join(table[i] for i in x) != given:
            return []
        ends.append(np.cumsum([len(table[i]) for i in x]).tolist())
    groups, (i, j) = [], (0, 0)
    after = [{e: k for k, e in enumerate(x, 1)} for x in ends]
    for e in sorted(after[0].keys() & after[1].keys()):
        k, m = after[0][e], after[1][e]
        groups.append((ids[0][i:k], ids[1][j:m]))
        i, j = k, m
    return groups


def brute(tokenizers, texts):
    every = [whole(tokenizers, t) for t in texts]
    links = [[(a, b) for x, y in g for a in x for b in y] for g in every]
    count = Counter(p for one in links for p in set(one))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for g, one in zip(every, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(one), sum(count[p] == best[p[0]] for p in one), sum(count[p] for p in one), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def some_texts():
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "foo", "'s", "é", "　", "1", "23", "!", "\x1f", "日", "<s>", "Ġ", "ingness", "Überfall", "qzxv", "retition", "​"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 20))) for _ in range(250)]
    return ODD + made + [made[0]] * 3 + [" ".join(made * 8)]


@pytest.mark.parametrize("heavy", [1 << 20, 40, 0])
def test_equal_to_whole_texts(spark, tokenizers, heavy):
    texts = some_texts()
    rows = [(str(k) if k else None, t, "x", "y", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, row string, pairs string, n int").repartition(5)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.cross_tokenizer_links(docs, tokenizers, heavy=heavy).collect()}
    assert got == dict(zip([r[0] for r in rows], brute(tokenizers, texts), strict=True))


def test_given_documents(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.cross_tokenizer_links(docs, tokenizers).collect()}
    assert got == dict(zip([r[0] for r in rows], brute(tokenizers, [r[1] for r in rows]), strict=True))


def test_repeated_rows_and_empty_table(spark, tokenizers):
    docs = spark.createDataFrame([(1, "one two")] * 3 + [(2, None)], "doc_id long, text string")
    got = token_alignment.cross_tokenizer_links(docs, tokenizers).collect()
    assert len(got) == 4 and {r["count_sum"] for r in got if r["doc_id"] == 1} == {3 * r["n_links"] for r in got if r["doc_id"] == 1}
    assert token_alignment.cross_tokenizer_links(docs.limit(0), tokenizers).count() == 0


def test_pieces_are_encoded_like_whole_texts(tokenizers):
    assert tokenizers.splits
    for text in filter(None, some_texts()):
        pieces = tokenizers.cut(text)
        assert "".join(pieces) == " " + text
        order, ((a, a_n), (b, b_n)) = tokenizers.encode(list(dict.fromkeys(pieces)))
        at = {p: (a[s : s + n].tolist(), b[t : t + m].tolist()) for p, s, n, t, m in zip(order, np.cumsum(a_n) - a_n, a_n, np.cumsum(b_n) - b_n, b_n, strict=True)}
        assert [i for p in pieces for i in at[p][0]] == tokenizers.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in pieces for i in at[p][1]] == tokenizers.b.encode(text)


def test_identity_map(tokenizers):
    there = np.flatnonzero(tokenizers.identity >= 0)
    assert len(there) > 20_000
    assert all(tokenizers.a_bytes[a] == tokenizers.b_bytes[tokenizers.identity[a]] for a in there.tolist())
    assert sorted(token_alignment.byte_alphabet().values()) == list(range(256))


def test_one_to_one_groups_make_no_pairs(spark, tokenizers):
    """Texts of whole common words lead to no pair at all, so nothing enters the exchange."""
    docs = spark.createDataFrame([(k, "the river and the stone of the garden") for k in range(20)], "doc_id long, text string")
    aligned = token_alignment.align_documents(docs, tokenizers)
    assert aligned.selectExpr("sum(size(pairs)) AS n", "min(size(same)) AS m").first().asDict() == {"n": 0, "m": 6}
    assert token_alignment.count_same(aligned, len(tokenizers.a_bytes)).max() == 20
