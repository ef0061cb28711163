import math
import os
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnlytics.llm import decontaminate, language_id, license_scan, license_texts, mixing, queries, token_count, url_filter, warc
from turnlytics.llm.common import Scratch

from .conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# WARC


def pages(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{i}/", prose(rng, 50 + i)) for i in range(40)]
    rows += [(100 + i, "http://copy/", rows[0][2]) for i in range(5)] + [(200, None, None), (201, "u\r\nX: y", ""), (202, "", "é日本"), (203, "http://long/", prose(rng, 60_000))]
    rows += [rows[-1], (None, "http://none/", "no id"), (None, "http://none/", "no id")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


def test_warc_round_trip(spark):
    rows, frame = pages(spark)
    index = warc.write_archives(frame, Scratch(spark, "t"), frame_bytes=2000, bundle_bytes=20_000)
    records = warc.read_archives(index)
    assert records.rdd.getNumPartitions() >= index.select("bundle").distinct().count()
    got = records.withColumn("page_id", warc.page_number(F.col("record_id"))).collect()
    assert len(got) == len(rows) and index.select("bundle").distinct().count() > 1
    by = {r["page_id"]: r for r in got}
    text = {p: h or "" for p, _, h in rows}
    largest = {}
    for p, h in text.items():
        if p is not None:
            largest[h] = max(p, largest.get(h, p))
    for p, h in text.items():
        r = by[p]
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == warc.payload_digest(h.encode())
        if p is None or largest[h] == p:
            assert r["record_type"] == "response" and r["payload"] == h.encode() and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == f"<urn:page:{largest[h]}>"
    for p in (0, 3, 104, 203):  # by identifier: one frame each
        fields, block = warc.read_record(index, f"<urn:page:{p}>")
        assert fields["WARC-Record-ID"] == f"<urn:page:{p}>" and (block == text[p].encode() or fields["WARC-Type"] == "revisit")
    with pytest.raises(KeyError):
        warc.read_record(index, "<urn:page:77>")


def test_warc_bundle_is_plain_zstandard(tmp_path):
    import zstandard

    with open(tmp_path / "b", "wb") as f:
        w = warc.BundleWriter(f, 100)
        records = [warc.make_record([("WARC-Type", "response")], b"x" * n) for n in range(0, 300, 7)]
        places = [w.add(r) for r in records]
        w.close()
    source = pa.OSFile(str(tmp_path / "b"))
    table = warc.seek_table(source)
    for (frame, offset), r in zip(places, records):
        assert warc.read_frame(source, table[frame])[offset : offset + len(r)] == r
    with open(tmp_path / "b", "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records)


def test_warc_empty(spark):
    index = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), Scratch(spark, "t"))
    assert index.count() == warc.read_archives(index).count() == 0


# URL filters


def test_url_filter_equals_rules_one_by_one(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "", "allow"), ("a.b.net", "/es/x", "allow"), ("a.b.net", "/es/x", "block"), (None, "/", "block"), ("", "/", "block")]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in ("example.com", "WWW.Example.com", "x.www.example.com", "badexample.com", "net", "a.b.net", "b.net", "org", "", "com.") for p in ("", "/", "/en", "/en/", "/en/a?b", "/es/x#y", "?q=/en/", "#/en/")]
    urls += [None, "", "no scheme", "a://b://c/d", "://x.com/", "http://é.com/ü", "http://example.com/en/\nline"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"rule": F.lit(1), "host": F.lit(2)})
    got = {r["page_id"]: r for r in url_filter.judge_urls(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fit = [(len(h + p), len(h), h + p, v == "block") for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        assert (got[i]["rule"], got[i]["verdict"]) == ((best[2], "block" if best[3] else "allow") if best else (None, "allow")), u


def test_url_filter_of_no_pages_repeated_pages_and_long_urls(spark):
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    long = "http://" + "a." * 3000 + "com/" + "x" * 200_000
    frame = spark.createDataFrame([(1, long), (1, long), (None, "http://x.org/")], "page_id long, url string")
    assert url_filter.judge_urls(frame.limit(0), rules).count() == 0
    got = sorted((str(r["page_id"]), r["rule"], len(r["path"])) for r in url_filter.judge_urls(frame, rules).collect())
    assert got == sorted([("1", "com/", 200_001), ("1", "com/", 200_001), ("None", None, 1)], key=str)


def test_url_filter_many_shards_and_none(spark):
    rules = spark.createDataFrame([(f"h{i}.org", f"/{i % 3}/", "block" if i % 2 else "allow") for i in range(500)], "host string, path string, verdict string")
    scratch = Scratch(spark, "t")
    assert len(url_filter.build_index(spark, rules, scratch, shard_rules=100)) == 5
    frame = spark.createDataFrame([(i, f"http://h{i}.org/{i % 3}/x") for i in range(500)], "page_id long, url string")
    assert url_filter.judge_urls(frame, rules).where("verdict = 'block'").count() == 250
    assert url_filter.judge_urls(frame, rules.limit(0), default="block").where("verdict = 'block' AND rule IS NULL").count() == 500


# Mixing


def test_mixing_equals_sql_and_keeps_targets(spark, documents, rows):
    got = mixing.mix_sources(documents).collect()
    assert len(got) == len(rows)
    con = duckdb.connect()
    table = documents.select("doc_id", "text", "source").toArrow()
    con.register("documents", table)
    want = con.execute(queries.ORACLE_SQL["op5_mixing"]).fetchall()
    mine = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got)
    assert mine == sorted(want)
    by = {}
    for r in got:
        size, target, taken, biggest = by.get(r["source"], (0, 0, 0, 0))
        by[r["source"]] = (size + r["size"], r["target"], taken + r["taken"], max(biggest, r["size"]))
        assert r["taken"] <= 3 * r["size"]
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[1] for v in by.values()) - total) < 1e-6 * total
    for size, target, taken, biggest in by.values():
        assert abs(taken - target) <= biggest + 1 and target <= 3 * size + 1e-9


def test_targets_equal_refilling(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 100, 1000]) for i in range(9)}
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (1.0, 2.0, 3.0)).collect()}
        weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
        target, capped = {}, set()
        while True:
            left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
            w = sum(weight[s] for s in sizes if s not in capped)
            target = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in sizes}
            over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s] + 1e-9}
            if not over:
                break
            capped |= over
        assert got == pytest.approx(target)


def test_mixing_share_that_is_not_whole(spark):
    rows = [(i, "w " * 10, "small" if i < 50 else "large") for i in range(1000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 1.0), most=2.5).where("source = 'small'").collect()
    assert {r["target"] for r in got} == {1250.0} and abs(sum(r["taken"] for r in got) - 1250) <= 10 and {r["copies"] for r in got} == {2, 3}


def test_mixing_draws_rows_not_ids(spark):
    rows = [(None, f"t{i} w w", "a", i) for i in range(7)] + [(1, f"u{i}", None, i) for i in range(5)] + [(1, "u0", None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").withColumns({c: F.lit(c) for c in ("copy", "row", "size", "tie", "drawn")})
    got = mixing.draw_copies(frame)
    assert got.columns == [*frame.columns, "copy_"]
    counts = sorted(r["copies"] for r in mixing.mix_sources(frame).collect())
    taken = got.groupBy(*frame.columns).agg(F.count("*").alias("times")).collect()
    assert sum(r["times"] for r in taken) == sum(counts) and {r["copy"] for r in taken} == {"copy"}
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.draw_copies(frame.repartition(5)).collect()))


def test_mixing_empty_and_textless(spark, no_documents):
    assert mixing.mix_sources(no_documents).count() == 0
    got = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert {(r["doc_id"], r["target"], r["taken"]) for r in got} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_mixing_runs_no_python(documents):
    plan = mixing.mix_sources(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Decontamination


def edit_distance(a, b, free_ends):
    last = [0 if free_ends else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return min(last) if free_ends else last[-1]


def test_myers_equals_table():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 80))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 90))]
        assert decontaminate.least_distance(a, b)[0] == min(edit_distance(a, b, True), len(a))
        assert decontaminate.least_distance(a, b, anchored=True)[0] <= edit_distance(a, b, False)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 5, 9, 14, 30, 75, 1, 4])] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for i, text in items:
        for edits in range(0, 12):
            w = (text or "").split()
            for _ in range(edits):
                k = rng.randrange(len(w) + 1)
                op = rng.randrange(3)
                w[k : k + (op != 0)] = [] if op == 1 else [prose(rng, 1)]
            docs.append((len(docs), prose(rng, rng.randrange(20)) + " " + ", ".join(w).upper() + " " + prose(rng, rng.randrange(20))))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, prose(rng, 3000) + " " + items[4][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), block_words=40).collect()}
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    want = {}
    for d, text in docs:
        for i, item in items:
            w = words(item)
            if w:
                distance = edit_distance(w, words(text), True)
                if distance <= min(int(0.2 * len(w)), len(w) - 1):
                    want[d, i] = distance
    assert {k: r["distance"] for k, r in got.items()} == want
    for (d, i), r in got.items():  # the place that is returned has that distance
        assert edit_distance(words(dict(items)[i]), words(docs[d][1])[r["first_word"] : r["end_word"]], False) == r["distance"]
    clean = decontaminate.remove_leaks(frame, spark.createDataFrame(items, "item_id long, text string"))
    size = {i: len(words(t)) for i, t in items}
    gone = {d for d, i in want if size[i] >= 4 or 2 * size[i] >= len(words(docs[d][1]))}
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - gone and clean.columns == frame.columns


def test_leaks_of_short_items_and_scripts_without_spaces(spark):
    question = "下列哪一项是太阳系中体积最大的行星并且拥有明显的大红斑？"
    items = [(1, "Paris"), (2, "Name the French capital"), (3, question), (4, "ประเทศไทยมีกี่จังหวัดในปัจจุบันนี้"), (5, "フランスの首都はどこですか"), (2, "Name the French capital")]
    near = question.replace("最大", "很大").replace("明显", "显著")
    texts = ["In paris today.", "please NAME the french capital now", "前言，" + question + "后记。", "前言" + near + "后记", "จริงๆ" + items[3][1] + "ครับ", "問：" + items[4][1] + "？", "太阳系", None, "", "Paris"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == [(0, 1, 0), (1, 2, 0), (1, 2, 0), (2, 3, 0), (3, 3, 3), (4, 4, 0), (5, 5, 0), (9, 1, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.remove_leaks(docs, bench).collect()) == [0, 6, 7, 8]  # one word of a longer text is no leak
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.remove_leaks(docs, bench.limit(0)).count() == len(texts) and decontaminate.remove_leaks(docs.limit(0), bench).count() == 0
    again = docs.unionAll(docs)
    assert decontaminate.find_leaks(again, bench).count() == 2 * len(got)


# Token counts


def test_token_counts_equal_tokenizer(spark, documents, rows):
    from tokenizers import Tokenizer, models, normalizers

    v = token_count.load_vocabulary(queries.VOCABULARY)
    pieces = [("<unk>", 0.0)] + list(zip(v.pieces, v.scores)) + [(f"<0x{b:02X}>", min(v.scores)) for b in range(256)]
    # the unknown score follows from the lowest score, so byte pieces must not lower it
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = {r["doc_id"]: r["n_unigram"] for r in token_count.count_tokens(documents, queries.VOCABULARY).collect()}
    for d, text, _ in rows:
        assert got[d] == len(t.encode(text or "", add_special_tokens=False).ids), d


def test_token_counts_equal_the_files_own_encoder(spark, documents, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(documents, queries.VOCABULARY).collect()}
    for d, text, _ in rows:
        assert got[d] == len(model.encode(text or "")), d
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(given, queries.VOCABULARY).collect()}
    texts = [(r["doc_id"], r["text"] or "") for r in given.select("doc_id", "text").collect()]
    assert got == {d: len(x) for (d, _), x in zip(texts, model.encode([t for _, t in texts]), strict=True)}


def test_token_counts_of_odd_strings_equal_the_files_own_encoder():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)
    rng = random.Random(12)
    parts = ["aaaa", "tion", "the", " ", "  ", " " * 17, "\n", "\t", "日本", "ñandú", "İ", "😀", "1999", "...", "==", "sssss", "Re", "http://", "ing", "ingin", "กิ", "▁", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(3000)] + ["".join(rng.choice("abcdeinrst") for _ in range(40)) for _ in range(1000)]
    own, _, _ = token_count.count_texts(token_count.WordTable(token_count.load_vocabulary(queries.VOCABULARY), limit=5000), pa.array(texts))
    for text, n, ids in zip(texts, own, model.encode(texts), strict=True):
        assert n == len(ids), repr(text)


def small_vocabulary(byte_fallback):
    return token_count.Vocabulary(["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", "▁▁", "c", "bc", "abc"], [-3.0, -1.0, -1.0, -2.0, -2.0, -2.0, -3.0, -3.0, -4.0, -1.5, -2.5, -3.5], byte_fallback)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_token_count_ties_equal_tokenizer(byte_fallback):
    from tokenizers import Tokenizer, models, normalizers

    v = small_vocabulary(byte_fallback)
    pieces = [("<unk>", 0.0)] + list(zip(v.pieces, v.scores)) + ([(f"<0x{b:02X}>", -4.0) for b in range(256)] if byte_fallback else [])
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaabbc  xé\n▁") for _ in range(rng.randrange(0, 25))) for _ in range(500)]
    own, counts, _ = token_count.count_texts(token_count.WordTable(v, limit=50), pa.array(texts))
    assert own.tolist() == counts.tolist()
    for text, n in zip(texts, counts):
        assert n == len(t.encode(text).ids), repr(text)


def test_token_count_empty(no_documents):
    assert token_count.count_tokens(no_documents, queries.VOCABULARY).count() == 0


# Languages


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(queries.held_out(docs).where("NOT held_out").select("doc_id", "text", "lang"))
    got = queries.held_out(language_id.identify(docs, model)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) > 100


def test_language_id_odd_texts(spark, documents, no_documents):
    training = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), (None, "fr"), ("no label", None)] * 30)], "doc_id long, text string, lang string")
    model = language_id.fit(training, min_ratio=0.5)
    texts = [None, "", " 12 !!", "\u00a0", "zzzz qqqq", "the", "THE DOG", "une chatte et le chien", "é"]
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    pred = [r["lang_pred"] for r in got]
    assert pred[:4] == ["und"] * 4 and pred[5:8] == ["en", "en", "fr"] and pred[4] in model.languages and pred[8] in model.languages
    assert [r["score"] for r in got][4] == 0.0 and all(0 <= r["score"] <= 1 for r in got)
    kept = language_id.reject_unidentified(documents, language_id.fit(documents.select("doc_id", "text", "lang")))
    assert kept.columns == documents.columns and kept.where("text IS NULL OR text = ''").count() == 0
    assert language_id.identify(no_documents, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(documents, language_id.fit(training.limit(0))).collect()} == {"und"}


def test_language_id_learns_every_language(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)) for _ in range(300)]
    rows = [(1000 * k + i, texts[k], f"l{k:03d}") for k in range(300) for i in range(2)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), floors=False)
    assert len(model.languages) == 300
    got = language_id.identify(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {r[0]: r[2] for r in rows}


def test_language_id_equals_plain_sets(spark):
    """The same votes, counted with a set of n-grams per language instead of the Bloom filters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    training = queries.held_out(docs).where("NOT held_out").select("doc_id", "text", "lang")
    model = language_id.fit(training, floors=False)
    known = [(r["text"], r["lang"]) for r in training.where("text is not null and lang is not null").collect()]

    def grams(text):  # byte n-grams of the lower-cased text, runs of ASCII non-letters as one space
        b = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.lower().encode()).strip(b" ")
        b = b" " + b + b" " if b else b" "
        return [b[i : i + n] for n in model.sizes for i in range(len(b) - n + 1)]

    tables = {x: {} for x in model.languages}
    together = {}
    for text, lang in known:
        for g in grams(text):
            tables[lang][g] = tables[lang].get(g, 0) + 1
            together[g] = together.get(g, 0) + 1
    for t in tables.values():
        for g in [g for g in t if together[g] < 2]:
            del t[g]
    total = {x: sum(t.values()) for x, t in tables.items()}
    share = {x: {g: n / total[x] for g, n in t.items()} for x, t in tables.items()}
    sets = {x: {g for g, s in share[x].items() if s >= 1e-5 and s >= 0.25 * max(y.get(g, 0) for y in share.values())} for x in share}
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    differs = 0
    for r in docs.where("text is not null").select("doc_id", "text").collect():
        if not re.search(r"[^\W\d_]", r["text"]):
            continue
        found = grams(r["text"])
        votes = {x: sum(g in s for g in found) for x, s in sets.items()}
        best = max(model.languages, key=lambda x: (votes[x], -model.languages.index(x)))
        if got[r["doc_id"]]["lang_pred"] != best:
            differs += 1
            continue
        if sum(votes.values()) >= 200:  # false positives are corrected on average, so only longer texts agree closely
            assert abs(got[r["doc_id"]]["score"] - votes[best] / sum(votes.values())) < 0.05
    assert differs <= 0.002 * len(got)


def test_language_filter_returns_all_languages_of_a_gram(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("alpha beta", "x"), ("alpha gamma", "y")] * 20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sizes=(5,))
    hashes, _ = language_id._grams(pa.array(["alpha"]), (5,))
    assert set(model.languages) == {"x", "y"} and (model.masks(hashes[0]) == 3).all()
    only, _ = language_id._grams(pa.array(["gamma"]), (5,))
    assert (model.masks(only[0])[1:-1] == 1 << model.languages.index("y")).all()


# Licences


def test_license_base_equals_brute_force(spark, no_documents):
    rng = random.Random(2)
    parts = ["MIT License", "apache license,", "General Public\nLicense", "mit", "license", "GNU General Public License", "public", "licensé", "general public licenses", "mit-license", "xmit license", "word", "2.0", "Ünicode"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(200)] + [None, "", "MIT LICENSE" * 3, "\x00mit\x00license\x00", "mit license " * 30_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame).collect()}
    phrases = [(p.split(), label) for p, label in license_scan.PHRASES]
    for i, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        hits = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(hits))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert license_scan.scan_licenses(no_documents).count() == 0


def test_license_notices_with_changed_words(spark):
    mit = license_scan.NOTICES[0][1].split()
    changed = list(mit)
    changed[-2] = "papers"
    bsd = next(t for label, t, _ in license_scan.NOTICES if label == "bsd").split()
    texts = ["intro " + " ".join(mit), "x " + " ".join(changed).upper() + " y", " ".join(mit[:4]), "Licensed under CC BY-NC 4.0."]
    texts += [" ".join([*mit[:9], "odd", *mit[9:]]), " ".join([*mit[:12], *mit[13:]]), " ".join([*bsd[:11], "any", *bsd[11:]]), "// SPDX-License-Identifier: MIT", "SPDX-License-Identifier: BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "SPDX License: MIT"]
    got = [r["labels"] for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["mit", "mit", "", "cc-by-nc", "mit", "mit", "bsd", "mit", "boost", "boost", ""]


def in_order(template, weight, window):
    best = [0.0] * (len(window) + 1)
    for t in template:
        last = list(best)
        for j, w in enumerate(window, 1):
            best[j] = max(last[j], best[j - 1], last[j - 1] + weight[t] if w == t else 0.0)
    return best[-1]


def test_license_notices_equal_brute_force(spark):
    """Every place of every text against every template, word by word."""
    rng = random.Random(21)
    notices = [x for x in license_scan.NOTICES if len(x[1].split()) < 60]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(notices)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                k, op = rng.randrange(len(w) + 1), rng.randrange(3)
                w[k : k + (op != 0)] = [] if op == 1 else [rng.choice(["software", "the", "zebra", "license"])]
            parts += [prose(rng, rng.randrange(5)), " ".join(w)]
        texts.append(" ".join(parts))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), notices=notices).collect()}
    split = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t) for t in texts]
    vocabulary = {w for _, t, keys in notices for w in t.split()}
    weight = {w: 1 + math.log((1 + len(texts)) / (1 + sum(w in s for s in map(set, split)))) for w in vocabulary}
    for i, words in enumerate(split):
        want = set()
        for label, text, keys in notices:
            template = text.split()
            m, total = len(template), sum(weight[w] for w in template)
            around = max(1, int(0.2 * m))
            for s in range(-around, len(words)):
                window = words[max(s - around, 0) : max(s + m + around, 0)]
                bound = sum(weight[w] for w in template if w in window)
                if label in want or bound < 0.8 * total or not any(window[j : j + len(k.split())] == k.split() for k in keys for j in range(len(window))):
                    continue
                if in_order(template, weight, window) >= 0.8 * total:
                    want.add(label)
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == want | base, texts[i]


def test_whole_license_texts_of_a_folder(spark):
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts on this machine")
    notices = license_texts.folder_notices(folder)
    rng = random.Random(2)
    texts = []
    for _, text, _ in notices:
        w = text.split()
        for _ in range(len(w) // 50):
            w.insert(rng.randrange(len(w)), "zebra")
        texts.append("intro " + " ".join(w) + " end")
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), notices=notices).orderBy("doc_id").collect()
    for (label, _, _), r in zip(notices, got, strict=True):
        assert label in r["labels"].split(",") and r["score"] >= 0.8


def test_word_counts(spark, documents, rows):
    got = {r["doc_id"]: r["n"] for r in documents.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert got == {d: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t, _ in rows}
