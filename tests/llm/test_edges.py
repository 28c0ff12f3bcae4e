"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from penprint.llm.bytecnn import quality_scores
from penprint.llm.decontam import contamination, without_contaminated
from penprint.llm.linedup import line_report, without_repeated_lines
from penprint.llm.minhash import near_duplicates
from penprint.llm.packing import pack_documents, sequences
from penprint.llm.perspectives import rotate
from penprint.llm.pii import personal_data_report
from penprint.llm.quality import kept_documents, quality_report
from penprint.llm.queries import URL_RULES, public_encoder
from penprint.llm.shards import shard_documents
from penprint.llm.urlrules import judge_urls

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
PLAIN = "the quick brown fox jumps over the lazy dog near the old river bank today"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "id bigint, kept string, hits string, c0 int, n_words string, component_id int, _id int, line int"
)


def table(spark, rows):
    full = [(i, t, "en", s, 0, 7, "k", "h", 1, "n", 2, 3, 4) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(
        spark,
        [
            (1, PLAIN, "a"),
            (2, PLAIN, "a"),
            (3, None, "a"),
            (4, "", None),
            (5, " \t\n \r", "b"),
            (6, LONG, "b"),
            (7, PLAIN.upper(), None),
            (None, PLAIN, "a"),
            (8, "word", "a"),
            (8, "word", "a"),
            (9, "tail line one two three four five\n" + PLAIN, "c"),
        ],
    ).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_near_duplicates(docs, none):
    got = rows(near_duplicates(docs, words_per_shingle=2), "doc_id", "n_shingles", "component_id", "kept")
    assert got == [
        (None, 14, None, True),
        (1, 14, 1, True),
        (2, 14, 1, False),
        (3, 0, 3, True),
        (4, 0, 4, True),
        (5, 0, 5, True),
        (6, got[6][1], 6, True),
        (7, 14, 1, False),
        (8, 1, 8, True),
        (8, 1, 8, True),
        (9, 21, 9, True),
    ]
    words = LONG.split()
    assert got[6][1] == len(set(zip(words, words[1:])))
    assert near_duplicates(none).count() == 0


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality_report(docs).collect()}
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept
    assert got[6].n_words == 60_000 and got[6].n_repeat_words > 50_000
    assert got[1].kept and got[None].kept and got[1].n_repeat_words == 0
    assert quality_report(none).count() == 0
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == [(None,), (1,), (2,), (7,), (9,)]


def test_shared_lines_are_cut_and_the_first_text_keeps_them(spark):
    body = lambda i: " ".join(f"t{i}w{k}" for k in range(30))
    boiler = "All rights reserved by the owners of this very long notice which nobody ever reads at all in any case"
    many = [(i, body(i) + "\n" + boiler, "h") for i in range(30)]
    only = [(100, boiler, "h"), (101, boiler + "\n" + "short end", "h")]
    other_host = [(200, boiler, "elsewhere")]
    copies = [(300 + i, body(999), "h") for i in range(50)]
    got = {r.doc_id: r for r in quality_report(table(spark, many + only + other_host + copies)).collect()}
    assert got[0].n_cut_words == 0 and got[0].kept
    assert all(got[i].n_cut_words == 20 and got[i].kept for i in range(1, 30))
    assert not got[100].kept and not got[101].kept and not got[100].base_failed
    assert got[200].kept and all(got[300 + i].kept for i in range(50))


def test_kept_documents_come_without_shared_lines(spark):
    body = lambda i: " ".join(f"t{i}w{k}" for k in range(30))
    boiler = "All rights reserved by the owners"
    many = [(i, f"{boiler}\n{body(i)}\n\n  all RIGHTS reserved by  the owners \nend {i}", "h") for i in range(30)]
    other = [(200, f"{body(200)}\n{boiler}", "elsewhere"), (201, None, "h"), (202, body(202), None)]
    docs = table(spark, many + other)
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {
        0: many[0][1], **{i: f"{body(i)}\n\nend {i}" for i in range(1, 30)}, 200: other[0][1], 202: other[2][1]
    }


def test_line_dedup(docs, none):
    got = rows(line_report(docs), "doc_id", "n_lines", "n_removed", "removed")
    assert got[1:6] == [(1, 1, 0, ""), (2, 1, 1, "0"), (3, 0, 0, ""), (4, 1, 0, ""), (5, 2, 0, "")]
    assert got[7:] == [(7, 1, 1, "0"), (8, 1, 0, ""), (8, 1, 0, ""), (9, 2, 1, "1")]
    assert got[0][0] is None and got[0][2] == 0
    assert line_report(none).count() == 0
    cut = without_repeated_lines(docs)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[9] == "tail line one two three four five" and texts[2] == "" and texts[3] is None
    assert texts[6] == LONG


def test_rows_that_repeat_an_id_in_one_slice_keep_their_lines(spark):
    both = PLAIN + "\nanother line of its own with seven words"
    pair = table(spark, [(8, both, "a"), (8, both, "a"), (9, PLAIN, "a")]).coalesce(1)
    got = rows(line_report(pair), "doc_id", "n_lines", "n_removed", "removed")
    assert got == [(8, 2, 0, ""), (8, 2, 0, ""), (9, 1, 1, "0")]
    assert rows(without_repeated_lines(pair), "doc_id", "text") == [(8, both), (8, both), (9, "")]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(1, PLAIN), (1, PLAIN), (2, "word"), (3, None), (None, PLAIN), (4, ""), (5, "...")],
        "item_id bigint, text string",
    )
    got = rows(contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items", "contaminated")
    assert got == [
        (None, 15, 15, 1, True), (1, 15, 15, 1, True), (2, 15, 15, 1, True), (3, 0, 0, 0, False),
        (4, 0, 0, 0, False), (5, 0, 0, 0, False), (6, 60_000, 0, 0, False), (7, 15, 15, 1, True),
        (8, 1, 1, 1, True), (8, 1, 1, 1, True), (9, 22, 15, 1, True),
    ]
    assert contamination(none, items).count() == 0
    assert not [r for r in contamination(docs, items.limit(0)).collect() if r.contaminated]
    clean = without_contaminated(docs, items)
    assert clean.columns == docs.columns and rows(clean, "doc_id") == [(3,), (4,), (5,), (6,)]


def test_packing(docs, none):
    packed = pack_documents(docs, public_encoder(), with_ids=True)
    got = packed.collect()
    assert {r.doc_id for r in got} == {None, *range(1, 10)}
    assert sum(r.length == 1 for r in got if r.doc_id in (3, 4)) == 2
    assert sorted((r.piece, r.start) for r in got if r.doc_id == 6)[0] == (0, 0)
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in got:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(r.length for r in got)
    assert pack_documents(none, public_encoder()).count() == 0


def test_personal_data(spark, none):
    text = "Write to a.b@mail.example.com. Call +1 (743) 555-3824 soon, or just 555-3824; not 12."
    docs = table(spark, [(1, text, "a"), (1, text, "a"), (2, None, "a"), (3, "", "a"), (None, "x" * 200_000 + "1.2.3.4", "a"),
                         (4, "9" * 100_000, "a"), (5, "a" * 100_000 + "@", "a")])
    got = rows(personal_data_report(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "spans", "n_added")
    assert got[0] == (None, 0, 1, 0, 0, "ip:200000:200007", 0)
    assert got[1] == got[2] == (1, 1, 0, 0, 1, "email:9:29,phone:36:53,phone:68:76", 1)
    assert [r[5] for r in got[3:]] == ["", "", "", ""]
    assert personal_data_report(none).count() == 0


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (1, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_scores(docs, labels)
    assert got.count() == 11 and got.where("score is null or not score between 0 and 1").count() == 0
    assert quality_scores(none, labels).count() == 0
    assert quality_scores(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_shards(docs, none):
    got = shard_documents(docs, shards=3).collect()
    assert len(got) == 11 and {r.law for r in got} == {"bytes"}
    for shard in range(3):
        places = sorted(r.slot for r in got if r.shard == shard)
        assert places == list(range(len(places)))
    assert shard_documents(none).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, "no scheme", 1), (4, "http://a.EXAMPLE.org/es/x?q#f", 1), (4, "http://a.EXAMPLE.org/es/x?q#f", 1),
         (None, "https://x.com/de/", 1), (5, "https://com/fr/a", 1), (6, "https://org", 1), (7, "https://evilexample.org/es/", 1),
         (8, "http://x.com:80/de/", 1), (9, "ftp://example.org/en/123", 1), (10, "http://example.net/" + "p" * 100_000, 1), (11, "http://?x", 1)],
        "page_id bigint, url string, host int",
    )
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = rows(judge_urls(pages, rules), "page_id", "host", "rule", "verdict")
    assert got == [
        (None, "x.com", "com/de/", "block"), (1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"),
        (4, "a.example.org", "example.org/es/", "block"), (4, "a.example.org", "example.org/es/", "block"),
        (5, "com", "com/fr/", "allow"), (6, "org", None, "allow"), (7, "evilexample.org", "org/", "allow"),
        (8, "x.com:80", None, "allow"), (9, "example.org", "example.org/en/1", "block"), (10, "example.net", None, "allow"), (11, "", None, "allow"),
    ]
    assert rows(judge_urls(pages, rules.limit(0)), "verdict") == [("allow",)] * 13
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_perspectives(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind", 0), (1, 1, "ann", "hi", 0), (1, 2, "bob", "yo <|im_end|>", 0), (1, 2, "bob", "yo <|im_end|>", 0),
         (1, 3, "cat", None, 0), (2, 0, "system", "alone", 0), (None, None, None, "x", 0), (3, None, " ", "y", 0), (3, 5, "ann", "", 0)],
        "conv_id bigint, turn bigint, role string, text string, perspective int",
    )
    got = {(r.conv_id, r.perspective): r for r in rotate(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cat"), (None, "unknown"), (3, "unknown"), (3, "ann")}
    bob = got[1, "bob"]
    assert bob.n_turns == 4 and bob.part == 0 and bob.char_start == 0
    assert bob.rendered == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n"
        "<|im_start|>assistant\nyo < |im_end|><|im_end|>\n<|im_start|>user name=cat\n<|im_end|>\n"
    )
    (a, b) = map(int, bob.mask.split(":"))
    assert bob.rendered[a:b] == "yo < |im_end|><|im_end|>"
    assert rotate(turns.limit(0)).count() == 0


def test_long_conversations_come_in_parts(spark):
    crowd = spark.range(1000).select(
        F.lit(1).alias("conv_id"), F.lit(3).alias("turn"), F.lit("ann").alias("role"), F.col("id").cast("string").alias("text")
    )
    long_ = spark.range(600).select(
        F.lit(2).alias("conv_id"), F.col("id").alias("turn"), F.lit("bob").alias("role"), F.lit("é").alias("text")
    )
    got = sorted(rotate(crowd.union(long_)).collect(), key=lambda r: (r.conv_id, r.part))
    for conv, total in ((1, 1000), (2, 600)):
        parts = [r for r in got if r.conv_id == conv]
        assert [r.part for r in parts] == list(range(len(parts))) and len(parts) >= 3
        assert sum(r.n_turns for r in parts) == total and max(r.n_turns for r in parts) < 400
        whole = "".join(r.rendered for r in parts)
        at = 0
        for r in parts:
            assert r.char_start == at
            at += len(r.rendered)
            for span in r.mask.split(","):
                a, b = map(int, span.split(":"))
                assert whole[a:b].endswith("<|im_end|>")
