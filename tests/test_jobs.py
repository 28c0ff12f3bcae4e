"""Readers, writers, corpus build, syntax jobs, splits, scores and models."""

import json
import math
import os
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from penprint.catalog.rule_parser import make_rule_parser
from penprint.functions.labels import normalize_label
from penprint.operators import columns as co, corpus as cp, features as ft, metrics as mt
from penprint.operators import models as md, motifs as mo, parses as pa, scaling as sc, splits as sp
from penprint.operators import stylometry as st
from penprint.operators.joins import sized_join
from penprint.plans import corpus as build, syntax
from penprint.plans.evaluation import experiment_grid
from penprint.sinks import tables as sk
from penprint.sources import splits as ss, tables as stb, texts as stx

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def raw_dir(tmp_path):
    first, second = tmp_path / "detectrl", tmp_path / "ghostbuster"
    first.mkdir()
    second.mkdir()
    (first / "train.jsonl").write_text(
        '{"text": "", "story": "Once\\nupon", "label": 0, "note": {"a": null}}\n\n'
        '{"prompt": "Write", "label": null, "source": " Machine "}\n'
    )
    (first / "train.csv").write_text("text,label\nnever read,human\n")
    (second / "test.csv").write_text('text,document,generated\n"","He said ""no"",\nthen left",1\nplain,,REAL\n')
    return str(tmp_path)


def test_corpus_build(spark, raw_dir, tmp_path):
    authors = str(tmp_path / "authors")
    spark.createDataFrame([("t", "Ann", None)], "text string, label string, source string").write.parquet(authors)
    out = str(tmp_path / "corpus")
    rows = build.build_corpus(spark, raw_dir, authors, out).collect()
    got = {(r.text, r.label, r.source, r.domain, r.metadata.split) for r in rows}
    assert got == {
        ("Once\nupon", "human", "detectrl", "creative_writing", "train"),
        ("Write", "llm", "detectrl", "creative_writing", "train"),
        ('He said "no",\nthen left', "llm", "ghostbuster", "creative_writing", "test"),
        ("plain", "human", "ghostbuster", "creative_writing", "test"),
        ("t", "Ann", None, "prose", None),
    }
    first = next(r for r in rows if r.text == "Once\nupon")
    assert json.loads(first.metadata.raw)["note"] == {"a": None}
    plain = next(r for r in rows if r.text == "plain")
    assert json.loads(plain.metadata.raw) == {"text": "plain", "document": "", "generated": "REAL"}
    assert spark.read.parquet(out).count() == 5


def test_missing_corpora_are_skipped(spark, tmp_path):
    assert build.build_corpus(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("label", ["true", "1.0", "robot"])
def test_unknown_labels_fail_or_are_set_aside(spark, label):
    rows = spark.createDataFrame(
        [("train", "{}", "a", label), ("train", "{}", "b", "AI"), ("test", "{}", " ", None)],
        "split string, raw string, text string, label string",
    )
    with pytest.raises(PySparkException):
        cp.normalize_rows(rows, "detectrl").collect()
    good, bad = cp.quarantine_rows(rows, "detectrl")
    assert [r.text for r in good.collect()] == ["b"]
    assert {r.problem for r in bad.collect()} == {f"unknown label: {label}", "no label field"}


def test_label_spellings(spark):
    df = spark.createDataFrame([(" Human ",), ("0",), ("AI",), ("\tGOLD\n",), ("",), (None,)], "l string")
    assert [r[0] for r in df.select(normalize_label(F.col("l"))).collect()] == [
        "human", "human", "llm", "human", None, None,
    ]


@pytest.fixture
def text_dir(tmp_path):
    (tmp_path / "The_Sea-Ann_Lee.txt").write_bytes(b"One two. Three!\r\n\r\nCaf\xc3\xa9 \xff end.")
    (tmp_path / "A-B.txt").write_text("Alpha beta gamma. Delta.")
    return str(tmp_path)


def test_text_files(spark, text_dir):
    rows = stx.read_texts(spark, text_dir, ["The_Sea-Ann_Lee.txt"], "*.txt").orderBy("text_id").collect()
    assert [(r.text_id, r.title, r.author) for r in rows] == [
        (1, "The Sea", "Ann Lee"), (2, "A", "B"), (3, "The Sea", "Ann Lee"),
    ]
    assert rows[0].raw_text == "One two. Three!\n\nCafé � end."
    assert stx.list_inputs(spark, text_dir, glob="*.txt").count() == 2
    with pytest.raises(ValueError):
        stx.list_inputs(spark, text_dir)
    with pytest.raises(FileNotFoundError, match="no1.txt\n.*no2.txt"):
        stx.read_texts(spark, text_dir, ["no1.txt", "no2.txt"])


def test_syntax_job_and_cache_round_trip(spark, text_dir, tmp_path):
    texts = stx.read_texts(spark, text_dir, glob="*.txt")
    tables = syntax.syntax_tables(texts, make_offset_parser, "sentences")
    sentences = tables.features.orderBy("text_id", "chunk_id").collect()
    assert [(r.text_id, r.chunk_id, r.token_count) for r in sentences] == [
        (1, 1, 3), (1, 2, 1), (2, 1, 2), (2, 2, 1), (2, 3, 2),
    ]
    path = str(tmp_path / "cache")
    sk.write_parse_cache(syntax.cache_of(tables), path)
    with pytest.raises(FileExistsError):
        sk.write_parse_cache(syntax.cache_of(tables), path)
    cache = stb.read_parse_cache(spark, path)
    again = syntax.syntax_tables_from_cache(cache)
    key = ["text_id", "chunk_id"]
    assert again.features.drop("text").orderBy(*key).collect() == tables.features.drop("text").orderBy(*key).collect()
    assert sorted(again.motifs.collect()) == sorted(tables.motifs.collect())
    assert {(r.id, r.title) for r in again.metadata.collect()} == {(1, "A"), (2, "The Sea")}
    assert tuple(ft.cache_summary(cache).first()) == (5, 2)
    with pytest.raises(FileNotFoundError):
        stb.read_parse_cache(spark, path + "-none")


def make_offset_parser():
    """The rule parser, with character offsets as a real parser gives them."""
    inner = make_rule_parser()

    def parse(texts):
        for sentences in inner(texts):
            for s in sentences:
                ends, at = [], 0
                for word in s["lower"]:
                    ends.append(at + len(word))
                    at = ends[-1] + 1
                s["start"] = [e - len(w) for e, w in zip(ends, s["lower"])]
                s["end"] = ends
            yield sentences

    return parse


def test_chunk_modes_and_limit(spark, text_dir):
    texts = stx.read_texts(spark, text_dir, glob="*.txt")

    def sizes(**kw):
        rows = syntax.syntax_tables(texts, make_rule_parser, **kw).features.collect()
        return sorted((r.text_id, r.chunk_id, r.token_count) for r in rows)

    assert sizes() == [(1, 0, 4), (2, 0, 3), (2, 1, 2)]
    assert sizes(chunk_mode="window", window_size=2) == [(1, 0, 2), (1, 1, 2), (2, 0, 2), (2, 1, 2), (2, 2, 1)]
    assert sizes(max_sentences=1) == [(1, 0, 3), (2, 0, 2)]
    with pytest.raises(ValueError):
        sizes(chunk_mode="lines")
    with pytest.raises(ValueError):
        syntax.cache_of(syntax.syntax_tables(texts, make_rule_parser))


def test_missing_document_is_an_empty_sentence(spark, tmp_path):
    path = str(tmp_path / "c.jsonl")
    with open(path, "w") as out:
        out.write('{"text_id": 3, "sentence_id": 1}\n\n')
    row = ft.chunk_features(pa.parses_from_cache(stb.read_parse_cache(spark, path))).first()
    assert (row.text_id, row.text, row.token_count, row.sentence_count, row.subtree_size_min) == (3, "", 0, 0, 0.0)


def test_metadata_appends(spark, tmp_path):
    path = str(tmp_path / "meta")
    assert stb.metadata_row_count(spark, path).first()[0] == 0
    row = spark.createDataFrame([(1, 'A, "b"', "c\nd", "/p")], "id bigint, title string, author string, path string")
    for _ in range(2):
        sk.append_metadata(row, path)
    assert stb.read_metadata(spark, path).collect() == row.collect() * 2


def test_salted_join_gives_the_same_rows(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    for how in ("inner", "left"):
        wide = sized_join(big, small, "k", how)
        salted = sized_join(big, small, "k", how, max_rows=0)
        assert sorted(map(str, wide.collect())) == sorted(map(str, salted.select(wide.columns).collect()))


def test_detect_label_columns(spark):
    df = spark.createDataFrame(
        [("t", "x", 1, "a", float("nan")), ("t", "y", 2, "b", 1.0), ("t", "z", 3, None, 2.0)],
        "text string, author string, domain int, Generated string, ai_score double",
    )
    assert co.detect_label_columns(df) == ["author", "Generated", "ai_score"]
    assert co.detect_label_columns(df, "domain") == ["domain"]
    with pytest.raises(ValueError):
        co.detect_label_columns(df, "none")
    assert co.numeric_feature_columns(df, ["ai_score"]) == ["domain"]


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5, True), (3.0, 5, None)], "a double, b int, c boolean")
    rows = sc.fit_scaler(df, ["a", "b", "c"]).transform(df).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0, 1.0), (1.0, 0.0, -1.0)]


def test_exact_split_sizes(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 10 < 3, "a").otherwise("b").alias("y"))
    split = sp.stratified_split(df, "id", "y", 0.2)
    got = {(r.y, r.is_test): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert got[("a", True)] + got[("b", True)] == 201
    assert abs(got[("a", True)] - 0.2 * 303) < 1
    with pytest.raises(ValueError):
        sp.stratified_split(df.where("id < 4").limit(4), "id", "y")


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, prediction int")
    assert mt.f1_macro(df).first()[0] == pytest.approx((2 / 3 + 4 / 5) / 2)
    both = mt.scores(df).first()
    assert both.f1_macro == pytest.approx(11 / 15) and both.accuracy == 0.75


def brute_tfidf(train, texts):
    def grams(t):
        return Counter(t[i : i + k] for k in (3, 4, 5) for i in range(len(t) - k + 1))

    df = Counter()
    for t in train:
        df.update(grams(t).keys())
    idf = {g: math.log((1 + len(train)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}
    for t in texts:
        x = {g: n * idf[g] for g, n in grams(t).items() if g in idf}
        norm = math.sqrt(sum(v * v for v in x.values()))
        yield {g: v / norm for g, v in x.items()}


def test_tfidf_table_and_vectors_agree_with_brute_force(spark):
    train = ["the sea the sea", "the shore", "a sea shore", "other"]
    rows = spark.createDataFrame(list(enumerate(train + ["unseen sea"])), "id bigint, text string")
    fitted = st.fit_char_ngrams(rows.where("id < 4"))
    got = {i: {} for i in range(5)}
    for r in fitted.transform(rows, "id").collect():
        got[r.id][r.gram] = r.weight
    expected = list(brute_tfidf(train, train + ["unseen sea"]))
    for i, want in enumerate(expected):
        assert got[i] == pytest.approx(want)
    block = md.fit_baseline(rows.where("id < 4"))
    grams = {r.id: r.gram for r in block.tfidf.vocabulary.collect()}
    assert sorted(grams) == list(range(len(grams))) and list(dict(sorted(grams.items())).values()) == sorted(grams.values())
    for r in block.transform(rows).select("id", "baseline").collect():
        b = r.baseline
        assert b.size == 54 + len(grams) + 4
        values = {grams[i - 54]: v for i, v in zip(b.indices, b.values) if 54 <= i < 54 + len(grams)}
        assert values == pytest.approx(expected[r.id])
        assert list(b.indices) == sorted(b.indices)


def test_dense_ids_against_row_number(spark):
    from penprint.operators.vocabulary import dense_ids

    words = [f"w{(i * 7919) % 5003:05d}" for i in range(5003)]
    table = spark.createDataFrame([(w, len(w)) for w in words], "gram string, n int")
    got = {r.gram: r.id for r in dense_ids(table, "gram", partitions=7).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}
    assert dense_ids(table.where("n < 0"), "gram").collect() == []


def test_feature_union_of_sparse_blocks(spark):
    from pyspark.sql import functions as F

    from penprint.operators.vocabulary import dense_block, union_blocks

    df = spark.createDataFrame([([1.0, 0.0, 2.0], [0.0, 5.0])], "a array<double>, b array<double>")
    joined = df.select(union_blocks(dense_block(F.col("a"), 3), dense_block(F.col("b"), 2)).alias("u"))
    u = joined.first().u
    assert (u.size, list(u.indices), list(u.values)) == (5, [0, 2, 4], [1.0, 2.0, 5.0])
    v = md.feature_union(joined, ["u"], "v").first().v
    assert v.toArray().tolist() == [1.0, 0.0, 2.0, 0.0, 5.0]


def test_svd_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 12)) + 0.01 * rng.normal(size=(60, 12))
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(a.tolist())], ["id", "features"])
    got = md.reduced(md.truncated_svd(df, k=3), df).select(vector_to_array("features")).collect()
    lengths = np.linalg.norm(np.array([r[0] for r in got]), axis=0)
    assert lengths == pytest.approx(np.linalg.svd(a)[1][:3], rel=1e-6)


def test_grid_on_separable_texts(spark):
    rows = []
    for i in range(60):
        low = i % 2 == 0
        text = ("the sea and the shore " if low else "was it you or they ") * (2 + i % 5)
        rows.append((i, text, "x" if low else "y", 1.0 * low + (i % 7) / 100, i % 3))
    df = spark.createDataFrame(rows, "row bigint, text string, author string, depth double, noise int")
    params = {"random_forest": {"numTrees": 10}, "logistic_regression": {"maxIter": 50}, "linear_svm": {"maxIter": 50}}
    results = experiment_grid(df, "row", params=params).collect()
    assert len(results) == 9 and {r.label for r in results} == {"author"}
    assert all(r.accuracy >= 0.95 for r in results), results
    with pytest.raises(ValueError):
        experiment_grid(df.drop("author"), "row")
    with pytest.raises(ValueError):
        md.fit_features(df, "other", ["depth"])
    pivot = mt.results_pivot(spark.createDataFrame(results), "accuracy", list(md.FEATURE_SETS))
    assert pivot.count() == 3


def test_literal_words(spark, tmp_path):
    path = str(tmp_path / "w.txt")
    with open(path, "w") as out:
        out.write(" Sea \n\nTHE\n")
    words = stb.as_word_list(stb.literal_words(spark, ["the"], "Up, ,on", path))
    assert words == ["on", "sea", "the", "up"]
    with pytest.raises(ValueError):
        stb.as_word_list(stb.literal_words(spark, ["a", "b"]), 1)


def test_shared_folder_is_used(spark):
    from penprint.session import scratch_path, shared_dir

    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert os.path.basename(scratch_path(spark, "x")) == "x"


def test_named_files_are_read_or_refused(spark, tmp_path):
    (tmp_path / "G [1]-H.txt").write_text("in brackets")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "A-B.txt").write_text("one")
    (tmp_path / "deep" / "er" / "C-D.txt").write_text("two")
    base = str(tmp_path)
    named = ["G [1]-H.txt", "deep/A-B.txt", "G [1]-H.txt"]
    rows = stx.read_texts(spark, base, named).orderBy("text_id").collect()
    assert [r.raw_text for r in rows] == ["in brackets", "one", "in brackets"]
    listed = stx.list_inputs(spark, base, named).orderBy("text_id").collect()
    assert [(r.text_id, r.length) for r in listed] == [(1, 11), (2, 3), (3, 11)]
    found = stx.read_texts(spark, base, glob="**/*.txt").orderBy("text_id").collect()
    assert [r.raw_text for r in found] == ["in brackets", "one", "two"]
    assert stx.read_texts(spark, base, glob="deep/**/*.txt").count() == 2
    (tmp_path / "_C-D.txt").write_text("hidden")
    for selection in ({"files": ["_C-D.txt", "deep/A-B.txt"]}, {"glob": "*.txt"}):
        with pytest.raises(ValueError, match="_C-D.txt"):
            stx.read_texts(spark, base, **selection)


def test_blank_lines_of_any_kind_are_skipped(spark, tmp_path):
    path = tmp_path / "train.jsonl"
    path.write_text('{"text": "a"}\n\t\n  \n\u3000\n', encoding="utf-8")
    rows = ss.read_jsonl_split(spark, str(path), "train", ["text"]).collect()
    assert [r.text for r in rows] == ["a"]


def test_split_is_stratified_by_default(spark):
    df = spark.range(40).select("id", F.when(F.col("id") < 4, "rare").otherwise("usual").alias("y"))
    for seed in range(6):
        sides = sp.stratified_split(df, "id", "y", 0.25, seed).where("y = 'rare'").groupBy("is_test").count()
        assert {r.is_test: r["count"] for r in sides.collect()} == {True: 1, False: 3}
    many = spark.range(30_000).select("id", (F.col("id") % 15_000).alias("y"))
    assert sp.label_encode(many, "y").agg(F.max("label_index")).first()[0] == 14_999


def test_too_many_motifs_raise_whatever_the_session_says(spark):
    leaves = [f"l{i}" for i in range(66)]
    bag = [(leaf, 1) for leaf in leaves]
    bags = spark.createDataFrame(
        [(1, 0, "VERB", bag, 1)],
        "text_id bigint, chunk_id int, pos string, bag array<struct<value:string,n:bigint>>, heads bigint",
    )
    before = spark.conf.get("spark.sql.ansi.enabled")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(PySparkException):
                mo.expand_motifs(bags).count()
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


def test_clusters_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from penprint.session import shared_dir

    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: default),
        sparkContext=SimpleNamespace(master="spark://host:7077"),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_salted_join_takes_maps(spark):
    big = spark.range(20).select("id", F.create_map(F.lit("k"), "id").alias("m"))
    small = spark.range(5).select("id", F.lit("x").alias("v"))
    assert sized_join(big, small, "id", max_rows=0).count() == 5


def test_repeated_metadata_does_not_multiply_features(spark):
    features = spark.createDataFrame([(1, 5), (2, 6)], "text_id bigint, token_count int")
    meta = spark.createDataFrame(
        [(1, "B", "b", "/b"), (1, "A", "z", "/a"), (None, "N", "n", "/n")],
        "id bigint, title string, author string, path string",
    )
    rows = ft.attach_metadata(features, meta).orderBy("text_id").collect()
    assert [(r.text_id, r.title, r.author) for r in rows] == [(1, "A", "z"), (2, None, None)]


def test_first_metadata_is_the_same_on_every_run(spark):
    cache = spark.createDataFrame(
        [(None, 1, "T", "A", "/1"), (3, 1, "Y", "A", "/2"), (3, 1, "X", "B", "/3"), (3, 0, None, None, None)],
        "text_id bigint, sentence_id int, title string, author string, source_path string",
    )
    rows = ft.metadata_first_wins(cache).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(0, "T", "A", "/1"), (3, "Unknown", "Unknown", "")]
