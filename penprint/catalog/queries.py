"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.labels import LABEL_KEYS, STORY_TEXT_KEYS, build_metadata, normalize_label
from ..functions.words import CLAUSE_DEPS, FUNCTION_WORDS, LITERAL_WORDS
from ..operators import vocabulary as vc
from ..operators import (
    chunks as ch,
    columns as co,
    corpus as cp,
    features as ft,
    metrics as mt,
    models as md,
    motifs as mo,
    parses as pa,
    scaling as sc,
    splits as sp,
    stylometry as st,
    trees as tr,
)
from ..plans.evaluation import experiment_grid
from ..session import materialize, scratch_path
from ..sinks import tables as sk
from ..sources import splits as ss, tables as stb, texts as stx
from . import standins as si
from .rule_parser import make_rule_parser

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SYNTAX = [
    "token_count",
    "sentence_count",
    *[f"{d}_{s}" for d in ("dependency_depth", "branching_factor", "subtree_size") for s in ("mean", "max", "min")],
    *[f"clause_{d}_count" for d in CLAUSE_DEPS],
]
# A top-k report: so many motifs become columns in the pivot query.
PIVOTED = 100


def query(build: Query) -> Query:
    QUERIES[build.__name__.removeprefix("q_")] = build
    return build


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- sources and sinks -------------------------------------------------------------


@query
def q_src_text_files(spark, sf):
    base = si.write_text_files(spark, sf)
    texts = stx.read_texts(spark, base, glob="source=*/*.txt")
    per_source = texts.groupBy(
        F.regexp_extract("source_path", r"source=([^/]+)", 1).alias("source")
    ).agg(F.sum(tx.word_count(F.col("raw_text"))).alias("words"))
    dense = texts.agg(
        (F.max("text_id") == F.count_distinct("text_id")) & (F.min("text_id") == 1)
    ).scalar()
    return per_source.withColumn("ids_dense", dense)


@query
def q_src_list_inputs(spark, sf):
    base = si.write_text_files(spark, sf)
    listed = stx.list_inputs(spark, base, glob="source=*/*.txt")
    return listed.groupBy(F.regexp_extract("path", r"source=([^/]+)", 1).alias("source")).agg(
        F.sum("length").alias("bytes")
    )


def _raw_fields(rows: DataFrame, dataset: str) -> DataFrame:
    return rows.select(
        "split",
        cp.pick_field(rows, STORY_TEXT_KEYS[dataset]).alias("text"),
        cp.pick_field(rows, LABEL_KEYS).alias("label"),
    )


@query
def q_src_jsonl_splits(spark, sf):
    base = si.write_splits(spark, sf, "detectrl", "jsonl")
    return _raw_fields(ss.read_splits(spark, base, "detectrl"), "detectrl")


@query
def q_src_csv_splits(spark, sf):
    base = si.write_splits(spark, sf, "detectrl", "csv")
    return _raw_fields(ss.read_splits(spark, base, "detectrl"), "detectrl")


def _flat_corpus(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        "text", "label", "source", "domain", "metadata.split", "metadata.raw"
    )


@query
def q_src_corpus_parquet(spark, sf):
    path = scratch_path(spark, "authors")
    si.table(spark, sf, "benchmark").select(
        "text", F.when(F.col("item_id") % 2 == 0, "human").alias("label")
    ).write.parquet(path)
    return _flat_corpus(stb.read_author_corpus(spark, path))


@query
def q_src_features_parquet(spark, sf):
    path = scratch_path(spark, "features")
    sk.write_features(ft.chunk_features(si.parses(spark, sf)), path)
    return rounded(
        stb.read_features(spark, path).select("text_id", "text", "token_count", "dependency_depth_mean"),
        "dependency_depth_mean",
    )


def _written_cache(spark, sf) -> str:
    path = scratch_path(spark, "cache")
    sk.write_parse_cache(si.cache(spark, sf), path)
    return path


@query
def q_src_parse_cache(spark, sf):
    return stb.read_parse_cache(spark, _written_cache(spark, sf)).select(
        "text_id",
        "sentence_id",
        "author",
        "sentence_text",
        F.size("doc_json.tokens").cast("bigint").alias("tokens"),
    )


@query
def q_sink_corpus_parquet(spark, sf):
    path = scratch_path(spark, "corpus")
    sk.write_corpus(cp.normalize_rows(si.raw_rows(spark, sf), "detectrl"), path)
    return spark.read.parquet(path).groupBy("source", "domain", "label", "metadata.split").agg(
        F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")
    )


@query
def q_sink_features_parquet(spark, sf):
    path = scratch_path(spark, "features")
    features = ft.chunk_features(si.parses(spark, sf))
    sk.write_features(features, path)
    sk.write_features(features, path)
    return stb.read_features(spark, path).agg(
        F.count("*").alias("rows"),
        F.sum("token_count").alias("tokens"),
        F.sum("clause_acl_count").alias("acl"),
    )


@query
def q_sink_parse_cache(spark, sf):
    path = _written_cache(spark, sf)
    try:
        sk.write_parse_cache(si.cache(spark, sf), path)
        refused = False
    except FileExistsError:
        refused = True
    sk.write_parse_cache(si.cache(spark, sf), path, overwrite=True)
    return ft.cache_summary(stb.read_parse_cache(spark, path)).withColumn("refused", F.lit(refused))


@query
def q_sink_metadata_csv(spark, sf):
    path = scratch_path(spark, "metadata")
    for _ in range(2):
        sk.append_metadata(si.metadata(spark, sf), path)
    return stb.read_metadata(spark, path).groupBy("id", "title", "author", "path").agg(
        F.count("*").alias("rows")
    )


@query
def q_sink_results(spark, sf):
    path = scratch_path(spark, "results")
    sk.write_results(si.results(spark, sf), path)
    return rounded(spark.read.parquet(path), "accuracy", "f1_macro")


# --- projections, filters, scalar functions ----------------------------------------


@query
def q_first_nonempty_field(spark, sf):
    rows = si.raw_rows(spark, sf)
    return rows.select(
        "doc_id",
        cp.pick_field(rows, STORY_TEXT_KEYS["detectrl"]).alias("text"),
        cp.pick_field(rows, LABEL_KEYS).alias("spelled"),
    )


@query
def q_normalize_label(spark, sf):
    rows = si.raw_rows(spark, sf)
    return rows.select("doc_id", normalize_label(cp.pick_field(rows, LABEL_KEYS)).alias("label"))


@query
def q_build_metadata(spark, sf):
    return si.raw_rows(spark, sf).select(
        "doc_id", build_metadata(F.col("split"), F.col("raw")).alias("m")
    ).select("doc_id", "m.split", "m.raw")


@query
def q_tag_dataset(spark, sf):
    rows = si.raw_rows(spark, sf).select("doc_id", "split")
    return cp.tag_dataset(rows, "ghostbuster")


@query
def q_parse_filename_metadata(spark, sf):
    return ch.filename_columns(si.paths(spark, sf))


@query
def q_strip_header_footer(spark, sf):
    return si.books(spark, sf).select(
        "text_id", tx.strip_header_footer(F.col("raw_text")).alias("text")
    )


@query
def q_normalize_text(spark, sf):
    return si.messy(spark, sf).select("text_id", tx.normalize_text(F.col("text")).alias("text"))


@query
def q_word_count(spark, sf):
    return si.documents(spark, sf, "text").select(
        "doc_id", tx.word_count(F.col("text")).cast("bigint").alias("words")
    )


@query
def q_literal_words(spark, sf):
    path = scratch_path(spark, "words")
    si.table(spark, sf, "documents").select(
        F.concat(F.lit("  "), F.upper("source"), F.lit(" "))
    ).distinct().write.text(path)
    return stb.literal_words(spark, LITERAL_WORDS, "Upon, ,the", path)


@query
def q_child_label(spark, sf):
    labelled = tr.labelled_tokens(si.parses(spark, sf), "mixed", LITERAL_WORDS)
    return labelled.groupBy("text_id", "label").agg(F.count("*").alias("tokens"))


@query
def q_clause_filter(spark, sf):
    return tr.clause_filter(pa.tokens(si.parses(spark, sf))).select(
        "text_id", "sent_id", "token_i", "lower", "dep"
    )


def _with_labels(spark, sf) -> DataFrame:
    return si.table(spark, sf, "documents").join(si.table(spark, sf, "labels"), "doc_id", "left")


@query
def q_fill_missing(spark, sf):
    return ft.fill_missing(
        _with_labels(spark, sf).select("doc_id", "quality", "toxic"), ["quality"], ["toxic"]
    )


@query
def q_detect_label_columns(spark, sf):
    df = _with_labels(spark, sf).select(
        "text",
        F.col("lang").alias("author"),
        F.col("source").alias("domain"),
        F.col("quality").alias("quality_label"),
        F.col("toxic").alias("is_toxic"),
        F.col("n_chars").alias("human_chars"),
        (F.col("lang") == "en").alias("main_language"),
        F.col("toxic").cast("double").alias("AI_score"),
    )
    found = co.detect_label_columns(df)
    return spark.createDataFrame(list(enumerate(found)), "ordinal bigint, column_name string")


@query
def q_select_numeric_features(spark, sf):
    df = _with_labels(spark, sf).select(
        F.col("doc_id").alias("text_id"),
        "text",
        "lang",
        "n_chars",
        "quality",
        "toxic",
        (F.col("source") == "src1").alias("is_src1"),
    )
    chosen = co.numeric_feature_columns(df, ["quality"])
    return df.select(*chosen)


# --- chunkers ----------------------------------------------------------------------


@query
def q_chunk_paragraphs(spark, sf):
    texts = si.messy(spark, sf).withColumn("text", tx.normalize_text(F.col("text")))
    return ch.chunk_texts(texts, "paragraphs")


def _texts(spark, sf) -> DataFrame:
    return si.documents(spark, sf, "text").withColumnRenamed("doc_id", "text_id")


@query
def q_chunk_window(spark, sf):
    return ch.chunk_texts(_texts(spark, sf), "window", 200)


@query
def q_chunk_sentences(spark, sf):
    return ch.chunk_sentences(_texts(spark, sf))


@query
def q_limit_sentences(spark, sf):
    return ch.limit_sentences(_texts(spark, sf), 3)


@query
def q_tokens_from_cache(spark, sf):
    cache = stb.read_parse_cache(spark, _written_cache(spark, sf))
    return pa.tokens(pa.parses_from_cache(cache)).drop("sent_id").withColumnRenamed(
        "chunk_id", "sent_id"
    )


@query
def q_parse_hook(spark, sf):
    chunks = _texts(spark, sf).select("text_id", F.lit(0).alias("chunk_id"), "text")
    parsed = pa.parse_with(chunks, make_rule_parser)
    return pa.tokens(parsed).groupBy("text_id").agg(
        F.count("*").alias("tokens"),
        F.max("sent_id").alias("sentences"),
        F.sum("head_i").alias("heads"),
        F.sum(F.length("lower")).alias("chars"),
        F.count_if(F.col("dep") == "relcl").alias("relcl"),
        F.count_if(F.col("pos") == "VERB").alias("verbs"),
    )


# --- trees -------------------------------------------------------------------------


@query
def q_dependency_depth(spark, sf):
    return tr.dependency_depth(si.parses(spark, sf)).drop("chunk_id")


@query
def q_subtree_size(spark, sf):
    return tr.subtree_size(si.parses(spark, sf)).drop("chunk_id")


@query
def q_branching_factor(spark, sf):
    return tr.branching_factor(si.parses(spark, sf)).drop("chunk_id")


@query
def q_motif_counts(spark, sf):
    return mo.motif_counts(si.parses(spark, sf), "mixed", LITERAL_WORDS).drop("chunk_id")


@query
def q_clause_counts(spark, sf):
    return ft.clause_counts(si.parses(spark, sf)).drop("chunk_id")


# --- aggregations ------------------------------------------------------------------


@query
def q_token_sentence_counts(spark, sf):
    return ft.token_sentence_counts(si.parses(spark, sf)).drop("chunk_id")


@query
def q_distribution_summary(spark, sf):
    return rounded(
        _with_labels(spark, sf)
        .groupBy("source", "lang", "quality")
        .agg(*ft.distribution_summary(F.col("n_chars") * F.col("toxic"))),
        "mean",
    )


_MEANS = [c for c in SYNTAX if c.endswith("_mean")]


@query
def q_chunk_features(spark, sf):
    return rounded(ft.chunk_features(si.parses(spark, sf)), *_MEANS)


@query
def q_sentence_features(spark, sf):
    sentences = pa.sentence_rows(si.parses(spark, sf))
    return rounded(ft.chunk_features(sentences), *_MEANS)


@query
def q_motif_merge(spark, sf):
    sentences = pa.sentence_rows(si.parses(spark, sf))
    each = mo.motif_counts(sentences, by=("text_id",))
    return mo.merge_motifs(each.withColumn("chunk_id", F.lit(0))).drop("chunk_id")


@query
def q_motif_pivot(spark, sf):
    parses = si.parses(spark, sf)
    counts = materialize(mo.motif_counts(parses))
    motifs = mo.top_motifs(counts, PIVOTED)
    wide = mo.motif_pivot(ft.token_sentence_counts(parses), counts, motifs)
    # The columns depend on the texts, so they come back as rows.
    cells = F.array(*[
        F.struct(F.lit(m).alias("motif"), F.col(f"`motif_{m}_count`").alias("cnt")) for m in motifs
    ])
    return wide.select("text_id", "token_count", "sentence_count", F.inline(cells))


@query
def q_cache_summary(spark, sf):
    return ft.cache_summary(si.cache(spark, sf))


@query
def q_cache_counts(spark, sf):
    return ft.cache_counts(si.cache(spark, sf))


@query
def q_metadata_first_wins(spark, sf):
    return ft.metadata_first_wins(si.cache(spark, sf))


@query
def q_metadata_row_count(spark, sf):
    path = scratch_path(spark, "metadata")
    sk.append_metadata(si.metadata(spark, sf), path)
    return stb.metadata_row_count(spark, path)


@query
def q_results_pivot(spark, sf):
    sets = ["baseline", "combined", "syntax"]
    return rounded(mt.results_pivot(si.results(spark, sf), "accuracy", sets), *sets)


# --- stylometry --------------------------------------------------------------------


@query
def q_function_word_freq(spark, sf):
    rates = st.function_word_freq(si.documents(spark, sf, "text"), "doc_id")
    words = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    return rounded(
        rates.select("doc_id", F.inline(F.arrays_zip(words.alias("word"), F.col("function_words").alias("freq")))),
        "freq",
    ).toDF("doc_id", "word", "freq")


@query
def q_char_ngram_vocab(spark, sf):
    return st.char_ngram_vocab(si.documents(spark, sf, "text"))


def _in_train(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.where(sp.split_hash(F.col(key), 13) >= 0.2 * 2**32)


@query
def q_char_ngram_tfidf(spark, sf):
    docs = si.documents(spark, sf, "text")
    weights = st.fit_char_ngrams(_in_train(docs)).transform(docs, "doc_id", gram=False)
    return rounded(
        weights.groupBy("doc_id").agg(
            F.count("*").alias("grams"),
            F.sum("tf").alias("occurrences"),
            F.sum("weight").alias("weight_sum"),
            F.max("weight").alias("weight_max"),
            F.sum(F.col("weight") * F.col("weight")).alias("squares"),
        ),
        "weight_sum",
        "weight_max",
        "squares",
    )


@query
def q_sentence_stats(spark, sf):
    stats = st.sentence_stats(si.documents(spark, sf, "text"), "doc_id")
    return rounded(stats, "sentence_mean", "sentence_std")


def _block_figures(df: DataFrame, block: str, words: int, grams: int, keep: list[str], more: list[str] = ()) -> DataFrame:
    """Figures that read every entry of a baseline block from its sparse form.

    The block holds function-word rates, then ``grams`` n-gram weights, then four
    sentence statistics, and one entry for each name in ``more``; nothing is made dense.
    """
    names = [*[f"sentence_{n}" for n in ("mean", "std", "min", "max")], *more]
    ranges = [(0, words), (words, words + grams)]
    places = [words + grams + i for i in range(len(names))]
    made = df.select(*keep, vc.block_figures(F.col(block), ranges, places).alias("_f"))
    rates, weights = F.col("_f.ranges")[0], F.col("_f.ranges")[1]
    return made.select(
        *keep,
        rates["total"].alias("word_rate"),
        weights["n"].alias("grams"),
        weights["total"].alias("weight_sum"),
        weights["most"].alias("weight_max"),
        weights["squares"].alias("squares"),
        *[F.col("_f.places")[i].alias(n) for i, n in enumerate(names)],
    )


@query
def q_feature_union(spark, sf):
    """Every entry of the joined blocks of all texts counts in some figure."""
    docs = materialize(si.documents(spark, sf, "text"))
    fitted = md.fit_baseline(docs)
    joined = fitted.transform(docs, "features")
    figures = _block_figures(joined, "features", len(FUNCTION_WORDS), fitted.tfidf.size, ["doc_id"])
    return rounded(figures, *[c for c in figures.columns if c not in ("doc_id", "grams")])


def _feature_rows(spark, sf) -> DataFrame:
    return ft.chunk_features(si.parses(spark, sf)).withColumnRenamed("text_id", "doc_id")


@query
def q_standard_scale(spark, sf):
    features = materialize(_feature_rows(spark, sf).select("doc_id", *SYNTAX))
    scaler = sc.fit_scaler(_in_train(features), SYNTAX)
    return rounded(scaler.transform(features), *SYNTAX)


@query
def q_prepare_features(spark, sf):
    """All blocks of the combined features of the labelled texts, fitted on the train split."""
    labels = si.table(spark, sf, "labels").select("doc_id", "quality")
    features = materialize(_feature_rows(spark, sf).join(labels, "doc_id"))
    fitted = md.fit_features(_in_train(features), "combined", SYNTAX)
    words, grams = len(FUNCTION_WORDS), fitted.baseline.tfidf.size
    blocks = md.add_syntax(fitted.baseline.transform(features, "_baseline"), fitted.scaler, "_syntax")
    joined = md.feature_union(blocks, ["_baseline", "_syntax"], "features", vector=False)
    figures = _block_figures(joined, "features", words, grams, ["doc_id", "quality"], SYNTAX)
    return rounded(figures, *[c for c in figures.columns if c not in ("doc_id", "quality", "grams")])


# --- modelling and evaluation ------------------------------------------------------


@query
def q_label_encode(spark, sf):
    return sp.label_encode(si.table(spark, sf, "documents").select("doc_id", "lang"), "lang")


@query
def q_stratified_split(spark, sf):
    docs = si.table(spark, sf, "documents").select("doc_id", "lang")
    loose = sp.stratified_split(docs, "doc_id", "lang", exact=False)
    exact = sp.stratified_split(docs, "doc_id", "lang")
    return loose.join(exact.select("doc_id", F.col("is_test").alias("is_test_exact")), "doc_id")


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Function words and sentence statistics of labelled texts, train and test rows."""
    text = F.col("text")
    stats = tx.sentence_stats(text)
    rows = si.labelled(spark, sf, "text").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("double").alias("label"),
        tx.function_word_freq(text).alias("words"),
        stats.alias("s"),
    ).select(
        "row_id",
        "label",
        array_to_vector(F.concat("words", F.array("s.mean", "s.std", "s.min", "s.max"))).alias("features"),
    )
    divided = materialize(sp.stratified_split(rows, "row_id", "label"), md.SPLIT_BYTES)
    return divided.where(~F.col("is_test")), divided.where("is_test")


def _predict(spark, sf, model: str) -> DataFrame:
    train, test = _vectors(spark, sf)
    n_train = train.count()
    if model == "random_forest":
        train = md.forest_rows(train, n_train)
        return md.forest_predict(train, test, n_train, 2).select("row_id", "label", "prediction")
    return md.classifier(model, n_train, 2).fit(train).transform(test).select(
        "row_id", "label", "prediction"
    )


@query
def q_logistic_regression(spark, sf):
    return _predict(spark, sf, "logistic_regression")


@query
def q_linear_svm(spark, sf):
    return _predict(spark, sf, "linear_svm")


@query
def q_random_forest(spark, sf):
    return _predict(spark, sf, "random_forest")


@query
def q_fit_predict(spark, sf):
    train, test = _vectors(spark, sf)
    return md.fit_predict(train, test, "random_forest", "row_id", 2)


@query
def q_truncated_svd(spark, sf):
    train, test = _vectors(spark, sf)
    reduced = md.reduced(md.truncated_svd(train), test)
    # Signs of components are arbitrary, so lengths are reported.
    values = vector_to_array("features")
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)
    return reduced.select(
        "row_id", F.size(values).alias("components"), F.round(squares, 6).alias("squares")
    )


@query
def q_accuracy(spark, sf):
    return rounded(mt.accuracy(si.predictions(spark, sf)), "accuracy")


@query
def q_f1_macro(spark, sf):
    return rounded(mt.f1_macro(si.predictions(spark, sf)), "f1_macro")


@query
def q_experiment_grid(spark, sf):
    labels = si.table(spark, sf, "labels").select("doc_id", "quality")
    features = materialize(_feature_rows(spark, sf).join(labels, "doc_id"))
    # All grams, columns, trees and solver steps.
    return experiment_grid(features, "doc_id", "quality")


# --- joins and unions --------------------------------------------------------------


@query
def q_join_tokens_to_head(spark, sf):
    return tr.tokens_with_head(si.parses(spark, sf)).drop("chunk_id")


@query
def q_corpus_union(spark, sf):
    stories = cp.normalize_rows(si.raw_rows(spark, sf), "detectrl")
    authors = cp.author_rows(
        si.table(spark, sf, "benchmark").select("text", F.lit("human").alias("label"))
    )
    return _flat_corpus(cp.corpus_union([stories, authors]))


@query
def q_attach_metadata(spark, sf):
    features = ft.token_sentence_counts(si.parses(spark, sf)).drop("chunk_id")
    return ft.attach_metadata(features, si.metadata(spark, sf))
