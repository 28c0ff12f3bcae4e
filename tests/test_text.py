"""Cleaning, chunking and counting on literal texts."""

import pytest
from pyspark.sql import functions as F

from penprint.functions import text as tx
from penprint.functions.words import FUNCTION_WORDS
from penprint.operators import chunks as ch


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t"))).first()[0]


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "text_id bigint, text string")


def test_normalize_text(spark):
    assert one(spark, " a\r\nb\rc \t d\n\n\n\ne \n", tx.normalize_text) == "a\nb\nc d\n\ne"


def test_space_between_line_breaks_does_not_part_paragraphs(spark):
    rows = ch.chunk_texts(texts(spark, "x\n \ny"), "paragraphs").collect()
    assert [(r.chunk_id, r.text) for r in rows] == [(0, "x\n \ny")]


def test_window_chunks(spark):
    rows = ch.chunk_texts(texts(spark, "a b c d e", "    "), "window", 2).collect()
    assert [(r.chunk_id, r.text) for r in rows] == [(0, "a b"), (1, "c d"), (2, "e")]
    with pytest.raises(ValueError):
        ch.chunk_texts(texts(spark, "a"), "window", 0)
    with pytest.raises(ValueError):
        ch.chunk_texts(texts(spark, "a"), "lines")


def test_windows_reassemble_the_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("text_id"), "text"
    )
    kept = ch.chunk_texts(docs, "window", 7).agg(F.sum(tx.word_count(F.col("text")))).first()[0]
    assert kept == docs.agg(F.sum(tx.word_count(F.col("text")))).first()[0]


@pytest.mark.parametrize(
    "lines, kept",
    [
        (["x", "S", "a", "S", "b", "E", "c", "E", "y"], ["a", "S", "b", "E", "c"]),
        (["x", "S", "a"], ["a"]),
        (["a", "E", "x"], ["a"]),
        (["a", "b"], ["a", "b"]),
        (["a", "E", "b", "S", "c"], []),
        (["*** START OF THE PROJECT GUTENBERG EBOOK X ***", "a"], None),
    ],
)
def test_markers(spark, lines, kept):
    names = {
        "S": "*** START OF THIS PROJECT GUTENBERG EBOOK X ***",
        "E": "*** END OF THIS PROJECT GUTENBERG EBOOK X ***",
    }
    full = [names.get(line, line) for line in lines]
    expected = full if kept is None else [names.get(line, line) for line in kept]
    assert one(spark, "\r\n".join(full) + "\n", tx.strip_header_footer) == "\n".join(expected)


def test_sentence_stats(spark):
    def stats(text):
        return tuple(one(spark, text, tx.sentence_stats))

    assert stats("One two. Three! ") == (1.5, 0.5, 1.0, 2.0)
    assert stats("") == (0.0, 0.0, 0.0, 0.0)
    assert stats("... — ? a") == (0.5, 0.5, 0.0, 1.0)


def test_function_words_skip_single_letters(spark):
    rates = dict(zip(FUNCTION_WORDS, one(spark, "The cat and a dog", tx.function_word_freq)))
    assert (rates["the"], rates["and"], rates["a"]) == (0.2, 0.2, 0.0)
    assert sum(one(spark, "", tx.function_word_freq)) == 0.0


def test_words_are_unicode(spark):
    assert one(spark, "naïve él_1 x-١", tx.word_count) == 4


def test_char_ngrams_take_whole_characters(spark):
    grams = one(spark, "A\U0001f600b \t C", lambda c: tx.char_ngrams(c, 3, 4))
    assert grams == ["a\U0001f600b", "\U0001f600b ", "b c", "a\U0001f600b ", "\U0001f600b c"]
    assert one(spark, "ab", tx.char_ngrams) == []


def test_filename_metadata(spark):
    def names(path):
        return tuple(one(spark, path, tx.filename_metadata))

    assert names("/d/The_Sea-Ann_Lee-2.txt") == ("The Sea", "Ann Lee")
    assert names("/d/Alone.txt") == ("Alone", "Unknown")
    assert names("/d/-_.txt") == ("Unknown title", "Unknown")


def test_limit_sentences(spark):
    df = texts(spark, "A b. C!\n\nD? E.")
    assert ch.limit_sentences(df, 3).first().text == "A b. C! D?"
    assert ch.limit_sentences(df, 0).first().text == "A b. C!\n\nD? E."
    assert ch.limit_sentences(df, -1).first().text == ""


def test_sentences_are_numbered_through_the_text(spark):
    rows = ch.chunk_sentences(texts(spark, "A b. C!\n\nD? E.")).collect()
    assert [(r.sentence_id, r.text) for r in rows] == [(1, "A b."), (2, "C!"), (3, "D?"), (4, "E.")]


def test_row_wise_operators_run_on_a_stream(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("text_id"), F.col("text").alias("raw_text")
    )
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))

    def chunks(df):
        return ch.chunk_texts(ch.clean_texts(df), "window", 50)

    run = (
        chunks(stream)
        .writeStream.option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"), format="parquet")
    )
    assert run.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(chunks(docs)).isEmpty() and got.count() == chunks(docs).count()
