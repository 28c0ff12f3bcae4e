"""Inputs for the registered queries, derived from the given tables.

The tables hold plain texts: no book markers, raw label spellings or parses. These views
add them by rule, so every query still reads whole tables and grows with them. The parse
is arithmetic, not linguistic: the same trees can be built in any engine.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import words
from ..operators.parses import cache_rows, sentence_rows
from ..schemas import SENTENCES
from ..session import scratch_path, spread

SPELLINGS = ["0", "1", " Human ", "AI", "gold", "machine", "REAL", "generated", "human_written", "llm"]
POS = ["NOUN", "VERB", "ADJ", "DET", "ADP", "ADV", "PRON"]
DEP = ["nsubj", "ccomp", "det", "advcl", "obj", "xcomp", "acl", "relcl"]
# Text that is parsed at once; the parse of a slice takes about forty times its bytes.
SLICE_BYTES = 1 << 20
START_LINE = "*** START OF THIS PROJECT GUTENBERG EBOOK SAMPLE ***"
END_LINE = "*** END OF THIS PROJECT GUTENBERG EBOOK SAMPLE ***"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The text table with the wanted columns, on all cores even when the file is small."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with doubled and tripled line breaks, doubled spaces and CR LF."""
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n\n"))).otherwise(
        F.replace("text", F.lit("\n"), F.lit("\n\n"))
    )
    text = F.when(k % 5 == 0, F.replace(text, F.lit(" "), F.lit(" \t "))).otherwise(text)
    text = F.when(k % 7 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return documents(spark, sf_dir, "text").select(k.alias("text_id"), text.alias("text"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts between marker lines: both, start only, end only, or none."""
    k = F.col("doc_id") % 4
    before = F.when(k <= 1, F.lit(f"license\n{START_LINE}\n")).otherwise("")
    after = F.when((k == 0) | (k == 2), F.lit(f"\n{END_LINE}\nlicense")).otherwise("")
    return documents(spark, sf_dir, "text").select(
        F.col("doc_id").alias("text_id"), F.concat(before, "text", after).alias("raw_text")
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names: full, without author, without title, with blank author."""
    k = F.col("doc_id") % 5
    doc = F.concat(F.lit("/d/Doc_"), F.col("doc_id").cast("string"))
    path = (
        F.when(k == 1, F.concat(doc, F.lit(".txt")))
        .when(k == 2, F.concat(F.lit("/d/-"), "source", F.lit(".txt")))
        .when(k == 3, F.concat(doc, F.lit("-__.v2.txt")))
        .when(k == 4, F.concat(doc, F.lit("-__.txt")))
        .otherwise(F.concat(doc, F.lit("-"), "source", F.lit("_"), "lang", F.lit("-x.txt")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("source_path"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw corpus rows: the label and the text sit under varying keys and spellings."""
    k, t = F.col("doc_id") % 10, F.col("doc_id") % 4
    spelled = _pick(SPELLINGS, k)
    split = F.when(F.col("doc_id") % 5 == 3, "validation").when(F.col("doc_id") % 5 == 4, "test").otherwise("train")
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        split.alias("split"),
        F.when(k <= 3, spelled).when((k == 6) | (k == 7), "").alias("label"),
        F.when((k == 4) | (k == 5), spelled).alias("source"),
        F.when((k == 6) | (k == 7), spelled).alias("generated"),
        F.when(k >= 8, spelled).alias("is_ai"),
        F.when(t == 0, text).when(t == 2, "").alias("text"),
        F.when(t == 1, text).alias("story"),
        F.when(t == 2, text).alias("content"),
        F.when(t == 3, text).alias("prompt"),
        F.to_json(F.struct("doc_id", "lang", F.col("source").alias("origin"))).alias("raw"),
    )


def write_splits(spark: SparkSession, sf_dir: str, dataset: str, suffix: str) -> str:
    """Raw rows as split files of a corpus below a fresh folder; returns that folder."""
    base = scratch_path(spark, "raw")
    rows = raw_rows(spark, sf_dir).drop("raw")
    for split in ("train", "validation", "test"):
        writer = rows.where(F.col("split") == split).drop("split", "doc_id").write
        path = os.path.join(base, dataset, f"{split}.{suffix}")
        if suffix == "jsonl":
            writer.json(path)
        else:
            writer.csv(
                path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
            )
    return base


def write_text_files(spark: SparkSession, sf_dir: str) -> str:
    """Texts as many small text files, a folder per source."""
    base = scratch_path(spark, "texts")
    table(spark, sf_dir, "documents").select("text", "source").write.option(
        "maxRecordsPerFile", 50
    ).partitionBy("source").text(base)
    return base


@functools.cache
def word_points(spark: SparkSession) -> np.ndarray:
    """Which code points stand in words, as Spark's own pattern for words tells."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    found = spark.createDataFrame([(every,)], "c string").select(F.array_join(words(F.col("c")), "")).first()[0]
    points = np.zeros(0x110000, bool)
    points[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = True
    return points


def _word_bytes(joined: bytes, b: np.ndarray, in_words: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text stand in words; a byte of no character stands in none."""
    if joined.isascii():
        return in_words[:128][b]
    # Bytes of no character become lone surrogates, one each.
    points = joined.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(points, np.uint32)
    width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
    return np.repeat(in_words[code], np.where((code >= 0xDC80) & (code <= 0xDCFF), 1, width))


def _lowered(b: np.ndarray, in_word: np.ndarray, after: np.ndarray) -> pa.Array:
    """The words in lower case, each as it would be alone: a blank ends a word's context."""
    kept = in_word.copy()
    kept[after] = True
    spaced = np.where(in_word, b, np.uint8(32))[kept].tobytes()
    low = np.frombuffer(spaced.decode("utf-8").lower().encode("utf-8"), np.uint8)
    blank = low == 32
    ends = np.flatnonzero(blank) - np.arange(len(after))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(after), pa.py_buffer(offsets), pa.py_buffer(low[~blank]))


def stand_in_sentences(texts: pa.Array, in_words: np.ndarray) -> pa.Array:
    """Sentences of texts with arithmetic trees, as arrays of packed sentences.

    A sentence ends where ``.``, ``!`` or ``?`` stands before white space; pieces without words
    count in ``sent_id`` but give no sentence. The tree is four-way over the words, mirrored
    with the root last for odd lengths. A null text gives null. ``in_words`` tells for each
    code point whether it stands in words.
    """
    joined = b"\n".join(t or b"" for t in texts.cast(pa.binary()).to_pylist()) + b"\n"
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    b = np.frombuffer(joined, np.uint8)
    in_word = _word_bytes(joined, b, in_words)
    edges = np.diff(in_word.astype(np.int8), prepend=0, append=0)
    first, after = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)

    # Pieces: how many breaks lie before a byte.
    ends_piece = (b == 46) | (b == 33) | (b == 63)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    breaks = b == 1
    breaks[:-1] |= ends_piece[:-1] & blank[1:]
    before = np.concatenate([[0], np.cumsum(breaks)])
    row = np.searchsorted(begins, first, "right") - 1
    piece = before[first] - before[begins[row]] + 1

    # Sentences, and each word's place in its own.
    opens = np.ones(len(first), bool)
    opens[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
    at = np.flatnonzero(opens)
    borders = np.append(at, len(first))
    n_each = np.diff(borders)
    n = np.repeat(n_each, n_each)
    i = np.arange(len(first)) - np.repeat(at, n_each)
    up = lambda k: np.maximum(k - 1, 0) >> 2
    head = np.where(n % 2 == 0, up(i), n - 1 - up(n - 1 - i))

    points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    length = points[after] - points[first]
    reach = np.cumsum(length + 1)
    end = reach - np.repeat(reach[at] - length[at] - 1, n_each) - 1

    # A sentence's text: its words and one blank after each but the last.
    gap = np.zeros(len(b), bool)
    gap[after[:-1][~opens[1:]]] = True
    kept = in_word | gap
    ahead = np.concatenate([[0], np.cumsum(kept)])
    text = np.where(in_word, b, np.uint8(32))[kept]
    text_ends = np.append(ahead[first[at]], len(text)).astype(np.int32)

    borders = pa.array(borders, pa.int32())
    listed = lambda values: pa.ListArray.from_arrays(borders, values)
    ints = lambda values: listed(pa.array(values, pa.int32()))
    names = lambda values, index: listed(pa.array(values).take(pa.array(index)))
    fields = {
        "sent_id": pa.array(piece[at], pa.int32()),
        "text": pa.StringArray.from_buffers(len(at), pa.py_buffer(text_ends), pa.py_buffer(text)),
        "head": ints(head),
        "pos": names(POS, length % 7),
        "dep": names([*DEP, "ROOT"], np.where(head == i, len(DEP), i % 8)),
        "lower": listed(_lowered(b, in_word, after)),
        "start": ints(end - length),
        "end": ints(end),
    }
    per_row = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(texts)))])
    return pa.ListArray.from_arrays(
        pa.array(per_row, pa.int32()),
        pa.StructArray.from_arrays([*fields.values()], [*fields]),
        mask=texts.is_null(),
    )


def _parser(packed: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``sents`` to batches, in slices of about ``SLICE_BYTES`` of text."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_words = np.unpackbits(packed).astype(bool)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES)) + 1
            borders = [0, *cut.tolist(), batch.num_rows]
            for low, high in zip(borders, borders[1:]):
                part = batch.slice(low, high - low)
                yield part.append_column("sents", stand_in_sentences(part["text"], in_words))

    return parsed


def parses(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Whole documents as parsed chunks, ``chunk_id`` 0.

    The stand-in parse is made batch by batch from Arrow's text buffers: as column
    expressions it took four fifths of the time of the queries that read it.
    """
    texts = documents(spark, sf_dir, "text", *keep).select(
        F.col("doc_id").alias("text_id"), F.lit(0).alias("chunk_id"), *keep, "text"
    )
    schema = T.StructType([*texts.schema.fields, T.StructField("sents", SENTENCES)])
    parsed = texts.mapInArrow(_parser(np.packbits(word_points(spark))), schema)
    return parsed.select("text_id", "chunk_id", "text", "sents", *keep)


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cache rows, one per sentence; one in nine has no author."""
    named = parses(spark, sf_dir, "source", "lang").select(
        "*",
        F.concat(F.lit("Doc "), F.col("lang")).alias("title"),
        F.when(F.col("text_id") % 9 != 0, F.col("source")).alias("author"),
        F.concat(F.lit("/d/"), F.col("text_id").cast("string"), F.lit(".txt")).alias("source_path"),
    )
    return cache_rows(sentence_rows(named, ["title", "author", "source_path"]))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Doc, \""), F.col("doc_id").cast("string"), F.lit("\"")).alias("title"),
        F.col("source").alias("author"),
        F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
    )


def labelled(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents that have class labels."""
    return documents(spark, sf_dir, *columns).join(table(spark, sf_dir, "labels"), "doc_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a prediction that is wrong for every fifth id."""
    quality = F.col("quality")
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        quality.alias("label"),
        F.when(F.col("doc_id") % 5 == 0, 1 - quality).otherwise(quality).alias("prediction"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: shares of labelled documents that a rule per arm gets right."""
    arms = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(fs).alias("feature_set"),
                F.lit(m).alias("model"),
                F.lit(6 * a + 3 * b + c + 2).alias("k"),
            )
            for a, label in enumerate(("quality", "toxic"))
            for b, fs in enumerate(("baseline", "combined", "syntax"))
            for c, m in enumerate(("linear_svm", "logistic_regression", "random_forest"))
        ]
    )
    return (
        table(spark, sf_dir, "labels")
        .select("doc_id", F.inline(arms))
        .groupBy("label", "feature_set", "model")
        .agg(
            F.avg((F.col("doc_id") % F.col("k") != 0).cast("int")).alias("accuracy"),
            F.avg((F.col("doc_id") % (F.col("k") + 1) != 0).cast("int")).alias("f1_macro"),
        )
    )
