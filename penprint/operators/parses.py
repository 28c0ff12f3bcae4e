"""Parsed chunks: one row per chunk with its sentences as packed arrays.

Keeping a chunk's trees in its own row means that chunk features need no shuffle and
chunks without sentences keep their row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.arrays import positions
from ..schemas import PARSES, SENTENCES

# What a user's parser returns for one piece of text: sentences as mappings with
# ``text``, ``head``, ``pos``, ``dep``, ``lower`` and, optionally, ``start`` and ``end``.
Parser = Callable[[list[str]], Iterable[Iterable[dict]]]


def parse_with(
    chunks: DataFrame,
    make_parser: Callable[[], Parser],
    pieces: Column | None = None,
    batch_size: int = 10,
) -> DataFrame:
    """Run a user's parser over ``(text_id, chunk_id, text)`` in batches.

    ``make_parser`` is called once per task, so a model is loaded once and reused. By
    default a chunk is parsed as a whole; ``pieces`` is an array column of parts to
    parse one by one, whose sentences are numbered on through the row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make_parser()
        # A few rows at a time, so that the parses of a whole Arrow batch are never held.
        for frame in (f[at : at + batch_size] for f in frames for at in range(0, len(f), batch_size)):
            flat = [p for row in frame["pieces"] for p in row]
            parsed = iter(
                [
                    sentences
                    for at in range(0, len(flat), batch_size)
                    for sentences in parser(flat[at : at + batch_size])
                ]
            )
            rows = [
                [s for _ in row for s in next(parsed)] for row in frame["pieces"]
            ]
            yield frame.drop(columns="pieces").assign(
                sents=[[_sentence(i, s) for i, s in enumerate(row, start=1)] for row in rows]
            )

    return chunks.select(
        F.col("text_id").cast("bigint"),
        F.col("chunk_id").cast("int"),
        "text",
        (F.array("text") if pieces is None else pieces).alias("pieces"),
    ).mapInPandas(run, PARSES)


def _sentence(number: int, s: dict) -> dict:
    return {
        "sent_id": number,
        "text": s.get("text"),
        "head": list(s["head"]),
        "pos": list(s["pos"]),
        "dep": list(s["dep"]),
        "lower": list(s["lower"]),
        "start": s.get("start"),
        "end": s.get("end"),
    }


def sentence_rows(parses: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per sentence, ``chunk_id`` being the sentence number from 1.

    Meant for parses of whole texts (``chunk_id`` 0 everywhere).
    """
    return _explode_sentences(parses, ["text_id", *keep]).where("s.sent_id IS NOT NULL").select(
        "text_id",
        *keep,
        F.col("s.sent_id").alias("chunk_id"),
        F.col("s.text").alias("text"),
        F.array("s").alias("sents"),
    )


def _explode_sentences(parses: DataFrame, keep: list[str]) -> DataFrame:
    """One row per sentence ``s``, and one with a null ``s`` for a chunk without any.

    The plain explode would make the optimizer test the array's size below, and so
    compute an array that is not read from a file twice.
    """
    return parses.select(*keep, F.explode_outer("sents").alias("s"))


def token_table(
    parses: DataFrame, keep: list[str] = (), **arrays: Callable[[Column], Column]
) -> DataFrame:
    """``(text_id, chunk_id, sent_id, token_i, ...)`` with one column per given array.

    Arrays are built per sentence and zipped before the explode, so no array is carried
    along and indexed per token.
    """
    s = F.col("s")
    ids = ["text_id", "chunk_id", *keep]
    staged = _explode_sentences(parses, ids).select(
        *ids,
        s["sent_id"].alias("sent_id"),
        positions(F.size(s["head"])).alias("token_i"),
        *[build(s).alias(name) for name, build in arrays.items()],
    )
    return staged.select(*ids, "sent_id", F.inline(F.arrays_zip("token_i", *arrays)))


def tokens(parses: DataFrame) -> DataFrame:
    """The flat token table."""
    return token_table(
        parses,
        head_i=lambda s: s["head"],
        lower=lambda s: s["lower"],
        pos=lambda s: s["pos"],
        dep=lambda s: s["dep"],
    )


def nest_tokens(chunks: DataFrame, flat: DataFrame) -> DataFrame:
    """Parsed chunks from a flat token table; chunks without tokens get no sentences.

    Groups are single sentences, then the sentences of single chunks.
    """
    keys = ["text_id", "chunk_id"]
    token = F.struct("token_i", "head_i", "pos", "dep", "lower")
    none = F.lit(None).cast("array<int>")
    sentences = flat.groupBy(*keys, "sent_id").agg(
        F.sort_array(F.collect_list(token)).alias("t")
    ).select(
        *keys,
        F.struct(
            F.col("sent_id").cast("int").alias("sent_id"),
            F.array_join("t.lower", " ").alias("text"),
            F.col("t.head_i").cast("array<int>").alias("head"),
            F.col("t.pos").alias("pos"),
            F.col("t.dep").alias("dep"),
            F.col("t.lower").alias("lower"),
            none.alias("start"),
            none.alias("end"),
        ).alias("s"),
    )
    nested = sentences.groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("sents"))
    empty = F.array().cast(SENTENCES)
    return chunks.select(*keys, "text").join(nested, keys, "left").select(
        *keys, "text", F.coalesce("sents", empty).alias("sents")
    )


def parses_from_cache(cache: DataFrame) -> DataFrame:
    """Cache rows to parsed chunks; a missing document has no sentences.

    Token ids and heads are absolute in a document and become positions within their
    sentence; a sentence owns the tokens inside its character range.
    """
    doc = F.col("doc_json")

    def sentence(span: Column, number: Column) -> Column:
        mine = F.filter(
            doc["tokens"],
            lambda t: (t["start"] >= span["start"]) & (t["end"] <= span["end"]),
        )
        return F.transform(
            F.array(mine),
            lambda own: F.struct(
                (number + 1).alias("sent_id"),
                F.substring(doc["text"], span["start"] + 1, span["end"] - span["start"]).alias("text"),
                F.transform(own, lambda t: t["head"] - F.get(own, F.lit(0))["id"]).alias("head"),
                F.transform(own, lambda t: t["pos"]).alias("pos"),
                F.transform(own, lambda t: t["dep"]).alias("dep"),
                F.transform(
                    own,
                    lambda t: F.lower(
                        F.substring(doc["text"], t["start"] + 1, t["end"] - t["start"])
                    ),
                ).alias("lower"),
                F.transform(own, lambda t: t["start"] - span["start"]).alias("start"),
                F.transform(own, lambda t: t["end"] - span["start"]).alias("end"),
            ),
        )[0]

    sents = F.coalesce(F.transform(doc["sents"], sentence).cast(SENTENCES), F.array().cast(SENTENCES))
    return cache.select(
        F.coalesce("text_id", F.lit(0).cast("bigint")).alias("text_id"),
        F.col("sentence_id").alias("chunk_id"),
        F.coalesce(doc["text"], F.lit("")).alias("text"),
        sents.alias("sents"),
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce("author", F.lit("Unknown")).alias("author"),
        F.coalesce("source_path", F.lit("")).alias("source_path"),
    )


def cache_rows(sentences: DataFrame) -> DataFrame:
    """Sentence rows (with title, author, source_path) to the cache layout."""
    s = F.get("sents", F.lit(0))
    token = F.transform(
        positions(F.size("s.head")),
        lambda i: F.struct(
            i.alias("id"),
            F.get("s.start", i).alias("start"),
            F.get("s.end", i).alias("end"),
            F.lit("").alias("tag"),
            F.get("s.pos", i).alias("pos"),
            F.lit("").alias("morph"),
            F.lit("").alias("lemma"),
            F.get("s.dep", i).alias("dep"),
            F.get("s.head", i).alias("head"),
        ),
    )
    return sentences.withColumn("s", s).select(
        "text_id",
        "title",
        "author",
        "source_path",
        F.col("chunk_id").alias("sentence_id"),
        F.col("text").alias("sentence_text"),
        F.struct(
            F.col("s.text").alias("text"),
            F.array(F.struct(F.lit(0).alias("start"), F.length("s.text").alias("end"))).alias("sents"),
            token.alias("tokens"),
        ).alias("doc_json"),
    )
