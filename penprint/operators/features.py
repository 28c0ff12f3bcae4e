"""Feature rows of chunks and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import total
from ..functions.trees import count_of, sentence_summary
from ..functions.words import CLAUSE_DEPS
from .joins import sized_join


def distribution_summary(values: Column) -> list[Column]:
    """Aggregates ``mean``, ``max`` and ``min`` of a group, 0.0 when it is empty."""
    zero = F.lit(0.0)
    return [
        F.coalesce(F.avg(values).cast("double"), zero).alias("mean"),
        F.coalesce(F.max(values).cast("double"), zero).alias("max"),
        F.coalesce(F.min(values).cast("double"), zero).alias("min"),
    ]


def chunk_features(parses: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per chunk: counts, three distributions and clause counts.

    All of it follows from a short summary per sentence, added up inside the row, and from
    the relations of all its tokens.
    """
    staged = parses.select(
        "text_id",
        "chunk_id",
        "text",
        *keep,
        F.transform("sents", sentence_summary).alias("m"),
        F.flatten("sents.dep").alias("_deps"),
    )

    def add(field: str) -> Column:
        return total(F.col("m"), lambda x: x[field])

    def most(field: str) -> Column:
        return F.coalesce(F.array_max(F.col(f"m.{field}")).cast("double"), F.lit(0.0))

    summed = staged.select(
        "text_id",
        "chunk_id",
        "text",
        *keep,
        add("tokens").alias("token_count"),
        F.size("m").cast("bigint").alias("sentence_count"),
        add("depth_sum").alias("_depths"),
        add("arcs").alias("_arcs"),
        *[most(f).alias(f"_{f}") for f in ("depth_max", "branching_max", "subtree_max")],
        # Looking for a value gives null where an array has nulls: then the count is unknown.
        *[
            F.when(F.array_contains("_deps", "").isNotNull(), count_of(F.col("_deps"), d)).alias(f"clause_{d}_count")
            for d in CLAUSE_DEPS
        ],
    )
    n = F.col("token_count")
    zero = F.lit(0.0)
    some = F.when(n > 0, 1.0).otherwise(zero)
    depth_mean = F.when(n > 0, F.col("_depths") / n).otherwise(zero)
    return summed.select(
        "text_id",
        "chunk_id",
        "text",
        *keep,
        "token_count",
        "sentence_count",
        depth_mean.alias("dependency_depth_mean"),
        F.col("_depth_max").alias("dependency_depth_max"),
        zero.alias("dependency_depth_min"),
        F.when(n > 0, F.col("_arcs") / n).otherwise(zero).alias("branching_factor_mean"),
        F.col("_branching_max").alias("branching_factor_max"),
        zero.alias("branching_factor_min"),
        (depth_mean + some).alias("subtree_size_mean"),
        F.col("_subtree_max").alias("subtree_size_max"),
        some.alias("subtree_size_min"),
        *[f"clause_{d}_count" for d in CLAUSE_DEPS],
    )


def token_sentence_counts(parses: DataFrame) -> DataFrame:
    return parses.select(
        "text_id",
        "chunk_id",
        total(F.col("sents"), lambda s: F.size(s["head"])).alias("token_count"),
        F.size("sents").cast("bigint").alias("sentence_count"),
    )


def clause_counts(parses: DataFrame) -> DataFrame:
    deps = F.flatten("sents.dep")
    return parses.select(
        "text_id", "chunk_id", *[count_of(deps, d).alias(f"clause_{d}_count") for d in CLAUSE_DEPS]
    )


def fill_missing(df: DataFrame, syntax: list[str] = (), motifs: list[str] = ()) -> DataFrame:
    """Nulls to 0.0 in syntax columns and to integer 0 in motif columns."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in syntax}
    filled |= {
        c: F.coalesce(F.col(f"`{c}`").cast("bigint"), F.lit(0).cast("bigint")) for c in motifs
    }
    return df.withColumns(filled) if filled else df


def attach_metadata(features: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add title, author and path to feature rows by text id.

    Metadata files grow by appending and ids start anew with every run, so an id can be
    there several times. The least of its rows is taken: features never multiply.
    """
    single = metadata.groupBy(F.col("id").alias("text_id")).agg(
        F.min(F.struct("title", "author", "path")).alias("m")
    )
    return sized_join(features, single.select("text_id", "m.*"), "text_id", "left")


def cache_summary(cache: DataFrame) -> DataFrame:
    """Sentences and distinct texts; a missing id counts as text 0.

    Grouping by text first keeps the distinct count free of any single hot task.
    """
    return (
        cache.groupBy(F.coalesce("text_id", F.lit(0).cast("bigint")).alias("text_id"))
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("sentence_total"),
            F.count("*").alias("text_total"),
        )
    )


def cache_counts(cache: DataFrame) -> DataFrame:
    """Sentences per author and per title in one pass, most frequent first.

    Counted per (author, title) first, so the second grouping sees one row per pair.
    """
    pairs = cache.groupBy(
        F.coalesce("author", F.lit("Unknown")).alias("author"),
        F.coalesce("title", F.lit("Unknown")).alias("title"),
    ).agg(F.count("*").alias("n"))
    return (
        pairs.groupingSets([["author"], ["title"]], "author", "title")
        .agg(F.sum("n").alias("sentences"), F.grouping("author").alias("_title"))
        .select(
            F.when(F.col("_title") == 1, "title").otherwise("author").alias("kind"),
            F.when(F.col("_title") == 1, F.col("title")).otherwise(F.col("author")).alias("name"),
            "sentences",
        )
        .orderBy("kind", F.desc("sentences"), "name")
    )


def metadata_first_wins(cache: DataFrame) -> DataFrame:
    """One metadata row per text: that of its first sentence.

    A missing id is text 0, as for the parses. Of several first sentences the one with the
    least title, author and path counts.
    """
    row = F.struct(
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce("author", F.lit("Unknown")).alias("author"),
        F.coalesce("source_path", F.lit("")).alias("path"),
    )
    return (
        cache.groupBy(F.coalesce("text_id", F.lit(0).cast("bigint")).alias("id"))
        .agg(F.min(F.struct("sentence_id", row.alias("row"))).alias("m"))
        .select("id", "m.row.*")
    )
