"""Per-token tree operators over parsed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import trees
from ..functions.arrays import bind
from ..functions.words import CLAUSE_DEPS
from .parses import token_table


def dependency_depth(parses: DataFrame) -> DataFrame:
    return token_table(parses, depth=lambda s: trees.depths(s["head"]))


def subtree_size(parses: DataFrame) -> DataFrame:
    return token_table(parses, subtree_size=lambda s: trees.subtree_sizes(s["head"]))


def branching_factor(parses: DataFrame) -> DataFrame:
    return token_table(parses, branching_factor=lambda s: trees.branching_factors(s["head"]))


def tokens_with_head(parses: DataFrame) -> DataFrame:
    """Each token with its head's part of speech and depth, looked up inside the row."""
    return token_table(
        parses,
        pos=lambda s: s["pos"],
        head_pos=lambda s: F.transform(s["head"], lambda h: F.get(s["pos"], h)),
        head_depth=lambda s: bind(
            trees.depths(s["head"]), lambda d: F.transform(s["head"], lambda h: F.get(d, h))
        ),
    )


def labelled_tokens(
    parses: DataFrame, mode: str = "category", words: list[str] = ()
) -> DataFrame:
    """Each token with its leaf label, made from the flat columns of its row."""
    flat = token_table(
        parses, lower=lambda s: s["lower"], pos=lambda s: s["pos"], dep=lambda s: s["dep"]
    )
    label = trees.child_label(F.col("lower"), F.col("pos"), F.col("dep"), mode, words)
    return flat.withColumn("label", label).drop("pos", "dep")


def clause_filter(flat: DataFrame) -> DataFrame:
    """Tokens that open a clause."""
    return flat.where(F.col("dep").isin(CLAUSE_DEPS))
