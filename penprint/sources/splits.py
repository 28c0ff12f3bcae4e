"""Raw corpora kept as train/validation/test files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.labels import LABEL_KEYS, STORY_TEXT_KEYS
from ..functions.text import is_blank
from .files import exists

# Split names, in reading order.
SPLITS = ["train", "validation", "test"]


def available_splits(spark: SparkSession, directory: str) -> dict[str, str]:
    """Split name to its file; a JSONL file is preferred to a CSV file."""
    found = {}
    for split in SPLITS:
        for suffix in ("jsonl", "csv"):
            path = os.path.join(directory, f"{split}.{suffix}")
            if exists(spark, path):
                found[split] = path
                break
    return found


def read_jsonl_split(spark: SparkSession, path: str, split: str, keys: list[str]) -> DataFrame:
    """Raw lines and the wanted keys as strings; blank lines are skipped.

    The schema is given, so the file is read once, and ``raw`` is the line as it stands.
    """
    schema = ", ".join(f"`{k}` string" for k in keys)
    lines = spark.read.text(path).where(~is_blank(F.col("value")))
    return lines.select(
        F.lit(split).alias("split"),
        F.col("value").alias("raw"),
        F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"),
    ).select("split", "raw", "row.*")


def read_csv_split(
    spark: SparkSession, path: str, split: str, keys: list[str], quoted_newlines: bool = True
) -> DataFrame:
    """The same columns from CSV with a header; every value is a string.

    Line breaks inside quotes force one task per file. Where the data has none,
    ``quoted_newlines=False`` lets Spark cut large files.
    """
    rows = spark.read.csv(
        path, header=True, multiLine=quoted_newlines, escape='"', inferSchema=False
    )
    filled = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])
    return filled.select(
        F.lit(split).alias("split"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in filled.columns])).alias("raw"),
        *[
            (F.col(f"`{k}`") if k in filled.columns else F.lit(None).cast("string")).alias(k)
            for k in keys
        ],
    )


def read_splits(
    spark: SparkSession,
    base_dir: str,
    dataset: str,
    keys: list[str] | None = None,
    quoted_newlines: bool = True,
) -> DataFrame | None:
    """All present splits of a raw corpus, or None when it has no split file."""
    wanted = keys or list(dict.fromkeys(STORY_TEXT_KEYS[dataset] + LABEL_KEYS))
    parts = []
    for split, path in available_splits(spark, os.path.join(base_dir, dataset)).items():
        if path.endswith(".jsonl"):
            parts.append(read_jsonl_split(spark, path, split, wanted))
        else:
            parts.append(read_csv_split(spark, path, split, wanted, quoted_newlines))
    if not parts:
        return None
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
