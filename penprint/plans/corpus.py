"""Raw splits and an author corpus to one normalized corpus."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import STORY_TEXT_KEYS
from ..operators.corpus import corpus_union, normalize_rows
from ..schemas import CORPUS
from ..sinks.tables import write_corpus
from ..sources.files import exists
from ..sources.splits import read_splits
from ..sources.tables import read_author_corpus

log = logging.getLogger(__name__)


def build_corpus(
    spark: SparkSession, raw_dir: str, author_path: str | None = None, output: str | None = None
) -> DataFrame:
    """Unite the corpora that are present; a missing one is skipped with a message."""
    parts = []
    for dataset in STORY_TEXT_KEYS:
        rows = read_splits(spark, raw_dir, dataset)
        if rows is None:
            log.warning("raw corpus %s not found; skipped", dataset)
        else:
            parts.append(normalize_rows(rows, dataset))
    if author_path and exists(spark, author_path):
        parts.append(read_author_corpus(spark, author_path))
    else:
        log.warning("author corpus not found; skipped")
    corpus = corpus_union(parts) if parts else spark.createDataFrame([], CORPUS)
    if output:
        write_corpus(corpus, output)
    return corpus
