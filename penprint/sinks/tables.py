"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.files import exists

# Sentences per file of a JSON cache, a few hundred MB of plain lines.
CACHE_FILE_ROWS = 200_000

def write_corpus(corpus: DataFrame, path: str) -> None:
    """Parquet, one folder per source; replaces what is there."""
    corpus.write.mode("overwrite").partitionBy("source").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def write_parse_cache(
    cache: DataFrame,
    path: str,
    overwrite: bool = False,
    file_format: str = "json",
    compression: str | None = None,
) -> None:
    """One JSON line (or parquet row) per sentence; refuses to replace unless told to.

    JSON names every field of every token, about 33 times the text, so its files are
    gzipped by default; Spark's reader unpacks them by their suffix. Such a file is read
    by one task, hence the bound on its rows. ``compression="none"`` writes plain lines.
    """
    if not overwrite and exists(cache.sparkSession, path):
        raise FileExistsError(f"parse cache exists at {path}; pass overwrite=True to replace it")
    writer = cache.write.mode("overwrite" if overwrite else "errorifexists").format(file_format)
    if file_format == "json":
        writer = writer.option("compression", compression or "gzip").option("maxRecordsPerFile", CACHE_FILE_ROWS)
        # The fastest level: field names shrink at any level, and time goes to the parse.
        writer = writer.option("zlib.compress.level", "BEST_SPEED")
    elif compression:
        writer = writer.option("compression", compression)
    writer.save(path)


def append_metadata(metadata: DataFrame, path: str) -> None:
    """Append ``id, title, author, path`` rows to a CSV folder; runs are not deduplicated."""
    metadata.select("id", "title", "author", "path").write.mode("append").csv(
        path, header=True, escape='"'
    )


def write_results(results: DataFrame, path: str) -> None:
    """The result table in reading order; it has one row per label, set and model."""
    results.orderBy("label", "model", "feature_set").coalesce(1).write.mode("overwrite").parquet(path)
