"""Text files as one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import unix_newlines
from ..operators.chunks import filename_columns
from .files import literal, selected_files, without_scheme


def decode(content: Column) -> Column:
    """Bytes to text: invalid UTF-8 is replaced, line ends become LF."""
    return unix_newlines(F.make_valid_utf8(content.cast("string")))


def _opened(
    spark: SparkSession, input_dir: str, files: list[str], glob: str | None
) -> tuple[DataFrame, DataFrame]:
    """The selection as ``(text_id, path, source_path)``, ids 1..n, and the files' rows.

    Readers pass over names that start with ``_`` or ``.``. Such files are refused here,
    before anything is read, and never left out in silence.
    """
    selection = selected_files(spark, input_dir, files, glob)
    distinct = sorted(set(selection))
    contents = spark.read.format("binaryFile").load([literal(p) for p in distinct])
    if len(set(contents.inputFiles())) < len(distinct):
        hidden = [p for p in distinct if p.rpartition("/")[2].startswith(("_", "."))]
        raise ValueError("files that cannot be read:\n" + "\n".join(map(without_scheme, hidden or distinct)))
    numbered = spark.createDataFrame(
        [(i, p, without_scheme(p)) for i, p in enumerate(selection, start=1)],
        "text_id bigint, path string, source_path string",
    )
    return numbered, contents


def list_inputs(
    spark: SparkSession, input_dir: str, files: list[str] = (), glob: str | None = None
) -> DataFrame:
    """Number, path, size and time of each selected file, repeats included.

    Contents are not read. ``text_id`` gives the order.
    """
    numbered, contents = _opened(spark, input_dir, files, glob)
    facts = contents.select("path", "length", "modificationTime")
    return numbered.drop("source_path").join(facts, "path").select(
        "text_id", "path", "length", "modificationTime"
    )


def read_texts(
    spark: SparkSession, input_dir: str, files: list[str] = (), glob: str | None = None
) -> DataFrame:
    """``(text_id, title, author, source_path, raw_text)``, ids 1..n in input order.

    A file that is selected twice gets two ids.
    """
    numbered, contents = _opened(spark, input_dir, files, glob)
    texts = contents.select("path", decode(F.col("content")).alias("raw_text"))
    return filename_columns(texts.join(numbered, "path")).select(
        "text_id", "title", "author", "source_path", "raw_text"
    )
