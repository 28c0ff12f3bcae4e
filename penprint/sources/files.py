"""Finding input files through the cluster's file system."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import SparkSession

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?")
_SPECIAL = re.compile(r"([\\\[\]{}*?])")


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _located(spark, path)
    return fs.exists(place)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's file columns print it."""
    fs, place = _located(spark, path)
    return fs.makeQualified(place).toString()


def literal(path: str) -> str:
    """A path that a reader takes as it stands, special characters of patterns included."""
    return _SPECIAL.sub(r"\\\1", path)


def without_scheme(path: str) -> str:
    return _SCHEME.sub("", path)


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Qualified matches of one pattern."""
    fs, place = _located(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(place) or []]


def glob_paths(spark: SparkSession, directory: str, pattern: str) -> list[str]:
    """Qualified matches below a directory, ordered component by component.

    ``**`` stands for any number of folders, none included. It is widened one level at a
    time for as long as there are folders that deep.
    """
    base = literal(directory)
    if "**" not in pattern.split("/"):
        found = _matches(spark, posixpath.join(base, pattern))
    else:
        before, _, behind = f"/{pattern}".partition("/**")
        before, behind = before.strip("/"), behind.strip("/") or "*"
        found, level = [], ""
        while _matches(spark, posixpath.join(base, before, level) + "/"):
            found += glob_paths(spark, directory, posixpath.join(before, level, behind))
            level = posixpath.join(level, "*")
            if not _matches(spark, posixpath.join(base, before, level, "*")):
                found += glob_paths(spark, directory, posixpath.join(before, level, behind))
                break
    return sorted(set(found), key=lambda p: without_scheme(p).split("/"))


def selected_files(
    spark: SparkSession, input_dir: str, files: list[str] = (), glob: str | None = None
) -> list[str]:
    """Qualified paths of the selection, repeats included.

    Named files come first, in their order and relative to ``input_dir``; then the matches
    of the pattern. Selecting nothing is an error, and so is naming files that are not
    there; the error names all of them.
    """
    if not files and not glob:
        raise ValueError("name input files or a pattern; the whole directory is not read by default")
    named = [qualified(spark, f if "://" in f else posixpath.join(input_dir, f)) for f in files]
    absent = [p for p in dict.fromkeys(named) if not exists(spark, p)]
    if absent:
        raise FileNotFoundError("missing input files:\n" + "\n".join(map(without_scheme, absent)))
    selection = named + (glob_paths(spark, input_dir, glob) if glob else [])
    if not selection:
        raise ValueError(f"no file matches {glob}")
    return selection
