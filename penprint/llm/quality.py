"""Document quality rules: text measures, and lines that many documents of a host share.

Everything is DataFrame expressions. Measures are taken inside the row. For the line rule
each distinct line of a document sends (host, line hash) once; documents are told apart by
their text, so exact copies of one document count as one. A line is boilerplate on a host
when it is in more distinct texts than both limits allow. The text that has it first (the
least document id) keeps it; elsewhere it is removed, and documents of which too little is
left are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def word_list(text: Column) -> Column:
    """Words of a text, runs of anything but blanks; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; lambdas would evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    spots = F.sequence(F.lit(0), F.size(words) - window)
    hashes = F.transform(spots, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h, window)))
    ).cast("bigint")


def _covered(hashes: Column, window: int) -> Column:
    """Words covered by windows whose hash is there twice: neighbours once sorted."""
    tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = _let(
        tagged,
        lambda s: F.filter(
            s,
            lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True)
            | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True),
        ),
    )
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
    return F.aggregate(
        starts,
        start,
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )


def measures(text: Column) -> dict[str, Column]:
    """The base measures; a null text counts as an empty one."""
    full = F.coalesce(text, F.lit(""))
    words = word_list(text)
    lines = F.filter(F.split(full, "\n"), lambda x: _without(x, BLANKS) > 0)
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": _without(full, BLANKS).cast("bigint"),
        "n_symbols": (F.length(full) - _without(full, SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": _let(words, lambda w: repeated_words(w)),
    }


def normal_line(line: Column) -> Column:
    """Lower-cased, with single blanks and no outer ones."""
    return F.trim(F.regexp_replace(F.lower(line), BLANK, " "))


def shared_lines(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int, percent: float
) -> DataFrame:
    """``(id, text_hash, host, line, words)``: lines to remove, one row per document and line.

    A line counts per host in how many distinct texts it is; more than ``max_docs`` and more
    than ``percent`` of the host's distinct texts make it boilerplate.
    """
    line = lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(word_list(x)).alias("words"))
    lines = F.array_distinct(
        F.transform(
            F.filter(F.transform(F.split(text_col, "\n"), normal_line), lambda x: x != ""), line
        )
    )
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.xxhash64(host_col).alias("host"),
        F.explode(lines).alias("l"),
    ).select("id", "text_hash", "host", "l.line", "l.words")
    texts = rows.groupBy("host", "line", "text_hash").agg(F.min("id").alias("id"))
    counts = texts.groupBy("host", "line").agg(
        F.count("*").alias("n_texts"), F.min_by("text_hash", F.struct("id", "text_hash")).alias("first")
    )
    hosts = (
        docs.where(F.col(text_col).isNotNull())
        .select(F.xxhash64(host_col).alias("host"), F.xxhash64(text_col).alias("text_hash"))
        .distinct()
        .groupBy("host")
        .agg(F.count("*").alias("host_texts"))
    )
    frequent = (
        counts.where(F.col("n_texts") > max_docs)
        .join(hosts, "host")
        .where(100 * F.col("n_texts") > percent * F.col("host_texts"))
        .select("host", "line", "first")
    )
    return rows.join(frequent, ["host", "line"]).where("text_hash <> first").drop("first")


def _judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 20,
    percent: float = 2.0,
    keep_percent: int = 30,
    min_words: int = 10,
    max_repeat_percent: int = 20,
) -> DataFrame:
    """``docs`` under the names c0, c1, ... with its measures and verdict.

    Adds ``cut_lines``, the hashes of the removed lines (null if there are none), and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_cut_words`` (words on removed lines, each distinct line once) and ``kept``. A document
    is kept unless it fails the base rules, or fewer than ``min_words`` words or
    ``keep_percent`` percent of its words are outside removed lines.

    A null or empty text fails for want of words. A null host is a host of its own. Rows that
    repeat an id are judged each; the lines cut from any of them count for all. A null id
    has measures, and no line of it is cut. No table is too small: an empty one stays empty.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text, host = (names[docs.columns.index(c)] for c in (id_col, text_col, host_col))
    cut = (
        shared_lines(plain.where(F.col(key).isNotNull()), key, text, host, max_docs, percent)
        .groupBy("id", "text_hash")
        .agg(F.sum("words").alias("cut"), F.collect_set("line").alias("cut_lines"))
        .withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    )
    measured = plain.withColumns(measures(F.col(text))).withColumn("_text_hash", F.xxhash64(text))
    joined = measured.join(
        cut, (F.col(key) == F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left"
    )
    n_words, n_cut = F.col("n_words"), F.coalesce("cut", F.lit(0)).cast("bigint")
    failed = (n_words < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n_words)
    rest = n_words - n_cut
    depleted = (n_cut > 0) & ((rest < min_words) | (100 * rest < keep_percent * n_words))
    return joined.select(
        *names,
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        n_cut.alias("n_cut_words"),
        (~failed & ~depleted).alias("kept"),
        "cut_lines",
    )


def judge(docs: DataFrame, *args, **options) -> DataFrame:
    """``docs`` under the names c0, c1, ... with its measures and verdict; see ``_judged``."""
    return _judged(docs, *args, **options).drop("cut_lines")


def quality_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: the id, its measures and its verdict."""
    judged = judge(docs, id_col, **options)
    key = f"c{docs.columns.index(id_col)}"
    own = [c for c in judged.columns if c not in {f"c{i}" for i in range(len(docs.columns))}]
    return judged.select(F.col(key).alias(id_col), *own)


def kept_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Boilerplate lines are cut out of the texts, wherever they stand in them; a text without
    any stays as it is.
    """
    judged = _judged(docs, text_col=text_col, **options).where("kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    rest = F.filter(
        F.split(text, "\n"), lambda x: ~F.array_contains("cut_lines", F.xxhash64(normal_line(x)))
    )
    cut = F.when(F.col("cut_lines").isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))
    return judged.select(*[cut.alias(c) if c == text else c for c in names]).toDF(*docs.columns)
