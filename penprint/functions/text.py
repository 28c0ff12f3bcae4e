"""Text cleaning, splitting and counting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import bind, positions, run_lengths, total
from .words import FUNCTION_WORDS

# Unicode white space, spelled out because Java's \s is ASCII only.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Maximal runs of letters, numbers and underscore.
WORD = r"[\p{L}\p{N}_]+"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Marker lines around a book's own text.
START_MARKER = r"\*\*\* START OF THIS PROJECT GUTENBERG EBOOK .* \*\*\*"
END_MARKER = r"\*\*\* END OF THIS PROJECT GUTENBERG EBOOK .* \*\*\*"

SENTENCE_END = r"[.!?]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE[1:]}")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalize_text(text: Column) -> Column:
    """Unix newlines, single spaces, at most one empty line in a row, stripped."""
    text = F.regexp_replace(unix_newlines(text), r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def strip_header_footer(
    text: Column, start: str = START_MARKER, end: str = END_MARKER
) -> Column:
    """Lines after the first start marker and before the last end marker."""

    def body(lines: Column) -> Column:
        first = F.coalesce(
            F.array_position(F.transform(lines, lambda l: l.rlike(start)), True), F.lit(0)
        )
        from_end = F.coalesce(
            F.array_position(
                F.reverse(F.transform(lines, lambda l: l.rlike(end))), True
            ),
            F.lit(0),
        )
        stop = F.when(from_end > 0, F.size(lines) - from_end).otherwise(F.size(lines))
        return F.array_join(
            F.slice(lines, first.cast("int") + 1, F.greatest(stop - first, F.lit(0)).cast("int")),
            "\n",
        )

    # A trailing line break does not start another line.
    lines = F.split(F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK)
    return bind(lines, body)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def tokens_by_space(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def paragraphs(text: Column) -> Column:
    return F.filter(
        F.transform(F.split(text, "\n\n"), strip), lambda p: p != ""
    )


def windows(text: Column, size: int) -> Column:
    if size < 1:
        raise ValueError("window size must be at least 1")
    return bind(
        tokens_by_space(text),
        lambda w: F.transform(
            positions(F.ceil(F.size(w) / F.lit(size)).cast("int")),
            lambda i: F.array_join(F.slice(w, i * size + 1, F.lit(size)), " "),
        ),
    )


def rule_sentences(text: Column) -> Column:
    """Sentences without a parser: a break after end punctuation and white space."""
    marked = F.regexp_replace(text, r"([.!?]+)" + SPACE + "+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: ~is_blank(s))


def sentence_stats(text: Column) -> Column:
    """Words per sentence: mean, population deviation, min, max; zeros when none."""

    def stats(lengths: Column) -> Column:
        n = F.size(lengths)
        mean = total(lengths) / n
        spread = F.sqrt(
            F.aggregate(
                lengths, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)
            )
            / n
        )
        zero = F.lit(0.0)
        return F.struct(
            F.when(n > 0, mean).otherwise(zero).alias("mean"),
            F.when(n > 0, spread).otherwise(zero).alias("std"),
            F.when(n > 0, F.array_min(lengths).cast("double")).otherwise(zero).alias("min"),
            F.when(n > 0, F.array_max(lengths).cast("double")).otherwise(zero).alias("max"),
        )

    sentences = F.filter(F.split(text, SENTENCE_END), lambda s: ~is_blank(s))
    return bind(F.transform(sentences, word_count), stats)


def function_word_counts(text: Column, vocabulary: list[str] = FUNCTION_WORDS) -> Column:
    """``map<word, n>`` of vocabulary words in the text.

    Words of one character are never counted, although the vocabulary may list them.
    """
    known = [w for w in vocabulary if len(w) > 1]
    hits = F.filter(words(F.lower(text)), lambda w: w.isin(known))
    return F.map_from_entries(run_lengths(F.sort_array(hits)))


def function_word_freq(text: Column, vocabulary: list[str] = FUNCTION_WORDS) -> Column:
    """Rates in vocabulary order, relative to all words of the text."""
    whole = F.greatest(word_count(text), F.lit(1))
    return bind(
        F.struct(function_word_counts(text, vocabulary).alias("c"), whole.alias("n")),
        lambda x: F.transform(
            F.array(*[F.lit(w) for w in vocabulary]),
            lambda w: F.coalesce(F.try_element_at(x["c"], w), F.lit(0)) / x["n"],
        ),
    )


def gram_text(text: Column) -> Column:
    """The text that n-grams are taken of: lower case, blank runs of two or more a space."""
    return F.regexp_replace(F.lower(text), SPACE + SPACE + "+", " ")


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """All character n-grams, repeats kept; blank runs of two or more become a space."""
    flat = gram_text(text)
    # The look-ahead takes n characters, the dot moves on by one whole character.
    return bind(
        flat,
        lambda t: F.concat(
            *[
                F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))
                for n in range(low, high + 1)
            ]
        ),
    )


def file_stem(path: Column) -> Column:
    """Last path component without its last extension (a leading dot is no extension)."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    return F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1")


def filename_metadata(path: Column) -> Column:
    """``Title_Words-Author_Name[-more].txt`` to ``struct<title, author>``."""

    def part(pieces: Column, index: int, default: str) -> Column:
        piece = F.coalesce(F.get(pieces, F.lit(index)), F.lit(default))
        piece = strip(F.replace(piece, F.lit("_"), F.lit(" ")))
        return F.when(piece == "", F.lit(default)).otherwise(piece)

    return bind(
        F.split(file_stem(path), "-"),
        lambda p: F.struct(
            part(p, 0, "Unknown title").alias("title"),
            part(p, 1, "Unknown").alias("author"),
        ),
    )
