"""Occurrences of benchmark passages in documents, by Wu-Manber multi-pattern search.

The alphabet is words. A pattern is a window of consecutive benchmark words; all patterns
of one length share a block-shift table over pairs of words. A cursor reads the pair that
ends at its position: the table says how many positions no pattern can end at, and the
cursor skips them. Where the shift is 0, the patterns whose last pair has the same hash
are compared word by word, first by word hashes and then by their bytes. Many cursors per
batch move together as numpy vectors.

The benchmark is a query set: it is read in blocks of at most ``block_words`` words, one
pass over the documents per block, so what is sent to tasks has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bytetext import buffers, letters_and_digits, mix, slices, word_hashes, words

TABLE = 1 << 18
SEGMENT = 256
_PAIR = np.uint64(0x9FB21C651E98DF25)
HITS = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"


@dataclass
class Patterns:
    """All windows of one length, with the search tables over them."""

    length: int
    shift: np.ndarray
    last_pair: np.ndarray  # sorted hashes of the windows' last pairs
    order: np.ndarray  # window numbers in that order
    hashes: np.ndarray
    texts: list[bytes]
    items: list[list[str]]


def _pairs(h: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Hash of the block of words that ends at each position of ``at``."""
    return mix(h[at - 1] * _PAIR + h[at]) if block == 2 else mix(h[at])


def build_patterns(items: list[tuple[str, str]], size: int) -> list[Patterns]:
    """Search tables for ``(item id, text)`` rows; one entry per window length."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, dict[str, None]]]] = {}
    for item, text in items:
        data, offsets = buffers(pa.array([text], pa.string()))
        starts, ends, _ = words(data, offsets, letters_and_digits())
        if not len(starts):
            continue
        raw = data.tobytes().lower()
        parts = [raw[a:b] for a, b in zip(starts, ends)]
        h = word_hashes(data, starts, ends)
        m = min(size, len(parts))
        for i in range(len(parts) - m + 1):
            window = by_length.setdefault(m, {}).setdefault(b" ".join(parts[i : i + m]), (h[i : i + m], {}))
            window[1][item] = None
    return [_tables(m, windows) for m, windows in sorted(by_length.items())]


def _tables(m: int, windows: dict) -> Patterns:
    hashes = np.array([h for h, _ in windows.values()], np.uint64)
    block = min(2, m)
    shift = np.full(TABLE, m - block + 1, np.uint8 if m < 250 else np.int32)
    for end in range(block - 1, m):
        keys = _pairs(hashes.T, np.array([end]), block)[0] if m > 1 else mix(hashes[:, 0])
        np.minimum.at(shift, (keys % np.uint64(TABLE)).astype(np.int64), m - 1 - end)
    last = _pairs(hashes.T, np.array([m - 1]), block)[0] if m > 1 else mix(hashes[:, 0])
    order = np.argsort(last, kind="stable")
    return Patterns(m, shift, last[order], order, hashes, list(windows), [list(i) for _, i in windows.values()])


def find(
    p: Patterns, h: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """End position and window number of every occurrence by word hashes.

    ``first`` has the bounds of the rows' words; occurrences do not cross them.
    """
    m, block = p.length, min(2, p.length)
    cursors, stops = [], []
    begin, end = first[:-1] + m - 1, first[1:]
    n = np.maximum(0, -(-(end - begin) // SEGMENT))
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[row] + step * SEGMENT
    stop = np.minimum(at + SEGMENT, end[row])
    while len(at):
        jump = p.shift[(_pairs(h, at, block) % np.uint64(TABLE)).astype(np.int64)].astype(np.int64)
        cursors.append(at[jump == 0])
        at = at + np.maximum(jump, 1)
        on = at < stop
        at, stop = at[on], stop[on]
    at = np.concatenate(cursors) if cursors else np.zeros(0, np.int64)
    if not len(at):
        return at, at
    key = _pairs(h, at, block)
    low, high = np.searchsorted(p.last_pair, key, "left"), np.searchsorted(p.last_pair, key, "right")
    n = high - low
    where = np.repeat(at, n)
    which = p.order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    for k in range(m):  # front to back: the first word rules most out
        same = h[where - m + 1 + k] == p.hashes[which, k]
        where, which = where[same], which[same]
    return where, which


def _search(tables: list[Patterns], text: str, hits: str, more: bool):
    """Append the column ``hits``; with ``more`` it is there already and is added to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, text):
            starts, ends, first = words(data, offsets, letters_and_digits())
            h = word_hashes(data, starts, ends)
            rows: dict[int, tuple[list, dict]] = {}
            if more:
                for i, old in enumerate(batch.column(hits).to_pylist()):
                    if old["items"]:
                        rows[i] = (list(zip(old["starts"], old["ends"])), dict.fromkeys(old["items"]))
            raw = None
            for p in tables:
                where, which = find(p, h, first)
                if not len(where):
                    continue
                raw = data.tobytes().lower() if raw is None else raw
                owner = np.searchsorted(first, where, "right") - 1
                for e, w, i in zip(where.tolist(), which.tolist(), owner.tolist()):
                    begin = e - p.length + 1
                    found = b" ".join(raw[a:b] for a, b in zip(starts[begin : e + 1], ends[begin : e + 1]))
                    if found == p.texts[w]:
                        spans, items = rows.setdefault(i, ([], {}))
                        spans.append((begin - int(first[i]), e + 1 - int(first[i])))
                        items.update(dict.fromkeys(p.items[w]))
            yield _with_hits(batch, hits, np.diff(first), rows)

    return run


def _with_hits(batch: pa.RecordBatch, hits: str, n_words: np.ndarray, rows: dict) -> pa.RecordBatch:
    starts, ends, items = [], [], []
    for i in range(batch.num_rows):
        spans, names = rows.get(i, ((), ()))
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        starts.append([a for a, _ in merged])
        ends.append([b for _, b in merged])
        items.append(sorted(names))
    column = pa.StructArray.from_arrays(
        [
            pa.array(n_words.astype(np.int64)),
            pa.array(starts, pa.list_(pa.int32())),
            pa.array(ends, pa.list_(pa.int32())),
            pa.array(items, pa.list_(pa.string())),
        ],
        ["n_words", "starts", "ends", "items"],
    )
    names = [n for n in batch.schema.names if n != hits]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], column], [*names, hits])


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    block_words: int = 200_000,
) -> DataFrame:
    """``docs`` under the names c0, c1, ... with a column ``hits`` of what was found.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased. A window is ``size`` consecutive words of an item, or the whole of a
    shorter one. ``hits`` has the number of words, the word spans inside occurrences
    (merged, end exclusive) and the ids, as sorted strings, of the items that occur.

    Null, empty and wordless texts have no hits; items with a null id or without words are
    left out; repeated items and rows are each reported. An empty benchmark finds nothing.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    out = docs.toDF(*names)
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).where("item is not null and text is not null")
    # The length in blanks bounds the number of words from above within a factor of two.
    weight = F.length("text") / 2 + 1
    total = items.agg(F.sum(weight)).first()[0] or 0
    blocks = max(1, -int(-total // (3 * block_words)))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        tables = build_patterns([(r["item"], r["text"]) for r in part.collect()], size)
        schema = ", ".join(f"{n} {t}" for n, t in out.dtypes if n != "hits") + f", hits {HITS}"
        out = out.mapInArrow(_search(tables, text, "hits", block > 0), schema)
    return out


def report(hits: Column | str = "hits") -> list[Column]:
    """``n_words, n_hit, n_items, items_sha256, contaminated`` from a ``hits`` column."""
    h = F.col(hits) if isinstance(hits, str) else hits
    total = lambda a: F.aggregate(h[a], F.lit(0).cast("bigint"), lambda s, x: s + x)
    n_hit = total("ends") - total("starts")
    return [
        h["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(h["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    ]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: the id and the columns of :func:`report`."""
    key = f"c{docs.columns.index(id_col)}"
    return with_hits(docs, benchmark, **options).select(F.col(key).alias(id_col), *report())


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns."""
    names = docs.columns
    found = with_hits(docs, benchmark, **options)
    return found.where(F.size("hits.items") == 0).drop("hits").toDF(*names)
