"""Best-fit packing of tokenized documents into sequences, with large-item matching.

Lengths are whole numbers up to the capacity, so the packing is decided on their histogram,
whose size is the capacity, whatever the corpus. Pieces above a third of the capacity are
matched greedily, the longest with the longest that still fits, at most two to a sequence.
Smaller pieces then go, longest first, where they leave the smallest gap. The result is a
table of patterns; pieces find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .bytetext import slices

PIECES = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
SALTS = 64
Encode = Callable[[str], list[int]]


def byte_pair_encoder(
    ranks_file: str, pattern: str, special: dict[str, int] | None = None
) -> Callable[[], Encode]:
    """A maker of encoders for a rank file. ``special`` tokens get their id wherever a text
    holds them; all else is ordinary text."""
    special = special or {}
    key = (ranks_file, pattern, *sorted(special.items()))

    def make() -> Encode:
        import base64

        import tiktoken

        # Kept with the library, so that a worker builds it once and not for every task.
        made = vars(tiktoken).setdefault("_encodings_by_file", {})
        if key not in made:
            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            made[key] = tiktoken.Encoding(
                "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special
            )
        encoding = made[key]
        return lambda text: encoding.encode(text, allowed_special="all")

    return make


# --- pieces ------------------------------------------------------------------------


def _cut(make_encoder: Callable[[], Encode], end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch, _, _ in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                short = len(ids) % capacity
                cuts = [*([0] if short else []), *range(short, len(ids), capacity), len(ids)]
                for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    raw = ids[a:b].tobytes()
                    values = (key, number, a, b - a, zlib.crc32(raw), ids[a:b].tolist() if with_ids else None)
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            width = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out[:width], kinds)], names[:width]
            )

    return run


def token_pieces(
    docs: DataFrame,
    make_encoder: Callable[[], Encode],
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    capacity: int = 1024,
    with_ids: bool = False,
) -> DataFrame:
    """Token pieces of at most ``capacity``: ``(id, piece, start, length, ids_crc32[, ids])``.

    A document is its text's tokens and then ``end_id``; a null text has only that. A longer
    one is cut into full pieces, of which only the first may be shorter.
    """
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")
    )
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return texts.mapInArrow(_cut(make_encoder, end_id, capacity, with_ids), schema)


# --- packing on the histogram ------------------------------------------------------


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(how many sequences, their piece lengths)`` for a histogram of lengths.

    Open sequences of one content are handled together, so the work depends on the number
    of lengths and not on that of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    open_gaps: list[int] = []

    def add(many: int, content: tuple[int, ...]) -> None:
        gap = capacity - sum(content)
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append((many, content))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        many = left[longest]
        fits = bisect_left(large, capacity - longest + 1) - 1
        if fits < 0:
            add(many, (longest,))
            large.pop()
            continue
        partner = large[fits]
        pairs = many // 2 if partner == longest else min(many, left[partner])
        if partner == longest and many % 2 and fits == 0:
            add(1, (longest,))
        elif partner == longest and many % 2:
            add(1, (longest, large[fits - 1]))
            left[large[fits - 1]] -= 1
        if pairs:
            add(pairs, (longest, partner))
        left[longest] -= many if partner == longest else pairs
        if partner != longest:
            left[partner] -= pairs
        large = [n for n in large if left[n]]

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[length]
        while rest:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                per = capacity // length
                if rest >= per:
                    add(rest // per, (length,) * per)
                    rest %= per
                else:
                    add(1, (length,) * rest)
                    rest = 0
                continue
            gap = open_gaps[at]
            many, content = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            used = min(many, rest)
            if many > used:
                add(many - used, content)
            add(used, (*content, length))
            rest -= used
    return [entry for gap in open_gaps for entry in gaps[gap]]


def place_table(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their rank: runs of one rank per sequence."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for many, content in patterns:
        offset = 0
        for length in content:
            rank = used.get(length, 0)
            used[length] = rank + many
            rows.append((length, rank, sequence, offset))
            offset += length
        sequence += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def _place(table: dict[str, np.ndarray]):
    """Add ``sequence_id`` and ``offset`` to pieces that carry their rank."""
    bounds = {n: (np.searchsorted(table["length"], n), np.searchsorted(table["length"], n, "right"))
              for n in np.unique(table["length"]).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                low, high = bounds[n]
                mine = length == n
                at[mine] = low + np.searchsorted(table["rank"][low:high], rank[mine], "right") - 1
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(table["sequence"][at] + rank - table["rank"][at]),
                    pa.array(table["offset"][at]),
                ],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Ranks within a length are taken within (length, salt), on top of the counts of smaller
    salts, so a length that many pieces share is not one task's work. Pieces are written
    once, since their ranks must not change when a task is run again.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("id", "piece"), F.lit(SALTS)).cast("int"))
    salted = materialize(salted)
    # At most capacity * SALTS rows, whatever the corpus.
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).toArrow()
    table = sorted(zip(*(counts[c].to_pylist() for c in ("length", "_salt", "n"))))
    before, histogram = np.zeros((capacity + 1) * SALTS, np.int64), {}
    for length, salt, n in table:
        before[length * SALTS + salt] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    patterns = pack_lengths(histogram, capacity)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0  # rows come sorted by group
        for batch in batches:
            if not batch.num_rows:
                continue
            length, salt = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_salt")
            )
            group = length * SALTS + salt
            at = np.arange(len(group))
            fresh = np.concatenate([[group[0] != last], group[1:] != group[:-1]])
            within = at - np.maximum.accumulate(np.where(fresh, at, 0))
            if group[0] == last:
                within[group == last] += seen
            last, seen = int(group[-1]), int(within[-1]) + 1
            names = [c for c in batch.schema.names if c != "_salt"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(before[group] + within)], [*names, "rank"]
            )

    kept = ", ".join(f"{n} {t}" for n, t in salted.dtypes if n != "_salt")
    return (
        salted.repartition("length", "_salt")
        .sortWithinPartitions("length", "_salt", "id", "piece")
        .mapInArrow(ranks, kept + ", rank bigint")
        .mapInArrow(_place(place_table(patterns)), kept + ", sequence_id bigint, offset bigint")
    )


def pack_documents(
    docs: DataFrame,
    make_encoder: Callable[[], Encode],
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    capacity: int = 1024,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places, one row per piece.

    Every row gives at least one piece, a null or empty text one of the end token alone.
    Repeated rows are packed each; a null id stays null. Other columns are ignored, and an
    empty table gives no piece.
    """
    pieces = token_pieces(docs, make_encoder, id_col, text_col, end_id, capacity, with_ids)
    return pack(pieces, capacity).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: whole sequences, from pieces packed ``with_ids``.

    A group holds at most ``capacity`` tokens.
    """
    parts = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
