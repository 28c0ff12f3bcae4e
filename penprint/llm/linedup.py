"""Near-duplicate lines across documents, by an exact set-similarity join.

A line is its set of words (blank-separated, A-Z lower-cased). Two lines match when the
Jaccard similarity of their sets reaches the threshold, and a line is removed when any
earlier line matches it. Earlier means a smaller document id, then a smaller line number.

1. Word frequencies over all lines are counted in a hashed table of fixed size, which
   gives one global order from rare to frequent. Any fixed order keeps the join exact.
2. Every line sends its prefix, the ``n - ceil(t * n) + 1`` rarest words, to the words'
   buckets. Two lines that match share a word there.
3. A bucket is read in order of line length. Pairs pass a length filter, a positional
   filter and a bound on the overlap from parity signatures; none of these loses
   a match. Repeats of one line, by hashes of its set, refer to the first of them.
4. What remains is compared on the real words.

In each bucket a line proposes its ``FIRST`` closest earlier partners at first. Lines that
are still unmatched after the comparison, and had more, meet their whole bucket in a second
round, in cells of bounded size that compare full sets and emit only the lines that match.
So large groups of near copies cost a few pairs per line and nothing is lost.

A bucket of more than ``HOT`` rows is streamed in runs of ``RUN`` rows that are compared
within themselves. Its lines that are then still unmatched meet all its lines in cells, a
block of open lines against a block of members, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .bytetext import (
    blank_separated,
    buffers,
    mix,
    slices,
    whole_groups,
    word_hashes,
    words,
)

COUNTERS = 1 << 22
FIRST, SMALL, BLOCK = 4, 1024, 512
HOT, RUN, CELL = 1 << 15, 2048, 1 << 14
CHUNK, POOL = 200_000, 1_000_000
_TOKEN_BITS, _LEVEL_BITS = 38, 6
_SALT = np.uint64(0x8CB92BA72F3D8DD7)
# A bucket's row: ``shape`` packs the line's size, the word's place in it and some bits of
# the set's hash. ``sig`` is the set's 64-bit parity. ``proof`` is half of a 128-bit parity
# for lines of more than ``LONG`` words; for others the set's hash, with the rarest word only.
# A negative shape marks a repeat of the line (``sig``, ``proof``) = (id, line).
LONG = 100
_PLACE_BITS, _HASH_BITS = 22, 17
ENTRY = "token int, shape bigint, sig bigint, proof bigint, id bigint, line int"
# A proposed pair; without ``y`` a member of a bucket in which a line had more partners, or,
# with ``shape``, a row of a bucket that was cut into runs.
PAIR = (
    "x_id bigint, x_line int, y_id bigint, y_line int, same boolean, more boolean, token int, "
    "shape bigint, sig bigint, proof bigint"
)


# --- lines as sets of word hashes --------------------------------------------------


def line_words(data: np.ndarray, offsets: np.ndarray):
    """Words by line: ``(row, line, tokens, group)``.

    ``row`` and ``line`` (counted from 0 within the row) are given per line that has words;
    ``tokens`` are the words' hashes in the order of the text, ``group`` numbers their lines.
    """
    starts, ends, first = words(data, offsets, blank_separated())
    empty = np.zeros(0, np.int64)
    if not len(starts):
        return empty, empty, np.zeros(0, np.uint64), empty
    breaks = np.flatnonzero(data == 10)
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    number = np.searchsorted(breaks, starts)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (number[1:] != number[:-1]) | (row_of[1:] != row_of[:-1])
    group = np.cumsum(fresh) - 1
    row = row_of[fresh]
    line = number[fresh] - np.searchsorted(breaks, offsets[row])
    return row, line, _tokens(word_hashes(data, starts, ends)), group


def _tokens(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - _TOKEN_BITS)


def rarest_first(tokens: np.ndarray, group: np.ndarray, levels: np.ndarray):
    """Distinct tokens of each line from rare to frequent, with the numbers of their lines."""
    level = levels[_counter(tokens)].astype(np.uint64)
    token_bits, level_bits = np.uint64(_TOKEN_BITS), np.uint64(_TOKEN_BITS + _LEVEL_BITS)
    if group[-1] < 1 << (64 - _TOKEN_BITS - _LEVEL_BITS):  # all in one sort key
        key = (group.astype(np.uint64) << level_bits) | (level << token_bits) | tokens
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        low = np.uint64((1 << _TOKEN_BITS) - 1)
        return key & low, (key >> level_bits).astype(np.int64)
    order = np.lexsort((tokens, level, group))
    tokens, group = tokens[order], group[order]
    keep = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (group[1:] != group[:-1])])
    return tokens[keep], group[keep]


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def overlap_needed(n_x, n_y, percent: int):
    """Least common words of two sets that match: ceil(t / (1 + t) * (n_x + n_y))."""
    return -(-percent * (n_x + n_y) // (100 + percent))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    held, size = [], 0

    def settle() -> None:
        nonlocal held, size
        if held:
            counts[:] += np.bincount(np.concatenate(held), minlength=COUNTERS)
        held, size = [], 0

    for _, data, offsets in slices(batches):
        starts, ends, _ = words(data, offsets, blank_separated())
        held.append(_counter(_tokens(word_hashes(data, starts, ends))))
        size += len(starts)
        if size > COUNTERS:
            settle()
    settle()
    used = np.flatnonzero(counts)
    for at in range(0, len(used), CHUNK):
        part = used[at : at + CHUNK]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(counts[part])], ["bucket", "count"]
        )


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


def rarity_levels(texts: DataFrame) -> np.ndarray:
    """Log-scaled word frequency by hash bucket; its size does not depend on the corpus."""
    totals = (
        texts.select("text")
        .mapInArrow(_counts, "bucket int, count bigint")
        .groupBy("bucket")
        .agg(F.sum("count").alias("count"))
        .select("bucket", F.floor(2 * F.log2("count")).cast("int").alias("level"))
    ).toArrow()
    levels = np.zeros(COUNTERS, np.uint8)
    levels[totals["bucket"].to_numpy()] = totals["level"].to_numpy()
    return levels


def _shape(n: np.ndarray, pos: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (n << (_PLACE_BITS + _HASH_BITS)) | (pos << _HASH_BITS) | part


def _entries(levels: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            row, line, tokens, group = line_words(data, offsets)
            if not len(row):
                continue
            tokens, group = rarest_first(tokens, group, levels)
            n = np.bincount(group, minlength=len(row))
            begin = np.concatenate([[0], np.cumsum(n)])[:-1]
            mixed = mix(tokens)
            bit = mix(tokens ^ _SALT) >> np.uint64(57)
            one = np.uint64(1) << (bit & np.uint64(63))
            folded = np.bitwise_xor.reduceat(one, begin)
            upper = np.bitwise_xor.reduceat(np.where(bit > 63, one, np.uint64(0)), begin)
            whole = mix(np.add.reduceat(mixed, begin) ^ np.add.reduceat(mix(mixed ^ _SALT), begin))
            sig, long_ = folded.view(np.int64), n > LONG
            proof = np.where(long_, upper, whole).view(np.int64)
            part = (whole & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[row]
            # Repeats within the slice name its first such line and send one row each; the
            # same line of a row that repeats the id is that line and sends nothing.
            order = np.lexsort((line, ids, whole, sig, n))
            same = np.zeros(len(order), bool)
            same[1:] = np.logical_and.reduce(
                [v[order][1:] == v[order][:-1] for v in (whole, sig, n)]
            )
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            again, first = order[same], order[head[same]]
            other = (ids[again] != ids[first]) | (line[again] != line[first])
            again, first = again[other], first[other]
            lead = np.zeros(len(row), bool)
            lead[order[~same]] = True
            # Prefixes of the others.
            pos = np.arange(len(group)) - begin[group]
            keep = lead[group] & (pos < prefix_length(n, percent)[group])
            tokens, group, pos = tokens[keep], group[keep], pos[keep]
            short = tokens.astype(np.uint32).view(np.int32)
            scatter = mix(np.arange(len(again), dtype=np.uint64) + np.uint64(len(tokens))).astype(np.uint32)
            columns = [
                (short, scatter.view(np.int32), np.int32),
                (_shape(n[group], pos, part[group]), np.full(len(again), -1), np.int64),
                (sig[group], ids[first], np.int64),
                (np.where(long_[group] | (pos == 0), proof[group], 0), line[first], np.int64),
                (ids[group], ids[again], np.int64),
                (line[group], line[again], np.int32),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, b]).astype(t)) for a, b, t in columns],
                ["token", "shape", "sig", "proof", "id", "line"],
            )

    return run


# --- buckets -----------------------------------------------------------------------

Rows = dict[str, np.ndarray]


def _differ(c: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A lower bound on how many words only one of two lines has.

    Words that both have cancel out in the exclusive or of the parities.
    """
    sig = (c["sig"][i] ^ c["sig"][j]).view(np.uint64)
    bound = np.bitwise_count(sig).astype(np.int64)
    both = np.flatnonzero((c["n"][i] > LONG) & (c["n"][j] > LONG))
    if len(both):
        upper = (c["proof"][i[both]] ^ c["proof"][j[both]]).view(np.uint64)
        bound[both] = np.bitwise_count(upper) + np.bitwise_count(sig[both] ^ upper)
    return bound


def _passes(c: Rows, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs pass the positional and the parity filter."""
    n_i, n_j = c["n"][i], c["n"][j]
    need = overlap_needed(n_i, n_j, percent)
    ok = np.flatnonzero(np.minimum(n_i - c["pos"][i], n_j - c["pos"][j]) >= need)
    out = np.zeros(len(i), bool)
    out[ok] = _differ(c, i[ok], j[ok]) <= (n_i + n_j - 2 * need)[ok]
    return out


def _directed(c: Rows, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The later line of each pair first; pairs of one line with itself are left out."""
    same = c["id"][i] == c["id"][j]
    apart = ~same | (c["line"][i] != c["line"][j])
    i, j, same = i[apart], j[apart], same[apart]
    later = (c["id"][i] > c["id"][j]) | (same & (c["line"][i] > c["line"][j]))
    return np.where(later, i, j), np.where(later, j, i)


class _Closest:
    """The ``FIRST`` closest earlier partners of each line, and how many there were."""

    def __init__(self, c: Rows):
        self.c, self.size = c, 0
        self.count = np.zeros(len(c["token"]), np.int64)
        self.pool: list[tuple] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        x, y = _directed(self.c, i, j)
        np.add.at(self.count, x, 1)
        self.pool.append((x, y, _differ(self.c, x, y)))
        self.size += len(x)
        if self.size > POOL:
            self.shrink()

    def shrink(self) -> None:
        x, y, gap = (np.concatenate(v) for v in zip(*self.pool))
        order = np.lexsort((y, gap, x))
        x, y, gap = x[order], y[order], gap[order]
        keep = np.arange(len(x)) - np.searchsorted(x, x) < FIRST
        self.pool = [(x[keep], y[keep], gap[keep])]
        self.size = int(keep.sum())

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pool:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.shrink()
        return self.pool[0][:2]


def _bucket_pairs(c: Rows, percent: int, cut: bool) -> tuple[tuple, tuple, np.ndarray]:
    """Repeats, proposed pairs and rows of buckets that have more, as row numbers.

    Rows come by bucket in the order (token, shape, sig, id, line). Of a run of a ``cut``
    bucket all rows but repeats are given, and no pair is said to have more.
    """
    # Repeats of a line: one pair with the first of them, which stands for all.
    same = np.zeros(len(c["token"]), bool)
    same[1:] = np.logical_and.reduce(
        [c[k][1:] == c[k][:-1] for k in ("token", "shape", "sig", "proof")]
    )
    at = np.arange(len(same))
    head = np.maximum.accumulate(np.where(same, 0, at))
    again = at[same & (c["pos"] == 0)]
    repeats = _directed(c, again, head[again])
    # Buckets of one line have no pair.
    keep = single = at[~same]
    token = c["token"][keep]
    alone = np.ones(len(keep), bool)
    alone[1:] &= token[1:] != token[:-1]
    alone[:-1] &= token[:-1] != token[1:]
    keep, token, closest = keep[~alone], token[~alone], _Closest(c)
    end = np.searchsorted(token, token, "right")
    start = np.searchsorted(token, token, "left")
    large = end - start > SMALL
    n = c["n"][keep]
    i, lag = np.flatnonzero(~large), 1
    # Lines of a bucket come by size, so a line is done at the first that is too long.
    while len(i := i[i + lag < end[i]]) and len(i := i[100 * n[i] >= percent * n[i + lag]]):
        ok = _passes(c, keep[i], keep[i + lag], percent)
        closest.add(keep[i[ok]], keep[i[ok] + lag])
        lag += 1
    for low in np.unique(start[large]).tolist():
        rows = keep[low : end[low]]
        size = c["n"][rows]
        begin = np.searchsorted(100 * size, percent * size)
        for k in range(1, len(rows)):
            here, earlier = np.full(k - begin[k], rows[k]), rows[begin[k] : k]
            ok = _passes(c, here, earlier, percent)
            if ok.any():
                closest.add(here[ok], earlier[ok])
    x, y = closest.best()
    if cut:
        return repeats, (x, y, np.zeros(len(x), bool)), single
    crowded = np.unique(c["token"][closest.count > FIRST])
    members = keep[np.isin(token, crowded)]
    return repeats, (x, y, closest.count[x] > FIRST), members


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Whole buckets, many at a time, and runs of buckets of more than ``HOT`` rows (True)."""
    held: list[pa.RecordBatch] = []  # the last bucket as far as it came
    size, last, cut = 0, None, False

    def grow(part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, bool]]:
        nonlocal held, size, cut
        held.append(part)
        size += part.num_rows
        cut = cut or size > HOT
        if cut and size >= RUN:
            rows = pa.concat_batches(held)
            whole = size - size % RUN
            for at in range(0, whole, RUN):
                yield rows.slice(at, RUN), True
            held, size = [rows.slice(whole)], size - whole

    def done() -> Iterator[tuple[pa.RecordBatch, bool]]:
        nonlocal held, size, cut
        if size:
            yield pa.concat_batches(held), cut
        held, size, cut = [], 0, False

    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column("token").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(token[1:] != token[:-1]) + 1
        # Buckets that end in this batch go together, but for the first and for large ones.
        own = [0, *edges[: 1 if token[0] == last else 0].tolist()]
        for a, b in zip(edges, edges[1:]):
            if b - a > HOT:
                own += [int(a), int(b)]
        own += [*edges[-1:].tolist(), batch.num_rows]
        bounds = sorted(set(own))
        for a, b in zip(bounds, bounds[1:]):
            if token[a] != last:
                yield from done()
            last = token[b - 1]
            if token[a] == last:
                yield from grow(batch.slice(a, b - a))
            else:
                yield batch.slice(a, b - a), False
    yield from done()


def _buckets(percent: int):
    names = ["token", "shape", "sig", "proof", "id", "line"]

    def pairs(parts: list[pa.RecordBatch], cut: bool = False) -> Iterator[pa.RecordBatch]:
        batch = pa.concat_batches(parts)
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        gone = c["shape"] < 0
        yield _pair_batch(c["id"][gone], c["line"][gone], c["sig"][gone], c["proof"][gone], True, False, c["token"][gone])
        c = {k: v[~gone] for k, v in c.items()}
        _unpack(c)
        if not len(c["n"]):
            return
        at = lambda rows: (c["id"][rows], c["line"][rows])
        (again, first), (x, y, more), members = _bucket_pairs(c, percent, cut)
        yield _pair_batch(*at(again), *at(first), True, False, c["token"][again])
        yield _pair_batch(*at(x), *at(y), False, more, c["token"][x])
        entry = [c[k][members] for k in ("shape", "sig", "proof")] if cut else None
        yield _pair_batch(*at(members), None, None, False, False, c["token"][members], entry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch, cut in _runs(batches):
            if cut:
                yield from pairs([batch], True)
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield from pairs(held)
                held, size = [], 0
        if held:
            yield from pairs(held)

    return run


def _unpack(c: Rows) -> None:
    c["n"] = c["shape"] >> (_PLACE_BITS + _HASH_BITS)
    c["pos"] = (c["shape"] >> _HASH_BITS) & ((1 << _PLACE_BITS) - 1)


def _pair_batch(x_id, x_line, y_id, y_line, same, more, token, entry=None) -> pa.RecordBatch:
    size = len(x_id)
    none = y_id is None
    return pa.RecordBatch.from_arrays(
        [
            pa.array(x_id),
            pa.array(x_line),
            pa.nulls(size, pa.int64()) if none else pa.array(y_id),
            pa.nulls(size, pa.int32()) if none else pa.array(y_line.astype(np.int32)),
            pa.array(np.broadcast_to(same, size)),
            pa.array(np.broadcast_to(more, size)),
            pa.array(token),
            *(map(pa.array, entry) if entry else [pa.nulls(size, pa.int64())] * 3),
        ],
        ["x_id", "x_line", "y_id", "y_line", "same", "more", "token", "shape", "sig", "proof"],
    )


def _cell_pairs(percent: int):
    """Of each cell, the ``FIRST`` closest earlier members of the open lines."""
    names = ["cell", "token", "shape", "sig", "proof", "id", "line", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "cell"):
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            _unpack(c)
            begin = np.flatnonzero(np.concatenate([[True], c["cell"][1:] != c["cell"][:-1]]))
            for low, high in zip(begin, [*begin[1:], batch.num_rows]):
                rows = np.arange(low, high)
                members, size = rows[~c["open"][low:high]], c["n"][rows[~c["open"][low:high]]]
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
                for k in rows[c["open"][low:high]]:
                    n = c["n"][k]
                    y = members[np.searchsorted(100 * size, percent * n) : np.searchsorted(percent * size, 100 * n, "right")]
                    y = y[(c["id"][y] < c["id"][k]) | ((c["id"][y] == c["id"][k]) & (c["line"][y] < c["line"][k]))]
                    x = np.full(len(y), k)
                    ok = _passes(c, x, y, percent)
                    x, y = x[ok], y[ok]
                    best = np.argsort(_differ(c, x, y), kind="stable")[:FIRST]
                    found.append((x[best], y[best], np.full(len(best), len(y) > FIRST)))
                x, y, more = (np.concatenate(v) for v in zip(*found))
                at = lambda rows: (c["id"][rows], c["line"][rows])
                yield _pair_batch(*at(x), *at(y), False, more, c["token"][x])

    return run


# --- verification ------------------------------------------------------------------


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None  # rows that repeat an id come one after another and are read once
    for batch, _, _ in slices(batches):
        keys, numbers, found = [], [], []
        for key, text, lines in zip(*(batch.column(k).to_pylist() for k in ("id", "text", "lines"))):
            if key == last:
                continue
            last = key
            parts = text.split("\n")
            wanted = [k for k in lines if k < len(parts)]
            keys += [key] * len(wanted)
            numbers += wanted
            found += [parts[k] for k in wanted]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(found, pa.string())],
            ["id", "line", "words"],
        )


def _word_set(line: str) -> set[bytes]:
    # bytes.split() and bytes.lower() know exactly these blanks and A-Z
    return set(line.encode().lower().split())


def _matching(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, b = [], None, set()
            for x, y in zip(batch.column("x_words").to_pylist(), batch.column("y_words").to_pylist()):
                if y != last:
                    last, b = y, _word_set(y)
                a = _word_set(x)
                both = len(a & b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both) and both > 0)
            yield batch.select(["x_id", "x_line", "y_id", "y_line"]).filter(pa.array(keep, pa.bool_()))

    return run


def _lines_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The words of the lines ``(id, line)``."""
    wanted = members.groupBy("id").agg(F.collect_set("line").alias("lines"))
    return (
        texts.join(wanted.hint("merge"), "id")
        .select("id", "text", "lines")
        .mapInArrow(_fetch, "id bigint, line int, words string")
    )


def _verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The later lines of the pairs that match."""
    side = lambda s: lines.select(
        F.col("id").alias(f"{s}_id"), F.col("line").alias(f"{s}_line"), F.col("words").alias(f"{s}_words")
    )
    return (
        pairs.select("x_id", "x_line", "y_id", "y_line")
        .distinct()
        .join(side("x"), ["x_id", "x_line"])
        .join(side("y"), ["y_id", "y_line"])
        .select("x_id", "x_line", "y_id", "y_line", "x_words", "y_words")
        .mapInArrow(_matching(percent), "x_id bigint, x_line int, y_id bigint, y_line int")
        .select("x_id", "x_line")
    )


def _cell_matches(percent: int):
    """Of each cell, the open lines that an earlier line of the cell matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "cell"):
            data, offsets = buffers(batch.column("words"))
            starts, ends, first = words(data, offsets, blank_separated())
            hashes = word_hashes(data, starts, ends)
            sets = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]
            size = np.array([len(x) for x in sets])
            cell, ids, line, open_ = (
                batch.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "id", "line", "open")
            )
            hit = np.zeros(len(ids), bool)
            begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            for low, high in zip(begin, [*begin[1:], len(cell)]):
                _, code = np.unique(np.concatenate(sets[low:high]), return_inverse=True)
                at = np.concatenate([[0], np.cumsum(size[low:high])])
                has = np.zeros(code.max() + 1, np.int32)
                for k in np.flatnonzero(open_[low:high]):
                    mine = code[at[k] : at[k + 1]]
                    has[mine] = 1
                    common = np.add.reduceat(has[code], at[:-1])
                    has[mine] = 0
                    x = low + k
                    before = (ids[low:high] < ids[x]) | ((ids[low:high] == ids[x]) & (line[low:high] < line[x]))
                    hit[x] = (before & (100 * common >= percent * (size[x] + size[low:high] - common))).any()
            yield batch.select(["id", "line"]).filter(pa.array(hit))

    return run


def _cells(members: DataFrame, open_: DataFrame, block: int) -> DataFrame:
    """``cell`` and ``open`` beside the rows: a block of open lines against one of members."""
    sizes = (
        members.groupBy("token")
        .agg(F.ceil(F.count("*") / block).alias("blocks"))
        .join(open_.groupBy("token").agg(F.ceil(F.count("*") / block).alias("opens")), "token")
    )
    kept = members.columns

    def placed(rows: DataFrame, own: str, other: str, is_open: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "line"), F.col(own))
        theirs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias("theirs")
        pair = (F.col("mine"), F.col("theirs")) if is_open else (F.col("theirs"), F.col("mine"))
        return (
            rows.join(sizes, "token")
            .select(*kept, mine.alias("mine"), theirs)
            .select(*kept, F.xxhash64("token", *pair).alias("cell"), F.lit(is_open).alias("open"))
        )

    return placed(members, "blocks", "opens", False).union(placed(open_, "opens", "blocks", True))


def _second_round(members: DataFrame, open_: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Open lines ``(id, line, token)`` that an earlier member ``(id, line, token)`` of their
    bucket matches. Cells are a block of open lines against a block of members."""
    cells = _cells(members, open_, BLOCK).select("id", "line", "cell", "open")
    return (
        cells.join(lines, ["id", "line"])
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_cell_matches(percent), "id bigint, line int")
    )


def _cut_round(hot: DataFrame, removed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Lines of buckets cut into runs that are not yet removed and that an earlier line of
    their whole bucket matches. ``hot`` has the buckets' rows."""
    open_ = materialize(hot.join(removed, ["id", "line"], "left_anti").select(*hot.columns))
    near = materialize(
        _cells(hot, open_, CELL)
        .repartition("cell")
        .sortWithinPartitions("cell", "shape")
        .mapInArrow(_cell_pairs(percent), PAIR)
    )
    side = lambda s: near.select(F.col(f"{s}_id").alias("id"), F.col(f"{s}_line").alias("line"))
    lines = materialize(_lines_of(side("x").union(side("y")), texts))
    found = materialize(_verified(near, lines, percent).distinct().toDF("id", "line"))
    rest = materialize(
        near.where("more")
        .select(F.col("x_id").alias("id"), F.col("x_line").alias("line"), "token")
        .distinct()
        .join(found, ["id", "line"], "left_anti")
    )
    if rest.isEmpty():
        return found
    members = materialize(hot.select("id", "line", "token").join(rest.select("token").distinct(), "token", "left_semi"))
    words_of = materialize(_lines_of(members, texts))
    again = _second_round(members.select("id", "line", "token"), rest, words_of, percent)
    return materialize(found.union(again).distinct())


# --- the operator ------------------------------------------------------------------


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80
) -> DataFrame:
    """``(id, line)``: the lines (from 0, cut at each newline) that an earlier line matches.

    Lines without words match nothing. Rows with a null id or text take no part. Rows that
    repeat an id count as one document, so they do not remove each other's lines.
    """
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")
    ).where("id is not null and text is not null")
    levels = rarity_levels(texts)
    proposed = materialize(
        texts.mapInArrow(_entries(levels, percent), ENTRY)
        .repartition("token")
        .sortWithinPartitions("token", "shape", "sig", "id", "line")
        .mapInArrow(_buckets(percent), PAIR)
    )
    # Lines of equal size, parity and set hash are repeats; the rest is compared on its words.
    near = proposed.where("y_id is not null and not same")
    members = proposed.where("y_id is null and shape is null").select(
        F.col("x_id").alias("id"), F.col("x_line").alias("line"), "token"
    )
    wanted = (
        near.select(F.col("x_id").alias("id"), F.col("x_line").alias("line"))
        .union(near.select("y_id", "y_line"))
        .union(members.select("id", "line"))
    )
    lines = materialize(_lines_of(wanted, texts))
    removed = materialize(
        proposed.where("same")
        .select("x_id", "x_line")
        .union(_verified(near, lines, percent))
        .distinct()
        .toDF("id", "line")
    )
    hot = proposed.where("shape is not null").select(
        "token", "shape", "sig", "proof", F.col("x_id").alias("id"), F.col("x_line").alias("line")
    )
    if not hot.isEmpty():
        removed = removed.union(_cut_round(hot, removed, texts, percent))
    open_ = materialize(
        near.where("more")
        .select(F.col("x_id").alias("id"), F.col("x_line").alias("line"), "token")
        .distinct()
        .join(removed, ["id", "line"], "left_anti")
    )
    if open_.isEmpty():
        return removed
    return removed.union(_second_round(members, open_, lines, percent)).distinct()


def removed_by_document(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``(id, lines)``: the removed line numbers of each document that has any."""
    return (
        repeated_lines(docs, id_col, text_col, percent)
        .groupBy("id")
        .agg(F.sort_array(F.collect_set("line")).alias("lines"))
    )


def line_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80
) -> DataFrame:
    """One row per input row: the id, ``n_lines``, ``n_removed`` and ``removed``.

    ``n_lines`` counts newline-separated pieces (a null text has none, an empty one has
    one); ``removed`` lists removed line numbers, comma-joined, empty if there are none.
    """
    lines = removed_by_document(docs, id_col, text_col, percent)
    breakless = F.replace(F.col(text_col), F.lit("\n"), F.lit(""))
    counted = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.octet_length(text_col) - F.octet_length(breakless) + 1, F.lit(0))
        .cast("bigint")
        .alias("n_lines"),
    )
    return counted.join(lines, "id", "left").select(
        F.col("id").alias(id_col),
        "n_lines",
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(F.col("lines").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


def without_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80
) -> DataFrame:
    """``docs`` with the removed lines cut out of the text; all columns and rows stay."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    lines = removed_by_document(docs, id_col, text_col, percent)
    joined = plain.join(
        lines.select(F.col("id").alias("_id"), F.col("lines").alias("_lines")),
        F.col(key).cast("bigint") == F.col("_id"),
        "left",
    )
    kept = F.array_join(
        F.filter(F.split(text, "\n"), lambda part, i: ~F.array_contains("_lines", i)), "\n"
    )
    cut = F.when(F.col("_lines").isNull(), F.col(text)).otherwise(kept)
    return joined.select(*[cut.alias(c) if c == text else c for c in plain.columns]).toDF(*names)
