"""Near-duplicate classes by HyperMinHash registers, banding and full-set confirmation.

1. A text becomes its set of word shingles. The set is sketched into registers: each
   bucket keeps its least hash as a leading-zero count and a few mantissa bits. Empty
   buckets borrow from a filled one along a fixed random order, so that two sets agree in
   a register with about their Jaccard similarity also when they are small.
2. Equal sets fall together by a 128-bit hash of the set; one representative goes on.
3. Bands of compressed registers are hashed; representatives that share a band are
   candidates. In a bucket only pairs with its least id are tried first, so a group of
   thousands of near copies gives thousands of pairs, not millions.
4. Pairs whose collision-corrected estimate lies far below the threshold are dropped
   (five standard deviations), the rest are confirmed on their full shingle sets.
5. Confirmed links join into classes. Buckets that still hold several classes are then
   tried between classes, in cells of bounded size, so no candidate is lost: a first pass
   over registers marks the members that have a likely partner, a second compares their
   full sets. Only confirmed links leave a cell, never its pairs.

With 40 bands of 5 registers a pair at similarity 0.8 shares no band with probability
(1 - 0.8**5)**40, about 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .bytetext import (
    blank_separated,
    mix,
    shingles,
    slices,
    whole_groups,
    word_hashes,
    words,
)
from .components import components

MANTISSA = 10
EMPTY = 0xFFFF
BLOCK = 512
_SECOND = np.uint64(0xA0761D6478BD642F)
_THIRD = np.uint64(0xE7037ED1A0B428DB)


# --- sketches ----------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    starts, ends, first = words(data, offsets, blank_separated())
    h = word_hashes(data, starts, ends)
    return [
        np.unique(shingles(h[first[i] : first[i + 1]], size)) for i in range(len(offsets) - 1)
    ]


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and mantissa (10 bits) of each bucket's least hash."""
    _, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint64)
    rest = least << (zeros + np.uint64(1))
    return ((zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def _borrow_order(m: int) -> np.ndarray:
    """For each bucket, the order in which an empty one looks at the others."""
    keys = mix(np.arange(m * m, dtype=np.uint64) + np.uint64(m))
    return np.argsort(keys.reshape(m, m), axis=1).T.copy()


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of ``m`` registers per set; rows of empty sets stay empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    bucket = ((flat >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    at = np.repeat(np.arange(len(sets)) * m, sizes) + bucket.astype(np.int64)
    np.minimum.at(least, at, mix(flat ^ _SECOND) >> np.uint64(1))
    filled = np.zeros(len(least), bool)
    filled[at] = True
    own = np.where(filled, compress(least), EMPTY).astype(np.uint16).reshape(len(sets), m)
    out = own.copy()
    row, col = np.nonzero((own == EMPTY) & (sizes > 0)[:, None])
    for step in _borrow_order(m):
        if not len(row):
            break
        value = own[row, step[col]]
        hit = value != EMPTY
        out[row[hit], col[hit]] = value[hit]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(rows: np.ndarray, bands: int, width: int) -> np.ndarray:
    """One 64-bit key per band of ``width`` registers."""
    parts = rows[:, : bands * width].reshape(len(rows), bands, width).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _SECOND), parts.shape[:2])
    for k in range(width):
        key = mix(key * _THIRD + parts[:, :, k])
    return key


def collision_rate(n_a: np.ndarray, n_b: np.ndarray, m: int) -> np.ndarray:
    """How often registers of disjoint sets agree by chance.

    A bucket's least of k uniform hashes falls in the cell [x, x + w) with probability
    (1 - x)**k - (1 - x - w)**k; within one leading-zero count the 2**MANTISSA cells are
    taken at equal shares.
    """
    k_a, k_b = np.maximum(n_a / m, 1.0), np.maximum(n_b / m, 1.0)
    total = np.zeros(len(k_a))
    for zeros in range(1, 40):
        low, high = 2.0 ** -(zeros), 2.0 ** -(zeros - 1)
        in_a = (1 - low) ** k_a - (1 - high) ** k_a
        in_b = (1 - low) ** k_b - (1 - high) ** k_b
        total += in_a * in_b / 2**MANTISSA
    return total


def estimate(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int) -> np.ndarray:
    """Jaccard from the share of agreeing registers, corrected for chance collisions."""
    chance = collision_rate(n_a, n_b, m)
    return (agree - chance) / (1 - chance)


def plausible(agree, n_a, n_b, m: int, percent: int) -> np.ndarray:
    """False where sizes rule a match out, or the estimate lies far below the threshold.

    Far is five standard deviations; the second term allows for elements of small sets
    that fall into one bucket.
    """
    t = percent / 100
    crowding = np.minimum(1, m / (4 * np.maximum(np.minimum(n_a, n_b), 1)))
    slack = 5 * np.sqrt(t * (1 - t) / m + crowding / (2 * m))
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & (estimate(agree, n_a, n_b, m) >= t - slack)


# --- worker functions --------------------------------------------------------------


def _sketch(size: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            sets = shingle_sets(data, offsets, size)
            rows = registers(sets, m)
            with np.errstate(over="ignore"):
                keys = [
                    [(mix(s ^ c).sum(dtype=np.uint64)) for s in sets] for c in (_SECOND, _THIRD)
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *[pa.array(np.array(k, np.uint64).view(np.int64)) for k in keys],
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                ["id", "n", "key_a", "key_b", "registers"],
            )

    return run


def _unpack(column: pa.Array, m: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(len(column), m)


def _bands(bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_unpack(batch.column("registers"), bands * width), bands, width)
            every = np.repeat(np.arange(batch.num_rows), bands)
            others = [c for c in batch.schema.names if c != "registers"]
            number = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.reshape(-1).view(np.int64)),
                    pa.array(number),
                    *[batch.column(c).take(pa.array(every)) for c in others],
                ],
                ["key", "band", *others],
            )

    return run


def _likely(m: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_unpack(batch.column("r_a"), m) == _unpack(batch.column("r_b"), m)).mean(axis=1)
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            keep = pa.array(plausible(agree, n_a, n_b, m, percent))
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            sets = shingle_sets(data, offsets, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["id", "shingles"],
            )

    return run


def _confirm(percent: int):
    """Keep pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("s_a"), batch.column("s_b")):
                left, right = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = np.concatenate([left, right])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _meet(side: np.ndarray, component: np.ndarray, i, j) -> np.ndarray:
    """Side 0 meets side 1; side 2, a block with itself, meets its own kind."""
    return (component[i] != component[j]) & ((side[i] != side[j]) | (side[i] == 2))


def _mark(bands: int, width: int, percent: int):
    """Of each cell, the members that have a likely partner in another class.

    A pair counts in the first band that it shares, not in every one.
    """
    m = bands * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "cell"):
            rows = _unpack(batch.column("registers"), m)
            cell, side, component, n, band = (
                batch.column(c).to_numpy(zero_copy_only=False)
                for c in ("cell", "side", "component", "n", "band")
            )
            end = np.searchsorted(cell, cell, "right")
            marked = np.zeros(len(cell), bool)
            i, lag = np.arange(len(cell)), 1
            while len(i := i[i + lag < end[i]]):
                at = i[_meet(side, component, i, i + lag)]
                for part in np.array_split(at, len(at) // 4096 + 1):
                    agree = rows[part] == rows[part + lag]
                    shared = agree.reshape(len(part), bands, width).all(axis=2).argmax(axis=1)
                    likely = plausible(agree.mean(axis=1), n[part], n[part + lag], m, percent)
                    ok = part[likely & (shared == band[part])]
                    marked[ok] = marked[ok + lag] = True
                lag += 1
            yield batch.select(["cell", "side", "id", "component"]).filter(pa.array(marked))

    return run


def _between(percent: int):
    """Confirmed links between classes within each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "cell"):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles")]
            cell, side, ids, component = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side", "id", "component")
            )
            size = np.array([len(s) for s in sets])
            left, right = [], []
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            for start, stop in zip(starts, [*starts[1:], len(cell)]):
                _, code = np.unique(np.concatenate(sets[start:stop]), return_inverse=True)
                at = np.concatenate([[0], np.cumsum(size[start:stop])])
                has = np.zeros(code.max() + 1, np.int32)
                for k in range(stop - start - 1):
                    rest = np.arange(start + k + 1, stop)
                    if not _meet(side, component, start + k, rest).any():
                        continue
                    has[code[at[k] : at[k + 1]]] = 1
                    common = np.add.reduceat(has[code[at[k + 1] :]], at[k + 1 : -1] - at[k + 1])
                    has[code[at[k] : at[k + 1]]] = 0
                    union = size[start + k] + size[rest] - common
                    ok = rest[
                        (100 * common >= percent * union) & _meet(side, component, start + k, rest)
                    ]
                    left.append(np.full(len(ok), ids[start + k]))
                    right.append(ids[ok])
            if left:
                pair = [np.concatenate(left), np.concatenate(right)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(*pair)), pa.array(np.maximum(*pair))], ["a", "b"]
                )

    return run


# --- the operator ------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 5,
    percent: int = 80,
    bands: int = 40,
    width: int = 5,
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, one row per input row.

    Two texts are linked when 100 * |A and B| >= percent * |A or B| over their distinct
    shingles (words are lower-cased A-Z and blank-separated; a shorter text is one
    shingle). ``component_id`` is the least id reachable, ``kept`` marks that id's row.

    A null, empty or wordless text has an empty set, links with nothing and is kept. A row
    with a null id takes no part: its component is null and it is kept. Rows that repeat an
    id are each judged by their own text. Other columns, whatever their names, are ignored;
    an empty table gives an empty result.
    """
    m = bands * width
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")
    )
    sketches = materialize(
        texts.mapInArrow(
            _sketch(words_per_shingle, m),
            "id bigint, n bigint, key_a bigint, key_b bigint, registers binary",
        )
    )
    reps = materialize(
        sketches.where("n > 0 and id is not null")
        .groupBy("key_a", "key_b")
        .agg(F.min(F.struct("id", "n", "registers")).alias("first"))
        .select("key_a", "key_b", "first.*")
    )
    links = _links(texts, reps, words_per_shingle, percent, bands, width)
    by_class = reps.join(components(links), "id", "left").select(
        "key_a", "key_b", F.coalesce("component", "id").alias("component")
    )
    named = sketches.join(by_class, ["key_a", "key_b"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return named.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _links(
    texts: DataFrame, reps: DataFrame, size: int, percent: int, bands: int, width: int
) -> DataFrame:
    """Confirmed links ``(a, b)`` between representatives."""
    m = bands * width
    keyed = reps.select("id", "registers").mapInArrow(_bands(bands, width), "key bigint, band int, id bigint")
    leaders = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("most"))
    star = materialize(
        keyed.join(leaders.where("a < most"), "key")
        .where("id > a")
        .select("a", F.col("id").alias("b"))
        .distinct()
    )
    # The sets of all that share a bucket, made once. The corpus is on one side of this join,
    # so one plan is asked for at every size.
    shared = star.select(F.col("a").alias("id")).union(star.select("b")).distinct()
    candidates = materialize(
        texts.join(shared.hint("merge"), "id", "left_semi")
        .mapInArrow(_sets(size), "id bigint, shingles binary")
        .where("length(shingles) > 0")
    )
    likely = _pairs_with(star, reps, ["n", "registers"]).mapInArrow(
        _likely(m, percent), "a bigint, b bigint"
    )
    direct = materialize(
        _pairs_with(materialize(likely), candidates, ["shingles"])
        .mapInArrow(_confirm(percent), "a bigint, b bigint")
        .distinct()
    )
    labelled = (
        reps.join(shared, "id", "left_semi")
        .join(components(direct), "id", "left")
        .select("id", "n", "registers", F.coalesce("component", "id").alias("component"))
    )
    return direct.union(_cross_class(materialize(labelled), candidates, bands, width, percent))


def _pairs_with(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the columns of both members, named by first letter and side."""

    def side(name: str) -> DataFrame:
        return table.select(F.col("id").alias(name), *[F.col(c).alias(f"{c[0]}_{name}") for c in columns])

    wanted = [f"{c[0]}_{name}" for c in columns for name in "ab"]
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", *wanted)


def _cross_class(
    labelled: DataFrame, sets: DataFrame, bands: int, width: int, percent: int
) -> DataFrame:
    """Confirmed links between different classes that share a bucket.

    In a bucket the largest class meets only the others; the others also meet each other.
    Both are cut into blocks of about ``BLOCK`` rows by a hash of the id, and a cell is
    one block against another.
    """
    keyed = labelled.select("registers", "id", "component").mapInArrow(
        _bands(bands, width), "key bigint, band int, id bigint, component bigint"
    )
    sizes = keyed.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = (
        sizes.groupBy("key")
        .agg(
            F.max(F.struct("c", "component")).alias("top"),
            F.sum("c").alias("rows"),
            F.count("*").alias("classes"),
        )
        .where("classes > 1")
        .select(
            "key",
            F.col("top.component").alias("main"),
            F.ceil(F.col("top.c") / BLOCK).alias("mains"),
            F.ceil((F.col("rows") - F.col("top.c")) / BLOCK).alias("others"),
        )
    )
    rows = keyed.join(mixed, "key").select(
        "key", "band", "id", "component", "mains", "others",
        (F.col("component") == F.col("main")).alias("is_main"),
        F.pmod(F.xxhash64("id"), F.when(F.col("component") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).alias("block"),
    )
    block = F.col("block")

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1)

    def cell(kind: str, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("cell"), side.cast("int").alias("side"))

    with_others = F.transform(upto("others"), lambda j: cell("main", block, j, F.lit(0)))
    with_mains = F.transform(upto("mains"), lambda i: cell("main", i, block, F.lit(1)))
    among = F.transform(
        upto("others"),
        lambda j: cell(
            "others",
            F.least(block, j),
            F.greatest(block, j),
            F.when(j == block, 2).when(j > block, 0).otherwise(1),
        ),
    )
    cells = F.when(F.col("is_main"), with_others).otherwise(F.concat(with_mains, among))
    placed = rows.select("id", "band", "component", F.explode(cells).alias("p")).select(
        "id", "band", "component", "p.cell", "p.side"
    )
    marked = materialize(
        placed.join(labelled.select("id", "n", "registers"), "id")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_mark(bands, width, percent), "cell bigint, side int, id bigint, component bigint")
    )
    return (
        marked.join(sets, "id")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_between(percent), "a bigint, b bigint")
        .distinct()
    )
