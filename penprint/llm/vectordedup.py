"""Near-duplicate embeddings by an inverted multi-index.

Each vector is cut into two halves; a k-means codebook of CENTROIDS entries is fitted on
each half from a bounded sample, which makes a grid of CENTROIDS^2 cells. Every distinct
vector is indexed in the cell of its two nearest centroids. For the search, each vector
visits its PROBES nearest cells in the order of a multi-sequence traversal (a heap over the
two sorted lists of centroid distances), and meets the vectors indexed there that share its
label. Candidates are verified by their cosine in double precision, so no link falls below
the threshold; recall against brute force is measured in the tests.

Exact copies are grouped before the index (one row per (label, vector)), so a group of
thousands of copies is one row there, and its inner links are counted from its size. Large
cells are compared block by block: both sides are dealt into blocks of at most BLOCK rows
and each pair of blocks is its own group, so no cell is one task's work. A block's vectors
and the visits to it come to one task in a run, and a matrix product compares them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .components import components
from .whitening import join_back

THRESHOLD = 0.93
CENTROIDS = 32
PROBES = 24
# The codebooks are fitted on at most this many distinct vectors (every vector is indexed).
SAMPLE = 20_000
BLOCK = 2_000
ITERATIONS = 25
CELL_TABLE_BYTES = 64 << 20
# More than a matrix product differs from a sum entry by entry.
_ROUNDING = 1e-9


def _clean(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows ``(vec_id, key)`` and the usable ones ``(vec_id, label, v, key)``.

    Usable: vec_id and label not null, the vector not null, all entries finite and not
    null, not all zero, and of the table's most common length (ties: the longer).
    """
    v = F.col("embedding")
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").alias("label"),
        F.transform(v, lambda c: c.cast("double")).alias("v"),
    )
    finite = F.forall(
        "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & finite & F.exists("v", lambda c: c != 0)
    )
    common = (
        rows.where(usable).groupBy(F.size("v").alias("d")).count()
        .orderBy(F.desc("count"), F.desc("d")).first()
    )
    dim = common["d"] if common else 0
    rows = rows.withColumn("ok", F.coalesce(usable & (F.size("v") == dim), F.lit(False)))
    good = rows.where("ok").select("vec_id", "label", "v", F.struct("label", "v").alias("key"))
    return rows, good


def _kmeans(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's k-means with k-means++ seeding on a bounded sample."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = [points[rng.integers(len(points))]]
    dist = ((points - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        total = dist.sum()
        pick = rng.integers(len(points)) if total <= 0 else rng.choice(len(points), p=dist / total)
        centres.append(points[pick])
        dist = np.minimum(dist, ((points - points[pick]) ** 2).sum(1))
    c = np.asarray(centres)
    for _ in range(ITERATIONS):
        near = ((points[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        for j in range(k):
            members = points[near == j]
            if len(members):
                c[j] = members.mean(0)
    return c


def fit_codebooks(groups: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS):
    """Two codebooks, one per half of the unit vectors, from at most ``sample`` groups.

    The sample is the groups with the smallest hashes of their representative, the same on
    every run; its bound is the only thing that reaches the driver.
    """
    picked = groups.orderBy(F.xxhash64("rep")).limit(sample).select("v").collect()
    points = np.asarray([r["v"] for r in picked], dtype=np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    half = points.shape[1] // 2
    return _kmeans(points[:, :half], centroids, 1), _kmeans(points[:, half:], centroids, 2)


def _traverse(d1: np.ndarray, d2: np.ndarray, probes: int) -> list[int]:
    """Cells (i * K + j) in rising d1[i] + d2[j]: the multi-sequence traversal."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    k = len(d2)
    heap = [(d1[o1[0]] + d2[o2[0]], 0, 0)]
    seen = {(0, 0)}
    cells = []
    while heap and len(cells) < probes:
        _, a, b = heapq.heappop(heap)
        cells.append(int(o1[a]) * k + int(o2[b]))
        for na, nb in ((a + 1, b), (a, b + 1)):
            if na < len(o1) and nb < len(o2) and (na, nb) not in seen:
                seen.add((na, nb))
                heapq.heappush(heap, (d1[o1[na]] + d2[o2[nb]], na, nb))
    return cells


def _cells(groups: DataFrame, books, probes: int) -> DataFrame:
    """``(rep, cell, probes)``: each group's own cell and the cells it visits."""
    c1, c2 = books
    half = c1.shape[1]

    def assign(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            u = flat.reshape(n, -1)
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
            d1 = ((u[:, None, :half] - c1[None]) ** 2).sum(2)
            d2 = ((u[:, None, half:] - c2[None]) ** 2).sum(2)
            own = d1.argmin(1) * c2.shape[0] + d2.argmin(1)
            visits = [_traverse(d1[i], d2[i], probes) for i in range(n)]
            yield pa.RecordBatch.from_pydict(
                {"rep": batch.column("rep"), "cell": pa.array(own, pa.int32()),
                 "probes": pa.array(visits, pa.list_(pa.int32()))}
            )

    return groups.select("rep", "v").mapInArrow(assign, "rep bigint, cell int, probes array<int>")


def _similar(va: np.ndarray, vb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``va`` and ``vb`` whose cosine is at least ``threshold`` (or no number).

    One matrix product finds them; what lies within its rounding of the threshold is summed
    again entry by entry.
    """
    with np.errstate(all="ignore"):
        na, nb = (va * va).sum(1), (vb * vb).sum(1)
        cosine = va @ vb.T / np.sqrt(na[:, None] * nb[None])
        i, j = np.nonzero(~(cosine < threshold - _ROUNDING))
        unsure = np.flatnonzero(~(cosine[i, j] > threshold + _ROUNDING))
        for at in range(0, len(unsure), BLOCK):
            some = unsure[at : at + BLOCK]
            x, y = va[i[some]], vb[j[some]]
            summed = [np.cumsum(p, axis=1)[:, -1] for p in (x * y, x * x, y * y)]
            i[some[summed[0] / np.sqrt(summed[1] * summed[2]) < threshold]] = -1
    return i[i >= 0], j[i >= 0]


def _meet(threshold: float):
    """Pairs of visits and indexed vectors of each block, which come in one run, index first."""

    def met(batches):
        block, ids, vectors = None, [], []
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            label, kind = batch.column("label"), batch.column("kind").to_numpy()
            rep = batch.column("rep").to_numpy()
            numbers = [batch.column(c).to_numpy() for c in ("cell", "pblock", "iblock")]
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(label.slice(1), label.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            for x in (*numbers, kind):
                new[1:] |= x[1:] != x[:-1]
            borders = [*np.flatnonzero(new).tolist(), n]
            for low, high in zip(borders, borders[1:]):
                here = (label[low].as_py(), *(int(x[low]) for x in numbers))
                if here != block:
                    block, ids, vectors = here, [], []
                if kind[low] == 0:
                    ids.append(rep[low:high])
                    vectors.append(v[low:high])
                    continue
                if len(ids) > 1:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                for at in range(low, high, BLOCK) if ids else ():
                    top = min(high, at + BLOCK)
                    i, j = _similar(v[at:top], vectors[0], threshold)
                    a, b = rep[at:top][i], ids[0][j]
                    other = a != b
                    a, b = a[other], b[other]
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return met


def similar_pairs(groups: DataFrame, books, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """``(a, b)`` with a < b: representatives of groups with equal labels and cosine >= threshold
    that the index brings together."""
    placed = materialize(
        groups.join(_cells(groups, books, probes), "rep").select("rep", "label", "v", "cell", "probes")
    )
    sizes = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("size")).select(
        "label", "cell", F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int").alias("nb")
    )
    n_cells = sizes.count()
    if n_cells * 32 <= CELL_TABLE_BYTES:
        sizes = F.broadcast(sizes)
    # A label is compared by its text: any type does.
    block = [F.col("label").cast("string").alias("label"), "cell"]
    index = placed.join(sizes, ["label", "cell"]).select(
        *block, F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("pblock"),
        F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int").alias("iblock"),
        F.lit(0).alias("kind"), "rep", "v",
    )
    visits = placed.select("label", "rep", "v", F.explode("probes").alias("cell"))
    visits = visits.join(sizes, ["label", "cell"]).select(
        *block, F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int").alias("pblock"),
        F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("iblock"),
        F.lit(1).alias("kind"), "rep", "v",
    )
    keys = ["label", "cell", "pblock", "iblock"]
    together = index.unionAll(visits).repartition(*keys).sortWithinPartitions(*keys, "kind")
    return together.mapInArrow(_meet(threshold), "a bigint, b bigint").distinct()


def near_duplicate_vectors(
    embeddings: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES,
    sample: int = SAMPLE, centroids: int = CENTROIDS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors link when their labels are equal and not null and their cosine is at least
    ``threshold``. Rows that are unusable (see ``_clean``) link with nothing: n_links 0,
    component_id their own vec_id, kept true; a null vec_id gives component_id null and kept
    false. Exact copies (same label, same entries) link with each other, so a repeated row
    counts its repeats as links. ``n_links`` counts other rows linked directly;
    ``component_id`` is the smallest vec_id reachable. Only vec_id, label and embedding are
    read. An empty table gives an empty result.
    """
    rows, good = _clean(embeddings)
    groups = materialize(
        good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .select("key", "rep", "copies", F.col("key.label").alias("label"), F.col("key.v").alias("v"))
    )
    if groups.limit(1).count() == 0:
        return _alone(rows)
    books = fit_codebooks(groups, sample, centroids)
    pairs = materialize(similar_pairs(groups, books, threshold, probes))
    copies = groups.select("rep", "copies")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.join(copies.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(
        F.sum("copies").alias("partners")
    )
    comp = components(pairs)
    per_group = (
        groups.select("key", "rep", "copies")
        .join(partners.withColumnRenamed("a", "rep"), "rep", "left")
        .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "key", "copies",
            (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).cast("bigint").alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = join_back(good.select("vec_id", "key"), per_group, "key", "copies").select(
        "vec_id", "n_links", "component_id"
    )
    out = linked.unionByName(_alone(rows.where(~F.col("ok"))).select("vec_id", "n_links", "component_id"))
    return out.select(
        "vec_id", "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _alone(rows: DataFrame) -> DataFrame:
    return rows.select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.col("vec_id").isNotNull().alias("kept"),
    )
