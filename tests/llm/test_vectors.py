"""Whitening and near-duplicate vectors against brute force, with edge cases."""

import math

import numpy as np
import pytest

from penprint.llm.queries import QUERIES
from penprint.llm.vectordedup import near_duplicate_vectors
from penprint.llm.whitening import whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, n double, x string, component_id int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1.0, "x", 9) for i, v, lab in rows], SCHEMA)


def _brute_whiten(ids, vectors):
    x = np.floor(256 * np.asarray(vectors, dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    d = (fit * n - s).astype(float)
    cov = d.T @ d / n**3
    e, v = np.linalg.eigh(cov)
    o = np.argsort(e)[::-1][:4]
    e, v = e[o], v[:, o]
    w = (x - s / n) @ v / np.sqrt(e)
    dev = ((n * x - s) ** 2).sum(1)
    return n, e / np.trace(cov), w, dev


def test_whitening_matches_brute_force(spark, sf_dir):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pandas()
    got = QUERIES["op11_weighted_whitening"](spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    n, explained, w, dev = _brute_whiten(table.vec_id, list(table.embedding))
    order = np.argsort(table.vec_id.values)
    assert len(got) == 4 * len(table)
    assert (got.n == n).all()
    gw = got.whitened.values.reshape(-1, 4)
    for k in range(4):  # either sign, the same for all rows
        sign = np.sign(gw[0, k] * w[order][0, k])
        assert np.max(np.abs(gw[:, k] - sign * w[order][:, k])) < 1e-9
    assert np.allclose(got.groupby("component").explained.first().values, explained, rtol=1e-6)
    assert (got.deviation.values.reshape(-1, 4)[:, 0] == dev[order]).all()
    assert got.identity_error.max() <= 1e-4


def test_whitening_edges(spark):
    rng = np.random.default_rng(3)
    base = [rng.normal(size=6).tolist() for _ in range(30)]
    rows = [(i, v, 0) for i, v in enumerate(base)]
    rows += [(100, base[0], 0), (100, base[0], 0)]  # repeated rows: same values, own rows
    rows += [(101, None, 0), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (103, [float("nan")] * 6, 0)]
    rows += [(104, [float("inf")] + [0.0] * 5, 0), (105, [0.5, 0.5], 0), (None, base[1], None)]
    got = whiten(_frame(spark, rows)).toPandas()
    ids = set(got.vec_id.dropna())
    assert ids == set(range(30)) | {100}
    assert got.vec_id.isna().sum() == 4  # a null id keeps its row
    assert len(got[got.vec_id == 100]) == 8
    assert got[got.vec_id == 100].whitened.tolist()[:4] == got[got.vec_id == 0].whitened.tolist()
    # the fit list is the distinct vectors: 30, whatever the repeats
    assert (got.n == 30).all()
    empty = whiten(_frame(spark, [])).collect()
    assert empty == []
    one = whiten(_frame(spark, [(1, [0.1, 0.2], 0), (2, [0.1, 0.2], 0)])).collect()
    assert one == []  # a single distinct vector has no variance


def _brute_links(rows, threshold=0.93):
    usable = [
        (i, r) for i, r in enumerate(rows)
        if r[0] is not None and r[2] is not None and r[1] is not None
        and all(c is not None and math.isfinite(c) for c in r[1]) and any(c != 0 for c in r[1])
    ]
    links = {i: set() for i in range(len(rows))}
    for a, (i, ra) in enumerate(usable):
        for j, rb in usable[a + 1:]:
            if ra[2] != rb[2] or len(ra[1]) != len(rb[1]):
                continue
            va, vb = np.asarray(ra[1], float), np.asarray(rb[1], float)
            if va @ vb / math.sqrt((va @ va) * (vb @ vb)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in range(len(rows)):
        if i in comp:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        for j in seen:
            comp[j] = min(ids) if rows[j][0] is not None else None
    return [(r[0], len(links[i]), comp[i]) for i, r in enumerate(rows)]


def test_near_duplicate_vectors_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        for k in range(int(rng.integers(1, 6))):
            v = centre + rng.normal(scale=0.15, size=16)
            rows.append((len(rows), v.astype(np.float32).tolist(), int(c % 3)))
    rows.append((len(rows), rows[0][1], rows[0][2]))  # an exact copy
    rows.append((len(rows), rows[0][1], rows[0][2] + 1))  # same vector, other label
    rows.append((len(rows), rows[1][1], None))  # null label
    rows.append((len(rows), [0.0] * 16, 0))  # zero vector
    rows.append((len(rows), [float("nan")] + [1.0] * 15, 0))
    rows.append((len(rows), None, 0))
    rows.append((None, rows[2][1], 0))
    rows.append((0, rows[0][1], rows[0][2]))  # a repeated row
    norm = [(i, [float(c) for c in v] if v is not None else None, lab) for i, v, lab in rows]
    want = _brute_links(norm)
    got = near_duplicate_vectors(_frame(spark, rows), probes=8, centroids=4).toPandas()
    assert len(got) == len(rows)
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2] if t[2] is not None else -1)
    got_rows = sorted(
        [(None if np.isnan(r.vec_id) else int(r.vec_id), int(r.n_links),
          None if np.isnan(r.component_id) else int(r.component_id)) for r in got.itertuples()],
        key=key,
    )
    assert got_rows == sorted(want, key=key)
    assert sum(w[1] for w in want) > 20
    kept = got[got.vec_id == got.component_id]
    assert kept.kept.all()
    assert not got[got.vec_id.isna()].kept.any()


def test_near_duplicate_vectors_empty(spark):
    assert near_duplicate_vectors(_frame(spark, [])).collect() == []
    lone = near_duplicate_vectors(_frame(spark, [(1, None, 1), (2, [1.0], None)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lone) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_cells_are_compared_by_matrix_products(spark, monkeypatch):
    from penprint.llm import vectordedup as vd

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(50, 8)), rng.normal(size=(30, 8))
    a[:4], b[0] = b[:4], [1e200] * 8  # equal vectors, and squares beyond a double
    want = set()
    with np.errstate(all="ignore"):
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                dot, na, nb = (np.cumsum(p)[-1] for p in (x * y, x * x, y * y))
                want |= {(i, j)} if not dot / np.sqrt(na * nb) < 0.5 else set()
    i, j = vd._similar(a, b, 0.5)
    assert set(zip(i.tolist(), j.tolist())) == want and {(1, 1), (2, 2), (3, 3)} <= want
    at_one = vd._similar(b[1:], b[1:], 1.0)  # on the threshold the sums decide
    assert all(x in range(29) and x == y for x, y in zip(*at_one))

    rows = [(i, (np.float32(rng.normal(size=6)) + (i % 5) * 3).tolist(), i % 2) for i in range(300)]
    frame = _frame(spark, rows)
    groups = vd._clean(frame)[1].selectExpr("vec_id as rep", "label", "v")
    books = vd.fit_codebooks(groups, 100, 4)
    found = vd.similar_pairs(groups, books, 0.97, 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
    whole = sorted(found.collect())
    vectors = [np.asarray(r[1]) for r in rows]
    brute = [(i, j) for i in range(300) for j in range(i + 1, 300) if i % 2 == j % 2
             and vectors[i] @ vectors[j] / math.sqrt((vectors[i] @ vectors[i]) * (vectors[j] @ vectors[j])) >= 0.97]
    assert [tuple(r) for r in whole] == brute and len(brute) > 1000
    monkeypatch.setattr(vd, "BLOCK", 7)
    assert sorted(vd.similar_pairs(groups, books, 0.97, 16).collect()) == whole
