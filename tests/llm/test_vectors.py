"""Vector operators against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import ann, cover_tree

SCHEMA = "vec_id long, embedding array<float>, label int, cid string"


def vectors(seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((260, 16))
    x[40:80] = x[0] + 0.02 * rng.standard_normal((40, 16))
    x[80:90] = x[1]
    x[90:120] = x[2] + 0.12 * rng.standard_normal((30, 16))
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3) if i >= 120 else 0, "clash") for i in range(260)]
    nothing = [(900, None, 0, None), (901, [0.0] * 16, 0, None), (902, [float("nan")] * 16, 0, None), (903, [float("inf")] + [1.0] * 15, 0, None), (904, [None] + [1.0] * 15, 0, None), (905, [], 0, None), (906, rows[5][1], None, None), (907, [1.0, 2.0], 0, None), (908, [2.0, 4.0], 0, None)]
    return rows + nothing


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3)


def test_cover_tree_links(spark, table, monkeypatch):
    rows = vectors()
    x = np.array([r[1] for r in rows[:260]], dtype=np.float64)
    label = np.array([r[2] for r in rows[:260]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    least = np.arange(260)
    for _ in range(260):
        least = np.minimum(least, np.where(near, least[None, :], 999).min(axis=1))
    expected = {i: (int(near[i].sum()), int(least[i]), bool(least[i] == i)) for i in range(260)}
    expected |= {i: (0, i, True) for i in range(900, 907)} | {907: (1, 907, True), 908: (1, 907, False)}
    for cell, chunk in ((4096, 2048), (40, 16)):
        monkeypatch.setattr(cover_tree, "CELL_ROWS", cell)
        monkeypatch.setattr(cover_tree, "CHUNK_ROWS", chunk)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicate_vectors(table).collect()}
        assert got == expected
    assert near.sum() > 1000


def test_cover_tree_node_pairs():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = cover_tree.CoverTree(x[:200]), cover_tree.CoverTree(x[200:])
    for threshold in (0.98, 0.7):
        reach = float(np.sqrt(2 - 2 * threshold))
        found = {(int(p), int(q)) for ps, qs in cover_tree.close_pairs(a, b, reach, threshold, False) for p, q in zip(ps, qs, strict=True)}
        assert found == set(zip(*map(lambda v: v.tolist(), np.nonzero(x[:200] @ x[200:].T >= threshold)), strict=True))
    assert all(np.linalg.norm(a.x[r] - c, axis=1).max() <= rad + 1e-12 for r, c, rad in zip(a.rows, a.center, a.radius, strict=True))


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cover_tree.near_duplicate_vectors(empty).collect() == []
    assert ann.nearest(empty, empty["vec_id"] % 20 == 0).collect() == []


def test_nearest_neighbours(spark, table, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 70)
    monkeypatch.setattr(ann, "LEAF", 8)
    got = ann.nearest(table, (table["vec_id"] % 10 == 0) & (table["vec_id"] < 260), k=10).collect()
    rows = [r for r in vectors() if r[0] < 260 or r[0] == 906]
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    hit = total = 0
    for q in ids[(ids % 10 == 0) & (ids < 260)]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:10]
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        for r in mine:
            assert r.score == pytest.approx(score[ids == r.vec_id][0], rel=1e-12) and r.vec_id != q
        hit += len({r.vec_id for r in mine} & set(ids[order].tolist()))
        total += 10
    assert hit >= 0.9 * total
    few = ann.nearest(table.where("vec_id < 5"), table["vec_id"] == 0, k=20).collect()
    assert len(few) == 4


def test_neighbours_of_uneven_norms_and_ties(spark, monkeypatch):
    """Norms from 0.001 to 1000, equal vectors at the border of the list, and columns named like those of the result."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 50)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 8)) * 10.0 ** rng.integers(-3, 4, (200, 1))
    x[100:130] = x[7]
    rows = [(i, [float(v) for v in x[i]], 1, 2.0) for i in range(200)]
    table = spark.createDataFrame([*rows, rows[7], rows[60]], "vec_id long, embedding array<double>, rank int, score double").repartition(4)
    got = ann.nearest(table, table["vec_id"] % 20 == 0, k=5).collect()
    hit = 0
    ids = np.array([*range(200), 7, 60])
    every = np.vstack([x, x[7], x[60]])
    for q in range(0, 200, 20):
        score = (every * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine) and len(mine) == 5
        hit += sum(r.score >= score[order[-1]] * (1 - 1e-12) if score[order[-1]] > 0 else True for r in mine)
    assert hit >= 45


@pytest.mark.parametrize(("leaf", "block"), [(8, 3), (40, 1024)])
def test_search_stops_by_the_chi_square_test(monkeypatch, leaf, block):
    """Clusters far apart: leaves beyond the test stay unread, what was read is ranked exactly, repeats of an id included."""
    monkeypatch.setattr(ann, "LEAF", leaf)
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((20, 12)), 30, axis=0) + 0.01 * rng.standard_normal((600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5:15] = x[5]
    ids = np.arange(600)
    ids[11] = 10
    shard = ann.Shard(ids, x, 1.0)
    read = []
    monkeypatch.setattr(shard.tree, "bounds", type("Counted", (np.ndarray,), {"__getitem__": lambda self, i: read.append(i) or np.ndarray.__getitem__(self, i)})(shard.tree.bounds.shape, shard.tree.bounds.dtype, shard.tree.bounds.copy()))
    query = ids % 50 == 0
    found = shard.search(ids[query], x[query], 10, ann.chi_square_quantile(0.98, ann.DIMS))
    assert len(read) / 2 < query.sum() * len(shard.tree.low) / 2
    for q in ids[query]:
        score = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:10]
        mine = found[0] == q
        assert found[1][mine].tolist() == ids[order].tolist() and found[2][mine].tolist() == score[order].tolist()


def test_vectors_whose_squares_overflow_or_vanish(spark):
    rows = [(1, [1e-200, 0.0], 0), (2, [3e-310, 0.0], 0), (3, [1e200, 0.0], 0), (4, [2e200, 0.0], 0), (5, [0.0, 1e-170], 0), (6, [1e200, 1e200], 1), (7, [1.0, 1.0], 1)]
    got = cover_tree.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


@pytest.mark.parametrize("huge", [1e160, 1e300, 1e-300])
def test_neighbours_beside_an_extreme_vector(spark, huge):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 4)) * (1.0 if huge > 1 else 1e-302)
    x[0] = [huge, 0, 0, 0]
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "vec_id long, embedding array<double>")
    got = ann.nearest(table, table["vec_id"] % 20 == 0, k=5).collect()
    for q in (20, 40):
        score = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(60), -score)) if i != q][:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == order and [r.score for r in mine] == [pytest.approx(score[i], rel=1e-12) for i in order]
