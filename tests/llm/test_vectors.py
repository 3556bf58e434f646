"""Search and near duplicates of vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knownby.llm import collision_counting, cross_polytope

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [None] + [1.0] * 15, 1), (9004, [nan] + [1.0] * 15, 1), (9005, [inf] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (9006, [1.0, 2.0], 1)]


def vectors(n, seed, spread=1.0):
    pick = np.random.default_rng(seed)
    return (pick.normal(size=(n, 16)) * pick.uniform(0.5, 1 + spread, size=(n, 1))).astype(np.float32)


def test_search_against_brute_force(llm):
    x = vectors(1500, 1)
    x[7] = x[3]
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)] + odd_rows()
    df = llm.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1))
    got = collision_counting.search(df, F.col("id") % 20 == 0, 10, base_block=600, query_block=32).collect()
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    for q in range(0, 1500, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and q not in {r.vec_id for r in own}
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(exact[q, r.vec_id], rel=1e-12) for r in own)
        order = np.lexsort((np.arange(1500), -exact[q]))
        hits += len({r.vec_id for r in own} & set(order[order != q][:10].tolist()))
    assert hits / (75 * 10) >= 0.9
    assert {r.query_id for r in got} == set(range(0, 1500, 20))


def test_search_with_few_repeated_or_no_vectors(llm):
    rows = [(20, [1.0, 0.0], 1), (21, [0.5, 0.5], 1), (21, [0.5, 0.5], 1), (22, [0.5, 0.5], 1), (40, [0.0, 1.0, 1.0], 1)]
    df = llm.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in collision_counting.search(df, F.col("id") % 20 == 0, 20).collect())
    assert got == [(20, 1, 21, 0.5), (20, 2, 22, 0.5)]
    assert collision_counting.search(df.limit(0), F.col("id") % 20 == 0, 20).count() == 0


def test_links_against_all_pairs(llm):
    pick = np.random.default_rng(5)
    x = vectors(700, 2)
    for i in range(0, 300, 3):  # neighbours at angles around the limit, copies, and other lengths
        noise = pick.normal(size=16)
        x[i + 1] = x[i] + np.float32(pick.uniform(0.05, 0.6)) * np.linalg.norm(x[i]) / np.linalg.norm(noise) * noise
    x[600:640] = x[600]
    x[640:680] = x[600] + pick.normal(size=(40, 16)).astype(np.float32) * 0.05
    x[5] = x[4] * np.float32(2)
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)] + odd_rows()
    df = llm.createDataFrame(rows, SCHEMA).withColumn("links", F.lit(1))
    got = cross_polytope.near_vectors(df).collect()
    assert len(got) == len(rows)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    by_id = {r.vec_id: r for r in got}
    found = sum(by_id[i].n_links for i in range(700))
    assert all(by_id[i].n_links <= linked[i].sum() for i in range(700))
    assert found >= 0.98 * linked.sum()
    clear = unit @ unit.T >= 0.95
    for i in range(700):
        assert by_id[i].n_links >= clear[i].sum() - 1
        assert by_id[i].kept == (by_id[i].component_id == i)
    assert {by_id[i].component_id for i in range(600, 680)} == {600}
    for i, _, _ in odd_rows():
        assert by_id[i].n_links == 0 and by_id[i].component_id == i and by_id[i].kept


def test_each_pair_is_counted_once_across_blocks(llm, monkeypatch):
    x = np.repeat(vectors(1, 3), 60, axis=0) + vectors(60, 4) * np.float32(0.02)
    df = llm.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    monkeypatch.setattr(cross_polytope, "BLOCK", 16)
    assert {r.n_links for r in cross_polytope.near_vectors(df).collect()} == {59}


def test_hadamard_keeps_lengths_and_inner_products():
    x = vectors(20, 6).astype(np.float64)
    for turned in cross_polytope.rotations(x, 2):
        assert np.allclose(turned @ turned.T, x @ x.T)


def test_empty_and_repeated_ids(llm):
    df = llm.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in cross_polytope.near_vectors(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert cross_polytope.near_vectors(df.limit(0)).count() == 0
