"""Embedding near-duplicates against all pairs: recall, large buckets and components, extreme and odd vectors."""

import numpy as np
import pytest

from chargelens.llm.embedding_dedup import embedding_dedup, most_different, tables_for


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(n // 3, n // 2):  # pairs from far apart to nearly equal
        x[k] = x[k - n // 3] + rng.normal(size=dim) * rng.uniform(0.05, 0.8)
    return x


def all_pairs(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def links(near):
    root = np.arange(len(near))
    while True:
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(near))])
        if (new == root).all():
            return root
        root = new


@pytest.mark.parametrize(("n", "dim"), [(600, 16), (3000, 32)])
def test_recall_at_two_sizes(spark, n, dim):
    x = clustered(n, dim, n)
    near = all_pairs(x)
    got = {r.vec_id: r for r in embedding_dedup(frame(spark, x)).collect()}
    found = sum(r.n_links for r in got.values())
    assert 0.98 * near.sum() <= found <= near.sum() and near.sum() > n / 20


@pytest.mark.parametrize("limit", [1 << 20, 3])
def test_one_large_family_is_compared_in_blocks(spark, limit):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1, 24)) + rng.normal(size=(150, 24)) * 0.05, rng.normal(size=(100, 24))])
    near = all_pairs(x)
    got = {r.vec_id: r for r in embedding_dedup(frame(spark, x), block=20, component_limit=limit, recall=0.999999).collect()}
    root = links(near)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), root[i], root[i] == i)


def test_extreme_and_odd_vectors(spark):
    inf = float("inf")
    rows = [
        (0, [1e200, 0.0], "own"), (1, [1e200, 1e199], "own"), (2, [1e-200, 0.0], "own"), (3, [0.0, -1.0], "own"), (4, [inf, 1.0], "own"), (5, [float("nan"), 1.0], "own"), (6, None, "own"), (7, [], "own"),
        (8, [1.0, None], "own"), (9, [0.0, 0.0], "own"), (10, [1.0, 0.0, 0.0], "own"), (None, [1e200, 0.0], "own"), (11, [1e200, 0.0], "own"), (11, [1e200, 0.0], "own"),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<double>, digest string, component_id string")
    got = embedding_dedup(df, recall=0.999999).collect()
    by = {r.vec_id: r for r in got if r.vec_id is not None}
    assert len(got) == len(rows)
    assert [by[k].n_links for k in range(11)] == [4, 4, 4, 0, 0, 0, 0, 0, 0, 0, 0] and by[11].n_links == 4
    assert by[11].component_id == 0 and not by[11].kept and by[0].kept and by[10].component_id == 10
    assert next(r for r in got if r.vec_id is None)[1:] == (0, None, True)
    assert embedding_dedup(df.limit(0)).count() == 0


def test_parameters_follow_the_rows():
    assert tables_for(10_000, 0.9, 0.995, 512)[1] < tables_for(1_000_000, 0.9, 0.995, 512)[1] < 60
    assert 25 < most_different(0.9, 0.0005) < 40
