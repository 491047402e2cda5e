from __future__ import annotations

import numpy as np
import pytest

from surveyloom.llm.components import connected_components
from surveyloom.llm import multi_index
from surveyloom.llm.multi_index import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute_force(rows, similarity):
    """Pairs, then components by repeated minimum."""
    unit = {}
    for k, (vec_id, v, label, *_) in enumerate(rows):
        if vec_id is None or v is None or label is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(float)
        unit[k] = (label, x / np.linalg.norm(x))
    links = {k: set() for k in range(len(rows))}
    for i in unit:
        for j in unit:
            if i != j and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= similarity:
                links[i].add(j)
    component = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in links:
            for j in links[i]:
                if component[j] < component[i]:
                    component[i], changed = component[j], True
    return sorted(((r[0], len(links[k]), component[k], r[0] is not None and r[0] == component[k]) for k, r in enumerate(rows)), key=str)


def clustered(n_groups=12, per_group=9, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        centre = rng.standard_normal(dim)
        for i in range(per_group):
            v = centre + (0.02 + 0.05 * i) * rng.standard_normal(dim)
            rows.append((len(rows), [float(x) for x in v], g % 3, "x"))
    return rows


def run(spark, rows, **kw):
    got = near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted(((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in got), key=str)


def test_links_and_components_match_brute_force(spark):
    rows = clustered()
    assert run(spark, rows) == brute_force(rows, 0.93)


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    from surveyloom.llm import cells

    monkeypatch.setattr(multi_index, "ROWS_PER_BLOCK", 4)
    monkeypatch.setattr(cells, "ROWS_PER_BLOCK", 4)
    rows = clustered(4, 30)
    assert run(spark, rows) == brute_force(rows, 0.93)


def test_odd_vectors(spark):
    ok = [1.0, 2.0, 3.0]
    rows = [
        (1, ok, 1, "a"), (2, ok, 1, "a"), (3, [2.0, 4.0, 6.0], 1, "a"), (4, ok, 2, "a"), (5, ok, None, "a"), (6, None, 1, "a"),
        (7, [], 1, "a"), (8, [0.0, 0.0, 0.0], 1, "a"), (9, [1.0, None, 3.0], 1, "a"), (10, [1.0, float("nan"), 3.0], 1, "a"),
        (11, [1.0, float("inf"), 3.0], 1, "a"), (12, [1.0, 2.0], 1, "a"), (13, [1.0, 2.0], 1, "a"), (14, [5.0], 1, "a"), (15, [-5.0], 1, "a"),
        (16, [3e38, 0.0, 0.0], 1, "a"), (17, [1e-38, 0.0, 0.0], 1, "a"), (2, ok, 1, "a"),
    ]
    assert run(spark, rows) == brute_force(rows, 0.93)
    missing = run(spark, [*rows, (None, ok, 1, "a")])
    assert (None, 0, None, False) in missing and len(missing) == len(rows) + 1


def test_no_vectors(spark):
    assert run(spark, []) == []


def test_recall_on_random_neighbours(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal(base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.94 * base + np.sqrt(1 - 0.94**2) * away
    rows = [(i, [float(x) for x in v], 0, "x") for i, v in enumerate(np.concatenate([base, near]))]
    found = sum(n for _, n, _, _ in run(spark, rows))
    want = sum(n for _, n, _, _ in brute_force_links(rows))
    assert want >= 3000 and found >= 0.99 * want


def low_rank(rng, n, rank, dim):
    """Vectors of a subspace, and for each a neighbour at 0.935 inside the same subspace."""
    axes = np.linalg.qr(rng.standard_normal((dim, rank)))[0].T
    base = rng.standard_normal((n, rank))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal(base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return base @ axes, (0.935 * base + np.sqrt(1 - 0.935**2) * away) @ axes


@pytest.mark.parametrize("rank, dim", [(8, 64), (8, 256), (12, 64)])
def test_margin_of_low_rank_vectors_with_large_codebooks(rank, dim):
    sample, other = low_rank(np.random.default_rng(6), 6000, rank, dim)
    index = multi_index.fit(sample, 125, 0.93, 0.9999)
    here = np.arange(len(sample))
    needed = multi_index._needed(index.excess(sample), index.excess(other), here, here)
    assert len(index.first) == 125 and (needed <= index.margin).mean() >= 0.999


@pytest.mark.parametrize("own_subspaces", [False, True])
def test_low_rank_vectors_with_many_centroids_lose_no_link(spark, monkeypatch, own_subspaces):
    """Also where each cluster has a subspace of its own, which the covariance of all vectors does not show."""
    rng = np.random.default_rng(7)
    if own_subspaces:
        parts = []
        for _ in range(15):
            centre, away = rng.standard_normal(64), low_rank(rng, 100, 3, 64)[0]
            centre /= np.linalg.norm(centre)
            parts.append(centre + 0.4 * away)
    else:
        parts = low_rank(rng, 750, 8, 64)
    rows = [(i, [float(x) for x in v], 0, "x") for i, v in enumerate(np.concatenate(parts))]
    monkeypatch.setattr(multi_index, "ROWS_PER_CELL", 1.5)
    sizes = []
    fit = multi_index.fit
    monkeypatch.setattr(multi_index, "fit", lambda *a: sizes.append(fit(*a)) or sizes[-1])
    found = {r[0]: r[1] for r in run(spark, rows)}
    want = {r[0]: r[1] for r in brute_force_links(rows)}
    assert len(sizes[0].first) >= 30
    assert sum(want.values()) >= 1000 and sum(found.values()) >= 0.999 * sum(want.values())
    assert all(found[k] <= want[k] for k in want)


def brute_force_links(rows):
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = (x @ x.T >= 0.93).sum(1) - 1
    return [(i, int(k), None, None) for i, k in enumerate(n)]


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, k) for k in range(501, 560)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (501, 500), (900, 901), (901, 902), (902, 900)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {900: 900, 901: 900, 902: 900}
    assert got == want
    assert connected_components(links.limit(0)).collect() == []
