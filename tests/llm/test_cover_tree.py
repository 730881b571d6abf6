"""Cover trees: covering radii, dual traversal and the whole join against all pairs."""

import numpy as np
import pytest

from rowmill.llm import cover_tree
from rowmill.llm.cover_tree import dual_links


def cloud(rng, n, dims, copies=3, noise=0.15):
    base = rng.normal(size=(n, dims))
    return np.concatenate([base + noise * k * rng.normal(size=base.shape) / 2 for k in range(copies)])


@pytest.mark.parametrize("dims", [2, 5, 64])
@pytest.mark.parametrize("cosine", [0.93, 0.5, 0.999])
def test_dual_links(dims, cosine):
    rng = np.random.default_rng(dims)
    a, b = cloud(rng, 60, dims), cloud(rng, 50, dims)
    b[:20] = a[:20]
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    assert (dual_links(a, b, cosine) == (a @ b.T / norms >= cosine)).all()
    for level in cover_tree.cover_tree(a / np.linalg.norm(a, axis=1)[:, None], 0.1):
        unit = a / np.linalg.norm(a, axis=1)[:, None]
        away = np.linalg.norm(unit - unit[level.centre[level.node_of]], axis=1)
        assert (away <= level.radius[level.node_of] + 1e-12).all()


def test_a_block_measures_its_points_once(monkeypatch):
    """A tree needs a number of passes over its points that goes with its levels, not with its centres."""
    passes = []
    norm = np.linalg.norm
    monkeypatch.setattr(np.linalg, "norm", lambda *a, **k: passes.append(1) or norm(*a, **k))
    points = np.random.default_rng(4).normal(size=(600, 64))
    points /= np.sqrt((points * points).sum(1))[:, None]
    levels = cover_tree.cover_tree(points, 0.1)
    assert len(levels[-1].centre) == 600 and len(passes) <= len(levels)


def brute(rows, cosine=0.93):
    good = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    root, links = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, v, l) in enumerate(good):
        for j, w, m in good[:k]:
            if l == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (links[i], find(i), find(i) == i) for i, *_ in rows}


@pytest.mark.parametrize("block", [2048, 24])
def test_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = np.concatenate([cloud(rng, 40, 6), cloud(rng, 1, 6, copies=60, noise=0.01)]).astype("f4").tolist()
    vectors += [vectors[0]] * 40
    labels = [0 if rng.random() < 0.7 else 1 for _ in vectors]
    odd = [(None, 0), ([], 0), ([0.0] * 6, 0), ([1.0, None, 0.0, 0.0, 0.0, 0.0], 0), ([float("nan")] * 6, 0), ([float("inf")] + [0.0] * 5, 0), (vectors[0], None), (vectors[0][:3], 0)]
    rows = [(k, v, l) for k, (v, l) in enumerate([*zip(vectors, labels), *odd])]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "vec_id long, embedding array<float>, label int, id int, node string").repartition(5)
    found = cover_tree.link_vectors(df).collect()
    assert {r.vec_id: tuple(r)[1:] for r in found} == brute(rows)
    assert len(found) == len(rows)
    if block == 24:
        assert cover_tree.link_vectors(df.limit(0)).collect() == []


def test_embeddings(spark):
    from rowmill.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = {r.vec_id: tuple(r)[1:] for r in QUERIES["op6_near_vectors"](spark, folder).collect()}
    assert found == brute(rows)
