"""Lattice hashing against all pairs."""

from __future__ import annotations

import numpy as np

from schemalign.llm import lattice


def plain(vectors, threshold):
    """{vec_id: (n_links, component_id)} by all pairs."""
    good = [
        (i, np.array(e, float), lab)
        for i, e, lab in vectors
        if lab is not None and e is not None and None not in e and np.isfinite(np.array(e, float)).all() and any(e)
    ]
    linked = {i: set() for i, *_ in vectors}
    for i, x, a in good:
        for j, y, b in good:
            if i != j and a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                linked[i].add(j)
    low = {i: i for i in linked}
    for _ in linked:
        low = {i: min([low[i], *[low[j] for j in linked[i]]]) for i in low}
    return {i: (len(linked[i]), low[i]) for i in linked}


def planted(rng, n, dims):
    """Vectors with neighbours at cosines around 0.93, and copies."""
    base = rng.normal(size=(n, dims))
    found = list(base)
    for x in base:
        for cosine in (0.9, 0.931, 0.95, 0.99):
            u = rng.normal(size=dims)
            u -= u @ x / (x @ x) * x
            found.append(cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u))
    found += [x.copy() for x in base[:5]]
    return [np.float32(x * rng.uniform(0.1, 50)).tolist() if k < len(found) - 5 else np.float32(x).tolist() for k, x in enumerate(found)]


def test_against_all_pairs(rows):
    rng = np.random.default_rng(3)
    data = [(i, x, int(i % 2)) for i, x in enumerate(planted(rng, 40, 64))]
    data += [(1000 + i, x, 7) for i, x in enumerate(planted(rng, 10, 8))]
    star = rng.normal(size=64)
    data += [(2000 + i, np.float32(star + 0.02 * rng.normal(size=64)).tolist(), 9) for i in range(120)]
    odd = [None, [], [0.0] * 64, [1.0, None], [float("nan")] + [1.0] * 63, [float("inf")] * 64, [1e30] * 64, [2e30] * 64]
    data += [(3000 + i, e, 1) for i, e in enumerate(odd)]
    data += [(4000, data[0][1], None), (4001, data[0][1], None)]
    got = lattice.near_duplicates(rows([(*d, "x") for d in data], "vec_id long, embedding array<float>, label int, copies string"), block_rows=16)
    found = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
    want = plain(data, 0.93)
    assert found == want and found[3006] == (1, 3006) and found[3007] == (1, 3006)


def test_recall_at_the_threshold(rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    a, b = (lattice.cell_keys(v, 0.93, lattice.TABLES, lattice.PROBES) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() > 0.999


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    near = lattice.nearest_e8(x)
    distance = ((x - near) ** 2).sum(axis=1)
    assert (distance <= 1 + 1e-9).all()
    assert all((((x - near - r) ** 2).sum(axis=1) >= distance - 1e-9).all() for r in lattice.ROOTS)


def test_empty_table(rows):
    assert lattice.near_duplicates(rows([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_labels_of_any_type_and_vectors_of_any_size(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=8)
    sizes = {1: 1.0, 2: 1e-60, 3: 1e300, 4: 1e-200}
    for kind, one, other in (("string", "a", "b"), ("bigint", 1 << 40, 5), ("double", 0.5, 0.25)):
        data = [(i, (x * s).tolist(), one) for i, s in sizes.items()] + [(9, x.tolist(), other)]
        got = lattice.near_duplicates(spark.createDataFrame(data, f"vec_id long, embedding array<double>, label {kind}")).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 9: (0, 9)}
