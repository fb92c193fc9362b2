import math

import numpy as np
import pytest

from marlstone.llm import embedding_dedup
from marlstone.llm.embedding_dedup import called_for, chosen_bits, entries, near_vectors, read_entries, rotation_count, rotations, table_plan, upper_bounds


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.95):
    n = len(rows)
    links = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = rows[i][1], rows[j][1]
            if i != j and None not in (rows[i][0], rows[j][0]) and good(a) and good(b) and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                links[i][j] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold
    one = [[rows[i][0] is not None and rows[i][0] == rows[j][0] for j in range(n)] for i in range(n)]  # rows of one id reach the same
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = [j for j in range(n) if (links[k][j] or one[k][j]) and j not in seen]
            seen |= set(new)
            todo += new
        c = None if v is None else min(rows[j][0] for j in seen)
        out.append((v, sum(links[i]), c, v is None or v == c))
    return sorted(out, key=str)


def data(seed, n=150, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.choice([0, 0.02, 0.05, 0.07]) * rng.standard_normal(dim)
        else:
            v = rng.standard_normal(dim)
            v /= np.linalg.norm(v)
        rows.append((k, [float(x) for x in v.astype(np.float32)]))
    rows.append((n + 3, None))
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = data(1)
    odd = [(501, []), (502, [0.0] * 24), (503, [float("nan")] + [1.0] * 23), (504, [None] + [1.0] * 23), (505, [1.0, 0.0]), (506, [2.0, 0.1]), (None, rows[0][1]), (0, rows[0][1]), (507, rows[0][1]), (508, [1e30] * 24), (509, [3e30] * 24)]
    df = spark.createDataFrame([(v, e, 1, "x") for v, e in rows + odd], "vec_id long, embedding array<float>, label int, component string")
    assert sorted((tuple(r) for r in near_vectors(df).collect()), key=str) == brute(rows + odd)
    assert near_vectors(df.limit(0)).count() == 0


def test_ids_with_several_vectors(spark):
    rows = [(v, e and [float(x) for x in e]) for v, e in [(1, [1, 0, 0, 0]), (1, [0, 1, 0, 0]), (2, [1, 0.01, 0, 0]), (3, [0.01, 1, 0, 0]), (4, [0.02, 1, 0, 0]), (5, [0, 0, 1, 0]), (5, None), (6, [0, 0, 1, 0.01]), (5, [-0.0, 0, 1, 0]), (7, [0] * 4)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in near_vectors(df).collect()), key=str)
    assert got == brute(rows) and sorted(r[1] for r in got if r[0] == 1) == [1, 2]


def pairs(n, cosine, dim=64, seed=5):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine**2) * b


def test_estimates_are_unbiased_and_bounded():
    x, _ = pairs(400, 0.95, seed=3)
    turned = x @ rotations(64)[0].T
    entry = signs, factor, rest, near = read_entries([e.tobytes() for e in entries(turned)], 64)
    assert (np.sqrt(((near - turned) ** 2).sum(1)) <= rest + 1e-6).all() and rest.max() < 0.02
    estimate = signs @ turned.T / 8 / factor[:, None]
    off = ~np.eye(400, dtype=bool)
    sd = np.sqrt((1 - factor**2) / factor**2 / 63)
    assert abs((estimate - x @ x.T)[off].mean()) < 2e-3 and (np.abs(estimate - x @ x.T) <= 4 * sd[:, None] + 1e-6)[off].mean() > 0.999
    every = np.arange(400)
    assert (upper_bounds(entry, every, every) >= x @ x.T)[off].mean() > 0.9995


def test_bounds_rule_out_most_and_keep_pairs_at_the_threshold():
    a, b = pairs(20_000, 0.9501)
    turn = rotations(64)[0]
    entry = read_entries([e.tobytes() for e in entries(np.concatenate([a, b]) @ turn.T)], 64)
    signs, factor, rest, near = entry
    bound = []
    for i, j in ((slice(0, 20_000), slice(20_000, None)), (slice(20_000, None), slice(0, 20_000))):
        f = factor[i]
        bound.append((signs[i] * near[j]).sum(1) / (8 * f) + 4 * np.sqrt((1 - f * f) / f**2 / 63) + rest[j] / f + 1e-5)
    assert (np.minimum(*bound) >= 0.95).mean() > 0.9998
    some = tuple(x[:300] for x in entry)
    assert called_for(some, np.zeros(300, int), False, 0.95).mean() < 0.1


def test_recall_at_the_threshold():
    """Pairs meet in a table; measured for plans of 50,000 and 20,000,000 vectors."""
    a, b = pairs(3000, 0.9501)
    for count in (50_000, 20_000_000):
        bits, tables = table_plan(count, 0.95)
        turn, places = np.concatenate(rotations(64, rotation_count(64, bits, tables))), chosen_bits(64, bits, tables)
        key = [((x @ turn.T > 0)[:, places] @ (1 << np.arange(bits))) for x in (a, b)]
        assert (key[0] == key[1]).any(1).mean() > 0.999


def test_recall_from_vectors_to_links(spark):
    """Pairs at the threshold among 6,000 others: every one is linked, and nothing else."""
    a, b = pairs(500, 0.9502, seed=8)
    rest, _ = pairs(6000, 0.5, seed=9)
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([a, b, rest]))]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[500 + i].component_id == i for i in range(500)) >= 499
    assert sum(r.n_links for r in got.values()) <= 1000


def test_tables_share_no_signs():
    for dim, count in ((64, 50_000), (64, 20_000_000), (16, 1_000_000), (2, 1000)):
        bits, tables = table_plan(count, 0.95)
        places = chosen_bits(dim, bits, tables)
        assert places.shape == (tables, bits) and len(np.unique(places)) == bits * tables and places.max() < rotation_count(dim, bits, tables) * dim
