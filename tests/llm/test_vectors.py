"""Nearest neighbours and hard negatives against all pairs, on random vectors and edge cases."""

import numpy as np
import pytest

from glimt.llm import grid, nearest, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec string, dim string, norm string, v1 string, k1 string, band string, score string, same string, `a.b` string"


def rows(spark, items):
    return spark.createDataFrame([(i, v, x, *["clash"] * 10) for i, v, x in items], SCHEMA).repartition(3)


def vectors(rng, n, dim=12, groups=6):
    """Some near each other, some equal, some long."""
    centres = rng.standard_normal((groups, dim))
    out = centres[rng.integers(groups, size=n)] + 0.3 * rng.standard_normal((n, dim))
    out[n // 2 :: 7] = out[0]
    out[3] *= 50
    return [[float(np.float32(x)) for x in v] for v in out]


ODD = [(900, None, 1), (901, [1.0, None, 2.0], 1), (902, [float("nan")] * 12, 2), (903, [float("inf")] + [0.0] * 11, 2), (904, [0.0] * 12, 3), (905, [], 3), (None, [1.0] * 12, 3), (906, [1.0, 2.0], 1), (907, [2.0, 1.0], 1), (908, [3.0, 3.0], 2), (909, [1.0] * 12, None)]


def plain_nearest(items, k, every):
    """All pairs in plain Python; rows that agree in id and vector count once."""
    taken = {(i, tuple(v)) for i, v, _ in items if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in taken:
        if q % every == 0:
            scored = []
            for i, b in taken:
                if len(a) == len(b) and (i, b) != (q, a):
                    s = 0.0
                    for x, y in zip(a, b, strict=True):
                        s += x * y
                    scored.append((-s, i))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_nearest(spark):
    items = [(i, v, i % 3) for i, v in enumerate(vectors(np.random.default_rng(3), 150))]
    items += items[:4] + ODD + [(6, [-x for x in items[6][1]], 0)]  # repeated rows, and an id with two vectors
    df = rows(spark, items)
    got = sorted(tuple(r) for r in nearest.nearest(df, df.where("vec_id % 3 = 0"), 8).collect())
    want = plain_nearest(items, 8, 3)
    assert len(got) == len(want)
    key = lambda x: {(q, i, s) for q, _, i, s in x}
    assert len(key(got) & key(want)) >= 0.95 * len(key(want))
    by_query = {}
    for q, r, i, s in got:
        by_query.setdefault(q, []).append((r, -s, i))
    for q, own in by_query.items():
        if q != 6:
            own = sorted(own)
            assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_nearest_of_nothing(spark):
    empty = rows(spark, [])
    assert nearest.nearest(empty, empty).count() == 0
    one = rows(spark, [(0, [1.0, 0.0], 1)])
    assert nearest.nearest(one, one).count() == 0
    same = rows(spark, [(i, [1.0, 0.0], 1) for i in range(60)])  # equal vectors: the smallest other ids
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(same, same.where("vec_id % 20 = 0")).collect())
    assert got == sorted((q, r + 1, i) for q in (0, 20, 40) for r, i in enumerate([i for i in range(60) if i != q][:20]))


def test_forest_finds_near_rows_in_few():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((400, 64))
    data = np.repeat(centres, 15, axis=0) + 0.25 * rng.standard_normal((6000, 64))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    forest = nearest.Forest(np.arange(6000), data)
    queries = data[::20]
    q, r, s = forest.search(queries, 10, np.full(len(queries), -np.inf))
    true = np.argsort(-(queries @ data.T), axis=1)[:, :10]
    hit = sum(len(set(r[q == k]) & set(true[k])) for k in range(len(queries)))
    assert hit >= 0.95 * true.size and forest.compared < 0.25 * len(queries) * len(data)
    assert np.allclose(s, (queries[q] * data[r]).sum(axis=1))


def test_forest_finds_all_at_the_root():
    rng = np.random.default_rng(6)
    data = rng.standard_normal((700, 24))  # nothing is near: the ascent ends where all trees meet
    forest = nearest.Forest(np.arange(700), data)
    q, r, _ = forest.search(data[:50], 5, np.full(50, -np.inf))
    true = np.argsort(-(data[:50] @ data.T), axis=1)[:, :5]
    assert all(set(r[q == k]) == set(true[k]) for k in range(50))


def plain_negatives(items, every, positives=5, negatives=5):
    taken = {(i, tuple(v), x) for i, v, x in items if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    whole = {(i, v, x): [int(np.floor(256 * c)) for c in v] for i, v, x in taken}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
    out = []
    for a in taken:
        if a[0] % every == 0:
            others = [(-score(a, b), b[0], b) for b in taken if b != a and len(b[1]) == len(a[1])]
            first = sorted(x for x in others if x[2][2] == a[2])[:positives]
            for p, pid, _ in first:
                fit = sorted(x[:2] for x in others if x[2][2] != a[2] and 80 * p >= 100 * x[0] and 100 * x[0] >= 100 * p)[:negatives]
                out += [(a[0], pid, r + 1, i, -p, -s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed):
    rng = np.random.default_rng(seed)
    items = [(i, v, int(rng.integers(3))) for i, v in enumerate(vectors(rng, 160, groups=2 + seed))]
    items += items[:4] + ODD + [(8, items[9][1], 0), (911, [1e30] * 12, 1)]  # the last is too long to take part
    df = rows(spark, items)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, df.where("vec_id % 4 = 0")).collect())
    assert got == plain_negatives(items[:-1], 4)


def test_hard_negatives_of_nothing(spark):
    empty = rows(spark, [])
    assert negatives.hard_negatives(empty, empty).count() == 0
    hot = rows(spark, [(i, [1.0, 0.5], i % 2) for i in range(80)])  # every score is the same
    got = sorted(tuple(r)[:4] for r in negatives.hard_negatives(hot, hot.where("vec_id = 20")).collect())
    assert got == [(20, p, r + 1, 2 * r + 1) for p in (0, 2, 4, 6, 8) for r in range(5)]


def test_index_bounds_lose_no_pair():
    rng = np.random.default_rng(9)
    data = np.floor(256 * rng.standard_normal((500, 40)) * np.geomspace(1, 0.01, 40))
    index, anchors = negatives.SuffixNormIndex(data), data[:30]
    true = (anchors @ data.T).astype(np.int64)
    for share in (0.02, 0.5, 0.9, 1.0):
        least = np.quantile(true, share, axis=1)
        a, r, s = index.above(anchors, least)
        want = {(i, j, int(true[i, j])) for i in range(30) for j in range(500) if true[i, j] >= least[i]}
        assert {*zip(a.tolist(), r.tolist(), s.tolist(), strict=True)} == want and len(a) == len(want)


def test_blocks_meet_every_chunk_once(spark, monkeypatch):
    monkeypatch.setattr(grid, "LEAST_ROWS", 16)
    monkeypatch.setattr(grid, "MOST_ROWS", 16)
    monkeypatch.setattr(grid, "QUERIES", 8)
    import pyarrow as pa

    def work(block, chunk):
        a, b = (x["id"].to_pylist() if len(x) else [] for x in (block, chunk))
        return pa.table({"a": pa.array([x for x in a for _ in b], pa.int64()), "b": pa.array([y for _ in a for y in b], pa.int64())})

    left = spark.range(100).selectExpr("id", "id as v1", "id % 2 as g")
    right = spark.range(40).selectExpr("id", "id as v1", "id % 4 as g")
    got = sorted(tuple(r) for r in grid.meet(left, right, ["g"], work, "a long, b long").collect())
    assert got == sorted((i, j) for i in range(100) for j in range(40) if i % 2 == j % 4)
