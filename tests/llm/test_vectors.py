import math

import numpy as np

from panelspark.llm import vectors


def brute(rows, cosine=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(ok):
        for j, y in ok[:k]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (links[i], find(i)) for i, _ in rows}


def run(spark, rows):
    docs = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, cls long")
    return vectors.near_duplicates(docs).collect()


def test_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    v = [*base, *(base[rng.integers(0, 8, 120)] + 0.25 * rng.standard_normal((120, 16))), *(base[rng.integers(0, 4, 20)] * 3), *[base[0]] * 30]
    rows = [(int(i * 3 + 1), np.float32(x).tolist()) for i, x in enumerate(v)]
    exp = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in run(spark, rows)} == exp
    assert max(n for n, _ in exp.values()) > 30
    monkeypatch.setattr(vectors, "CHUNK", 7)  # many chunks in a cell
    assert {r.vec_id: (r.n_links, r.component_id) for r in run(spark, rows)} == exp


def test_edge_cases(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [math.inf, 1.0]), (6, [math.nan, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (10, [5.0]), (11, [-5.0]), (12, [3.0]), (13, [1e-30, 2e-30])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, rows)}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (2, 7), 8: (2, 7), 9: (0, 9), 10: (1, 10), 11: (0, 11), 12: (1, 10), 13: (2, 7)}
    out = run(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])])
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in out) == [("1", 1, True), ("1", 1, True), ("None", 0, True)]
    assert run(spark, []) == []


def test_pairs_of_tiles_are_not_shuffled(spark, monkeypatch):
    """Vectors meet as pairs of staged tiles: no exchange by key copies them, however many tiles there are; also twice as many unlike rows."""
    plans = []
    real = vectors.stage

    def stage(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(vectors, "stage", stage)
    monkeypatch.setattr(vectors, "CHUNK", 16)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((90, 24))
    v = [*base, *(base[:45] + 0.25 * rng.standard_normal((45, 24))), *base[:9] * 1e200]  # the last ones need double precision
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(docs).collect()}
    assert got == brute([(i, (np.array(x) / np.abs(x).max()).tolist()) for i, x in rows])
    assert sum(n > 0 for n, _ in got.values()) > 50
    assert "hashpartitioning" not in plans[-1] and len(plans) == 3
