import math
import random

import numpy as np
import pytest

from skein.llm import topk


def brute(rows, k):
    """Every row is a candidate but the query's own, so repeated ids and rows count each."""

    def cells(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]

    good = [(i, c) for i, v in rows if i is not None and (c := cells(v)) is not None]
    out = []
    for at, (q, a) in enumerate(good):
        if q % 50 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for j, (i, b) in enumerate(good) if j != at)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 0, 0.0) for i, v in rows], "vec_id long, embedding array<float>, lane string, row int, norm double")
    v = topk.quantise(df, "vec_id", "embedding")
    return sorted(tuple(r) for r in topk.top_k(v.where("vec_id % 50 = 0"), v, 5, **kw).collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(2000, None), (2001, [None] + [0.1] * 15), (2002, [float("nan")] * 16), (2050, [float("inf")] * 16), (None, [0.1] * 16), (3, rows[3][1]), (2100, [0.0] * 16), (2101, [0.5] * 4)]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, rows, query_block=3, block=64) == brute(rows, 5)


def test_several_vectors_of_one_id(spark):
    rng = random.Random(2)
    rows = [(50, [rng.gauss(0, 1) for _ in range(4)]) for _ in range(6)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1, 12)]
    rows += [(100, [1.0, 2.0, 3.0, 4.0])] * 3
    want = brute(rows, 5)
    assert len(want) == 9 * 5 and run(spark, rows) == want
    assert run(spark, rows, query_block=2, block=4) == want


def test_large_values(spark):
    rng = random.Random(3)
    rows = [(0, [5e6, 1.0]), (1, [5e6, 1.0]), (2, [0.5, 0.25]), (50, [-5e6, 2.0]), (51, [3e7, -7e6])]
    rows += [(100 + i, [rng.choice([1, 1e3, 1e6, 4e8]) * rng.gauss(0, 1) for _ in range(2)]) for i in range(60)]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, rows, query_block=4, block=8) == brute(rows, 5)
    huge = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0]), (3, [3e38, 3e38]), (50, [2e38, -1e10])]
    assert run(spark, huge) == brute(huge, 5)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert run(spark, rows) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, []), (1, []), (2, [1.0])]) == [(0, 1, 1, 0), (0, 2, 2, 0)]


@pytest.mark.parametrize("dense", [0.0, 0.05, 2.0])
def test_max_score_skips_nothing(monkeypatch, dense):
    monkeypatch.setattr(topk, "DENSE", dense)
    rng = np.random.default_rng(2)
    cells = rng.integers(-100, 100, (500, 12)).astype(float)
    cells[:20] *= 10
    ids = rng.permutation(500)
    q = rng.integers(-100, 100, (50, 12)).astype(float)
    own = np.where(np.arange(50) % 2, -1, np.arange(50))
    for floors in (np.full(50, -np.inf), np.sort(q @ cells.T, axis=1)[:, -7]):
        at, hit, score = topk.max_score(q, cells, floors, own, ids, 5)
        want = []
        for i in range(50):
            each = sorted((-s, ids[j], j) for j, s in enumerate((q[i] @ cells.T).tolist()) if j != own[i])[:5]
            want += [(i, j, -s) for s, _, j in each]
        assert list(zip(at.tolist(), hit.tolist(), score, strict=True)) == want
