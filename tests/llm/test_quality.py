import random
import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from skein.llm import quality


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        text = " ".join(w) + "." if good else (" ".join([w[0]] * len(w)) if rng.random() < 0.5 else " ".join(x.upper() + "!!" for x in w))
        rows.append((i, text, "en", "a"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, table):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.classify(table(rows), lab).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out["doc_id"], out["held_out"], strict=True))
    assert ((out["score"] >= 0.7) == (out["predicted"] == 1)).all()
    truth = dict((i, q) for i, q, _ in labels)
    held = out[out["held_out"]]
    assert np.mean([truth[i] == p for i, p in zip(held["doc_id"], held["predicted"], strict=True)]) > 0.95


def test_held_out_labels_are_not_used(spark, table):
    rows, labels = corpus(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    docs = table(rows)
    a, b = (sorted(quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
    assert [r["predicted"] for r in a] == [r["predicted"] for r in b]


def test_odd_rows(spark, table, odd_rows):
    rows, labels = corpus(100)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(table(odd_rows), lab).collect()
    assert len(out) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.classify(table([]), lab).collect() == []
    none = quality.classify(table(odd_rows), lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


@given(st.lists(st.tuples(st.integers(1, 5), st.floats(0, 1)), min_size=1, max_size=30))
def test_pooled_is_monotone(cells):
    n = np.array([c for c, _ in cells], float)
    at, value = quality.pooled(np.arange(len(cells), dtype=float), n, n * np.array([p for _, p in cells]))
    assert (np.diff(value) >= -1e-9).all() and (np.diff(at) > 0).all()


def test_keep_returns_rows_unchanged(spark, table):
    rows, labels = corpus(200)
    docs = table([*rows, (900, None, "en", "a")])
    model = quality.fit(quality.document_statistics(docs).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = quality.keep(docs, model, 0.5)
    assert kept.schema == docs.schema and 0 < kept.count() < len(rows)
    assert quality.keep(docs, model, -1.0).count() == len(rows) + 1


def test_equations_against_plain_numpy(spark, table):
    rows, labels = corpus(150)
    docs = table(rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(quality.document_statistics(docs).cache(), lab)
    x = np.concatenate([quality.statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t, _, _ in rows])
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i, *_ in rows])
    y = np.array([q for _, q, _ in labels], float)
    known, fit = fold != 2, (fold != 2) & (fold != 3)
    assert np.allclose(model.mean, x[known].mean(axis=0)) and np.allclose(model.spread, np.where(x[known].std(axis=0) > 1e-9, x[known].std(axis=0), 1.0))
    z = model.features(x[fit])
    left = z.T @ z + quality.RIDGE * fit.sum() / (quality.FOURIER + 1) * np.eye(quality.FOURIER + 1)
    assert np.allclose(left @ model.weights, z.T @ y[fit], atol=1e-6)
    raw = model.raw(x[fold == 3])
    cell = np.clip(np.floor((raw + 0.5) * (quality.CELLS / 2)), 0, quality.CELLS - 1)
    n = np.array([(cell == c).sum() for c in np.unique(cell)], float)
    hits = np.array([y[fold == 3][cell == c].sum() for c in np.unique(cell)])
    at = np.array([raw[cell == c].mean() for c in np.unique(cell)])
    level = brute_isotonic(n, hits)
    keep = [0, *(np.nonzero(np.diff(level) > 1e-12)[0] + 1)]
    assert np.allclose(model.score, level[keep])
    ends = [*keep[1:], len(n)]
    assert np.allclose(model.at, [(at[a:b] * n[a:b]).sum() / n[a:b].sum() for a, b in zip(keep, ends, strict=True)])


def brute_isotonic(n, hits):
    """The least-squares non-decreasing fit by its min-max formula."""
    mean = lambda a, b: hits[a : b + 1].sum() / n[a : b + 1].sum()
    return np.array([max(min(mean(a, b) for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))])


@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 5)), min_size=1, max_size=14))
def test_pooled_against_min_max(cells):
    n = np.array([c for c, _ in cells], float)
    hits = np.array([min(h, c) for c, h in cells], float)
    at, value = quality.pooled(np.arange(len(cells), dtype=float), n, hits)
    level = brute_isotonic(n, hits)
    assert np.allclose(value, level[[0, *(np.nonzero(np.diff(level) > 1e-12)[0] + 1)]])
