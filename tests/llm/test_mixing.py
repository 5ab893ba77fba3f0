from collections import defaultdict

import pytest

from skein.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_copies(table, odd_rows):
    out = mixing.mix(table(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    sizes, taken, got = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        got[r["source"]] = (r["source_size"], r["target"])
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] <= 2
    assert sum(sizes.values()) == sum(len((t or "").split()) for _, t, _, _ in odd_rows)
    want = brute_targets(sizes)
    for s, (size, target) in got.items():
        assert size == sizes[s] and target == pytest.approx(want[s])
    largest = {s: max(r["size"] for r in out if r["source"] == s) for s in want}
    for s in want:  # within one document's words of the target
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_reruns_agree_and_rows_follow(table, odd_rows):
    docs = table(odd_rows)
    a, b = (sorted(mixing.mix(docs).collect(), key=repr) for _ in range(2))
    assert a == b
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert rows.count() == sum(r["copies"] for r in a)


def test_whole_copies_then_sample(table):
    docs = table([(i, "w " * 10, "en", "a") for i in range(50)] + [(100 + i, "w " * 10, "en", "b") for i in range(50)])
    out = mixing.mix(docs, (3.0, 1.0), 1.0, 2.0).collect()
    copies = defaultdict(list)
    for r in out:
        copies[r["source"]].append(r["copies"])
    assert set(copies["a"]) == {1, 2} and sum(copies["a"]) == 75
    assert set(copies["b"]) == {0, 1} and sum(copies["b"]) == 25


def test_empty_table(table):
    assert mixing.mix(table([])).collect() == []


def test_no_words_at_all(table):
    out = mixing.mix(table([(1, None, "en", "a"), (2, "", "en", "b")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 2


def near_target(out):
    taken, most, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    return all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6 for s in target)


def test_repeated_rows_are_drawn_one_by_one(table):
    rows = [(1, "w " * 10, "en", "a")] * 100
    out = mixing.mix(table(rows)).collect()
    assert sum(r["taken"] for r in out) == 1500 and {r["copies"] for r in out} == {1, 2}
    rows = [(None, "w " * 10, "en", "a")] * 60 + [(i, "w " * 10, "en", "a") for i in range(40)]
    docs = table(rows)
    out = mixing.mix(docs, (1.0,), 0.5).collect()
    assert len(out) == 100 and sum(r["taken"] for r in out) == 500
    copies = mixing.mixed_rows(docs, (1.0,), 0.5).collect()
    assert len(copies) == 50 and sum(r["doc_id"] is None for r in copies) == sum(r["copies"] for r in out if r["doc_id"] is None)


def test_a_million_equal_rows(spark):
    docs = spark.range(1_000_000).selectExpr("7L AS doc_id", "'a b c' AS text", "'s' AS source")
    docs = docs.union(spark.range(1000).selectExpr("id AS doc_id", "'a b c d' AS text", "'t' AS source"))
    out = mixing.mix(docs, (1.0, 1.0), 0.3).groupBy("source").agg({"taken": "sum", "target": "max", "doc_id": "count"}).collect()
    assert {r["source"]: r["count(doc_id)"] for r in out} == {"s": 1_000_000, "t": 1000}
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 4 for r in out)


def test_plan_has_no_python(table, odd_rows):
    plan = mixing.mixed_rows(table(odd_rows))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_inclusion_probabilities(spark):
    """Over many draws each document is taken as often as its probability says, and words come near what is left every time."""
    sizes = [1 + (7 * i) % 40 for i in range(40)] + [400, 90]
    rows = [(1000 * d + i, "w " * n, f"s{d:03d}") for d in range(250) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, (1.0,), 0.5).collect()
    assert near_target(out)
    hits = defaultdict(int)
    for r in out:
        hits[r["doc_id"] % 1000] += r["copies"]
    total = sum(sizes)
    lead = lambda n: n >> max(n.bit_length() - 3, 0) << max(n.bit_length() - 3, 0)
    low, high = 0.0, 10.0
    for _ in range(100):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(1, c * lead(n)) * n for n in sizes) < 0.5 * total else (low, c)
    assert min(1, c * lead(400)) == 1
    for i, n in enumerate(sizes):
        want = min(1, c * lead(n))
        assert abs(hits[i] / 250 - want) < 0.12, (n, hits[i] / 250, want)
