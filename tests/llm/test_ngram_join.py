import random

import numpy as np
import pytest

from skein.llm import ngram_join, words
from skein.llm.components import connected_components


def word_list(text):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return (text or "").encode().translate(table).split()


def grams(text, k=3):
    w = word_list(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, num=9, den=10):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        out.append((str(d), len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def got(docs, **kw):
    return sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, **{"k": 3, "num": 9, "den": 10, **kw}).collect()), key=repr)


def test_odd_rows(table, odd_rows):
    assert got(table(odd_rows)) == brute([(i, t) for i, t, _, _ in odd_rows])


def near_rows(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [str(rng.randrange(10**6)) for _ in range(rng.choice([12, 25, 60, 150]))]
        for _ in range(n // 6):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [str(rng.random())], [w[at], str(rng.random())]])
            rows.append((len(rows) * 7 % 1009, " ".join(w), "en", "a"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies(table, seed):
    rows = near_rows(seed)
    assert got(table(rows)) == brute([(i, t) for i, t, _, _ in rows])


def test_blocks_and_shuffled_members(table, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROW_BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SKETCH_BLOCK", 5)
    rows = near_rows(3, 90)
    assert got(table(rows), broadcast_rows=0) == brute([(i, t) for i, t, _, _ in rows])


def test_empty_table(table):
    assert ngram_join.jaccard_components(table([])).collect() == []


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
@pytest.mark.parametrize("known", [0, 50])
def test_near_sets_share_a_posted_column(num, den, known):
    rng = np.random.default_rng(3)
    for _ in range(1500):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64))
        b = a[rng.permutation(len(a))[: max(1, len(a) - int(rng.integers(0, 1 + len(a) // 8)))]]
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 8))).astype(np.uint64)]))
        frequent = np.unique(rng.choice(a, min(known, len(a))))
        rank = rng.permutation(len(frequent)) + 1
        both = len(np.intersect1d(a, b))
        if den * both >= num * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_join.prefix(a, frequent, rank, num, den), ngram_join.prefix(b, frequent, rank, num, den)))


def test_frequent_columns_are_posted_last():
    s = np.arange(1, 101, dtype=np.uint64)
    posted = ngram_join.prefix(s, s[:79], np.arange(1, 80), 4, 5)
    assert len(posted) == 21 and set(posted.tolist()) == set(range(80, 101))
    posted = ngram_join.prefix(s, s[:90], np.arange(1, 91), 4, 5)
    assert set(posted.tolist()) == {*range(91, 101), *range(1, 12)}


def test_frequent_grams():
    common = np.arange(5, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, np.arange(100 * i, 100 * i + 50, dtype=np.uint64)])) for i in range(1, 40)]
    gram, uses = ngram_join.frequent_grams(sets)
    assert sorted(gram.tolist()) == [0, 1, 2, 3, 4] and set(uses.tolist()) == {39}
    assert len(ngram_join.frequent_grams([])[0]) == 0


def test_pairs_compared_grow_with_the_cluster(table, monkeypatch):
    """One cluster of near copies: rows meet their representative, and are not multiplied with each other once connected."""
    rng = random.Random(6)
    base = [str(rng.randrange(10**6)) for _ in range(200)]
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a"))
    seen = {}
    for name in ("_competing", "_star_pairs"):
        real = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda rows, *a, name=name, real=real: (seen.update({name: rows.count()}), real(rows, *a))[1])
    out = ngram_join.jaccard_components(table(rows)).collect()
    assert {r["component_id"] for r in out} == {0} and seen["_competing"] == 0 and seen["_star_pairs"] < 12 * len(rows)


def test_rows_unlike_their_representative_are_compared(table, monkeypatch):
    """Rows that share their rarest columns with a smaller row that is unlike both, but are near each other."""
    rng = random.Random(9)
    rows, seen = [], []
    for g in range(12):
        mine = [f"{g}a{i}" for i in range(60)]
        other = [f"{g}b{i}" for i in range(60)]
        for v in range(4):
            w = list(mine)
            w[20 + 3 * v] = f"{g}v{v}"
            rows.append(" ".join(w))
        for v in range(6):
            w = other + mine[: 10 + 8 * v]
            rows.append(" ".join(w))
    rng.shuffle(rows)
    real = ngram_join._multiply
    monkeypatch.setattr(ngram_join, "_multiply", lambda blocks, *a: (seen.append(blocks.count()), real(blocks, *a))[1])
    docs = [(i, t, "en", "a") for i, t in enumerate(rows)]
    assert got(table(docs), k=3, num=4, den=5) == brute(list(enumerate(rows)), 4, 5)
    assert seen[0] > 0


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_sketches_rule_out_no_similar_pair(num, den):
    rng = np.random.default_rng(5)
    ruled_out = 0
    for _ in range(1500):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 700))).astype(np.uint64))
        b = a[rng.permutation(len(a))[: max(1, len(a) - int(rng.integers(0, 1 + len(a) // 6)))]]
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 3))).astype(np.uint64)]))
        both, differ = len(np.intersect1d(a, b)), len(np.setxor1d(a, b))
        x, y = ngram_join.sketch(a, num, den), ngram_join.sketch(b, num, den)
        size = min(len(x), len(y))
        least = int(np.bitwise_count(ngram_join.folded([x], size) ^ ngram_join.folded([y], size)).sum())
        assert least <= differ and (differ - least) % 2 == 0
        near = bool(ngram_join.may_be_similar(np.int64(least), np.int64(len(a)), np.int64(len(b)), num, den))
        assert near or den * both < num * (len(a) + len(b) - both)
        ruled_out += not near
    assert ruled_out > 300


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 60).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert ngram_join.overlaps(sets[:5], sets[5:]).tolist() == want


def test_word_hashes_follow_the_definition():
    texts = ["Ab cD\tab\x0bCD", "", " ", "é É x", "ab", "\x1c a\x00b a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashes, before = words.word_hashes(data, offsets)
    flat = [w for t in texts for w in word_list(t)]
    assert np.diff(before).tolist() == [len(word_list(t)) for t in texts] and len(hashes) == len(flat)
    pairs = dict(zip(flat, hashes.tolist(), strict=True))
    assert [pairs[w] for w in flat] == hashes.tolist() and len(set(pairs.values())) == len(pairs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (201, 200), (200, 201)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 201: 200}
