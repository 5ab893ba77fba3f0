import math
import random
from itertools import combinations

import numpy as np

from skein.llm import langid

PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]


def segmentations(word):
    for r in range(len(word)):
        for cuts in combinations(range(1, len(word)), r):
            yield [word[i:j] for i, j in zip((0, *cuts), (*cuts, len(word)), strict=True)]


def test_forward_sums_all_segmentations():
    rng = random.Random(4)
    lattice, p = langid.Lattice(PIECES), [rng.random() for _ in PIECES]
    index = lattice.index
    for word in ("▁abab", "▁babc", "▁a", "▁bbabab"):
        weight = {tuple(s): math.prod(p[index[x]] if x in index else langid.UNKNOWN for x in s) for s in segmentations(word) if all(x in index or len(x) == 1 for x in s)}
        edges = lattice.edges(word)
        a = langid.forward(edges, len(word), p)
        total = sum(weight.values())
        assert math.isclose(a[len(word)] * math.exp(a[-1]), total, rel_tol=1e-9)
        counts = langid.expected_counts(edges, len(word), p)
        for k, piece in enumerate(PIECES):
            want = sum(w * s.count(piece) for s, w in weight.items()) / total
            assert math.isclose(counts.get(k, 0.0), want, rel_tol=1e-9, abs_tol=1e-12)


def test_long_words_do_not_vanish():
    lattice, p = langid.Lattice(PIECES), [1e-4] * len(PIECES)
    a = langid.forward(lattice.edges("▁" + "ab" * 2000), 4001, p)
    assert math.isfinite(a[-1]) and a[4001] > 0


def test_long_words_are_counted():
    lattice, p = langid.Lattice(PIECES), [0.3, 1e-3, 2e-3, 5e-4, 1e-4, 3e-4, 1e-5]
    for word in ("▁abab", "▁babc", "▁bbabab"):
        edges = lattice.edges(word)
        want, got = langid.expected_counts(edges, len(word), p), langid._long_counts(edges, len(word), p)
        assert want.keys() == got.keys() and all(math.isclose(want[k], got[k], rel_tol=1e-9) for k in want)
    for n in (30, 300, 3000):
        word = "▁" + "abbab" * n
        counts = langid.expected_counts(lattice.edges(word), len(word), p)
        assert math.isclose(sum(len(PIECES[k]) * x for k, x in counts.items()), len(word), rel_tol=1e-9)


def test_pieces_with_signs_are_looked_up():
    lattice = langid.Lattice([*PIECES, "a1", "b-b", "Ab"])
    assert {"a1", "b-b"} <= set(lattice.index) and "Ab" not in lattice.index
    assert (1, 3, len(PIECES)) in lattice.edges("▁a1b")


def test_held_out_accuracy(table):
    rng = random.Random(8)
    vocab = {"en": ["the", "and", "tion", "with", "that", "house"], "de": ["der", "und", "keit", "mit", "haus", "schön"], "fr": ["le", "et", "avec", "que", "maison", "été"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(30)), lang, "a") for i in range(150) for lang in [rng.choice(list(vocab))]]
    docs = table(rows)
    langs, tables = langid.learn(docs)
    assert langs == ["de", "en", "fr"] and np.allclose(tables.sum(axis=1), 1)
    out = {r["doc_id"]: r for r in langid.identify(docs, langs, tables).collect()}
    assert all(out[i]["lang_pred"] == lang and 0 <= out[i]["score"] <= 1 for i, _, lang, _ in rows)


def test_odd_rows(table, odd_rows):
    docs = table([*odd_rows, (500, "123 !!", "en", "a")])
    langs, tables = langid.learn(docs)
    out = langid.identify(docs, langs, tables).collect()
    assert len(out) == len(odd_rows) + 1
    und = {r["doc_id"] for r in out if r["lang_pred"] == "und"}
    assert und == {4, 5, 6, 500}
    empty = table([])
    assert langid.learn(empty)[0] == []
    assert {r["lang_pred"] for r in langid.identify(docs, [], np.zeros((0, 1))).collect()} == {"und"}
    assert langid.identify(empty, langs, tables).collect() == []


def test_memo_overflow(monkeypatch):
    want = langid.Scorer(PIECES, np.full((2, len(PIECES)), 0.1)).text("a b ab c")
    monkeypatch.setattr(langid, "MEMO_BYTES", 16_000)
    scorer = langid.Scorer(PIECES, np.full((2, len(PIECES)), 0.1))
    assert scorer.most == 1000
    scorer.memo.update({f"x{i}": 0 for i in range(998)})
    assert np.allclose(scorer.text("a b ab c"), want) and len(scorer.memo) == 4
    long = "ab" * 100
    assert np.allclose(scorer.text(long), scorer.word(long)) and long not in scorer.memo


def test_text_without_blanks_is_learned(table):
    """Languages written without blanks: each text is one long word."""
    rng = random.Random(12)
    parts = {"zh": ["\u4e00", "\u4e2d\u56fd", "\u4eba\u6c11", "\u5927\u5b66"], "ja": ["\u306e", "\u3068\u3044\u3046", "\u4eba", "\u3067\u3059"]}
    rows = [(i, "".join(rng.choice(parts[lang]) for _ in range(80)), lang, "a") for i in range(80) for lang in [("zh", "ja")[i % 2]]]
    docs = table(rows)
    langs, tables = langid.learn(docs)
    pieces = langid.vocabulary()
    ja = tables[langs.index("ja")]
    assert ja[pieces.index("\u306e")] > 0.01 > 100 * tables[langs.index("zh")][pieces.index("\u306e")]
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langs, tables).collect()}
    assert all(out[i] == lang for i, _, lang, _ in rows)
