import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import packing
from skein.llm.bpe import ByteBpe, chunks


def brute_bins(lengths, size):
    """The same greedy rule bin by bin, over single documents."""
    left, bins = sorted(lengths), []
    while left:
        content, gap = [], size
        while fit := [x for x in left if x <= gap]:
            x = max(fit)
            left.remove(x)
            content.append(x)
            gap -= x
        if gap and len(content) > 1:
            small = min(content)
            pairs = [(left[i] + left[j], left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if small < left[i] + left[j] <= gap + small]
            if pairs:
                best = max(p[0] for p in pairs)
                _, a, b = next(p for p in pairs if p[0] == best)
                content.remove(small)
                left.append(small)
                left.remove(a)
                left.remove(b)
                left.sort()
                content += [a, b]
        bins.append(sorted(content))
    return bins


@given(st.lists(st.integers(1, 30), max_size=40))
@settings(max_examples=60, deadline=None)
def test_counts_pack_like_single_documents(lengths):
    bins = packing.best_two_fit(dict(Counter(lengths)), 30)
    spread = [sorted(b) for b, n in bins for _ in range(n)]
    assert all(sum(b) <= 30 for b in spread)
    assert Counter(x for b in spread for x in b) == Counter(lengths)
    assert len(spread) == len(brute_bins(lengths, 30))


def test_replacement_is_tighter():
    assert packing.best_two_fit({60: 1, 35: 1, 21: 1, 19: 1}, 100) == [((60, 19, 21), 1), ((35,), 1)]


def test_tightest_pair_is_found():
    """Bin by bin over random counts, the replacement is the tightest that the documents left allow."""
    rng = random.Random(7)
    for _ in range(400):
        counts = {x: rng.randint(1, 2) for x in rng.sample(range(1, 60), rng.randint(3, 12))}
        bins = packing.best_two_fit(counts, 60)
        lengths = [x for x, n in counts.items() for _ in range(n)]
        assert sorted(x for b, n in bins for _ in range(n) for x in b) == sorted(lengths)
        assert [sorted(b) for b, n in bins for _ in range(n)][0] == brute_bins(lengths, 60)[0] or sum(bins[0][0]) == sum(brute_bins(lengths, 60)[0])


def test_places_are_gapless(table, odd_rows):
    docs = table(odd_rows)
    out = packing.pack_documents(docs, 64).toPandas()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 64
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _, _ in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (a, n) in enumerate(packing.cut(len(ids), 64)):
            want[i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())] += 1
    got = Counter((None if r[0] != r[0] else int(r[0]), *map(int, r[1:5])) for r in out.itertuples(index=False))
    assert got == want


def test_hot_length_and_lower_bound(table):
    rng = random.Random(1)
    docs = table([(i, "same text", "en", "a") for i in range(300)] + [(1000 + i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 40))), "en", "b") for i in range(200)])
    out = packing.pack_documents(docs, 64).toPandas()
    assert out["sequence_id"].nunique() <= 1.05 * out["length"].sum() / 64 + 1


def test_empty_table(table):
    assert packing.pack_documents(table([])).collect() == []


@pytest.mark.parametrize("n,size,want", [(0, 4, [(0, 0)]), (4, 4, [(0, 4)]), (5, 4, [(0, 1), (1, 4)]), (8, 4, [(0, 4), (4, 4)])])
def test_only_the_first_piece_is_short(n, size, want):
    assert packing.cut(n, size) == want


@given(st.text(alphabet=st.sampled_from(list("ab'sé漢\u00a0\u2003\t\n\r\x1c \x85.!9🎉")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_chunks_encode_alone(text):
    bpe = _bpe()
    assert "".join(chunks(text)) == text
    assert np.frombuffer(bpe.id_bytes(text), "<u4").tolist() == bpe.library_ids(text)


_shared = []


def _bpe():
    if not _shared:
        _shared.append(ByteBpe())
    return _shared[0]


def test_special_strings():
    bpe = _bpe()
    assert np.frombuffer(bpe.id_bytes("a <|endoftext|> b"), "<u4").tolist() == bpe.library_ids("a <|endoftext|> b")
