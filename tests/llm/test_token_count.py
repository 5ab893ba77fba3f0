import public_tokenizers
from tokenizers import Tokenizer

from skein.llm.bpe import ByteBpe
from skein.llm.token_count import TokenCounter, count_tokens, prove_whole_tokens


def test_counts(table, odd_rows):
    rows = [*odd_rows, (600, "a <|endoftext|> b", "en", "a"), (601, "it's  two\u00a0 \n\n spaces\t\x1c x", "en", "a"), (602, "word " * 600, "en", "a")]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _, _ in rows)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(table(rows)).collect())
    assert got == want


def test_proof():
    bpe = ByteBpe()
    whole = prove_whole_tokens(bpe)
    assert 30_000 < len(whole[0]) <= len(bpe.ranks)
    sample = sorted(whole[0])[::500]
    assert all(len(bpe.library_ids(s)) == 1 for s in sample)
    counter = TokenCounter(bpe, whole)
    assert counter.count(" the house's zqxjk") == len(bpe.library_ids(" the house's zqxjk"))


def test_empty_table(table):
    assert count_tokens(table([])).collect() == []


def test_other_scripts_and_long_chunks():
    bpe = ByteBpe()
    counter = TokenCounter(bpe, prove_whole_tokens(bpe))
    for text in ("слово, слова и ещё", "漢字 かな交じり文。", "наш дом's \u2003 x", "é" * 500, "a" * 5000 + " b", "мир " * 300, "\ufb01 ſ ½ ² Ⅷ x", "🎉🎉 ok"):
        assert counter.count(text) == len(bpe.library_ids(text)), text
    assert max(map(len, counter.memo)) <= ByteBpe.LONGEST
