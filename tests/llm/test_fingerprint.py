import hashlib
import random

import pytest

from skein.llm import fingerprint as fp


def shingles(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    w = [x for x in text.lower().split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_whole_table(table, odd_rows):
    docs = table(odd_rows)
    out = fp.compare_edited(docs).collect()
    assert len(out) == len(odd_rows)
    order = sorted({(i, t or "") for i, t, _, _ in odd_rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    at = {r: k for k, r in enumerate(order)}
    by_id = {i: t for i, t in order}
    prints = {}
    for r in out:
        text = by_id[r["doc_id"]]
        following = order[(at[r["doc_id"], text] + 1) % len(order)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == pytest.approx(likeness(shingles(text), shingles(edited)), abs=0.2)
        assert r["near_next"] == pytest.approx(likeness(shingles(text), shingles(following)), abs=0.2)
    assert prints[""] == prints[" \t\n "] == ""


def test_estimates_are_unbiased(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        w = [str(rng.random()) for _ in range(rng.choice([8, 40, 300]))]
        cut = rng.randrange(len(w))
        rows.append((i, " ".join(w), " ".join(w[:cut] + [str(rng.random()) for _ in w[cut:]])))
    df = fp.with_fingerprint(fp.with_fingerprint(spark.createDataFrame(rows, "i int, a string, b string"), "a", "fa"), "b", "fb")
    got = df.select("a", "b", fp.likeness(df.fa, df.fb).alias("x")).collect()
    errors = [r["x"] - likeness(shingles(r["a"]), shingles(r["b"])) for r in got]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.25


def test_no_python_in_the_plan(table, odd_rows):
    plan = fp.compare_edited(table(odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_single_document_and_empty_table(table):
    r = fp.compare_edited(table([(1, "a b c d e f", "en", "a")])).first()
    assert r["near_next"] == 1.0
    assert fp.compare_edited(table([])).collect() == []
