"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over all its
segmentations into pieces, by a forward pass; a text's is the product over its words. Probabilities are learned by
expectation maximisation: expected piece counts under all segmentations, first with equal probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.batches import written
from skein.plans.storage import materialize

#: Labelled documents of each language to learn from, at most; which ones depends on their ids alone.
SAMPLE = 2_000
ROUNDS = 2
SMOOTH = 0.1
UNKNOWN = 1e-7
#: Words that a worker remembers, at most, and bytes of their numbers; longer words aren't remembered.
MEMO = 800_000
MEMO_BYTES = 128 << 20
LONGEST = 64
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces without control and byte pieces; ``▁`` stands for the blank before a word."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Lattice:
    """Segmentations of words into the vocabulary's pieces, single unknown characters included.

    Words are in lower case, so of the longer pieces only those in lower case are looked up. One dictionary holds pieces and
    their prefixes, which have no number.
    """

    def __init__(self, pieces: list[str]):
        self.index = {p: i for i, p in enumerate(pieces) if len(p) == 1 or p == p.lower()}
        self.known = {p[:i]: -1 for p in self.index for i in range(1, len(p))} | self.index

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """``(from, to, piece)`` by ``from``; piece -1 is a character that is no piece."""
        get, out, n = self.known.get, [], len(word)
        for i in range(n):
            k = get(word[i])
            out.append((i, i + 1, -1 if k is None else k))
            if k is None:
                continue
            for j in range(i + 2, n + 1):
                k = get(word[i:j])
                if k is None:
                    break
                if k >= 0:
                    out.append((i, j, k))
        return out


def forward(edges: list[tuple[int, int, int]], n: int, p) -> list[float]:
    """Sums over all segmentations of each prefix, scaled so that long words don't vanish (log of the scale is the last entry)."""
    a, scale = [0.0] * (n + 2), 0.0
    a[0], at = 1.0, 0
    for i, j, k in edges:
        if i != at:
            at = i
            if a[i] < 1e-200:
                top = max(a[i : n + 1])
                if top <= 0:
                    break
                for x in range(i, n + 1):
                    a[x] /= top
                scale += math.log(top)
        a[j] += a[i] * (p[k] if k >= 0 else UNKNOWN)
    a[n + 1] = scale
    return a


def expected_counts(edges: list[tuple[int, int, int]], n: int, p) -> dict[int, float]:
    """Expected number of uses of each piece, over all segmentations by their probability."""
    a = forward(edges, n, p)
    if a[n + 1] or a[n] <= 0:
        return _long_counts(edges, n, p)
    b = [0.0] * (n + 1)
    b[n] = 1.0
    out: dict[int, float] = {}
    for i, j, k in reversed(edges):
        q = (p[k] if k >= 0 else UNKNOWN) * b[j]
        b[i] += q
        if k >= 0:
            out[k] = out.get(k, 0.0) + a[i] * q / a[n]
    return out


def _add_logs(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def _long_counts(edges: list[tuple[int, int, int]], n: int, p) -> dict[int, float]:
    """The expected counts by logarithms, for words whose probability is too small for a number."""
    steps = [(i, j, k, math.log(q)) for i, j, k in edges if (q := p[k] if k >= 0 else UNKNOWN) > 0]
    a, b = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    a[0] = b[n] = 0.0
    for i, j, _, q in steps:
        a[j] = _add_logs(a[j], a[i] + q)
    out: dict[int, float] = {}
    if a[n] == -math.inf:
        return out
    for i, j, k, q in reversed(steps):
        b[i] = _add_logs(b[i], q + b[j])
        if k >= 0:
            out[k] = out.get(k, 0.0) + math.exp(a[i] + q + b[j] - a[n])
    return out


def normal_word(token: str) -> str:
    """Lower case without what isn't a letter at either end, after the mark of a word's begin; empty if no letter is left."""
    w = _EDGES.sub("", token)
    return "▁" + w if w else ""


def crc_mod4(doc_id):
    """Column: crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def word_counts(docs: DataFrame, sample: int) -> DataFrame:
    """``lang, word, n`` over at most about ``sample`` learnable documents of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_mod4(F.col("doc_id")), F.lit(0)) != 2))
    shares = materialize(known.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count(F.lit(1))).alias("share")), "lang-shares")  # small, so Spark broadcasts it
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.join(shares, "lang").where(u < F.col("share")).select("lang", "text")

    def run(batches):
        counts: dict[str, Counter] = {}

        def flush():
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(text.lower().split())
                if sum(map(len, counts.values())) > 200_000:
                    yield flush()
        yield flush()

    partial = drawn.mapInArrow(run, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order, and probabilities by language and piece. Reads ``doc_id, text, lang`` of learnable documents only.

    Null texts and languages are left out, empty texts teach nothing, repeated rows count each, other columns are ignored; an empty table
    teaches no language.

    What comes to the driver is a number for each language and piece that occurs.
    """
    counted = written(word_counts(docs, sample), "lang-words")
    pieces = vocabulary(path)
    place = {lang: i for i, lang in enumerate(sorted(r["lang"] for r in counted.select("lang").distinct().collect()))}
    tables = np.full((len(place), len(pieces)), 1.0 / len(pieces))
    for _ in range(rounds if place else 0):
        given = [t.tolist() for t in tables]

        def run(batches, given=given):
            lattice, sums = Lattice(pieces), {}
            for b in batches:
                for lang, token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    w = normal_word(token)
                    if w:
                        mine = sums.setdefault(lang, {})
                        for k, x in expected_counts(lattice.edges(w), len(w), given[place[lang]]).items():
                            mine[k] = mine.get(k, 0.0) + n * x
            rows = [(lang, k, x) for lang, c in sums.items() for k, x in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], names=["lang", "piece", "x"])

        sums = np.full(tables.shape, SMOOTH)
        for r in counted.mapInArrow(run, "lang string, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).collect():
            sums[place[r["lang"]], r["piece"]] += r["x"]
        tables = sums / sums.sum(axis=1, keepdims=True)
    return list(place), tables


class Scorer:
    """Log-probabilities of words for all languages, kept in a bounded memo."""

    def __init__(self, pieces: list[str], tables: np.ndarray):
        self.lattice = Lattice(pieces)
        self.tables = [[*t.tolist(), UNKNOWN] for t in tables]  # piece -1 is the last
        self.memo: dict[str, int] = {}
        self.most = max(1000, min(MEMO, MEMO_BYTES // (8 * max(1, len(tables)))))
        self.logs = np.zeros((self.most + 1, len(tables)))

    def word(self, token: str) -> list[float]:
        w = normal_word(token)
        if not w:
            return [0.0] * len(self.tables)
        if (known := self.memo.get(w[1:])) is not None:
            return self.logs[known]  # the same word without marks around it
        edges, n, out = self.lattice.edges(w), len(w), []
        if n <= 40:  # too short to vanish, as a rule
            for t in self.tables:
                a = [0.0] * (n + 1)
                a[0] = 1.0
                for i, j, k in edges:
                    a[j] += a[i] * t[k]
                out.append(a[n])
            if min(out) > 1e-280:
                return [math.log(x) for x in out]
            out = []
        for t in self.tables:
            a = forward(edges, n, t)
            out.append(math.log(max(a[n], 1e-300)) + a[n + 1])
        return out

    def text(self, text: str) -> np.ndarray:
        words, memo = text.lower().split(), self.memo
        total, at, step = np.zeros(len(self.tables)), 0, min(50_000, self.most // 2)
        while at < len(words):
            part = words[at : at + step]
            at += step
            for w in part:
                if len(w) > LONGEST:
                    total += self.word(w)
            part = [w for w in part if len(w) <= LONGEST]
            if len(memo) + len(part) > self.most:
                missing = sum(1 for w in set(part) if w not in memo)
                if len(memo) + missing > self.most:
                    memo.clear()
            for w in part:
                if w not in memo:
                    self.logs[len(memo)] = self.word(w)
                    memo[w] = len(memo)
            total += self.logs[np.fromiter(map(memo.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return total


def identify(docs: DataFrame, langs: list[str], tables: np.ndarray, path: str | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs(doc_id, text, ...)``; score is the posterior with equal priors.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. Ties go to the first language; so do texts of
    nothing but characters outside the vocabulary, which cost the same in all languages, with a score of one in the number of languages.
    Repeated rows each give a row; other columns are ignored, so their names can't clash; an empty table gives an empty result.
    """
    scorers = []

    def run(batches):
        if not scorers:
            scorers.append(Scorer(vocabulary(path), tables))
        for b in batches:
            preds, scores = [], []
            for text in b.column(1).to_pylist():
                if not langs or not text or not any(map(str.isalpha, text)):
                    preds.append("und")
                    scores.append(0.0)
                    continue
                logs = scorers[0].text(text)
                best = int(np.argmax(logs))
                preds.append(langs[best])
                scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(slim.mapInArrow(run, "doc_id long, lang_pred string, score double"), "languages")
