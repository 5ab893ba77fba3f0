"""Quality classification: random Fourier features, ridge regression by normal equations, isotonic calibration.

Statistics of a document are standardised and mapped to cosines of random projections, whose inner products approximate a Gaussian
kernel. Partitions sum their share of the normal equations; the driver adds these few matrices and solves for the ridge
scores. Another part of the labelled rows calibrates the scores: pooled adjacent violators over counts per score cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.batches import bounded_batches, give_back, written
from skein.llm.langid import crc_mod4
from skein.llm.words import text_chunks, word_hashes
from skein.plans.storage import materialize

#: Labelled rows to fit on, at most (about); which ones depends on their ids alone.
SAMPLE = 200_000
FOURIER = 384
RIDGE = 1e-3
WIDTH = 3.0
PARTS = 16
CELLS = 2000

_KINDS = np.zeros((256, 9))
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b"!", b"|", b"#$%&*+=<>@^_~`\\/{}[]", b".,;:?", b"\n", range(128, 256))):
    _KINDS[list(_set), _i] = 1
STATISTICS = 20


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text: shares of kinds of bytes, word lengths, repetition of words, pairs and triples."""
    out = np.zeros((len(offsets) - 1, STATISTICS))
    words, before = word_hashes(data, offsets)
    blank = np.isin(data, np.array([9, 10, 11, 12, 13, 32], np.uint8))
    blanks = np.concatenate([[0], np.cumsum(blank)])[offsets]
    for i in range(len(out)):
        own, n = data[offsets[i] : offsets[i + 1]], before[i + 1] - before[i]
        if not n:
            continue
        size = len(own)
        shares = np.bincount(own, minlength=256) @ _KINDS / size
        w = words[before[i] : before[i + 1]]
        _, counts = np.unique(w, return_counts=True)
        pairs = w[1:] * np.uint64(0x9E3779B97F4A7C15) + w[:-1]
        triples = pairs[1:] * np.uint64(0x9E3779B97F4A7C15) + w[:-2]
        out[i, :9] = np.sqrt(shares)
        out[i, 9] = np.log1p(n)
        out[i, 10] = np.log((size - (blanks[i + 1] - blanks[i])) / n)
        out[i, 11] = len(counts) / n
        out[i, 12] = counts.max() / n
        out[i, 13] = (w[1:] == w[:-1]).mean() if n > 1 else 0
        out[i, 14] = len(np.unique(pairs)) / len(pairs) if n > 1 else 1
        out[i, 15] = len(np.unique(triples)) / len(triples) if n > 2 else 1
        out[i, 16] = shares[0] / max(shares[0] + shares[1], 1e-9)
        out[i, 17] = np.sqrt(shares[5] * size / n)
        out[i, 18] = np.sqrt((shares[3] + shares[4]) * size / n)
        out[i, 19] = np.sqrt(shares[6] * size / n)
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, x`` per row; a null text is empty and has zeros. One pass over the texts."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(crc_mod4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"))

    def run(batches):
        for b in batches:
            parts = [statistics(data, offsets) for _, data, offsets in text_chunks(b.column(1))]
            x = np.concatenate(parts) if parts else np.zeros((0, STATISTICS))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATISTICS, dtype=np.int32)), flat)], names=["doc_id", "held_out", "x"])
        give_back()

    return slim.mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


def labelled(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` that have a label. Ids are broadcast up to a count, and joined by a shuffle beyond."""
    ids = materialize(labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("_id")).distinct(), "labelled-ids")
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    return docs.join(ids, docs["doc_id"] == ids["_id"], "left_semi")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), STATISTICS)


class Model:
    """Standardisation, random projection, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turn = rng.normal(0, 1 / WIDTH, (STATISTICS, FOURIER))
        self.shift = rng.uniform(0, 2 * np.pi, FOURIER)
        self.weights = np.zeros(FOURIER + 1)
        self.at, self.score = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.turn + self.shift
        return np.concatenate([np.sqrt(2 / FOURIER) * np.cos(z), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.score), 0.0, 1.0)


def pooled(at: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit to ``hits / n`` over increasing ``at``: the blocks' mean places and values."""
    blocks: list[list[float]] = []
    for x, c, h in zip(at, n, hits, strict=True):
        blocks.append([x * c, c, h])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows of ``stats`` that aren't held out; ``labels(doc_id, quality)``, null labels and ids are left out.

    A document with several labels counts once for each. Without any labelled row every score is 0.5.
    """
    with bounded_batches(stats.sparkSession):
        return _fit(stats, labels, sample)


def _fit(stats: DataFrame, labels: DataFrame, sample: int) -> Model:
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = stats.where(~F.col("held_out")).join(known, "doc_id").select("x", "y", crc_mod4(F.col("doc_id")).alias("fold"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("u"))
    rows = materialize(rows, "labelled")
    n = rows.count()
    if n > sample:
        rows = rows.where(F.col("u") < int((1 << 30) * sample / n))
    each = [F.get("x", i) for i in range(STATISTICS)]
    s = rows.agg(*(F.avg(c) for c in each), *(F.stddev_pop(c) for c in each)).first()
    model = Model(np.array([v or 0.0 for v in s[:STATISTICS]]), np.array([v or 0.0 for v in s[STATISTICS:]]))
    if not n:
        return model

    def equations(batches):
        size = FOURIER + 1
        total, right = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            z = model.features(_matrix(b.column(0)))
            total += z.T @ z
            right += z.T @ np.asarray(b.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total.ravel(), right]).tobytes()], pa.binary())], names=["sums"])

    learn = rows.where(F.col("fold") != 3) if rows.where(F.col("fold") == 3).limit(1).count() else rows
    parts = learn.select("x", "y").repartition(PARTS).mapInArrow(equations, "sums binary").collect()  # PARTS matrices of fixed size
    sums = sum(np.frombuffer(p["sums"]) for p in parts)
    size = FOURIER + 1
    left, right = sums[: size * size].reshape(size, size), sums[size * size :]
    model.weights = np.linalg.solve(left + RIDGE * max(left[-1, -1], 1.0) / size * np.eye(size), right)

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b.column(0)))), b.column(1)], names=["raw", "y"])

    scored = rows.where((F.col("fold") == 3) | (F.lit(learn is rows))).select("x", "y").mapInArrow(raw, "raw double, y double")
    cells = scored.groupBy(F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((F.col("raw") + 0.5) * (CELLS / 2)))).alias("cell"))
    cells = sorted(cells.agg(F.avg("raw").alias("at"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).collect(), key=lambda r: r["cell"])  # CELLS rows at most
    model.at, model.score = pooled(*(np.array([float(r[c]) for r in cells]) for c in ("at", "n", "hits")))
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``stats``."""

    def run(batches):
        for b in batches:
            s = model.calibrated(_matrix(b.column(2))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text is scored ``least`` or more. Texts are scored where they are.

    A null or empty text is scored as a document of zeros; repeated rows are decided alike; columns of any name pass through; an
    empty table stays empty.
    """
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).cast(pa.string())
            parts = [model.calibrated(statistics(data, offsets)) for _, data, offsets in text_chunks(texts)]
            yield b.filter(pa.array(np.concatenate(parts) >= least)) if parts else b
        give_back()

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text, ...)``.

    Scores come from the text alone. Null and empty texts are scored as a document of zeros; repeated rows each give a row; other
    columns are ignored. An empty table gives an empty result.
    """
    stats = written(document_statistics(docs), "statistics")
    return score(stats, fit(stats, labels, sample), threshold)
