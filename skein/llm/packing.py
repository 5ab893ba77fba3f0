"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Lengths are whole numbers up to the sequence length, so the packing itself runs over counts per length: a table
whose size does not depend on the corpus. One bin is filled greedily (largest document that fits, again and again); then
its smallest document is replaced with two unpacked ones that fit the expanded gap more tightly. The
bin that results is repeated as often as the counts allow, which is what packing bin after bin would do. Documents
take their places by their rank among those of the same length.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.batches import give_back, written
from skein.llm.bpe import worker_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids; only the first piece of a longer document is shorter than ``size``."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many bins like that), for ``counts`` documents of each length up to ``size``.

    Each round uses up at least one length to below its number of uses in a bin, so there are few
    rounds: some multiple of ``size``, whatever the counts.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left)
    bins = []
    while order:
        used: dict[int, int] = {}
        gap, content = size, []
        free = lambda x: left.get(x, 0) - used.get(x, 0)
        while (k := bisect_right(order, gap)) > 0:
            while k and free(order[k - 1]) <= 0:
                k -= 1
            if not k:
                break
            x = order[k - 1]
            content.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        if gap and len(content) > 1:
            small = min(content)
            room, best = gap + small, (small, None)
            lo, hi = 0, bisect_right(order, room) - 1
            while lo <= hi:
                a, b = order[lo], order[hi]
                if a + b > room or free(b) <= 0:
                    hi -= 1
                    continue
                if a + b > best[0] and (free(a) > 0 if lo < hi else free(a) > 1):
                    best = (a + b, (a, b))
                lo += 1
            if best[1]:
                content.remove(small)
                used[small] -= 1
                for x in best[1]:
                    content.append(x)
                    used[x] = used.get(x, 0) + 1
        times = min(left[x] // n for x, n in used.items() if n)
        bins.append((tuple(content), times))
        for x, n in used.items():
            left[x] -= n * times
        if any(left[x] == 0 for x in used):
            order = [x for x in order if left[x]]
    return bins


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of the runs that share a place in like bins, number of the run's first bin, place."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first_bin = 0
    for content, times in bins:
        offset = 0
        for x in content:
            runs.setdefault(x, []).append((taken.get(x, 0), first_bin, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        first_bin += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def token_pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece of each document of ``docs(doc_id, text, ...)``; a null text is empty and is one piece of one id."""
    end = struct.pack("<I", end_id)

    def run(batches):
        bpe = worker_bpe(json_path, ranks_path)
        for b in batches:
            out = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(bpe.id_bytes(text or "") + end)
                for i, (start, n) in enumerate(cut(len(ids) // 4, size)):
                    for column, value in zip(out, (doc, i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        bpe.forget()
        give_back()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, PIECES)


def pack(pieces: DataFrame, size: int = 1024, rows_per_salt: int = 16_384) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless places in sequences of at most ``size`` ids.

    ``pieces`` holds ``doc_id, piece, start, length, ids_crc32`` and is written with a number for each row. A length that many rows
    share is ranked in salted parts, by those numbers, so equal rows are dealt over all parts too and get a place each. A null
    doc_id is packed like any other; other columns are left out; an empty table gives an empty result.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = written(pieces.select(*names, F.monotonically_increasing_id().alias("_at")), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    if any(x < 1 or x > size for x in counts):
        raise ValueError(f"lengths must be from 1 to {size}")
    where = places(best_two_fit(counts, size))
    salts = max(16, -(-sum(counts.values()) // rows_per_salt))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(salts)))
    parts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("length", "_salt").orderBy("_at")
    ranked = salted.join(parts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)

    # Runs of all lengths in one sorted table: the run that holds a rank is the last that begins at or before it.
    order = sorted(where)
    begin = np.concatenate([(x << 44) + where[x][0] for x in order] or [np.empty(0, np.int64)])
    first, base, place = (np.concatenate([where[x][i] for x in order] or [np.empty(0, np.int64)]) for i in range(3))

    def run(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            k = np.searchsorted(begin, (length << 44) + rank, side="right") - 1
            sequence, offset = base[k] + rank - first[k], place[k]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack whole documents of ``docs(doc_id, text, ...)``.

    A null or empty text is one piece of one id; repeated rows and null ids are packed like any other; other columns are ignored, so their names
    can't clash; an empty table gives an empty result.
    """
    return pack(token_pieces(docs, size, end_id), size)
