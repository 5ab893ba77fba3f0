"""Exact top-k by integer inner product with MaxScore.

A term is a vector component and its postings are the candidates' values of it. Candidates come in blocks by descending norm. Every query
first meets the block of the largest norms; its k-th best score there is a threshold that each later block starts from. A pair of a
query block and a candidate block whose norms can't lift any pair over the query block's lowest threshold is skipped
whole. In other pairs each query's terms are ordered by the largest contribution that the block's values allow: those whose bounds together
can't lift a candidate over the threshold are non-essential. Postings of essential terms are traversed for all
candidates, the others are probed only for candidates that can still compete. Shards' lists are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.batches import bounded_batches
from skein.plans.storage import materialize

HITS = "query_row long, query_id long, vec_id long, score long"
BLOCKS = "block long, n int, width int, norm double, ids binary, cells binary"
#: Integers up to here are exact as doubles, whatever order they are added in.
EXACT = float(2**53)
_LONG = 2**63
#: Share of pairs that still compete above which the other terms are traversed for all, too, as that costs less than probing them.
DENSE = 0.05


def quantise(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``row, vec_id, cells array<double>, norm``: ``floor(scale * x)`` of each component, a whole number, and a number for each row.

    Rows without id, vectors that are null and vectors with a null or non-finite component are left out, nothing else. Repeated rows are
    rows of their own. Other columns are ignored; an empty table gives an empty result. The result is a table, so that row numbers stay.
    """

    def cell(x):
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(F.coalesce(fine, F.lit(False)))
    kept = kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), cell).alias("cells"))
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda s, x: s + x * x))
    return materialize(kept.withColumn("norm", norm), "vectors")


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors in blocks of up to ``size`` of about equal norm; a block's matrix has as many columns as its widest vector."""
    ordered = vectors.repartitionByRange(F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row").select("row", "vec_id", "cells", "norm")

    def pack(part):
        ids, cells, norm = [], [], 0.0
        for b in part:
            ids.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1))
            cells += b.column(2).to_pylist()
            norm = max(norm, float(np.max(b.column(3).to_numpy())))
        width = max(map(len, cells))
        m = np.zeros((len(cells), width))
        for i, c in enumerate(cells):
            m[i, : len(c)] = c
        ids = np.concatenate(ids)
        values = (pa.array([int(ids[0, 0])], pa.int64()), pa.array([len(cells)], pa.int32()), pa.array([width], pa.int32()), pa.array([norm]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()))
        return pa.RecordBatch.from_arrays(list(values), names=["block", "n", "width", "norm", "ids", "cells"])

    def run(batches):
        part, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                took = b.slice(at, size - n)
                part.append(took)
                n += took.num_rows
                at += took.num_rows
                if n == size:
                    yield pack(part)
                    part, n = [], 0
        if n:
            yield pack(part)

    return ordered.mapInArrow(run, BLOCKS)


def _matrix(r: dict, prefix: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and values of a block, with columns of zeros up to ``width``."""
    ids = np.frombuffer(r[prefix + "ids"], "<i8").reshape(-1, 2)
    m = np.frombuffer(r[prefix + "cells"]).reshape(r[prefix + "n"], r[prefix + "width"])
    if width > m.shape[1]:
        m = np.concatenate([m, np.zeros((len(m), width - m.shape[1]))], axis=1)
    return ids[:, 0], ids[:, 1], m


def _exact(q: np.ndarray, c: np.ndarray) -> int:
    score = sum(int(x) * int(y) for x, y in zip(q.tolist(), c.tolist(), strict=True))
    return max(-_LONG, min(_LONG - 1, score))


def _in_long(floors: np.ndarray) -> np.ndarray:
    """Floors that don't tell scores apart that lie beyond the same bound of a long."""
    return np.where(floors < -float(_LONG), -np.inf, np.minimum(floors, float(_LONG) * (1 - 2.0**-40)))


def max_score(queries: np.ndarray, cells: np.ndarray, floors: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """``(query, candidate, score)`` of all pairs of rows that can be among the query's ``k`` best of this block and reach its floor.

    ``own`` is each query's own place among the candidates, or -1. Scores are exact: where products leave the range in which doubles are,
    survivors of bounds that allow for rounding are computed with whole numbers.
    """
    width, floors = max(1, cells.shape[1]), _in_long(floors)
    with np.errstate(over="ignore", invalid="ignore"):
        reach = np.abs(queries).max(initial=0.0) * np.abs(cells).max(initial=0.0) * width
        wide = not reach < EXACT
        low, high = cells.min(axis=0), cells.max(axis=0)
        most = np.maximum(queries * low, queries * high)
        gain = most - np.minimum(queries * low, queries * high)
        slack = (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high))) * (width * 2.0**-50) if wide else np.zeros(len(queries))
        slack = np.where(np.isfinite(slack), slack, np.inf)
        # Terms by falling gain; the tail whose best contributions stay below the floor, with all others at their least, is non-essential.
        order = np.argsort(-gain, axis=1, kind="stable")
        sorted_gain = np.take_along_axis(gain, order, axis=1)
        tail = np.cumsum(sorted_gain[:, ::-1], axis=1)[:, ::-1]  # what the terms from here on can add
        least = (most - gain).sum(axis=1)
        essential_sorted = least[:, None] + tail >= (floors - slack)[:, None]
        if wide:
            essential_sorted |= ~np.isfinite(tail)
        essential = np.zeros(queries.shape, bool)
        np.put_along_axis(essential, order, essential_sorted, axis=1)
        rest = np.where(essential, 0.0, most).sum(axis=1)
        partial = np.where(essential, queries, 0.0) @ cells.T
        alive = ~(partial + (rest + slack)[:, None] < floors[:, None])
        if alive.mean() > DENSE:
            essential[:] = True
            partial = queries @ cells.T
            alive = ~(partial + slack[:, None] < floors[:, None])
    mine = own >= 0
    alive[np.nonzero(mine)[0], own[mine]] = False
    q, c = np.nonzero(alive)
    if not len(q):
        return q, c, []
    if not wide:
        score = partial[q, c]
        probe = np.where(essential, 0.0, queries)
        for at in range(0, 0 if essential.all() else len(q), 65_536):  # probing the terms left, for the pairs that compete
            s = slice(at, at + 65_536)
            score[s] += np.einsum("ij,ij->i", probe[q[s]], cells[c[s]])
        keep = score >= floors[q]
        q, c, score = q[keep], c[keep], score[keep].astype(np.int64)
    else:
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.where(essential, 0.0, queries)
            guess = partial[q, c] + np.einsum("ij,ij->i", near[q], cells[c])
            bound = np.where(np.isfinite(guess), guess, np.nan)
            reached = np.full(len(queries), -np.inf)
            for i in np.unique(q).tolist():
                own_guess = bound[q == i]
                if len(own_guess) > k and np.isfinite(own_guess).all():
                    reached[i] = np.partition(own_guess, -k)[-k] - 2 * slack[i]
            reached = _in_long(reached)
            keep = ~(bound < np.maximum(reached, floors - slack)[q])
        q, c = q[keep], c[keep]
        exact = [_exact(queries[i], cells[j]) for i, j in zip(q.tolist(), c.tolist(), strict=True)]
        score = np.array(exact, dtype=object)
    order = sorted(range(len(q)), key=lambda i: (q[i], -score[i], ids[c[i]])) if wide else np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], c[keep], score[keep].tolist()


def _places(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The place of each of ``rows`` in ``of``, or -1."""
    order = np.argsort(of)
    at = np.minimum(np.searchsorted(of[order], rows), len(of) - 1)
    return np.where(of[order][at] == rows, order[at], -1)


def _first_floors(query_blocks: DataFrame, head: DataFrame, k: int) -> DataFrame:
    """Query blocks with each query's k-th best score in the block ``head`` as its floor, and the blocks' least floor."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                width = max(r["width"], r["c_width"])
                rows, _, q = _matrix(r, "", width)
                c_rows, c_ids, c = _matrix(r, "c_", width)
                at, _, score = max_score(q, c, np.full(len(q), -np.inf), _places(rows, c_rows), c_ids, k)
                floors = np.full(len(q), -np.inf)
                kth = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
                for i, s in zip(at[kth].tolist(), np.array(score, dtype=object)[kth].tolist(), strict=True):
                    f = float(s)  # a whole number beyond doubles may have been rounded up
                    floors[i] = f if int(f) <= s else np.nextafter(f, -np.inf)
                out = {x: [r[x]] for x in ("block", "n", "width", "norm", "ids", "cells")}
                yield pa.RecordBatch.from_pydict({**out, "floors": [floors.tobytes()], "least": [float(floors.min())]}, schema=schema)

    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("norm", pa.float64()), ("ids", pa.binary()), ("cells", pa.binary()), ("floors", pa.binary()), ("least", pa.float64())])
    one = head.select(*(F.col(x).alias(f"c_{x}") for x in ("n", "width", "ids", "cells")))
    return query_blocks.crossJoin(F.broadcast(one)).mapInArrow(run, BLOCKS + ", floors binary, least double")  # one block, of bounded size


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = 1024, block: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's ``k`` highest inner products among all candidate rows but its own.

    Both tables come from :func:`quantise` (``row, vec_id, cells, norm``); a row is a query's own if it has the query's row number.
    Ties go to the smaller id; vectors of different widths are compared as if the shorter were padded with zeros. Rows with equal
    ids or vectors are rows of their own. Scores beyond a long are given as its bound and tie there. An empty table gives an
    empty result. Candidate blocks are dealt to lanes and every query block is offered to every lane; blocks are of
    bounded size, and pairs of blocks that their norms rule out are dropped before their values move.
    """
    spark = queries.sparkSession
    with bounded_batches(spark):
        cb = materialize(_blocks(candidates, block), "candidate-blocks")
        head = materialize(cb.orderBy(F.desc("norm"), F.desc("n")).limit(1), "head-block")
        qb = materialize(_first_floors(_blocks(queries, query_block), head, k), "query-blocks")
        lanes = min(4 * spark.sparkContext.defaultParallelism, max(1, cb.count()))
        offered = qb.select(*(F.col(c).alias(f"q_{c}") for c in qb.columns)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        dealt = cb.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
        possible = (F.col("q_norm") * F.col("norm") * F.lit(1.0 + 1e-9) >= F.col("q_least")) | F.isnan(F.col("q_norm") * F.col("norm"))
        pairs = dealt.hint("merge").join(offered, dealt["lane"].eqNullSafe(offered["lane"]) & possible).select(dealt["*"], *(f"q_{c}" for c in qb.columns))
        return merge(materialize(_search(pairs, k), "hits"), k)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                width = max(r["width"], r["q_width"])
                q_rows, q_ids, q = _matrix(r, "q_", width)
                c_rows, c_ids, c = _matrix(r, "", width)
                at, hit, score = max_score(q, c, np.frombuffer(r["q_floors"]), _places(q_rows, c_rows), c_ids, k)
                columns = (q_rows[at], q_ids[at], c_ids[hit], np.array(score, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, np.int64)) for x in columns], names=["query_row", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, HITS)


def merge(hits: DataFrame, k: int) -> DataFrame:
    """The shards' lists, of ``k`` rows each, merged per query."""
    w = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
