"""N-gram Jaccard self-join by a blocked sparse matrix product of documents by n-grams.

Equal sets are one row of the matrix (a class). Bounds that follow from sizes say which columns of a row matter: two sets with a similarity
of t or more share at least t times the larger one's n-grams, so in any one order of all n-grams the first n - ceil(t * n) + 1 of
each hold a common one. The order puts n-grams that many documents share last; only these leading columns are posted.
Rows of about one size that meet in a posted column are candidates. Most are ruled out by parity sketches: a row's n-grams are dealt
into bits, each the parity of those in it, so two sketches differ in no more bits than the sets differ in n-grams, and sizes bound that
for similar rows. What is left is multiplied over all columns: overlap counts are accumulated, and pairs
below the bound are discarded.
First every row meets its columns' representative (the smallest row there), which takes a number of pairs that grows with the
postings; only rows that then share a column without being connected yet are compared with each other, in blocks of bounded size. A block
gives back links that span what it found connected, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.batches import give_back, written
from skein.llm.components import connected_components
from skein.llm.words import mix, shingle_sets, text_chunks
from skein.plans.storage import materialize

ROW_BLOCK = 128
ROW_BLOCK_BYTES = 4_000_000
#: Rows and bytes of a block of sketches.
SKETCH_BLOCK = 1024
SKETCH_BLOCK_BYTES = 8_000_000
#: N-grams whose use counts set the order, at most. Any order gives the same result, so this bounds cost alone.
FREQUENT = 65_536
#: An n-gram is counted where at least one of so many rows of a batch holds it.
SHARE = 256
_SEEN = 1 << 20


def row_id(s: np.ndarray) -> tuple[int, bytes]:
    """64 and 128 bits that stand for a set."""
    low = mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    high = mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(low.view(np.int64)[0]), low.byteswap().tobytes() + int(high).to_bytes(8, "big")


def sketch(s: np.ndarray, num: int, den: int) -> bytes:
    """Parities of the n-grams dealt into a power of two of bits, at least four times as many as similar sets can differ in n-grams.

    Sets that differ in far more n-grams differ in about half of the bits.
    """
    bits = 1 << max(6, (8 * (den - num) * len(s) // (num + den)).bit_length())
    at = (mix(s ^ np.uint64(0x9E6C63D0876A9A47)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """The sketches as rows of 64-bit words, longer ones folded to ``size`` bytes: parities of a number of bits that divides theirs."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    for i, b in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def may_be_similar(differ: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` n-grams that differ in ``differ`` or more can be similar."""
    sizes = den * np.minimum(n, m) >= num * np.maximum(n, m)
    return sizes & ((num + den) * differ <= (den - num) * (n + m))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(batch: pa.RecordBatch, k: int):
    for row, data, offsets in text_chunks(batch.column(1)):
        yield row, shingle_sets(data, offsets, k)


def frequent_grams(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that many of ``sets`` hold, and how many do."""
    flat = np.sort(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
    first = np.nonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))[0] if len(flat) else np.empty(0, np.int64)
    uses = np.diff(np.append(first, len(flat)))
    many = np.nonzero(uses >= max(4, len(sets) // SHARE))[0]
    many = many[np.argsort(-uses[many], kind="stable")[: FREQUENT // 16]]
    return flat[first[many]], uses[many]


def describe_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, n_shingles, low, row, sketch`` of each document (null for empty sets), and ``gram, uses`` in rows of their own.

    A task gives the sketch of equal sets once, as far as it remembers them.
    """

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            n, low, row, bits, classes = [], [], [], [], {}
            for _, sets in _sets(b, k):
                for s in sets:
                    n.append(len(s))
                    i, r = row_id(s) if len(s) else (None, None)
                    low.append(i)
                    row.append(r)
                    fresh = r is not None and r not in seen
                    bits.append(sketch(s, num, den) if fresh else None)
                    if fresh:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(r)
                    if r:
                        classes.setdefault(r, s)
            gram, uses = frequent_grams(list(classes.values()))
            none = lambda kind, m: pa.nulls(m, kind)
            more, own = len(gram), b.num_rows
            columns = (
                (b.column(0), none(pa.int64(), more)), (pa.array(n, pa.int64()), none(pa.int64(), more)), (pa.array(low, pa.int64()), none(pa.int64(), more)),
                (pa.array(row, pa.binary()), none(pa.binary(), more)), (pa.array(bits, pa.binary()), none(pa.binary(), more)), (none(pa.int64(), own), pa.array(gram.view(np.int64))), (none(pa.int64(), own), pa.array(uses, pa.int64())),
            )
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["doc_id", "n_shingles", "low", "row", "sketch", "gram", "uses"])
        give_back()

    return _slim(docs).mapInArrow(run, "doc_id long, n_shingles long, low long, row binary, sketch binary, gram long, uses long")


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The columns of ``s`` to post: those that come first when ``frequent`` n-grams follow, by ``rank``, all others."""
    keep = len(s) - -(-num * len(s) // den) + 1
    spread = mix(s ^ np.uint64(0x632BE59BD9B4E019))
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        late = np.where(frequent[at] == s, rank[at], 0)
        if late.any():
            return s[np.lexsort((spread, late))[:keep]]
    return s[np.argpartition(spread, keep - 1)[:keep]]


def postings(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """``key, low``: the posted columns of each set. A task posts copies once, as far as it remembers them."""
    given = docs.sparkSession.sparkContext.broadcast((frequent, rank))  # FREQUENT numbers at most

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            keys, lows = [np.empty(0, np.uint64)], []
            for _, sets in _sets(b, k):
                for s in sets:
                    if not len(s) or (low := row_id(s)[0]) in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(low)
                    keys.append(prefix(s, *given.value, num, den))
                    lows.append(low)
            low = np.repeat(np.array(lows, np.int64), [len(x) for x in keys[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(low)], names=["key", "low"])
        give_back()

    return _slim(docs).mapInArrow(run, "key long, low long")


def _rows_of(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for _, sets in _sets(b, k):
                sets = [s for s in sets if len(s)]
                ids = [row_id(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in ids], pa.int64()), pa.array([r for _, r in ids], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["low", "row", "grams"]
                )
        give_back()

    return _slim(docs).mapInArrow(run, "low long, row binary, grams binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all rows of two blocks: a sparse product over the columns that both hold."""
    columns = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    counts = np.zeros((len(left), len(right)), np.int64)
    for i, s in enumerate(left):
        first, last = np.searchsorted(columns, s), np.searchsorted(columns, s, side="right")
        n = last - first
        at = np.arange(n.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        counts[i] = np.bincount(owner[at], minlength=len(right))
    return counts


def spanning_links(rows: list[bytes], parts: list[int], grams: list[np.ndarray], groups: list, num: int, den: int) -> list[tuple[bytes, bytes]]:
    """Links that join what the rows' similarities join. With two part numbers only pairs across are compared; rows of one group count as joined."""
    parent, known = list(range(len(rows))), {}
    for i, g in enumerate(groups):
        parent[i] = known.setdefault(g, i)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kinds = sorted(set(parts))
    a = [i for i, x in enumerate(parts) if x == kinds[0]]
    b = a if len(kinds) == 1 else [i for i, x in enumerate(parts) if x == kinds[1]]
    n = np.array([len(g) for g in grams])
    both = overlaps([grams[i] for i in a], [grams[i] for i in b])
    near = den * both >= num * (n[a][:, None] + n[b][None, :] - both)
    links = []
    for x, y in np.argwhere(near).tolist():
        x, y = a[x], b[y]
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            links.append((rows[x], rows[y]))
    return links


def _blocks(met: DataFrame, weights: DataFrame, row_block: int, most_bytes: int, label: str) -> DataFrame:
    """``met(meet, size, low, ...)`` with ``part, a, b``: the rows of each meeting dealt into parts of bounded size, once for each pair of parts."""
    weight = met.join(weights, "low").groupBy("meet", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    parts = F.when(F.col("n") <= 3 * row_block // 2, F.lit(1)).otherwise(F.ceil(F.col("n") / row_block))
    weight = materialize(weight.select("meet", "size", F.greatest(parts, F.ceil(F.col("bytes") / most_bytes)).cast("int").alias("parts")), label)
    placed = met.join(weight, ["meet", "size"]).withColumn("part", F.pmod(F.xxhash64("low"), F.col("parts")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return placed.withColumn("a", F.least("part", "with")).withColumn("b", F.greatest("part", "with")).drop("with", "parts")


def _ready(table: pa.Table) -> bool:
    """Whether a block has two rows to compare: two parts, or a part with itself."""
    return table.num_rows > 1 and (table["a"][0].as_py() == table["b"][0].as_py() or len(table["part"].unique()) == 2)


def _multiply(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """``u, v`` links from ``blocks(meet, size, a, b, part, row, grams, group)``."""

    def run(table: pa.Table) -> pa.Table:
        links = []
        if _ready(table):
            seen = {}
            for row, *rest in zip(*(table[c].to_pylist() for c in ("row", "part", "grams", "group")), strict=True):
                seen.setdefault(row, rest)
            links = spanning_links(list(seen), [p for p, _, _ in seen.values()], [np.frombuffer(g, np.uint64) for _, g, _ in seen.values()], [x for _, _, x in seen.values()], num, den)
        return pa.table({"u": pa.array([x for x, _ in links], pa.binary()), "v": pa.array([y for _, y in links], pa.binary())})

    return blocks.groupBy("meet", "size", "a", "b").applyInArrow(run, "u binary, v binary")


def competing_rows(n: np.ndarray, bits: list[bytes], part: np.ndarray, group: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows of a block sketches don't rule out for some row of another group; with two parts only pairs across count."""
    rows, hit = folded(bits, min(map(len, bits))), np.zeros(len(n), bool)
    a = np.nonzero(part == part.min())[0]
    b = np.nonzero(part == part.max())[0]
    step = max(1, 500_000 // (len(b) * rows.shape[1]))
    for at in range(0, len(a), step):
        x = a[at : at + step]
        differ = np.bitwise_count(rows[x][:, None] ^ rows[b][None]).sum(axis=2, dtype=np.int64)
        near = may_be_similar(differ, n[x][:, None], n[b][None], num, den) & (group[x][:, None] != group[b][None])
        hit[x] |= near.any(axis=1)
        hit[b] |= near.any(axis=0)
    return hit


def _competing(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """``meet, size, low`` of the rows that sketches don't rule out for some row of another group, from ``blocks(..., n, sketch, group)``.

    Blocks are many and small, so they come sorted in one stream; a block has a bounded number of rows.
    """
    key = ["meet", "size", "a", "b"]
    ordered = blocks.select(*key, "part", "low", "group", "n", "sketch").repartition(*key).sortWithinPartitions(*key)

    def found(rows: list[np.ndarray], bits: list[bytes]) -> tuple[np.ndarray, ...] | None:
        keys, (part, low, group, n) = rows[:4], rows[4:]
        square = keys[2][0] == keys[3][0]
        if len(n) < 2 or (not square and part.min() == part.max()):
            return None
        hit = competing_rows(n, bits, part, group, num, den)
        return (keys[0][hit], keys[1][hit], low[hit]) if hit.any() else None

    def run(batches):
        rest: list[np.ndarray] | None = None
        rest_bits: list[bytes] = []
        for b in batches:
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            bits = b.column(8).to_pylist()
            if rest is not None:
                rows, bits = [np.concatenate(x) for x in zip(rest, rows, strict=True)], rest_bits + bits
            if not len(bits):
                continue
            ends = np.nonzero(np.any([x[1:] != x[:-1] for x in rows[:4]], axis=0))[0] + 1
            out, at = [], 0
            for end in ends.tolist():
                if (hit := found([x[at:end] for x in rows], bits[at:end])) is not None:
                    out.append(hit)
                at = end
            rest, rest_bits = [x[at:] for x in rows], bits[at:]
            yield batch(out)
        if rest is not None:
            yield batch([hit] if (hit := found(rest, rest_bits)) is not None else [])

    def batch(hits):
        columns = zip(*hits, strict=True) if hits else ([], [], [])
        kinds = (pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(c)) if hits else [], k) for c, k in zip(columns, kinds, strict=True)], names=["meet", "size", "low"])

    return ordered.mapInArrow(run, "meet long, size int, low long")


def _star_pairs(stars: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of ``stars(meet, low)`` that sizes and sketches don't rule out."""
    one = sketches.select("low", F.col("n").alias("n_low"), F.col("sketch").alias("s_low"))
    other = sketches.select(F.col("low").alias("meet"), F.col("n").alias("n_meet"), F.col("sketch").alias("s_meet"))
    sizes = F.lit(den) * F.least("n_low", "n_meet") >= F.lit(num) * F.greatest("n_low", "n_meet")
    pairs = stars.join(one, "low").join(other, "meet").where(sizes).select("meet", "low", "n_meet", "n_low", "s_meet", "s_low")

    def run(batches):
        for b in batches:
            keep = []
            for n, m, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                size = min(len(x), len(y))
                differ = np.bitwise_count(folded([x], size) ^ folded([y], size)).sum(dtype=np.int64)
                keep.append(bool(may_be_similar(differ, np.int64(n), np.int64(m), num, den)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["meet", "low"])

    return pairs.mapInArrow(run, "meet long, low long")


def _pair_links(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """``u, v`` of the pairs ``meet, low`` whose sets are similar."""
    full = pairs.join(rows.select("low", F.col("row").alias("v"), F.col("grams").alias("g_v")), "low")
    full = full.join(rows.select(F.col("low").alias("meet"), F.col("row").alias("u"), F.col("grams").alias("g_u")), "meet").select("u", "v", "g_u", "g_v")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int(overlaps([x], [y])[0, 0])
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    return full.mapInArrow(run, "u binary, v binary")


def _sketches(documents: DataFrame, lows: DataFrame, label: str) -> DataFrame:
    """``low, n, sketch`` of each class in ``lows``."""
    found = documents.where(F.col("sketch").isNotNull()).join(lows.distinct(), "low", "left_semi").select("low", F.col("n_shingles").alias("n"), "sketch")
    return materialize(found.dropDuplicates(["low"]), label)


def _member_rows(docs: DataFrame, classes: DataFrame, lows: DataFrame, k: int, broadcast_rows: int, label: str) -> DataFrame:
    """``low, row, grams`` of one document of each class in ``lows``. Their ids are broadcast up to a count, and joined by a shuffle beyond."""
    wanted = materialize(classes.join(lows.distinct(), "low", "left_semi").select("class_id"), f"{label}-ids")
    few = wanted.count() <= broadcast_rows
    members = _slim(docs).join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("class_id")), "left_semi")
    return written(_rows_of(members, k).dropDuplicates(["low", "row"]), label)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, broadcast_rows: int = 300_000) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text, ...)``.

    Documents link when the Jaccard similarity of their sets of ``k``-word shingles is ``num / den`` or more; ``component_id`` is
    the smallest doc_id that links reach. A null, empty or blank text has an empty set and is linked with nothing: it's its own
    component. Repeated rows are equal documents. A null doc_id never is the smallest, unless there is no other. Other
    columns are ignored, so their names can't clash; an empty table gives an empty result. Sets are compared by 64-bit hashes.
    """
    described = written(describe_rows(docs, k, num, den), "rows")
    common = described.where(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("uses").alias("uses"))
    common = common.orderBy(F.desc("uses"), "gram").limit(FREQUENT).collect()  # FREQUENT rows at most
    frequent = np.array([r["gram"] for r in common], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, rank = frequent[order], (len(common) - np.arange(len(common), dtype=np.int64))[order]

    documents = described.where(F.col("gram").isNull())
    classes = documents.where(F.col("row").isNotNull()).groupBy("row").agg(F.min("doc_id").alias("class_id"), F.first("low").alias("low"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")

    # The smallest row of each posted column is its representative; other rows meet each other too, if there are several.
    posted = postings(docs, k, num, den, frequent, rank)
    shared = posted.groupBy("key").agg(F.min("low").alias("meet"), F.max("low").alias("other"), F.count(F.lit(1)).alias("n")).where(F.col("meet") != F.col("other"))
    shared = written(shared.select("key", "meet", (F.col("n") > 2).alias("several")), "columns")
    met = posted.join(shared, "key").where(F.col("low") != F.col("meet")).groupBy("meet", "low").agg(F.max("several").alias("several"))
    met = written(met, "meetings")
    ns = classes.select("low", "n")
    stars = met.join(ns, "low").join(ns.select(F.col("low").alias("meet"), F.col("n").alias("n_meet")), "meet")
    stars = materialize(stars.where(F.lit(den) * F.least("n", "n_meet") >= F.lit(num) * F.greatest("n", "n_meet")).select("meet", "low"), "stars")
    pairs = written(_star_pairs(stars, _sketches(documents, stars.select("low").union(stars.select("meet")), "star-sketches"), num, den), "star-pairs")
    rows = _member_rows(docs, classes, pairs.select("low").union(pairs.select("meet")), k, broadcast_rows, "star-rows")
    links = written(_pair_links(pairs, rows, num, den), "star-links")

    # A group is named by the first half of its root's id.
    roots = connected_components(links).select(F.col("node").alias("row"), F.conv(F.hex(F.substring("root", 1, 8)), 16, -10).cast("long").alias("root"))
    groups = materialize(classes.join(roots, "row").select("low", "root"), "groups-so-far")
    # Similar sizes lie in one class or in neighbours; the base is a little larger than the ratio, so that rounding can't set them further apart.
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) * (1 + 1e-6))).cast("int")
    rest = met.where("several").join(ns, "low").select("meet", "low", F.explode(F.array(size, size - 1)).alias("size"))
    rest = rest.join(groups, "low", "left").select("meet", "size", "low", F.coalesce("root", "low").alias("group"))
    rest = materialize(rest, "meetings-groups")
    apart = rest.groupBy("meet", "size").agg(F.min("group").alias("one"), F.max("group").alias("other")).where(F.col("one") != F.col("other"))
    rest = materialize(rest.join(apart.select("meet", "size"), ["meet", "size"]), "meetings-apart")
    sketches = _sketches(documents, rest.select("low"), "sketches")
    weights = sketches.select("low", F.octet_length("sketch").alias("bytes"))
    blocks = _blocks(rest, weights, SKETCH_BLOCK, SKETCH_BLOCK_BYTES, "sketch-parts").join(sketches, "low")
    rest = written(_competing(blocks, num, den).distinct(), "competing").join(rest, ["meet", "size", "low"])
    rows = _member_rows(docs, classes, rest.select("low"), k, broadcast_rows, "block-rows")
    weights = rows.groupBy("low").agg(F.max(F.octet_length("grams")).alias("bytes"))
    blocks = _blocks(rest, weights, ROW_BLOCK, ROW_BLOCK_BYTES, "parts").join(rows, "low").select("meet", "size", "a", "b", "part", "row", "grams", "group")
    links = links.union(written(_multiply(blocks, num, den), "block-links"))
    return _label(documents.select("doc_id", "n_shingles", "row"), classes, connected_components(links))


def _label(described: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Each document with its component. Only classes of several documents or with links are joined, and their copies are dealt over salts."""
    nodes = roots.withColumnRenamed("node", "row")
    least = nodes.join(classes, "row").groupBy("root").agg(F.min("class_id").alias("least"))
    least = least.join(classes.select(F.col("row").alias("root"), "class_id"), "root").select("root", F.least("least", "class_id").alias("component"))
    least = materialize(least, "least-ids")
    moved = materialize(nodes.join(least, "root").select("row", "component").union(least.select(F.col("root").alias("row"), "component")), "moved")
    known = classes.join(moved, "row", "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
    known = materialize(known.select("row", F.coalesce("component", "class_id").alias("component")), "components")
    salts = 16
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    out = described.withColumn("salt", salt).join(salted, ["row", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
