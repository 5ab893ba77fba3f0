"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Each shingle of five words is hashed once; the hash's first bits choose one of ``BINS`` bins and the rest is the value,
of which a bin keeps the least. A bin without shingles takes the value of the first bin with some on its own walk over all
bins (a random odd step, so the walk meets each bin once): optimal densification. Of every value the low ``BITS`` bits
are stored, and the share of equal bins is corrected for those that agree by chance.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.mixing import word_array
from skein.plans.storage import materialize

WORDS = 5
BINS = 128
BITS = 8
_SHIFT = 63 - (BINS.bit_length() - 1)  # hashes are taken as 63 bits without a sign
_VALUE = (1 << _SHIFT) - 1


def _steps() -> list[int]:
    """For each bin the odd step of its walk."""
    return [2 * (int.from_bytes(hashlib.sha256(b"walk %d" % i).digest()[:4], "big") % (BINS // 2)) + 1 for i in range(BINS)]


PROBES = 6


def shingle_hashes(words: str) -> Column:
    """63-bit hashes of the shingles in the column ``words`` of word hashes; fewer than five words are one shingle."""
    n = F.size(words)
    at = lambda i, j: F.get(F.col(words), i + j)
    many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.shiftrightunsigned(F.xxhash64(*(at(i, j) for j in range(WORDS))), 1))
    one = F.array(F.shiftrightunsigned(F.xxhash64(F.col(words)), 1))
    return F.when(n >= WORDS, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))


def fill_bins(low: str, codes: str) -> Column:
    """Low bits of all bins, two hex digits each.

    ``low`` has each bin's low bits, null where it's empty, and ``codes`` the bins that aren't, as ``bin << BITS | low bits``. The
    first steps of a bin's walk are looked up; a longer walk's end is the code that the walk needs fewest steps to reach.
    """
    steps = _steps()
    ints = lambda xs: F.array(*(F.lit(x) for x in xs))
    inverse = ints(pow(s, -1, BINS) for s in steps)
    walks = [ints((i + t * s) % BINS for i, s in enumerate(steps)) for t in range(1, PROBES + 1)]

    def far(i: Column) -> Column:
        step = F.get(inverse, i)
        return F.array_min(F.transform(codes, lambda c: F.shiftleft(((F.shiftright(c, BITS) - i) * step).bitwiseAND(BINS - 1), BITS).bitwiseOR(c.bitwiseAND((1 << BITS) - 1)))).bitwiseAND((1 << BITS) - 1)

    digits = F.array(*(F.lit(f"{x:02x}") for x in range(1 << BITS)))
    value = lambda i: F.coalesce(F.get(F.col(low), i), *(F.get(F.col(low), F.get(w, i)) for w in walks), far(i))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(digits, value(i))), "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of its column ``text`` (not null) as ``name``; a text without words has an empty one."""
    out = df.withColumn("_words", F.transform(word_array(F.lower(F.col(text))), lambda w: F.xxhash64(w)))
    # One more, largest, hash for each bin: after sorting, the first of each bin is its least, or this mark if it's empty.
    marks = F.array(*(F.lit((i << _SHIFT) | _VALUE).cast("long") for i in range(BINS)))
    out = out.withColumn("_hashes", F.sort_array(F.concat(shingle_hashes("_words"), marks))).withColumn("_any", F.size("_words") > 0).drop("_words")
    first = F.filter("_hashes", lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(F.col("_hashes"), i - 1), _SHIFT)))
    out = out.withColumn("_least", first).drop("_hashes")
    full = lambda x: x.bitwiseAND(_VALUE) != _VALUE
    low = lambda x: x.bitwiseAND((1 << BITS) - 1).cast("int")
    out = out.withColumn("_low", F.transform("_least", lambda x: F.when(full(x), low(x))))
    out = out.withColumn("_codes", F.transform(F.filter("_least", full), lambda x: F.shiftleft(F.shiftright(x, _SHIFT).cast("int"), BITS).bitwiseOR(low(x)))).drop("_least")
    return out.withColumn(name, F.when(F.col("_any"), fill_bins("_low", "_codes")).otherwise("")).drop("_low", "_codes", "_any")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, from 0 to 1; an empty one is like an empty one only."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0),
        lambda n, i: n + (F.substring(a, 2 * i + 1, F.lit(2)) == F.substring(b, 2 * i + 1, F.lit(2))).cast("int"),
    )
    chance = 1.0 / (1 << BITS)
    corrected = F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


def next_in_order(ids: DataFrame) -> DataFrame:
    """``doc_id, tie, next_id, next_tie`` for ``ids(doc_id, tie)``: each row's successor by descending doc_id (null last), the first after the last.

    The rows are sorted over all partitions and written with their partition's number; successors are found inside partitions
    and, at their ends, among the partitions' first rows.
    """
    order = (F.desc_nulls_last("doc_id"), F.asc("tie"))
    placed = materialize(ids.orderBy(*order).withColumn("part", F.spark_partition_id()), "order")
    inside = W.partitionBy("part").orderBy(*order)
    following = placed.withColumn("next", F.lead(F.struct("doc_id", "tie")).over(inside))
    ranked = placed.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") == 1)
    parts = W.orderBy("part")
    firsts = ranked.select("part", F.struct("doc_id", "tie").alias("first"))
    ends = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(parts)).alias("after"))
    out = following.join(materialize(ends, "order-ends"), "part").withColumn("next", F.coalesce("next", "after"))
    return out.select("doc_id", "tie", F.col("next.doc_id").alias("next_id"), F.col("next.tie").alias("next_tie"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` and more per row of ``docs(doc_id, text, ...)``; a null text is empty. See :func:`compare_edited`."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("tie", F.xxhash64("text")).withColumn("n_chars", F.length("text").cast("long"))
    return with_fingerprint(slim, "text", "fingerprint")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of edited ones, and their likeness, per row of ``docs(doc_id, text, ...)``.

    The edited text has its last third of code points (rounded down) replaced by the first as many, or all, of the next document by
    descending doc_id, the first after the last; a single document is next to itself. Documents with one doc_id follow by a hash of
    their texts; rows equal in both are one document in that order, and each gives a row. A null text is empty. Null ids come last.
    Other columns are ignored; an empty table gives an empty result.

    Texts are shuffled once, by id; only prefixes of texts travel to their predecessors.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("tie", F.xxhash64("text"))
    printed = materialize(with_fingerprint(slim.withColumn("n_chars", F.length("text").cast("long")), "text", "fingerprint").select("doc_id", "id", "tie", "n_chars", F.unhex("fingerprint").alias("print")), "prints")
    one = printed.groupBy("id", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.first("print").alias("print"))
    follows = next_in_order(one.select("doc_id", "tie")).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "tie", F.coalesce("next_id", F.lit(-(2**63))).alias("next_id"), "next_tie")
    # For each document what its predecessor needs of it.
    wanted = follows.join(one.select("id", "tie", F.floor(F.col("n_chars") / 3).cast("int").alias("taken")), ["id", "tie"])
    wanted = materialize(wanted.select(F.col("id").alias("to_id"), F.col("tie").alias("to_tie"), F.col("next_id").alias("id"), F.col("next_tie").alias("tie"), "taken"), "wanted")
    texts = slim.select("id", "tie", "text")  # the same columns for both joins, so their shuffle is one
    given = texts.join(wanted, ["id", "tie"]).select(F.col("to_id").alias("id"), F.col("to_tie").alias("tie"), F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), "taken", F.substring(F.col("text"), F.lit(1), F.col("taken")).alias("prefix"))
    given = given.groupBy("id", "tie").agg(*(F.first(c).alias(c) for c in ("next_id", "next_tie", "taken", "prefix")))
    edited = texts.join(given, ["id", "tie"])
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("taken"))
    edited = edited.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(kept, F.col("prefix")))
    edited = edited.select(F.nullif("id", F.lit(-(2**63))).alias("doc_id"), "id", "tie", "next_id", "next_tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "edited")
    edited = with_fingerprint(edited, "edited", "edited_fingerprint").drop("edited")
    own = materialize(one.select("id", "tie", "print"), "prints-by-id")
    out = edited.join(own.withColumnRenamed("print", "own"), ["id", "tie"])
    out = out.join(own.select(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), F.col("print").alias("next_print")), ["next_id", "next_tie"])
    out = out.withColumn("fingerprint", F.lower(F.hex("own"))).withColumn("next_print", F.lower(F.hex("next_print")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
