"""Mixing sources to target weights with Pareto order sampling, in DataFrame operations only.

A source that must give more than its size gives certain whole copies of every document first. What then is left of its target is drawn with
unequal probabilities: a document's inclusion probability is in proportion to its words (to their three leading bits, so that there are few
different ones), and documents whose probability reaches 1 are certain whole copies too. The others are ranked by random odds divided by
inclusion odds, and taken in that order. The sample has a fixed size in words: it ends at the document where the words taken come nearest
to what is left.

The cut is found by histograms of the rank over all documents (two levels, then the rows of one cell), so no task gathers a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.plans.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 512


def word_array(text):
    """Column: the words in order, null for null. Replacing the five controls and splitting on one character beats a pattern."""
    for control in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(control), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def word_count(text):
    """Column: number of words, 0 for null. Words are runs of anything but space and the controls 9 to 13."""
    return F.coalesce(F.size(word_array(text)), F.lit(0)).cast("long")


def random_unit(*keys):
    """Column: a number in (0, 1) that depends on ``keys`` alone."""
    digits = F.substring(F.md5(F.concat_ws(":", *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def leading_bits(size):
    """Column: ``size`` with all but its three leading bits zero."""
    low = F.greatest(F.length(F.bin(size)) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``source, no, source_size, target`` from ``sizes(source, source_size)``, one row per source.

    Sources take ``weights`` in turn, by code point, null last. Together they get ``share`` of all sizes; none gets more than
    ``cap`` times its size, and what others leave is shared again by weight until none is above.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.withColumn("no", F.row_number().over(by_name)).withColumn("w", F.element_at(cycle, ((F.col("no") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    full = W.orderBy(F.col("most") / F.col("w"), "no")
    below = full.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0.0))
    )
    s = s.withColumn("level", level).withColumn("open", F.col("level") <= F.col("most") / F.col("w"))
    s = s.withColumn("at", F.row_number().over(full))
    rate = F.min(F.when(F.col("open"), F.struct("at", "level"))).over(whole)["level"]
    return s.withColumn("target", F.least(F.coalesce(F.col("w") * rate, F.col("most")), F.col("most"))).select("source", "no", "source_size", "target")


def inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, no, source_size, target, whole, measure, p, left`` from ``sizes(source, measure, words)``, one row per source and measure.

    ``p`` is the least of 1 and a source's constant times ``measure``, such that the expected words are what whole copies leave; ``left`` is what
    documents with a probability below 1 are to give. A source has as many measures as there are numbers of three leading bits.
    """
    t = targets.withColumnRenamed("source", "t_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    s = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("words", F.col("words").cast("double"))
    down = W.partitionBy("no").orderBy(F.desc("measure"))
    larger = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum(F.col("measure") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("larger", larger).withColumn("others", others)
    s = s.withColumn("rate", F.when(F.col("others") > 0, (F.col("rest") - F.col("larger")) / F.col("others")).otherwise(F.lit(0.0)))
    own = W.partitionBy("no")
    s = s.withColumn("c", F.max(F.when(F.col("rate") * F.col("measure") <= 1, F.struct("measure", "rate"))).over(own)["rate"])
    s = s.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("c") * F.col("measure"), F.lit(1.0)))))
    certain = F.coalesce(F.sum(F.when(F.col("p") >= 1, F.col("words"))).over(own), F.lit(0.0))
    return s.withColumn("left", F.col("rest") - certain).select("source", "no", "source_size", "target", "whole", "measure", "p", "left")


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows(doc_id, source, size, tie, number, ...)`` with what the plan says of their source and size, and their rank ``y`` in (0, 1).

    ``y`` is null where nothing is drawn: for documents that are certain or have no words.
    """
    t = plan.withColumnRenamed("source", "t_source").withColumnRenamed("measure", "t_measure")
    ranked = rows.join(t, F.col("source").eqNullSafe(F.col("t_source")) & (leading_bits(F.col("size")) == F.col("t_measure"))).drop("t_source", "t_measure")
    u, p = random_unit(F.col("doc_id"), F.col("tie"), F.col("number")), F.col("p")
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = ranked.withColumn("y", F.when((p > 0) & (p < 1), odds / (1 + odds)))  # orders as the odds do
    ranked = ranked.withColumn("cell", F.floor(F.col("y") * CELLS)).withColumn("sub", F.floor((F.col("y") * CELLS - F.col("cell")) * CELLS))
    return ranked.withColumn("key", F.struct("y", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "tie", "number"))


def _drawn():
    """Column: whether a ranked row joined with its source's cut is in the sample."""
    edge = (F.col("sub") < F.col("cut_sub")) | ((F.col("sub") == F.col("cut_sub")) & F.coalesce(F.col("key") <= F.col("cut_key"), F.lit(False)))
    return F.col("y").isNotNull() & (F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell")) | ((F.col("cell") == F.col("cut_cell")) & edge))


def plan_mix(units: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """Inclusion probabilities per source and measure, and the cut of each source's sample, from ``units(doc_id, source, size, tie, rows)``."""
    sizes = units.groupBy("source", leading_bits(F.col("size")).alias("measure")).agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    sizes = materialize(sizes, "mix-sizes")
    targets = materialize(source_targets(sizes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap), "mix-targets")
    plan = materialize(inclusion(sizes, targets), "mix-inclusion")
    drawn = _ranked(_numbered(units), plan).where(F.col("y").isNotNull())

    def crossing(cells: DataFrame, by: str, before) -> DataFrame:
        """The first cell of each source at which the words pass what is left, and the words before it."""
        run = W.partitionBy("no").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
        c = cells.withColumn("upto", before + F.sum("words").over(run)).where(F.col("upto") > F.col("left"))
        c = c.groupBy("no").agg(F.min(F.struct(F.col(by), (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
        return c.select("no", F.col(f"c.{by}").alias(f"cut_{by}"), F.col("c.before").alias(f"before_{by}"))

    first = materialize(crossing(drawn.groupBy("no", "left", "cell").agg(F.sum("size").alias("words")), "cell", F.lit(0)), "mix-cells")
    edge = drawn.join(first, "no").where(F.col("cell") == F.col("cut_cell"))
    second = crossing(edge.groupBy("no", "left", "before_cell", "sub").agg(F.sum("size").alias("words")), "sub", F.col("before_cell"))
    second = materialize(second.join(first, "no"), "mix-subcells")
    rows = edge.drop("cut_cell", "before_cell").join(second, "no").where(F.col("sub") == F.col("cut_sub"))
    last = W.partitionBy("no").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.col("before_sub") + F.sum("size").over(last)).withColumn("miss", F.col("left") - (F.col("upto") - F.col("size")))
    inside = (F.col("upto") <= F.col("left")) | ((F.col("miss") >= 0) & (F.col("upto") - F.col("left") < F.col("miss")))
    inner = rows.where(inside).groupBy("no").agg(F.max("key").alias("cut_key"))
    return plan, materialize(second.join(inner, "no", "left").select("no", "cut_cell", "cut_sub", "cut_key"), "mix-cuts")


def _copies(rows: DataFrame, plan: tuple[DataFrame, DataFrame]) -> DataFrame:
    inclusion_plan, cuts = plan
    extra = ((F.col("p") >= 1) | _drawn()).cast("long")
    return _ranked(rows, inclusion_plan).join(cuts, "no", "left").withColumn("copies", F.col("whole") + extra)


def _measured(docs: DataFrame, *more) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("tie"), *more,
    )


def _units(docs: DataFrame) -> DataFrame:
    """Equal rows counted: what of a document matters to the mix, and how often it's there."""
    return materialize(_measured(docs).groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("rows")), "mix-units")


def _numbered(units: DataFrame, most: int = 4096) -> DataFrame:
    """A row for each of a unit's equal rows, with its ``number``. Units of more than ``most`` rows are cut, and the parts are dealt to all tasks."""
    few = units.where(F.col("rows") <= most).withColumn("first", F.lit(0).cast("long"))
    many = units.where(F.col("rows") > most).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(most).cast("long"))))
    many = many.withColumn("rows", F.least(F.col("rows") - F.col("first"), F.lit(most))).repartition("tie", "doc_id", "first")
    return few.unionByName(many).withColumn("number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("rows") - 1))).drop("first", "rows")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for each row of ``docs(doc_id, text, source, ...)``.

    ``copies`` is how often the mix holds the whole document and ``taken`` its words, repeats counted. A null text has no
    words; null sources are one source; a null doc_id is drawn like any other, by its text. Repeated rows (equal id, source and text)
    are drawn one by one, by their number. Other columns are ignored, so their names can't clash; an empty table gives an empty result.
    The draw depends on ids, texts and numbers only, so reruns agree.
    """
    units = _units(docs)
    return _copies(_numbered(units), plan_mix(units, weights, share, cap)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, with all its columns. Texts of single rows are not shuffled.

    Rows with equal id, source and text are numbered inside the partitions they are written in, so no task gathers them. Nulls, empty texts,
    other columns and an empty table are as in :func:`mix`.
    """
    units = _units(docs)
    plan = plan_mix(units, weights, share, cap)
    rows = _measured(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    again = materialize(units.where(F.col("rows") > 1).select("doc_id", "source", "tie"), "mix-repeated")
    same = [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in ("doc_id", "source", "tie")]
    named = again.select(*(F.col(c).alias(f"a_{c}") for c in again.columns))
    single = rows.join(named, same, "left_anti").withColumn("number", F.lit(0).cast("long"))
    repeated = materialize(rows.join(named, same, "left_semi").withColumn("part", F.spark_partition_id()), "mix-repeated-rows")
    key = ["doc_id", "source", "tie"]
    upto = W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = repeated.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    before = before.select(*(F.col(c).alias(f"b_{c}") for c in (*key, "part")), "before")
    inside = W.partitionBy(*key, "part").orderBy(F.lit(0))
    numbered = repeated.withColumn("at", F.row_number().over(inside))
    numbered = numbered.join(before, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in (*key, "part")]).withColumn("number", F.col("before") + F.col("at") - 1)
    rows = single.unionByName(numbered.select(*single.columns))
    return _copies(rows, plan).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
