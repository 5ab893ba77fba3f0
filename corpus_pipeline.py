"""A corpus pipeline of the llm operators: each stage reads what its predecessor kept.

Quality classifier, n-gram Jaccard join, secret scan, mixing, packing. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing, ngram_join, packing, quality, secrets
from skein.llm.batches import written
from skein.plans.storage import materialize

#: Documents scored below are rejected. Lower than the operator's own 0.7, so a doubtful document stays.
LEAST_QUALITY = 0.5
#: Rows up to which the ids of dropped documents are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject. The texts stay in place.

    Statistics for the fit are computed for labelled documents only. Null and empty texts are scored like any other; repeated rows are
    kept or rejected together; without labels every document stays. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(written(quality.document_statistics(quality.labelled(docs, labels)), "statistics"), labels)
    return written(quality.keep(docs, model, LEAST_QUALITY), "kept")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that the n-gram join links.

    A document is an id with a text: other texts of the same id are decided on their own, repeated rows are one document. A null
    id never is the smallest, unless there is no other. Texts without words are linked with nothing, so those without id all stay.
    """
    key = F.xxhash64("doc_id", "text")
    grouped = ngram_join.jaccard_components(docs.select(key.alias("doc_id"), "text"), k=5, num=4, den=5)
    grouped = materialize(grouped.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")), "groups")
    named = materialize(grouped.distinct().join(docs.select(key.alias("key"), "doc_id").distinct(), "key"), "named")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = named.groupBy("group").agg(F.min(place)["key"].alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    first = materialize(first.select("group", "first"), "first")
    gone = materialize(named.join(first, "group").where(F.col("key") != F.col("first")).select("key"), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    # Rows travel as one column, so no name of theirs can clash.
    kept = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(gone, "key", "left_anti")

    twice = materialize(grouped.groupBy("key").count().where(F.col("count") > 1).select("key"), "repeated")
    n = twice.count()
    if not n:
        return kept.select("row.*")
    twice = F.broadcast(twice) if n <= BROADCAST_ROWS else twice
    blank = F.col("row.doc_id").isNull() & ~F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    repeated = kept.join(twice, "key", "left_semi")
    once = repeated.where(~blank).groupBy("key").agg(F.min("row").alias("row"))
    return kept.join(twice, "key", "left_anti").select("row.*").union(repeated.where(blank).select("row.*")).union(once.select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that the ledger lists for their blobs replaced by the kind's name.

    The ledger outlives the run; only blobs that it lacks are scanned. Null and empty texts stay as they are, repeated rows stay, columns of any
    name pass through; an empty table stays empty.
    """
    _, ledger = secrets.scan_versions(docs, ["doc_id"], store=secrets.ledger_store(spark))
    return written(secrets.redact(docs, ledger), "redacted")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Documents without words come as often as their source's whole copies; null sources are one source; repeated rows are drawn one by one;
    columns of any name pass through; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences; see the packing operator for the columns.

    Null and empty texts are one piece of one id, repeated rows are packed each, other columns are ignored; an empty table gives an empty result.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", keep_one_of_group),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
