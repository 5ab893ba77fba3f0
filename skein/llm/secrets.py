"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds a row for each blob and rule
version that was ever scanned, with its findings (none is a finding too). A run scans only the pairs that the ledger
lacks, one text per blob however many paths and versions carry it, and joins findings back to all of them.
With a store, the ledger outlives the run: a folder of the shared storage to which each run appends what it scanned.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.batches import bounded_batches, written
from skein.plans.storage import committed, materialize, shared_dir

SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"
#: Part of every rule version; to be raised when :func:`scan_text` changes what the same rules find.
SCANNER = 1
#: Rows up to which a checked side is broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``hints`` are lower-case strings of which a text with a match holds one at least; texts without them aren't searched.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    hints: tuple[str, ...] = ()


#: A private key from its BEGIN line through its END line; where none follows, through the base64 block (encryption headers included).
_BLANKS = r"""(?:[\s"',]|\\[rn])*+"""
_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_BLANKS}(?:Proc-Type|DEK-Info):[^\n\\]*+)*(?:{_BLANKS}(?:[A-Za-z0-9+/]{{16,}}+={{0,2}}|(?<=\n)[A-Za-z0-9+/]++={{0,2}}(?=[^\S\n]*(?:\n|\Z))))+|)"
)

#: Base kinds first; spans that start together are listed in this order.
RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, ("akia",)),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("pem", _PEM, 27, 0, ("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 35, 0, ("eyj",)),
    Rule("hook", r"https://hooks\.[a-z]+\.com/services/[A-Za-z0-9/]{20,}", 40, 0, ("https://hooks.",)),
)


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """Changes whenever any rule does."""
    return hashlib.sha256(f"{SCANNER} {rules!r}".encode()).hexdigest()[:16]


def scan_text(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, end exclusive, by start and then by rule."""
    low, found = text.lower(), []
    for order, rule in enumerate(rules):
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of ``blobs(blob, text)``. A task scans the copies of a blob once, as far as it remembers them."""
    version = rule_version(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        seen: set[str] = set()
        for b in batches:
            names, spans = [], []
            for blob, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if blob in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(blob)
                names.append(blob)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in scan_text(text.as_py(), rules)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([version] * len(names), pa.string()), pa.array(spans, kind)], names=["blob", "rule_version", "spans"])

    return blobs.mapInArrow(run, LEDGER)


def ledger_store(spark: SparkSession) -> str:
    """The folder of the lasting ledger in the shared storage."""
    return f"{shared_dir(spark)}/secret-ledger"


def open_ledger(spark: SparkSession, store: str, rules: tuple[Rule, ...] = RULES) -> DataFrame | None:
    """What earlier runs scanned with these rules, a row for each blob; None if no run has ended yet."""
    runs = committed(spark, f"{store}/{rule_version(rules)}")
    return spark.read.schema(LEDGER).parquet(*runs).dropDuplicates(["blob"]) if runs else None


def scan_versions(
    versions: DataFrame, keys: list[str], text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, store: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(findings, ledger)``: ``keys, blob, spans`` for every row of ``versions``, and the ledger with what was scanned now.

    A null text is the empty blob. Repeated rows and equal keys each keep a row; columns other than ``keys`` and
    ``text`` are ignored, so their names can't clash; an empty table gives empty results. Only pairs of blob and rule version that ``ledger``
    lacks are scanned, or with a ``store`` those that no earlier run has put there; the new part of the ledger is written there, or
    to the shared folder, before findings are joined. Blobs are chosen by hashes; texts that aren't to be scanned don't move.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    if store is not None:
        ledger = open_ledger(spark, store, rules)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    addressed = versions.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.sha2(content, 256).alias("blob"), content.alias("_text"))
    place = F.xxhash64("blob", *(f"_k{i}" for i in range(len(keys))))
    paths = materialize(addressed.drop("_text").withColumn("_place", place), "versions")
    blobs = paths.groupBy("blob").agg(F.min("_place").alias("_place"))  # one of its paths stands for a blob
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    chosen = materialize(blobs.select(F.col("_place").alias("_chosen")), "unseen-blobs")
    n = chosen.count()
    chosen = F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen
    scanned = _scan(addressed.withColumn("_place", place).join(chosen, F.col("_place") == F.col("_chosen"), "left_semi").select("blob", "_text"), rules)
    if store is None:
        scanned = written(scanned.dropDuplicates(["blob"]), "ledger")
    elif n:
        path = f"{store}/{version}/run-{uuid.uuid4().hex}"
        with bounded_batches(spark):
            scanned.dropDuplicates(["blob"]).write.parquet(path)
        scanned = spark.read.schema(LEDGER).parquet(path)
    else:
        scanned = spark.createDataFrame([], LEDGER)
    full = scanned if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(scanned)
    current = full.where(F.col("rule_version") == version).select("blob", "spans")
    joined = paths.drop("_place").join(current, "blob")
    return joined.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), "blob", "spans"), full


def span_string(spans, kinds: tuple[str, ...] | None = None):
    """Column: ``kind:start:end`` joined with commas, of the given kinds or of all."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: list) -> str:
    """``text`` with each span replaced by ``[kind]``; overlapping spans as one, by the first's kind. Spans are in order of their starts."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], "[", s["kind"], "]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: DataFrame, broadcast_rows: int = 100_000, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each span of each text replaced by ``[kind]``; overlapping spans are replaced as one, by the first's kind.

    Blobs with findings are broadcast while there are at most ``broadcast_rows`` of them and their spans, and joined by a shuffle beyond; only
    texts with findings go to Python. Null and empty texts stay as they are; rows, repeated ones too, and columns of any name are
    kept, ``n_chars`` (if there) is counted anew; an empty table stays empty.
    """

    @F.arrow_udf("string")
    def clean(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if t is None else redacted(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    hits = ledger.where((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans")
    if (hits.agg(F.sum(F.size("spans") + 1)).first()[0] or 0) <= broadcast_rows:
        hits = F.broadcast(hits)
    text = F.col("text").cast("string")
    rows = docs.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("blob"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = rows.join(hits, "blob", "left")
    found = F.col("spans").isNotNull()
    joined = joined.withColumn("clean", clean(F.when(found, F.col("row")["text"].cast("string")), F.col("spans")))
    values = {c: F.col("row").getField(c) for c in docs.columns}
    values["text"] = F.when(found, F.col("clean")).otherwise(values["text"])
    if "n_chars" in values:
        values["n_chars"] = F.when(found, F.length("clean").cast("long")).otherwise(values["n_chars"])
    return joined.select(*(v.alias(c) for c, v in values.items()))
