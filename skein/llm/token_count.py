"""Token counts with the whole-token shortcut.

Offline, every string of the vocabulary is merged on its own; those that give back exactly their own id are proven to
be whole tokens. While counting, a pre-token in that set counts one without merging, and only the rest is merged.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.batches import written
from skein.llm.bpe import _BEYOND_LATIN, ByteBpe, chunks, worker_bpe

LIMIT = 512


def prove_whole_tokens(bpe: ByteBpe) -> tuple[frozenset[str], frozenset[str]]:
    """Vocabulary strings that are one pre-token and encode alone as one token, by the library itself: at most the vocabulary's size.

    The second set has them as the library writes pre-tokens, a character for each byte.
    """
    strings = []
    for raw, i in bpe.ranks.items():
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not bpe.has_special(s):
            strings.append((s, i))
    proven, levels = set(), set()
    for (s, i), e in zip(strings, bpe.library.encode_batch([s for s, _ in strings], add_special_tokens=False), strict=True):
        if e.ids == [i]:
            proven.add(s)
            levels.add(e.tokens[0])
    return frozenset(proven), frozenset(levels)


class TokenCounter:
    """Counts per chunk, kept in a memo that is bounded in chunks and in the length of a chunk."""

    def __init__(self, bpe: ByteBpe, whole: tuple[frozenset[str], frozenset[str]]):
        self.bpe, (self.whole, self.levels), self.memo = bpe, whole, {}

    def chunk_count(self, chunk: str) -> int:
        if chunk in self.whole:
            return 1
        if _BEYOND_LATIN.search(chunk):  # cut and merged by the library, whose character classes are its own
            merge = self.bpe.library.model.tokenize
            return sum(1 if p in self.levels else len(merge(p)) for p, _ in self.bpe.library.pre_tokenizer.pre_tokenize_str(chunk))
        n = 0
        for p in self.bpe.pattern.findall(chunk):
            n += 1 if p in self.whole else len(self.bpe.fast.encode_ordinary(p))
        return n

    def count(self, text: str) -> int:
        if self.bpe.has_special(text):
            return len(self.bpe.library_ids(text))
        parts, memo = chunks(text), self.memo
        try:
            return sum(map(memo.__getitem__, parts))
        except KeyError:
            pass
        if len(memo) >= ByteBpe.MEMO:
            memo.clear()
        long = []
        for p in parts:
            if p not in memo:
                memo[p] = self.chunk_count(p)
                if len(p) > ByteBpe.LONGEST:
                    long.append(p)
        total = sum(map(memo.__getitem__, parts))
        for p in long:
            del memo[p]
        return total


_counter: list[TokenCounter] = []


def count_tokens(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs(doc_id, text, ...)``.

    A null text is empty and has no tokens. Repeated rows and equal ids each give a row; other columns are ignored.
    An empty table gives an empty result.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(ByteBpe(json_path, ranks_path)))  # within the vocabulary's size

    def run(batches):
        if not _counter:
            _counter.append(TokenCounter(worker_bpe(json_path, ranks_path), whole.value))
        counter = _counter[0]
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            n = [counter.count(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
        counter.memo.clear()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"), "token-counts")
