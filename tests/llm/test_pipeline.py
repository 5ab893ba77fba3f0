import random

import numpy as np

import corpus_pipeline
from skein.llm import langid, queries

from .test_ngram_join import grams


def test_stages_on_the_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, total = docs.columns, docs.count()
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    kept = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    good = labels.join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").count()
    assert labels.join(kept, "doc_id").count() >= 0.97 * good
    assert total > counts[0] > counts[1] == counts[2] > 0 and counts[4] >= counts[3]


def test_groups_keep_their_smallest(spark, table):
    text = " ".join(str(i) for i in range(50))
    docs = table([(5, text, "en", "a"), (3, text, "en", "a"), (9, "other words here now", "en", "a"), (None, "no id here", "en", "a"), (3, text, "en", "a")])
    out = corpus_pipeline.keep_one_of_group(spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "9", "None"] and out.columns == docs.columns


def test_columns_with_names_of_the_stages(spark):
    text = " ".join(str(i) for i in range(50))
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4), (2, text, 5, 6, 7, 8), (3, "password=abcdefghijkl", 9, 9, 9, 9)], "doc_id long, text string, key int, `group` int, row int, _key int")
    out = corpus_pipeline.keep_one_of_group(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, text, 1, 2, 3, 4), (3, "password=abcdefghijkl", 9, 9, 9, 9)]
    clean = corpus_pipeline.redact_secrets(spark, docs, "")
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect()))[2] == (3, "[assign]", 9, 9, 9, 9)
    assert corpus_pipeline.mix_sources(spark, docs.withColumnRenamed("_key", "source"), "").columns == [*docs.columns[:-1], "source"]


def similarity(a, b, k):
    a, b = grams(a, k), grams(b, k)
    return len(a & b) / len(a | b)


def one_of_group(rows):
    """Smallest ids of the groups that similarities of five-word shingles of 0.8 or more join, by brute force."""
    group = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and similarity(a, b, 5) >= 0.8:
                old, new = sorted((group[i], group[j]), reverse=True)
                group = {x: new if g == old else g for x, g in group.items()}
    return sorted(set(group.values()))


def test_stage_joins_what_five_words_join(spark, table):
    rng = random.Random(11)
    rows = []
    for _ in range(12):
        base = [str(rng.randrange(10**6)) for _ in range(rng.choice([60, 120, 250]))]
        for edits in (0, len(base) // 60, len(base) // 50, len(base) // 25, len(base) // 12):
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = "new" + str(rng.random())
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    between = [(a, b) for i, (_, a) in enumerate(rows) for _, b in rows[:i] if similarity(a, b, 5) >= 0.8 and similarity(a, b, 3) < 0.9]
    assert len(between) >= 5
    out = corpus_pipeline.keep_one_of_group(spark, table([(i, t, "en", "a") for i, t in rows]), "")
    assert sorted(r["doc_id"] for r in out.collect()) == one_of_group(rows)


def test_repeated_and_missing_ids_are_decided_by_text(spark, table):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [
        (1, a, "en", "a"), (2, a, "en", "a"), (2, b, "en", "a"), (3, c, "en", "z"), (3, c, "en", "a"), (3, d, "en", "a"), (3, d + " tail", "en", "a"),
        (None, a, "en", "a"), (None, "no id here", "en", "a"), (None, "no id here", "en", "b"), (None, "NO id here", "en", "a"),
        (None, " ", "en", "a"), (None, " ", "en", "a"), (None, None, "en", "a"), (4, None, "en", "a"), (4, None, "en", "a"), (4, "", "en", "a"), (5, "", "en", "a"),
    ]
    out = corpus_pipeline.keep_one_of_group(spark, table(rows), "")
    got = [(r["doc_id"], r["text"], r["source"]) for r in out.collect()]
    full = [x for x in got if x[1] and x[1].strip()]
    assert sorted((x for x in full if x[0] is not None and x[1][0] != "d")) == [(1, a, "a"), (2, b, "a"), (3, c, "a")]
    assert len([x for x in full if x[0] == 3 and x[1].startswith("d0")]) == 1
    assert [x[1].lower() for x in full if x[0] is None] == ["no id here"]
    assert sorted((x[:2] for x in got if x not in full), key=repr) == sorted([(None, " "), (None, " "), (None, None), (4, None), (4, ""), (5, "")], key=repr)


def test_registered(spark, sf):
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_language_query(spark, sf):
    out = queries.op6_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out["held_out"]]
    assert np.mean(held["lang"] == held["lang_pred"]) > 0.9
    assert langid.SAMPLE == 2_000
