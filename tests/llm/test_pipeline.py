"""Stages against what each operator says of the same rows, on the smallest tables with odd rows added."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from rillspark.llm import queries
from rillspark.llm.common import cut, table
from rillspark.llm.quality_rules import apply_rules
from rillspark.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"


def accepted(spark):
    """A text of middling length that the rules accept."""
    rules = apply_rules(table(spark, SF, "documents"), table(spark, SF, "labels")).where("kept and n_words between 150 and 400")
    return rules.join(table(spark, SF, "documents"), "doc_id").orderBy("anomaly", "doc_id").first()["text"]


def source(spark):
    docs = table(spark, SF, "documents")
    # words of an accepted document in other orders: as ordinary as itself, and no copies
    texts = []
    for seed in (1, 2):
        words = accepted(spark).split()
        random.Random(seed).shuffle(words)
        texts.append(" ".join(words))
    more = [(None, texts[0], None, None, None), (9_000, None, "en", "s", 0), (9_001, "", "en", "s", 0)]
    more += [(9_002, texts[1], "en", "s", None)] * 2
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


def test_stages_in_turn(spark):
    docs = source(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixture", "sentence pieces"]
    rules, dedup, pii, mixture, pieces = (f for _, f in corpus_pipeline.STAGES)

    kept = cut(rules(spark, docs, SF), "t")
    assert kept.schema.names == docs.schema.names
    want = apply_rules(docs, table(spark, SF, "labels")).where("kept")
    assert sorted((r[0] or -1 for r in kept.select("doc_id").collect())) == sorted((r[0] or -1 for r in want.select("doc_id").collect()))

    single = cut(dedup(spark, kept, SF), "t")
    assert single.schema.names == docs.schema.names
    key = F.coalesce("doc_id", F.xxhash64("text"))
    groups = near_duplicates(kept.withColumn("doc_id", key), words=5, similarity=0.8)
    assert single.count() == groups.select("component").distinct().count()
    assert single.where("doc_id = 9002").count() == 1 and single.where("doc_id is null").count() == 1

    clean = cut(pii(spark, single, SF), "t")
    assert clean.schema.names == docs.schema.names and clean.count() == single.count()
    assert clean.where(F.col("text").rlike(r"@[a-z0-9-]+\.[a-z]")).isEmpty()
    assert clean.where("n_chars <> length(text)").isEmpty()

    mixed = cut(mixture(spark, clean, SF), "t")
    assert mixed.schema.names == docs.schema.names
    assert mixed.select("doc_id").distinct().count() == clean.select("doc_id").distinct().count()

    out = pieces(spark, mixed, SF)
    assert out.count() == mixed.count() and out.where("n_tokens < 2").isEmpty()


def test_rows_that_share_an_id_stay_apart(spark):
    docs = table(spark, SF, "documents").limit(0)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.Random(k).choices(words, k=120)) for k in range(3)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (8, texts[1]), (9, texts[2]), (None, texts[2])]
    odd = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema).withColumns({"row": F.lit(1), "component": F.lit("x"), "__copy": F.lit(2), "copy": F.lit(3), "__clean": F.lit("c")})
    single = corpus_pipeline.near_dedup(spark, odd, SF)
    assert single.columns == odd.columns and sorted(r["count"] for r in single.groupBy("doc_id").count().collect()) == [1, 2]
    for stage in (corpus_pipeline.personal_data, corpus_pipeline.mixture):
        assert stage(spark, single, SF).columns == odd.columns
    assert corpus_pipeline.personal_data(spark, single.drop("n_chars"), SF).count() == 3


def test_run_and_empty_stages(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "n_tokens", "ids", "decoded_sha256"}
    none = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).isEmpty()


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{n}" for n in range(1, 14)}
