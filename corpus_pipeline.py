"""A training corpus from `documents`: rules, near-duplicates, personal data, mixture, tokens.

Every stage takes all that the one before it kept and returns the columns of
`documents`; the last one returns the encoded corpus. Stages handle nulls in
any column, repeated rows and empty tables as their operators state; extra
columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm.common import cut, table
from rillspark.llm.mixing import mix
from rillspark.llm.pii import sanitise
from rillspark.llm.quality_rules import apply_rules
from rillspark.llm.queries import TARGETS, labelled_languages, tokenizer
from rillspark.llm.sentence_pieces import encode_documents
from rillspark.llm.simhash import near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return apply_rules(docs, table(spark, sf_dir, "labels"), whole=True).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 or more of their five-word shingles shared) the document with the smallest id stays.

    A document without an id goes by a hash of its text. Of rows equal in id
    and text one stays; rows that share an id alone are documents of their own.
    """
    of_text = F.xxhash64(F.col("text").cast("string"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), of_text).alias("doc_id"), "text", F.struct("*").alias("row"))
    groups = near_duplicates(keyed.select("doc_id", "text"), words=5, similarity=0.8)
    kept = groups.groupBy("component").agg(F.min(F.struct("doc_id", "of_text")).alias("of")).select("of.*")
    return keyed.select("doc_id", of_text.alias("of_text"), "row").join(kept, ["doc_id", "of_text"], "left_semi").dropDuplicates(["doc_id", "of_text"]).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are sanitised, and n_chars follows if it is there; a null text stays null."""
    found = sanitise(docs, whole=True)
    clean = F.when(F.col("row.text").isNotNull(), F.col("sanitised"))
    row = F.col("row").withField("text", clean)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(clean).cast(dict(docs.dtypes)["n_chars"]))
    return found.select(row.alias("row")).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that language shares match TARGETS; none goes."""
    mixed = mix(docs, labelled_languages(spark, sf_dir), TARGETS, whole=True)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids are packed as little-endian unsigned 32-bit integers."""
    e = encode_documents(docs, tokenizer("piece_bpe_32k.model"))
    return e.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("sentence pieces", encoded),
]

#: Fitted models and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
