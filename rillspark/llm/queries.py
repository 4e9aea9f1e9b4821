"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, table
from .divergence import divergence
from .fill_middle import fill_in_middle, frame_documents, with_digests
from .html_text import extract_text
from .mixing import FIT_ROWS, mix
from .multi_index import search
from .ordinal_quality import grade_documents
from .pii import KINDS, listed, of_kind, sanitise
from .ppm import score_documents
from .quality_rules import apply_rules
from .sentence_pieces import encode_documents
from .simhash import near_duplicates
from .token_counts import count_tokens
from .toxicity import score_toxicity


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good; documents that are likelier good than not are kept."""
    labels = table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    return grade_documents(table(spark, sf_dir, "documents"), ratings, grades=3, keep_from=1)


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return e.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


#: Weights of the languages in the mixture.
TARGETS = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}


def labelled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents that the domain classifier is fitted on."""
    sample = labelled_sample(table(spark, sf_dir, "labels"), "quality", FIT_ROWS)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), labelled_languages(spark, sf_dir), TARGETS)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents"))
    counts = (F.size(of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in KINDS)
    return found.select("doc_id", *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(F.concat("spans", "terms")).alias("spans"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    scored = score_documents(table(spark, sf_dir, "documents"), remainder != 1)
    return scored.select("doc_id", (~F.col("train") & F.col("doc_id").isNotNull()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return n.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = "crc32(cast(doc_id as string)) % 5"
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), f"{fold} != 0")
    return scored.select("doc_id", F.coalesce(F.expr(f"{fold} = 0"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"), more=1)


#: The same by a table of every source and kept term.
OP12_SQL = r"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as k from documents),
w as (select lang, source, k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as materialized (select lang, term from w group by lang, term having count(distinct k) >= 3),
g as materialized (select distinct lang, source from d), v as (select lang, count(*) as v from kept group by lang),
c as materialized (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
s as (select lang, source, sum(n) as n from c group by all), a as materialized (select lang, term, sum(n) as n from c group by all), al as (select lang, sum(n) as n from c group by lang),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v) as p
 from g join kept k on g.lang = k.lang join v on g.lang = v.lang left join s on s.lang = g.lang and s.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // greatest(y.p, 1)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
every as (select x.lang, x.source, y.source as item, coalesce(pairs.value, 0) as value from g x join g y on x.lang = y.lang and x.source <> y.source left join pairs on pairs.lang = x.lang and pairs.source = x.source and pairs.item = y.source),
q as (select a.lang, a.term, (1000000000::hugeint * (a.n + 1)) // (al.n + v.v) as q from a join al using (lang) join v using (lang)),
terms as (select p.lang, p.source, p.term as item, ((p.p - q.q) * (p.p - q.q)) // greatest(q.q, 1) as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
parts as (select lang, source, 'pair' as part, item, value from every union all select lang, source, 'term', item, value from terms),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 200"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_in_middle(frame_documents(table(spark, sf_dir, "documents")))
    return with_digests(moved).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: The same by string functions.
OP13_SQL = """with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, length(text) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from t),
v as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
  else '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) end) as output_sha256, sha256(text) as restored_sha256 from v"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_multi_index, op2_ordinal_quality, op3_sentence_pieces, op4_quality_rules, op5_mixing, op6_pii, op7_ppm, op8_token_counts, op9_simhash, op10_toxicity, op11_html_text, op12_divergence, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op12_divergence": OP12_SQL, "op13_fill_middle": OP13_SQL}
