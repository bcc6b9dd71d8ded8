"""The operators bound to the shared tables, one query each, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierspark.llm import ball_tree, bpe, decontaminate, extract, fertility, host_reputation, language, ngram_join, pii, quality, toxicity, warc, whitening
from dossierspark.llm.rows import crc_rest, labelled_sample
from dossierspark.llm.sql import ARCHIVED, CONTAINED, JACCARD, RANKED, REPUTATION
from dossierspark.plans.registry import Registry
from dossierspark.session import table

reg = Registry()
#: Bounds of what the classifiers learn from.
TRAIN_DOCS, TRAIN_QUALITY, TRAIN_CHARS = 10_000, 4_000, 20_000


@reg.add("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def encoded(docs: DataFrame) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = bpe.round_trip(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, drop=("text",))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@reg.add("op2_ngram_jaccard", JACCARD)
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def _held_out(docs: DataFrame, rest: int, mod: int) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(crc_rest("doc_id", mod) == rest, F.lit(True)))


@reg.add("op3_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", TRAIN_DOCS, TRAIN_CHARS))
    return toxicity.score(_held_out(docs.select("doc_id", "text"), 0, 5), model, drop=("text",))


@reg.add("op4_fertility")
def fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pieces = bpe.read_ranks(public_tokenizers.path("piece_bpe_32k.model"))
    return fertility.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ranks, public_tokenizers.PATTERN, pieces, drop=("text", "lang"))


@reg.add("op5_quality")
def quality_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", TRAIN_QUALITY, TRAIN_CHARS))
    return quality.score(_held_out(docs.select("doc_id", "text"), 0, 5), model, drop=("text",))


@reg.add("op6_host_reputation", REPUTATION)
def host_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document whose number ends its path: good if its quality is 1 and it is not toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    path = host_reputation.path_of(F.col("url"))
    number = F.expr("try_cast(nullif(regexp_extract(_path, '/([0-9]+)(?:[.][a-z]+)?/?$', 1), '') AS bigint)")
    shown = pages.select(host_reputation.host_of(F.col("url")).alias("host"), path.alias("_path")).select("host", number.alias("doc_id"))
    known = table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    return host_reputation.judge(pages, shown.join(known, "doc_id").select("host", "good"))


@reg.add("op7_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.tag(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(), drop=("text",))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(joined("base_spans"), 256).alias("base_sha256"),
                       joined("all_spans").alias("spans"))


@reg.add("op8_language")
def language_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(_held_out(docs.select("doc_id", "text"), 2, 4), language.learn(docs), drop=("text",))


@reg.add("op9_decontamination", CONTAINED)
def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@reg.add("op10_main_text")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), drop=("html",))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@reg.add("op11_ranked_search", RANKED)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@reg.add("op12_warc", ARCHIVED)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@reg.add("op13_whitening")
def whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, whitening.fit(vectors), drop=("embedding",))
