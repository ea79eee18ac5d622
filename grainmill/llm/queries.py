"""Registered queries of the operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm import (
    ann, jaccard, langid, lm, mixing, packing, pii, quality, quality_rules, samples, topk, toxicity, trie, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"

MIX_WEIGHTS = {
    "domain": {"d0": 4, "d1": 1},
    "lang": {"en": 1, "es": 5, "fr": 2},
    "source": {"src0": 1, "src4": 3},
}
MIX_SEED = 7


def table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", DOCUMENTS)


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def judged(scored: DataFrame, modulus: int, value: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        samples.held_out("doc_id", modulus, value).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@register("op1_line_field_quality")
def line_field_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    labels = table(spark, folder, "labels", LABELS)
    field = quality.train(samples.labelled(docs, labels, "quality", samples.remainder("id", 5) != 0))
    return judged(quality.score(docs, field), 5, 0, 0.3)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(samples.labelled(docs, labels, "toxic", samples.remainder("id", 3) != 1))


@register("op2_compression_toxicity")
def compression_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    model = toxicity_model(docs, table(spark, folder, "labels", LABELS))
    return judged(toxicity.score(docs, model), 3, 1, 0.7)


@register("op3_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(documents(spark, folder).select("doc_id", "text"))


@register("op4_shape_field_pii")
def shape_field_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.tag(documents(spark, folder).select("doc_id", "text"), pii.train()).drop("text")


@register("op5_source_mix", mixing.oracle(MIX_WEIGHTS, 1.0, 2, MIX_SEED))
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """As many tokens as the documents have, by weights that some languages and sources cannot supply in two epochs."""
    docs = documents(spark, folder).select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, MIX_WEIGHTS, share=1.0, max_epochs=2, seed=MIX_SEED, details=True)


@register("op6_cost_packing")
def cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder).select("doc_id", "text"))


@register("op7_deleted_interpolation")
def deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    scored = lm.score(docs, samples.remainder("doc_id", 5) != 1)
    return scored.withColumn("held_out", samples.held_out("doc_id", 5, 1)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


TOP_K_SQL = """WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM s QUALIFY rank <= 10"""


@register("op8_pivot_top_k", TOP_K_SQL)
def pivot_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings", EMBEDDINGS).select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


@register("op9_adaptive_scan")
def adaptive_scan(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings", EMBEDDINGS).select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


@register("op10_byte_network_language")
def byte_network_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    net = langid.train(*langid.sample(docs, samples.remainder("doc_id", 4) != 2))
    return langid.identify(docs.select("doc_id", "text"), net).select(
        "doc_id", samples.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score"
    )


@register("op11_refined_whitening")
def refined_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings", EMBEDDINGS).select("vec_id", "embedding"))


@register("op12_parentheses_trie", trie.ORACLE)
def parentheses_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations", CONVERSATIONS))


@register("op13_ngram_quality_rules")
def ngram_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The regression learns from labelled rows outside the fold that `held_out` marks."""
    docs = documents(spark, folder).select("doc_id", "text")
    labels = table(spark, folder, "labels", LABELS)
    keep, limit = samples.remainder("id", 5) != 0, quality_rules.SAMPLE_ROWS
    model = quality_rules.train(samples.labelled(docs, labels, "quality", keep, limit))
    judged_rows = quality_rules.apply_rules(docs, model).drop("text")
    return judged_rows.withColumn("held_out", samples.held_out("doc_id", 5, 0))
