"""A corpus pipeline over the documents table: toxicity, near copies, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm import jaccard, mixing, packing, pii, queries, toxicity
from grainmill.session import delete_folder, scratch_folder, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.7
MIX_SHARE = 0.8  # of all tokens; no document is taken twice


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under `TOXIC`; the model learns as in the operator's own query."""
    small_batches(spark)
    labels = queries.table(spark, sf_dir, "labels", queries.LABELS)
    model = queries.toxicity_model(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(docs.select(*COLUMNS), model, name="_toxicity")
    return scored.where(F.col("_toxicity") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group connected by links of 0.8 or more.

    An id with several texts keeps those that head their own group; of rows alike in id and text the smallest stays.
    Null, empty and blank texts are one group. Rows with a null id belong to no group and stay.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    heads = jaccard.representatives(docs.select("doc_id", "text"))
    rest = [c for c in COLUMNS if c != "doc_id"]
    kept = docs.withColumn("seal", F.xxhash64("text")).join(heads, ["doc_id", "seal"], "left_semi")
    kept = kept.groupBy("doc_id", "seal").agg(F.min(F.struct(*rest)).alias("row"))
    kept = kept.select("doc_id", *[F.col(f"row.{c}").alias(c) for c in rest])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind and n_chars counted anew."""
    small_batches(spark)
    masked = pii.redact(docs.select(*COLUMNS), pii.train())
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of all tokens by the weights of domains, languages and sources."""
    return mixing.mix(docs.select(*COLUMNS), queries.MIX_WEIGHTS, share=MIX_SHARE, max_epochs=1, seed=queries.MIX_SEED)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("personal data", mask_personal_data),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier, MinHash groups and a tokeniser are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between them is written to the shared checkpoint folder.

    A stage's documents are deleted when the next one's are written; the last ones, which the result reads, by
    `session.clear_scratch`.
    """
    docs, before = queries.documents(spark, sf_dir), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_folder(spark, f"corpus-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete_folder(spark, before)
            before = path
    return docs
