"""A corpus pipeline: toxic documents go, near-duplicates go, secrets are masked, sources are mixed, texts are encoded.

Each stage works on all that its predecessor kept, written as Parquet and read again.
Cases: null and empty texts and null ids pass every stage; columns of any names stay as
they are until the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from lorekeep.llm.common import stash, table
from lorekeep.llm.minhash_dedup import near_duplicates
from lorekeep.llm.mixing import mix
from lorekeep.llm.secret_scan import mask_secrets
from lorekeep.llm.sentencepiece_nbest import encode_documents
from lorekeep.llm.toxicity import toxicity


def free_name(docs: DataFrame, stem: str) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while stem in taken:
        stem += "_"
    return stem


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer predicts to be toxic go; columns of any names stay."""
    score = free_name(docs, "toxic_score")
    predicted = free_name(docs, "toxic_predicted")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), score=score, predicted=predicted)
    return scored.where(F.col(predicted) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; documents without an id stay, and one of the rows with equal ids.

    Rows with one id are one document: of those the row with the least hash of its columns stays (maps don't count),
    if the id is its group's least.
    """
    found = near_duplicates(docs).where("doc_id is not null")
    # copies of whole rows each count as kept: an id that several rows have is settled below
    ids = found.groupBy("doc_id").agg(F.min("kept").alias("kept"), (F.count("*") > 1).alias("again"))
    odd = stash(ids.where("again or not kept"))
    alone = docs.where("doc_id is not null").join(odd.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    hashed = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)]
    rows = docs.join(odd.where("again and kept").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"), F.xxhash64(*hashed).alias("order"))
    one = rows.groupBy("doc_id").agg(F.min_by("row", "order").alias("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
    return alone.unionByName(one).unionByName(docs.where("doc_id is null"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, in every document that holds them."""
    masked = mask_secrets(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as their rates say, at least once."""
    return mix(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's best pieces, packed as little-endian 32-bit ids, with their number and score; its next best segmentations, with their scores, the same way."""
    found = encode_documents(docs)
    return found.select(
        F.col("path").alias("doc_id"),
        "n_tokens",
        F.get("scores", F.lit(0)).alias("score"),
        "ids",
        F.slice("scores", 2, F.greatest(F.size("scores") - 1, F.lit(0))).alias("next_scores"),
        F.slice("n_best", 2, F.greatest(F.size("n_best") - 1, F.lit(0))).alias("next_ids"),
        "round_trip",
    )


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", hide_secrets), ("mixing", mix_to_targets), ("encoding", encode)]

#: A classifier, a fit and a tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
