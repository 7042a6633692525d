"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import cluster_report
from .common import shared_folder, table
from .embedding_dedup import near_embeddings
from .fingerprint import fingerprint_report
from .license_scan import licence_report
from .minhash_dedup import near_duplicates
from .mixing import mixture
from .oracles import ORACLES as ORACLES
from .quality import quality_report
from .secret_scan import secret_report
from .sentencepiece_nbest import encoding_report
from .source_divergence import divergence
from .substring_dedup import window_report
from .suffix_dedup import byte_report
from .toxicity import toxicity_report


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; texts that an earlier run of this cluster scanned under the same rules are read from its ledger."""
    return secret_report(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/secret-ledger")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the sentences of every document state."""
    return licence_report(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best segmentations of every document, and the decoded text."""
    return encoding_report(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate vectors of one label."""
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that mix all documents to the target weights of the domains."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside repeated 35-word windows, of every document."""
    return window_report(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes outside repeated 200-byte strings, of every document."""
    return byte_report(table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors after five rounds of moving 40 centroids."""
    return cluster_report(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that each uses more than its language."""
    return divergence(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (
    op1_secret_scan,
    op2_license_scan,
    op3_sentencepiece,
    op4_embedding_dedup,
    op5_fingerprint,
    op6_toxicity,
    op7_mixing,
    op8_substring_dedup,
    op9_suffix_dedup,
    op10_minhash_dedup,
    op11_centroid_clusters,
    op12_source_divergence,
    op13_quality,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
