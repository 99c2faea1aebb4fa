"""The corpus pipeline: quality, near-dedup, secrets, mixing, encoding.

Each stage works on all rows that its predecessor kept; all but the last return the columns of documents.
Null texts, empty and very long texts, repeated rows and further columns are handled as the operators
state; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm.common import table, written
from ledgerlake.llm.quality_bayes import keep_good, trained
from ledgerlake.llm.secret_scan import mask_secrets
from ledgerlake.llm.sentencepiece_nbest import encode_documents
from ledgerlake.llm.simhash_golay import keep_one_of_each
from ledgerlake.llm.source_mixing import mixed


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is below one half go."""
    return keep_good(docs, trained(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash within two bits, or Jaccard similarity of five-word shingles of 0.8
    or more) the document with the smallest id stays."""
    return keep_one_of_each(docs, similar=True)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, decoded layers included, are replaced by their kind; n_chars follows the new text."""
    return mask_secrets(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed half way to even entropy; a copy of a document is a row."""
    return mixed(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces and N-best segmentations, with its id and source."""
    return encode_documents(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources", source_mixing),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: SQL has neither the fingerprints, the fitted classifier nor the lattice search; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
