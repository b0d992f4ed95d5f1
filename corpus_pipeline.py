"""A training corpus from raw documents: five stages, each one of the operators of hindsight.llm.

Every stage takes what its predecessor kept and judges rows, not ids: a row goes for what its own text
holds, whatever other rows share its doc_id or lack one. Of a class of near copies the row with the
smallest known doc_id stays, of rows that are alike in every column one. Rows without words are in no
class and stay; columns beyond those of documents are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.llm import bpe, decontam, jaccard, quality, secrets
from hindsight.llm.common import drop_dir, new_dir, stored, table


def row_key(docs: DataFrame) -> Column:
    """A digest of all columns of a row."""
    return F.sha2(F.to_json(F.struct(*docs.columns)), 256)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = quality.scored(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, "row")
    return rows.where("score >= 0.7").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingles at a similarity of 0.8 or more."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), row_key(docs).alias("row"))
    classes = jaccard.classes(rows.select("doc.doc_id", "doc.text", "row"), n=5, share=80)
    kept = classes.where("chosen").groupBy("row").agg(F.max(F.col("n_shingles") > 0).alias("words"))
    rows = rows.join(kept, "row")
    return rows.where("words").dropDuplicates(["row"]).unionByName(rows.where("NOT words")).select("doc.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into; a text that leaks goes from every row that holds it."""
    gone = decontam.leaking_texts(docs, table(spark, sf_dir, "benchmark"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), decontam.text_key(F.col("text")).alias("key"))
    return rows.join(gone, "key", "left_anti").select("doc.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text masked and n_chars to match."""
    rows = secrets.redacted(docs, new_dir(spark, "ledger"))
    return rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))) if "n_chars" in rows.columns else rows


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), "doc_id", digests=True)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", encoded),
]
#: The classifier, the tiling and the tokenizer are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_dir(spark, "stage")
            docs = stored(docs, path)
            if before is not None:
                drop_dir(spark, before)
            before = path
    return docs
