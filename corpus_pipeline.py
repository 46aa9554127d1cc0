"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs:

1. ``toxicity``: documents that the classifier calls toxic go;
2. ``near_duplicates``: one document of each class stays;
3. ``decontamination``: documents with a passage of a benchmark item go;
4. ``secrets``: every secret is replaced by its kind in angle brackets, and
   ``n_chars`` follows the new text; no document goes;
5. ``packing``: the documents left, as pieces packed into sequences.

All but the last return the columns of documents, whatever columns those are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlscope.llm import bag_minhash, decontamination, huffman, packing, secret_ledger, toxicity
from crawlscope.llm.queries import END_ID, VOCABULARY
from crawlscope.llm.shared import shared_path, table
from crawlscope.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bag_minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redacted(docs, n_chars_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return huffman.crc32_of(packing.pack(docs, VOCABULARY, END_ID))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Tokenizing, signatures and the classifier are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
