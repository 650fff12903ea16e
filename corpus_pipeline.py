"""From raw documents to encoded training text: a chain of stages, each written as Parquet before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import exact_dedup, mixing, near_dedup, piece_codec, toxicity
from touchline.llm.common import stored
from touchline.llm.queries import DOMAIN, MIX_WEIGHTS

#: Tokens that the mix may hold, as a share of those that reach it, and how often a document may be taken.
MIX_PERCENT, MIX_EPOCHS = 100, 4


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.document_chain(docs, labels))
    return scored.where("not is_toxic").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, rows that repeat both id and text included."""
    return exact_dedup.keep_one_of_each(exact_dedup.drop_exact_duplicates(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.taken(docs, F.expr(DOMAIN), MIX_PERCENT, MIX_WEIGHTS, MIX_EPOCHS, seed=7)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of them and of the text they decode to."""
    model_file = public_tokenizers.path("piece_bpe_32k.model")
    decoded = piece_codec.round_trip(docs, model_file)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near-duplicates", near_stage),
    ("mixing", mix_stage),
    ("encoding", encode_stage),
]

#: The toxicity, near-duplicate and encoding stages have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
