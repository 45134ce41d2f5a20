"""From raw documents to packed sequences: language ID, near-dedup, personal data, mixing, packing."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlens.llm import langid, mixing, packing, pii, simhash
from ladderlens.llm.common import documents, staged
from ladderlens.llm.tokens import default_path

#: Bits a byte of the best code beyond which a text is in none of the learned languages; bytes at
#: random cost about 8.
MOST_BITS = 7.5
#: Targets of the mix: shares of tokens to this power.
MIX_TEMPER = 0.95


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter or are coded no better than noise by every learned
    language; without any labelled language nothing can be judged and all stay. Repeated rows and all
    columns stay, whatever their names."""
    counts = langid.learn(docs.select("text", "lang"))
    if not counts:
        return docs
    judged = langid.identify(docs, counts, docs.columns)
    return judged.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked texts the one with the smallest doc_id, once. Rows of one doc_id are
    told apart by their texts: unlike ones are in groups of their own, repeated ones stay once, the one whose
    other columns hash lowest. Rows without a doc_id stay."""
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    rows = docs.select(key.alias("id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.where("id.doc_id IS NOT NULL")
    found = simhash.near_duplicates(named.select(F.col("id").alias("doc_id"), "text"))
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("id"))
    kept = named.select("id", "row").join(first, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*").union(rows.where("id.doc_id IS NULL").select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and the terms that disclose it; n_chars follows the new text."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics approach their tempered shares."""
    return mixing.sample(docs, partial(mixing.tempered, power=MIX_TEMPER)).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of at most 4096 tokens. A null or empty text has
    its end id only; repeated rows are packed as often as they come; an empty table gives no pieces."""
    return packing.pack(docs.select("doc_id", "text"), default_path())


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("pii", personal_data), ("source_mixing", source_mixing), ("packing", packed)]
#: Codes, sketches and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
