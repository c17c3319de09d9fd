"""A corpus pipeline of five stages: language ID, SimHash near-dedup, substring dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read
again as the next stage's docs. All but the last return the columns of ``documents``, also those of names that the
operators use themselves. An empty table passes all stages as an empty table; texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import bpe, decontam, langid, simhash, substring
from statloom.llm.common import table, written
from statloom.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told; profiles are learned from two thirds of the rows that name theirs.

    Null texts and texts without a letter go. A null doc_id stays but teaches nothing, a null lang too; repeated rows stay;
    of languages equally near, the name that comes first counts, which drops nothing.
    """
    return langid.keep_known(docs, langid.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8) stays, the one with the smallest doc_id.

    Rows without a doc_id stay, and so do rows that repeat the doc_id that stays. Null texts are alike.
    """
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences and words of repeated spans go; a document of which only white space is left goes.

    Null texts and rows without a doc_id stay as they are; rows that repeat a doc_id are one document and stay.
    """
    cleaned = substring.dedup(docs)
    return cleaned.where((F.col(cleaned.columns[-1]) == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go; null texts stay; rows of one doc_id, or none, are judged each."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of ids and of the text decoded from them, for each row; null text is empty."""
    found = bpe.encode_decode(docs, tokenizer_file())
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: Profiles, XXH64 and byte-pair merges have no form in SQL; the tests hold run() against a plain Python pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
