"""From raw documents to packed training sequences: five stages, each one of the llm operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

1. language ID: documents without a letter, or whose best language scores under 0.5, go;
2. line dedup: later copies of runs of lines of 50 words or more are deleted from the texts;
   documents that keep under a fifth of their words go, as they are copies of what stands
   elsewhere, n_chars follows the text;
3. near-dedup by covering LSH on shingles of five words: texts with a Jaccard similarity of 0.8
   or more are linked, the first document of each group stays;
4. decontamination: documents in which a window of the benchmark occurs go;
5. packing into sequences of at most 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language, lines, minhash, packing
from docloom.llm.common import materialise, table


#: Share of its words that a document must keep in line dedup; under it four fifths are copies, which is a near copy here too.
LEAST_LEFT = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(docs)
    left = F.size(F.filter(F.split("text", r"[ \t\r\n\f\v]+"), lambda w: w != ""))
    found = found.where((F.col("__removed") == 0) | ((left > 0) & (left >= LEAST_LEFT * (left + F.col("__removed_words")))))
    columns = [F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL has no words for the trained and greedy stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
