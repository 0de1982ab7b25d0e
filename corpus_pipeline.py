"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and gives a DataFrame, which is written as Parquet and read again for the next:

1. quality: documents that the ordinal classifier rejects go.
2. near_copies: of each group of near copies (5-word shingles, similarity of
   0.8 or more, also over chains of links) the least doc_id stays.
3. substrings: words covered by a window of 35 words that starts anywhere else
   go; n_chars follows the text.
4. mix: documents are taken as often as the water-filling mix says; a document
   without words is not taken.
5. packing: sequences of at most 4096 tokens.

Empty tables pass through all stages; nulls, ties and repeated rows are
treated as each operator's module says. Columns beyond those of documents are
carried through to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, quality, substrings
from tidemark.llm.common import keep, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(mixing.mix(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", filter_quality),
    ("near_copies", drop_near_copies),
    ("substrings", cut_repeats),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted classifier and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
