"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackmill.llm.common import read, stored
from trackmill.llm.line_dedup import line_dedup
from trackmill.llm.mixing import mix
from trackmill.llm.near import drop_near_duplicates
from trackmill.llm.packing import pack_in_order
from trackmill.llm.toxicity import drop_toxic, learn


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more as toxic go; the lexicon is learned from the labels of those at hand. Null and empty
    texts are scored as empty and stay; repeated rows stay or go together; without labels, fixed terms alone decide."""
    return drop_toxic(docs, learn(docs, read(spark, sf_dir, "labels")), threshold=0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents are taken out of all of them; the documents stay, in the end empty ones too.
    A null text becomes an empty one; repeated rows are documents of their own."""
    return line_dedup(docs, min_docs=10).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id (null ids last), and of repeated
    rows one: sets of five-word shingles with a Jaccard similarity of 0.8 or more. All empty texts are one group."""
    return drop_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, small sources up to one and a half times; written in the order of the mixture, which
    packing reads from the files. A null source is a source of its own."""
    return mix(docs, max_repeats=1.5).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096 tokens, and the places of the documents and of the sequences in
    the mixture. An empty text is its end token. Workers still hold what earlier stages needed, so they remember fewer
    words than op5's."""
    return pack_in_order(docs, cached_runs=200_000)


STAGES = [
    ("toxicity", toxic_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: No SQL: the stages learn, hash and tokenise. tests/llm/ hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again for the next. An empty table gives an empty
    result."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
