"""From raw documents to packed training sequences.

Each stage works on all that its predecessor kept and, but for the last, returns the columns of `documents`: toxic
documents go, then exact copies, then near copies but for one of each class, then documents that hold a passage of the
benchmark; what is left is packed into sequences of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import decontaminate, toxicity
from netquarry.llm.common import Scratch, settle
from netquarry.llm.exact_dedup import keep_first
from netquarry.llm.near_dedup import keep_one
from netquarry.llm.packing import pack, tokenize
from netquarry.llm.queries import END_ID, PACK_WIDTH, word_tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold. Null, empty and very long texts are scored like any other; repeated rows get equal
    scores; an empty table stays empty, and without labels of both kinds no row is dropped by more than the labels' share."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_below(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text, the one of the least identifier (null last). Null counts as empty, so one of all null
    and empty texts stays; of rows that share text and identifier one stays."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of one document of each class of near copies. Texts without words and rows without an identifier all stay;
    rows that share the identifier that stays all stay."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window. Null and wordless texts hold none; repeated rows are judged alike; an empty
    benchmark drops nothing."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences. Null and empty texts are one end token; repeated rows are packed as often as they
    come; longer texts than a sequence are cut; an empty table gives no piece."""
    return pack(tokenize(docs, word_tokenizer_path(), PACK_WIDTH, END_ID), PACK_WIDTH)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Training, order min-hash and packing are not expressible in SQL; the test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Between stages the rows are written as Parquet in the shared folder and read again; a stage's table
    is dropped as soon as the next one's is written. The last stage settles what it reads twice, so its rows outlive the
    table that it began with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES):
            made = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                return settle(made)
            made = scratch.keep(made)
            if k:
                scratch.drop(docs)
            docs = made
