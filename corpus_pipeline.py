"""The corpus pipeline: documents -> language ID -> line dedup -> near-dedup -> mixing -> token ids.

Each stage is given all documents that the one before kept. It is written as Parquet to the shared folder and read again, so a lost executor costs tasks, not stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe, langid, line_dedup, mixing, near_dup
from quernel.llm.common import table


def beside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but own under names that no operator adds, and what gives docs' columns back in their order."""
    names = {c: c if c in own else f"beside_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda out: out.select(*[F.col(new).alias(c) for c, new in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents that aren't held out; rejects those without a language: null and empty texts, and texts without a letter. The rest get the language found.

    Languages that tie: the first by name. Repeated rows stay, each with the same language. Other columns, of whatever names, stay as they are. Without labels there is nothing to find: no documents stay. An empty table stays empty.
    """
    plain, back = beside(docs, "doc_id", "text", "lang")
    found = langid.identify(plain, langid.learn(plain.where(~langid.held_out())))
    return back(found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines. Copies are one page here, and a document that was nothing else stays whole, so that near-dedup has each group's documents to choose from.

    Every document stays, repeated rows too, and lines on the same share of pages go or stay together. A null source is a source, a null text stays null. n_chars, if there, follows the text; other columns, of whatever names, stay. An empty table stays empty.
    """
    plain, back = beside(docs, "text", "source", "n_chars")
    clean = line_dedup.drop_lines(plain, "source", copies=False)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(clean)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 stays: the smallest doc_id (null last; ties by a hash of the row), of identical rows one.

    Null texts and texts without words link with nothing and stay. Columns of whatever names stay. An empty table stays empty.
    """
    return near_dup.keep_one(docs, k=5, threshold=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition of a document that the mix takes, the fractional one cut to its words, which is the feature.

    Null texts and texts without words come only with whole repetitions of their source. Repeated rows are documents of their own; equal ids share a cut by size. Columns of whatever names stay. An empty table stays empty.
    """
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (binary, little-endian unsigned 32-bit) and the digest of what they decode to; a row for each row of docs, whose other columns go.

    Null and empty texts have no ids. Repeated rows give repeated rows. An empty table stays empty.
    """
    out = bpe.encode(docs.select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "source", "lang", "n_tokens", F.col("ids_le").alias("ids"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("mixing", mixed),
    ("bpe", token_ids),
]

#: SQL can't express the language model, the similarity join or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
