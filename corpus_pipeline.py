"""The corpus pipeline: toxic documents go, repeated passages go, near duplicates go, sources are mixed, texts are encoded.

Each stage works on everything its predecessor kept. All but the last return the columns of documents.

In every stage: null texts count as empty, and empty texts stay where nothing else is said; null ids are no reason to go; long
texts count whole; null languages and sources stay as they are; columns of other names go along; an empty table gives an empty
one. Rows that agree in id and text are one document.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.byte_bpe import encode_texts, load_ranks
from marketloom.llm.common import cut, row_key, shared_dir
from marketloom.llm.line_dedup import dedup_lines, dedup_passages
from marketloom.llm.ngram_join import ngram_jaccard_join
from marketloom.llm.source_mixing import mix_sources
from marketloom.llm.toxicity import held_out, learn_exceptions, learn_lexicon, toxicity_column, training_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is 0.5 or more go. The lexicon is learnt from the labels outside the held-out fold.

    Null and empty texts hold nothing toxic and stay. Repeated rows are judged alike. Without labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    rows = training_rows(docs, labels)
    lexicon = learn_lexicon(rows)
    return docs.where(toxicity_column(F.col("text"), lexicon, learn_exceptions(rows, lexicon)) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of three lines or more go; documents of which nothing is left go with them.

    Null texts become empty and stay, as do texts of fewer than three lines. Rows with null ids come after all others, so of
    equal passages theirs go. Repeated rows stay alike; n_chars is that of the text that is left.
    """
    out = dedup_lines(docs).where("n_removed = 0 OR n_removed < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 over five-word shingles stays, that with the smallest id.

    Passages of more than 50 words that occur before in those that stay go, as repeated lines do. Texts without words link with
    nothing and stay. A row with a null id stays only if no row of its group has an id. Of repeated rows (equal id and text) one
    stays; if they differ in language or source, which one is not defined.
    """
    kept = ngram_jaccard_join(docs, n=5, percent=80).where("kept").select(F.col("row_key").alias("_key")).distinct()
    out = docs.withColumn("_key", row_key("doc_id", "text")).join(kept, "_key", "left_semi")
    out = cut(out.dropDuplicates(["_key"]).select(docs.columns))  # repeated rows have one key
    out = dedup_passages(out).where("n_removed = 0 OR n_removed < n_words")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to a flatter distribution: each document once at least, those of rare sources up to twice.

    Null sources are a source of their own. Empty texts are documents like others. Copies are whole rows.
    """
    keyed = docs.withColumn("_key", F.hex(row_key("doc_id", "text")))
    copies = mix_sources(keyed, id_col="_key").groupBy("_key").agg(F.max("copies").alias("_copies"))
    out = keyed.join(copies, "_key").where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return out.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    Null and empty texts have no tokens. Repeated rows have a row each.
    """
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_texts(docs, ranks, public_tokenizers.PATTERN, decode=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("source_mixing", mix),
    ("byte_bpe", encode),
]

#: The first stage learns from labels, which SQL can't express; tests/llm compares run() with a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
