"""A corpus pipeline of four stages over ``documents``.

Each stage works on all that the one before kept, written as Parquet and read again:
language ID (rejected documents go), n-gram Jaccard join (one document of each group stays), mixing sources
to target weights (a document stays as often as the mix takes it), byte-level BPE encoding and decoding.

Defined cases: null, empty, white and letterless texts have no language and go in the first stage; texts of any length are read
whole; of rows that repeat an id and a text one stays; a null source is a source, a null id is an id; an empty table gives an
empty table; extra columns, whatever their names, pass all stages but the last, which returns the digests, ids, languages and
sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import byte_bpe, langid, mixture, ngram_join
from pathloom.llm.shared import fresh, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognized."""
    model = langid.fit(docs.where(langid.is_training_row()).select("doc_id", "text", "lang"))
    own = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in ("lang_pred", "score", "rejected")}
    found = langid.predict(docs.withColumnsRenamed(own), model).where("not rejected")
    return found.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return ngram_join.one_of_each(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each document as often as the mix takes it: words taken by words, rounded (a half goes up). Documents are known by id and
    text, as ids may repeat."""
    taken_row, times, turn = (fresh(docs, name) for name in ("taken_row", "times", "turn"))
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    taken = mixture.mix(docs.select(row.alias("doc_id"), "text", "source")).where("size > 0")
    taken = taken.select(F.col("doc_id").alias(taken_row), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    met = docs.join(taken, row == F.col(taken_row))
    return met.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that the mix takes, as digests, with the text decoded from them checked by its hash."""
    return byte_bpe.digests(docs.select("doc_id", "text", "lang", "source"))


STAGES = [("language", language), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
