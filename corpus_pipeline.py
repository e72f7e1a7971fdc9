"""Corpus preparation: language identification, line deduplication, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; what a stage returns is written as Parquet and read
again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import langid, lines, minhash, packing
from panelspark.llm.common import stage, table

NO_ID = -(1 << 63)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this share of belief no language is accepted; a clear text is near 1.
LEAST_SCORE = 0.3
#: A text fits no language where its mean log-probability a letter is below the low quantile of all labelled texts times
#: FIT + 1 / sqrt(words): a few words vary more. Clean texts are near 1 times, other languages at 2.7 or more.
FIT = 2.0


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those that no language fits, go. Learnt from the labelled rows of ``docs``; where nothing can be
    learnt, all texts with a letter stay."""
    model = langid.train(docs, F.lit(True))
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    out = stage(langid.predict(docs, model, keep=tuple(COLUMNS), fit=True))
    low = langid.low_fits(out.filter("lang is not null and doc_id is not null"))
    bound = F.lit(None).cast("double")
    for lang, x in low.items():
        bound = F.when(F.col("lang_pred") == lang, x).otherwise(bound)
    fits = F.coalesce(F.col("fit") >= bound * (FIT + 1 / F.sqrt("n_words")), F.lit(True))
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & fits).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred before go, and texts of which nothing is left; n_chars follows the text."""
    out = lines.dedupe(docs.select(COLUMNS))
    out = out.filter((F.col("n_dropped") == 0) | (F.trim(F.col("text")) != ""))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that with the smallest id (of one id, the smallest hash of its text; null ids
    last). A document is its id and its text: unlike texts that share an id are told apart, and of equal rows one stays. Texts without
    words, and those met only without an id, are no group."""
    rows = stage(minhash.grouped(docs).filter("root is not null").select("root", "doc_id", "text_hash"))
    first = rows.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("f")).filter("n > 1")
    met = rows.join(first, "root").select("doc_id", "text_hash", (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_hash") == F.col("f.text_hash"))).alias("stays"))
    met = stage(met.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"))
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_hash"))
    listed = met.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("text_hash").alias("_hash"), "stays")
    alone = keyed.join(listed, ["_id", "_hash"], "left_anti")
    again = keyed.join(listed.filter("stays"), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return alone.unionByName(again).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("ids")


STAGES = [("language", keep_languages), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("packing", pack)]
#: Languages and token ids are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs)
    return docs
