"""The corpus pipeline: quality rules, near-duplicate removal, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents; further columns, whatever their names, are left out. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfleet.llm import private
from lumenfleet.llm.common import count_words, delete, scratch, staged
from lumenfleet.llm.mixing import schedule, weighted_fair_queue
from lumenfleet.llm.ngram_join import MOST_BROADCAST, ngram_components, with_set_ids
from lumenfleet.llm.packing import pack_documents
from lumenfleet.llm.quality import quality_rules
from lumenfleet.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the cascade reject go, null and empty texts among them; other rows stay as they are.

    A filter on the verdicts alone would be pushed below the features and work each of them out many times over; Spark moves none past a
    number of the row, so that each verdict is made once and no copy of the texts is written for it.
    """
    judged = quality_rules(docs.select(COLUMNS)).select(*COLUMNS, "kept", F.monotonically_increasing_id().alias("row"))
    return judged.filter("kept AND row >= 0").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; documents without words or ids stay too.

    Rows that repeat a doc_id are told apart by their sets: those of other components stay, those with equal sets are copies, of which
    the one with the smallest text stays. Only such rows are compared by their texts; all others go or stay by their id.
    """
    found = ngram_components(docs).filter("doc_id is not null").select("doc_id", "n_shingles", "set_id", "label")
    kept = found.filter("n_shingles > 0").groupBy("label").agg(F.min(F.struct("doc_id", "set_id")).alias("d")).select("d.*", F.lit(False).alias("empty"))
    kept = staged(kept.unionByName(found.filter("n_shingles = 0").select("doc_id", "set_id", F.lit(True).alias("empty")).distinct()), "kept")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    repeated = staged(ids.filter("m > 1").select("doc_id"), "repeated")
    gone = staged(ids.filter("m = 1").select("doc_id").join(kept, "doc_id", "left_anti").unionByName(repeated), "gone")
    few = lambda ids: F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    alone = docs.select(COLUMNS).join(few(gone), "doc_id", "left_anti")
    told = with_set_ids(docs.select(COLUMNS).join(few(repeated), "doc_id", "left_semi")).join(kept, ["doc_id", "set_id"])
    told = told.withColumn("each", F.when(F.col("empty"), F.monotonically_increasing_id()))
    one = told.groupBy("doc_id", "set_id", "each").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d")).select("doc_id", "d.*")
    return alone.unionByName(one.select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind; n_chars follows the new text. Null and empty texts stay as they are, and so do all rows."""
    clean = private.redact(docs.select(COLUMNS), private.fit())
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source comes to its target: documents past it go, those of short sources come again, the copy at the cut-off is cut behind its
    last word taken. Documents without words go. Rows are numbered and written once; the queue works on sizes, and texts are
    joined to the copies at the end.
    """
    rows = staged(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("number"), count_words(F.col("text")).alias("words")), "numbered")
    copies = schedule(weighted_fair_queue(rows.select("doc_id", "source", "number", "words"), size_col="words"))
    taken = rows.join(copies.select("number", "size", "copy_taken", "vfinish", "key", "copy"), "number")
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each with the white space before it
    until = F.array_join(F.slice(words, F.lit(1), F.col("copy_taken").cast("int")), "")
    taken = taken.withColumn("text", F.when(F.col("copy_taken") >= F.col("size"), F.col("text")).otherwise(until)).orderBy("vfinish", "key", "number", "copy")
    return taken.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as sequences of 2048 tokens: one row per piece. Null and empty texts are one end id."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: SQL has no tokenizer, field model or packing; tests/llm/test_pipeline.py compares run() to brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:  # its successor is written
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
