"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import private, toxicity
from .clustering import OP11_SQL, cluster
from .common import count_words, table
from .context_mixing import language_model_scores
from .conversations import reply_ordered
from .mixing import OP8_SQL, fair_mix
from .ngram_join import ngram_components
from .packing import pack_documents
from .quality import OP7_SQL, quality_rules
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files
from .topk import OP1_SQL, top_k
from .whitening import whiten


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder, order = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(index, folder, order).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.toxicity(docs, model).select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(table(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(columns)


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("words"))
    return fair_mix(sized, size_col="words").select("doc_id", "size", "source_size", "target", "taken")


def op9_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(table(spark, sf_dir, "documents"), private.fit())
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(private.KINDS) for x in (k, i)])
    listed = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]], s["end"], s["kind"]))), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in private.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_scalar_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, dims=64)


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op13_multiplicity_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pivot_topk, op2_token_files, op3_toxicity, op4_ngram_join, op5_quotation_linking, op6_packing, op7_quality_cascade, op8_fair_mix, op9_private, op10_token_counts, op11_scalar_tables, op12_context_mixing, op13_multiplicity_whitening)}
ORACLES = {"op1_pivot_topk": OP1_SQL, "op7_quality_cascade": OP7_SQL, "op8_fair_mix": OP8_SQL, "op11_scalar_tables": OP11_SQL}
