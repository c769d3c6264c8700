"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import clustering, licenses, vector_codes
from heddle.llm.chat_format import formatted
from heddle.llm.common import table
from heddle.llm.decontamination import contaminated
from heddle.llm.embedding_dedup import embedding_groups
from heddle.llm.mixing import mix
from heddle.llm.packing import pack
from heddle.llm.secrets import secret_spans, span_digest
from heddle.llm.simhash_dedup import near_duplicate_groups
from heddle.llm.token_counts import token_counts
from heddle.llm.token_output import token_output
from heddle.llm.toxicity import held_out, toxicity, train

TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = F.size("draws")
    return mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), F.array_join(F.col("draws.shard").cast("array<string>"), ",").alias("shards")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)).withColumnRenamed("id", "doc_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.concat_ws(",", F.transform("offending", lambda x: x.cast("string"))).alias("offending"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = span_digest(secret_spans(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations")).withColumnsRenamed({"conv": "conv_id", "root": "thread_turn"})


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_groups(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster_rows(clustering.cluster(table(spark, sf_dir, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1).rows
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.code_rows(vector_codes.compress(table(spark, sf_dir, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_licenses, op2_mixing, op3_token_counts, op4_decontamination, op5_toxicity, op6_secrets, op7_chat_format, op8_simhash_dedup, op9_embedding_dedup, op10_token_output, op11_centroid_clustering, op12_packing, op13_vector_codes)}

#: DuckDB SQL over whole tables. The other operators hash, draw, search or learn in ways that SQL cannot express.
ORACLES: dict[str, str] = {"op1_licenses": licenses.oracle(), "op11_centroid_clustering": clustering.oracle(), "op13_vector_codes": vector_codes.oracle()}
