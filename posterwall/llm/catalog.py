"""Queries of the operators over the driver's tables, with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from posterwall.llm import (
    byte_bpe, byte_gru, chunk_store, compression_rules, context_tree, filter_audit, license_scan, minhash_groups, radix_dedup,
    rule_ensemble, source_mix, warc_bundles, whitening,
)
from posterwall.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op1_compression_rules")
def op1(spark, sf_dir):
    return compression_rules.measure(table(spark, sf_dir, "documents"))


@query("op2_minhash_groups")
def op2(spark, sf_dir):
    return minhash_groups.components(table(spark, sf_dir, "documents"), width=3, percent=85)


@query("op3_chunk_store")
def op3(spark, sf_dir):
    lists, _, read = chunk_store.store_media(table(spark, sf_dir, "documents"))
    rows = lists.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")
    return rows.join(read.hint("merge"), "payload_sha256").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_warc_bundles")
def op5(spark, sf_dir):
    _, records = warc_bundles.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_license_scan", license_scan.oracle())
def op6(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op7_source_mix")
def op7(spark, sf_dir):
    return source_mix.mix(table(spark, sf_dir, "documents"))


@query("op8_byte_gru")
def op8(spark, sf_dir):
    return byte_gru.identify_documents(table(spark, sf_dir, "documents"))


@query("op9_context_tree")
def op9(spark, sf_dir):
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


@query("op10_rule_ensemble")
def op10(spark, sf_dir):
    scored = rule_ensemble.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op11_radix_dedup", radix_dedup.ORACLE)
def op11(spark, sf_dir):
    return radix_dedup.duplicates(table(spark, sf_dir, "documents"))


@query("op12_jacobi_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_filter_audit", filter_audit.ORACLE)
def op13(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
