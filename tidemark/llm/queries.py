"""The operators applied to their whole tables, with production parameters, and SQL for the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, decontaminate, exact_dedup, fingerprints, licenses, merkle, packing, quality, ranked_search, repair_files, simhash, url_filter, warc
from tidemark.llm.common import shared_folder, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op9_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "repair-ids")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    manifest = repair_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer)
    return repair_files.digest_token_files(manifest)


@query()
def op10_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op4_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query(url_filter.oracle())
def op6_rarest_token_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query()
def op1_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query()
def op2_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


@query()
def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return warc.read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query()
def op5_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_rows(table(spark, sf_dir, "conversations"))


@query(merkle.oracle())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_rows(merkle.proofs(table(spark, sf_dir, "documents"), claimed=merkle.lower_cased_fifth))


@query()
def op12_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


@query(ranked_search.oracle())
def op13_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
