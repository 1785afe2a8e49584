"""The registered queries of this package: each dealt operator over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.llm import (
    centroids,
    chunked_bpe,
    html_text,
    oracles,
    packing,
    pieces,
    prefix_trie,
    quality_model,
    quality_rules,
    repeats,
    sharding,
    simhash,
    topk,
    warc,
)
from tablekeep.llm.common import table
from tablekeep.session import scratch_folder


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return os.path.realpath(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of equal row counts, mixed as the whole by source."""
    docs = table(spark, folder, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        "source",
    )
    return sharding.assign_shards(rows, "source", 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    docs = table(spark, folder, "documents")
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), capacity=4096, end_id=2)


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again; of the texts the check sums are returned."""
    model = tokenizer_file("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, folder, "documents"), model)
    encoded = encoded.withColumn("n_tokens", F.size("ids").cast("long"))
    return pieces.decode(encoded, model).select(
        "doc_id",
        "n_chars",
        "n_chunks",
        "n_tokens",
        "ids_crc32",
        F.length("decoded").cast("long").alias("decoded_chars"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document, learnt from the labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, folder, "labels"))
    return quality_model.score(docs, model).select(
        "doc_id",
        F.coalesce(quality_model.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        "predicted",
    )


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document; a source stands for a host."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    judged = quality_rules.quality_rules(docs, "text", "source")
    return judged.select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept", "removed_words"
    )


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, folder, "pages"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate component of every document, shingles of 4 words, 4 bits."""
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=4, radius=4)


def op8_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best of all embeddings for each whose id is divisible by 20."""
    found = topk.top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.drop("query_row")


def op9_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """What repeated strings of 200 bytes take from every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = repeats.remove_repeats(docs, "text", length=200, with_texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    path = scratch_folder(spark, "llm-warc")
    warc.write_archives(table(spark, folder, "pages"), path, least_bytes=0)
    found = warc.read_archives(spark, path)
    return found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_chunked_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again; check sums of both."""
    tokenizer = tokenizer_file("word_bpe_49k.json")
    return chunked_bpe.encode(table(spark, folder, "documents"), tokenizer)


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings in 40 clusters after 5 rounds."""
    return centroids.cluster(table(spark, folder, "embeddings"), clusters=40, rounds=5, dim=64)


# name -> (query taking (spark, folder), SQL or None)
QUERIES = {
    "op1_sharding": (op1_sharding, None),
    "op2_packing": (op2_packing, None),
    "op3_sentencepiece": (op3_sentencepiece, None),
    "op4_quality_classifier": (op4_quality_classifier, None),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_html_extraction": (op6_html_extraction, None),
    "op7_simhash": (op7_simhash, None),
    "op8_top_k": (op8_top_k, None),
    "op9_suffix_array": (op9_suffix_array, None),
    "op10_warc": (op10_warc, None),
    "op11_prefix_trie": (op11_prefix_trie, oracles.PREFIX_TRIE),
    "op12_chunked_bpe": (op12_chunked_bpe, None),
    "op13_centroids": (op13_centroids, oracles.centroids_sql()),
}
