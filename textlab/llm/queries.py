"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (byte_bpe, decontaminate, exact_dedup, language_id, license_scan, merkle, ngram_join, packing,
               periodic_runs, secret_scan, suffix_dedup, token_counts, warc)
from .common import ascii_lower, materialise, shared_folder, table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the files are never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern that goes with the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE))


def op2_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    digests = materialise(exact_dedup.with_digest(docs).select("doc_id", "text_sha256"))
    return exact_dedup.exact_dedup(digests)


def op3_decontamination(spark, sf_dir):
    return decontaminate.contained_items(table(spark, sf_dir, "documents", "doc_id", "text"),
                                         table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_ngram_join(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_secrets(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_licenses(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(PIECES))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language_id.identify(docs, tokenizer_path(PIECES), keep=["doc_id"])
    held = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = shared_folder(spark, "warc")
    files = warc.write_warc(pages, folder)
    read = warc.read_warc(files, folder, pages.schema["page_id"].dataType.simpleString())
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest(*fields, ascii_lower(F.col("text"))))
    return merkle.manifest(docs, "doc_id", "source", [*fields, F.col("text")], tampered).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def with_planted_periods(docs):
    """A tenth of the texts, by checksum of the id, become periodic from some word on."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(crc / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n = F.size("words")
    later = F.transform(F.sequence(F.lit(0).cast("long"), n - F.col("a") - 1),
                        lambda i: F.element_at("words", (F.col("a") + i % F.col("p") + 1).cast("int")))
    some = docs.where(F.coalesce(crc % 10 == 0, F.lit(False))).withColumn("words", words)
    a = F.when(n > 0, g % n)
    some = some.withColumn("a", a).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    planted = F.when(n > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), later), " "))
    rest = docs.where(~F.coalesce(crc % 10 == 0, F.lit(False)))
    return rest.unionByName(some.select("doc_id", planted.alias("text")))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents", "doc_id", "text")))


def op13_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    encoded = byte_bpe.encode(docs, tokenizer_path(BYTE_BPE), split_pattern())
    decoded = byte_bpe.decode(encoded, tokenizer_path(BYTE_BPE))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_join": op4_ngram_join,
    "op5_secrets": op5_secrets,
    "op6_licenses": op6_licenses,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_merkle": op11_merkle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}
