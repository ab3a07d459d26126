"""The training-data operators over the given tables, one query each, and the same in SQL where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outings.llm import sql
from outings.llm.alignment import align
from outings.llm.common import table
from outings.llm.decontaminate import decontaminate
from outings.llm.embeddings import near_vectors
from outings.llm.grace import exact_copies
from outings.llm.huffman import encode_corpus, read_ids
from outings.llm.langid import identify, train
from outings.llm.layout import extract_layout
from outings.llm.packing import pack_documents
from outings.llm.sharding import balanced_map, numbered, place, size_of
from outings.llm.simhash import near_duplicates
from outings.llm.substrings import remove_repeats
from outings.llm.warc import deduplicate, read_archives, resolved
from outings.llm.whitening import whiten
from outings.session import scratch_dir


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, words inside benchmark windows, and items that occur in it."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]).cast("binary"), 256).alias("items_sha256"), c.contaminated.alias("contaminated"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest document reachable by near fingerprints."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as the deduplicated archives give it back."""
    archives = deduplicate(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch_dir(spark, "warc"))
    return resolved(read_archives(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words that are left when passages of smaller documents are cut."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = F.col("repeats")
    return found.select("doc_id", c.n_words.alias("n_words"), c.n_removed.alias("n_removed"),
                        F.sha2(c.kept.cast("binary"), 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's visible text, laid out."""
    found = extract_layout(table(spark, sf_dir, "pages").select("page_id", "html"))
    c = F.col("layout")
    return found.select("page_id", c.n_lines.alias("n_lines"), c.n_chars.alias("n_chars"), c.text.alias("text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard of 16 of nearly equal bytes, and its number there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = place(docs, balanced_map(docs, 16).newest(), text="text").select(
        "doc_id", size_of("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "vslot", "shard")
    return numbered(placed, "slot", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op8_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place and ids in the encoded files, as read back from them."""
    manifest = encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2, folder=scratch_dir(spark, "ids"))
    return read_ids(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, predicted by a network that has seen none of the held-out ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.drop("lang"), train(docs, ~held_out()))
    c = F.col("language")
    return found.select("doc_id", held_out().alias("held_out"), c.lang.alias("lang_pred"), c.score.alias("score"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's number of links, the smallest vector reachable, and whether that is itself."""
    found = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    c = F.col("links")
    return found.select("vec_id", c.n_links.alias("n_links"), c.component.alias("component_id"), c.kept.alias("kept"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, groups and links between two tokenizers, and how common its links are."""
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
                  public_tokenizers.path("piece_bpe_32k.model")).documents
    a = F.col("alignment")
    return found.select("doc_id", *[a[c].alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of equal texts, and whether it is the one that stays."""
    found = exact_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    c = F.col("copies")
    return found.select("doc_id", c.keep_id.alias("keep_id"), c.group_size.alias("group_size"), c.kept.alias("kept"), c.sha256.alias("text_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable vector's leading whitened components, over the covariance of all of them."""
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    w = F.col("whitening")
    return found.select("vec_id", w.n.alias("n"), w.deviation.alias("deviation"), w.explained.alias("shares"),
                        w.identity_error.alias("identity_error"), F.posexplode(w.whitened).alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("shares", F.col("place")).alias("explained"), "identity_error")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_substrings": op4_substrings,
    "op5_packing": op5_packing,
    "op6_layout": op6_layout,
    "op7_sharding": op7_sharding,
    "op8_huffman": op8_huffman,
    "op9_language": op9_language,
    "op10_embeddings": op10_embeddings,
    "op11_alignment": op11_alignment,
    "op12_exact": op12_exact,
    "op13_whitening": op13_whitening,
}
ORACLES = {
    "op1_decontamination": sql.DECONTAMINATION,
    "op3_warc": sql.WARC,
    "op4_substrings": sql.SUBSTRINGS,
    "op7_sharding": sql.SHARDING,
    "op10_embeddings": sql.EMBEDDINGS,
    "op12_exact": sql.EXACT,
}
