"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import documents


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_checksums, write_token_files

    return read_checksums(write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op2_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substring_dedup import substring_dedup

    d = substring_dedup(documents(spark, sf_dir), width=50)
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_trie import ngram_jaccard

    return ngram_jaccard(documents(spark, sf_dir), n=3, percent=90)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(documents(spark, sf_dir), 16)


def op7_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_language

    return predict_language(documents(spark, sf_dir))


def op8_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pii_crf import KINDS, find_pii

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    d = find_pii(documents(spark, sf_dir)).withColumn("base", F.filter("spans", lambda s: s["base"]))
    return d.select("doc_id", *map(of, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op9_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from .bpe import encode_decode

    d = encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return d.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .deleted_interpolation import score_documents

    return score_documents(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_alignment import align_tokenizers

    return align_tokenizers(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_audit import source_divergence

    return source_divergence(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_debruijn_spans, op3_jaccard_trie, op4_source_mixing, op5_exact_dedup, op6_feistel_sharding, op7_byte_gru, op8_pii_skip_chain, op9_bpe_words, op10_quality_rules, op11_deleted_interpolation, op12_token_alignment, op13_source_audit)}
ORACLES: dict[str, str] = {
    "op2_debruijn_spans": oracles.SUBSTRING,
    "op3_jaccard_trie": oracles.JACCARD,
    "op4_source_mixing": oracles.MIXING,
    "op5_exact_dedup": oracles.EXACT,
    "op10_quality_rules": oracles.QUALITY,
    "op13_source_audit": oracles.AUDIT,
}
