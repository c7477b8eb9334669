"""A corpus pipeline of five training-data operators, each stage written as Parquet and read again by the next.

All stages but the last give the columns of documents and ignore others, whatever their names. An empty table gives
an empty one. Rows without an id are rows like any other, where a stage says nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_decode
from tessera.llm.common import documents, fits, materialize, n_words
from tessera.llm.exact_dedup import keep_exact
from tessera.llm.jaccard_trie import keep_one
from tessera.llm.mixing import mix_sources
from tessera.llm.quality import keep_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail.

    Null and empty texts go, as they have too few words. Each row is judged by itself, so ties and repeated rows do not
    matter. A text of any length is read whole, with its words as an array, by one task.
    """
    d = keep_quality(docs.select(*COLUMNS))
    return d.withColumn("n_chars", F.length("text").cast("long"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id.

    Null counts as the empty text, and a null id is the smallest; of repeated rows one stays. Texts of any length are
    compared in chunks.
    """
    return keep_exact(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at five words and 0.8 the one with the smallest doc_id.

    Texts without words, null or not, and rows without an id are linked with nothing and stay; rows that share an id stay
    or go together. A text of any length is read whole; its words' hashes are held by one task.
    """
    return keep_one(docs.select(*COLUMNS), n=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    Null and empty texts have no words and are never taken; a null source is a source of its own. Rows alike in id,
    source and size share out their numbers of copies in the order of their texts. Texts of any length are only counted.
    """
    key = ["doc_id", "source", "__size"]
    m = mix_sources(docs).select("doc_id", "source", F.col("size").alias("__size"), "copies")
    m = materialize(m.groupBy(*key).agg(F.sort_array(F.collect_list("copies")).alias("__copies")), "mix")
    rows, most = m.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("__copies")), F.lit(0))).first()
    d = docs.select(*COLUMNS).withColumn("__size", n_words(F.col("text")))
    # rows alike in id, source and size take turns at their numbers of copies
    turn = F.row_number().over(W.partitionBy(*key).orderBy("text")) if most > 1 else F.lit(1)
    d = d.withColumn("__turn", turn)
    r = m.select(*[F.col(c).alias(f"__m{c}") for c in key], "__copies")
    r = F.broadcast(r) if most <= 1 and fits(rows, 200) else r
    d = d.join(r, [F.col(c).eqNullSafe(F.col(f"__m{c}")) for c in key])
    n = F.element_at("__copies", F.col("__turn")).cast("int")
    return d.withColumn("__n", n).filter("__n > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, as little-endian unsigned 32-bit integers, and digests.

    Null counts as the empty text, without ids. Repeated rows, which the mix makes, each have their result. A text of any
    length is encoded whole; see ``encode_decode`` for what that takes.
    """
    import public_tokenizers

    d = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return d.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", bpe_tokens),
]

#: Trie joins over unbounded groups and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
