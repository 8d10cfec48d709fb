"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .curriculum import ORACLE as MIXING_SQL
from .repair import ORACLE as REPAIR_SQL
from .url_rules import ORACLE as URL_SQL
from .vector_codes import ORACLE as CODES_SQL
from .warc import ORACLE as WARC_SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_classes

    return jaccard_classes(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    out = judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, scan, written

    out = scan(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op6_mixing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .curriculum import mixed

    mix = mixed(_read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.get("takes.position", F.lit(0)).alias("position"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(_read(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2)


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import judged

    return judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .additive_quantisation import search

    return search(_read(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0, k=20)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import decided, rule_table

    return decided(_read(spark, sf_dir, "pages"), rule_table(spark))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import roundtrip

    return roundtrip(_read(spark, sf_dir, "pages")).drop("payload")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import laid_out, scanned

    return scanned(laid_out(_read(spark, sf_dir, "documents"))).select("row.doc_id", "path", "own", "cosine", "licence", "from_path", "how")


def op11_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    out = sharded(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_delta_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import encoded, fingerprint, with_label_errors

    codes, books = encoded(_read(spark, sf_dir, "embeddings"))
    out = with_label_errors(codes)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, digested, repaired

    return digested(repaired(damaged(_read(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_kneser_ney_quality,
        op2_additive_quantisation,
        op3_best_fit_packing,
        op4_url_filters,
        op5_pii,
        op6_mixing_curriculum,
        op7_warc_bundles,
        op8_ngram_jaccard_join,
        op9_license_scan,
        op10_quality_rules,
        op11_karmarkar_karp_shards,
        op12_delta_lloyd_codes,
        op13_conversation_repair,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": URL_SQL,
    "op6_mixing_curriculum": MIXING_SQL,
    "op7_warc_bundles": WARC_SQL,
    "op12_delta_lloyd_codes": CODES_SQL,
    "op13_conversation_repair": REPAIR_SQL,
}
