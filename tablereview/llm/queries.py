"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablereview.llm import (
    dedup,
    fingerprints,
    head_tail,
    language,
    licenses,
    line_dedup,
    line_rules,
    mixing,
    packing,
    periods,
    pii,
    resample,
    secret_scan,
)
from tablereview.llm.native import let, words_of
from tablereview.llm.reference_sql import SQL

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.near_duplicates(documents(spark, folder), width=dedup.WIDTH)


def op3_prefix_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(documents(spark, folder))


def op4_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.line_rules(documents(spark, folder))


def op5_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(documents(spark, folder)))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a tree: source / thousands / fifties / id."""
    path = F.concat_ws(
        "/", "source", F.expr("doc_id div 1000"), F.expr("doc_id div 50"), F.concat(F.col("doc_id"), F.lit(".txt"))
    )
    files = documents(spark, folder).select(path.alias("path"), "text")
    found = licenses.scan_licenses(files)
    doc_id = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id")
    return found.select(doc_id, "*")


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.scan_personal(documents(spark, folder)))


def op9_language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    models = language.language_models(documents(spark, folder))
    return language.identify(spark.read.parquet(f"{folder}/pages.parquet"), models)


def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, folder), copy_column="copy_no")


def op11_head_tail_resampling(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    drawn = head_tail.resample_towards(documents(spark, folder), benchmark)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(documents(spark, folder)).drop("keep")


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents with h % 10 = 0, h the CRC-32 of the id: from a word on, p words are said again and again."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def again(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.when(n > 0, F.array_join(F.transform(words, lambda _, i: F.get(words, at(i))), " ")).otherwise("")

    return docs.select("doc_id", F.when(h % 10 == 0, let(words_of(F.col("text")), again)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.digest(periods.find_runs(with_periods(documents(spark, folder))))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_minhash_near_dedup,
        op3_prefix_fingerprints,
        op4_line_rules,
        op5_importance_resampling,
        op6_secret_scan,
        op7_license_scan,
        op8_personal_data,
        op9_language_fusion,
        op10_mix_sources,
        op11_head_tail_resampling,
        op12_line_dedup,
        op13_periodic_runs,
    )
}
