"""Queries of this package: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import canonical, covering, packing, sampling, spam, tokens


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return covering.all_pairs(*covering.near_duplicates(_read(spark, folder, "claims_test")))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return covering.group_near_duplicates(*covering.near_duplicates(_read(spark, folder, "claims_test")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    same = canonical.same_records(_read(spark, folder, "claims_test"))
    return same.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def p3_copies(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.collapse(_read(spark, folder, "claims_test"))


def _sample(spark: SparkSession, folder: str) -> sampling.TargetSample:
    return sampling.TargetSample(_read(spark, folder, "claims_test"), _read(spark, folder, "sample_targets"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder).report().where("short").select("plan_id", "evidence_label")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder).report()


def p6_wanted(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the report that doesn't depend on the draw."""
    return p6_report(spark, folder).select("plan_id", "evidence_label", "wanted", "available", "short")


def p6_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder).sample()


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_tokens(_read(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(_read(spark, folder, "documents")), _read(spark, folder, "pack_plan"))


def p8_fill_report(spark: SparkSession, folder: str) -> DataFrame:
    """For each plan: containers used, the fewest possible by volume, and the share of room that is free."""
    return packing.fill_report(p8_containers(spark, folder), _read(spark, folder, "pack_plan"))


def p8_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(plan_id, doc_id, parts, chars, in_bounds) of documents packed by their characters: all of each is placed, within a container."""
    plans = _read(spark, folder, "pack_plan")
    packed = packing.pack(_read(spark, folder, "documents"), plans, size="n_chars")
    inside = packed.join(plans, "plan_id").withColumn("ok", (F.col("place") >= 0) & (F.col("place") + F.col("n_chars") <= F.col("capacity")))
    return inside.groupBy("plan_id", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_chars").alias("chars"), F.bool_and("ok").alias("in_bounds"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.find_spam(_read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_copies, p6_found, p6_report, p6_wanted, p6_sample, p7_ids, p8_containers, p8_fill_report, p8_parts, p9_found)}
