"""The queries of this subpackage over the given tables, and their oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import align, bagminhash, chat, decontaminate, extract, hnsw, licences, likelihood, mixing, quality, resample, secret_links, warc
from lintlake.llm.common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


ORACLES["op1_warc_revisits"] = warc.SQL


@query
def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.report(table(spark, sf_dir, "embeddings"))


ORACLES["op2_hnsw"] = hnsw.SQL


@query
def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.scan(table(spark, sf_dir, "documents"))


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


@query
def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.report(table(spark, sf_dir, "documents"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.typed(table(spark, sf_dir, "conversations")))


ORACLES["op6_chat"] = chat.SQL


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op7_decontaminate"] = decontaminate.SQL


@query
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


ORACLES["op8_licences"] = licences.SQL


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


ORACLES["op10_mixing"] = mixing.SQL


@query
def op11_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_log_ratio"] = likelihood.SQL


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(table(spark, sf_dir, "documents"))


@query
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_resample"] = resample.SQL
