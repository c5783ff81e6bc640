"""The queries opN_<name> over the whole documents table, and the DuckDB SQL for the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemill.llm import exact, language, licenses, lines, mixing, pii, sentencepiece, simhash, spotsigs, substring
from tidemill.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query
def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder)).drop("spans")


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder))


ORACLE_SQL["op3_mixing"] = mixing.ORACLE


@query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(documents(spark, folder))


@query
def op5_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, folder))


ORACLE_SQL["op5_exact"] = exact.ORACLE


@query
def op6_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.remove_repeated_lines(documents(spark, folder)).drop("kept")


ORACLE_SQL["op6_lines"] = lines.ORACLE


@query
def op7_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.edited_likeness(documents(spark, folder))


@query
def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, folder))


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(documents(spark, folder))


@query
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece.digests(documents(spark, folder))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
