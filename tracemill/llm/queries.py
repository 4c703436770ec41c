"""Registered queries of the text operators. What has no SQL form is tested against brute force, round trips and held-out texts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, leakage, reading
from tracemill.session import table

TOKENIZERS = os.environ.get("TRACEMILL_TOKENIZERS", "/opt/tokenizers")
#: The word pattern that belongs to byte_bpe_50k (a fixed value of that tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_suites(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items and documents holding them, by suite."""
    items = table(spark, d, "eval_items")
    found = leakage.leaked(table(spark, d, "documents"), items)
    return items.select("item_id", "suite").join(found, "item_id").groupBy("suite").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("doc_id").alias("documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_anchors")).select("doc_id", "level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by level: documents, words of prose, and the mean coverage rank of a document."""
    levels = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_anchors"))
    return levels.groupBy("level").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.avg("coverage").alias("coverage"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p7_suites, p8_found, p8_profile)}
#: Every run of an item's length in every document; JSON notebooks are unescaped as far as their words need it.
_P7 = r"""
WITH plain AS (SELECT doc_id, CASE WHEN nb_format = 'ipynb' THEN regexp_replace(regexp_replace(text, '\\[nrtbf"/]', ' ', 'g'), '\\u001b\[[0-9;]*m|\\u001[bB]\[[0-9;]*m', '', 'g') ELSE regexp_replace(text, '\x1b\[[0-9;?]*[ -/]*[@-~]', '', 'g') END AS t FROM documents),
docs AS (SELECT doc_id, regexp_extract_all(lower(t), '[\p{L}\p{Nd}]+') AS w FROM plain),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM eval_items),
passages AS (SELECT DISTINCT item_id, least(12, len(w)) AS n, array_to_string(w[k:k + least(12, len(w)) - 1], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM passages),
runs AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT item_id, doc_id FROM passages JOIN runs USING (n, p))
"""
ORACLE = {
    "p7_found": _P7 + "SELECT item_id, doc_id FROM found",
    "p7_suites": _P7 + "SELECT suite, count(DISTINCT item_id) AS items, count(DISTINCT doc_id) AS documents FROM found JOIN eval_items USING (item_id) GROUP BY suite",
}
