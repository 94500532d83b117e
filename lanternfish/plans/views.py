"""Views of the given tables in the shape of media sightings, in Spark and in SQL.

``events`` stands in for sightings, ``documents`` for texts, ``embeddings`` for faces and prompts, ``pages`` for articles
and ``orders`` for long histories.  The SQL of a view is a common table expression that starts an oracle query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLASSES = {"click": "subject_left", "view": "subject_right", "purchase": "object_only", "signup": "subject_only", "error": "other"}
SOURCES = {0: "bsky", 1: "gdelt", 2: "site"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(value: Column, names: dict) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, author, posted_at, klass, label, source, likes, reposts, sha1, domain, query)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("author"), F.col("ts").alias("posted_at"),
        choose(F.col("event_type"), CLASSES).alias("klass"), (k % 12).alias("label"), choose(F.col("user_id") % 3, SOURCES).alias("source"),
        F.floor("value").cast("long").alias("likes"), F.when(k % 5 != 0, k).alias("reposts"),
        F.sha1((F.col("event_id") % 400).cast("string").cast("binary")).alias("sha1"),
        F.concat(F.lit("site"), (F.col("user_id") % 17).cast("string"), F.lit(".example")).alias("domain"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 7 < 3, "name").otherwise("term").alias("query"))


SIGHTINGS = """s AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS author, ts AS posted_at,
    CASE event_type WHEN 'click' THEN 'subject_left' WHEN 'view' THEN 'subject_right' WHEN 'purchase' THEN 'object_only'
      WHEN 'signup' THEN 'subject_only' WHEN 'error' THEN 'other' END AS klass,
    CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS label,
    CASE user_id % 3 WHEN 0 THEN 'bsky' WHEN 1 THEN 'gdelt' ELSE 'site' END AS source,
    CAST(floor(value) AS BIGINT) AS likes,
    CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS reposts,
    sha1(CAST(event_id % 400 AS VARCHAR)) AS sha1,
    'site' || CAST(user_id % 17 AS VARCHAR) || '.example' AS domain,
    CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 7 = 0 THEN NULL WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 7 < 3 THEN 'name' ELSE 'term' END AS query
  FROM events)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, h): 64 bits of the digest of each document's text; copies of a text become near values by flipping up to four
    bits that their ids choose."""
    d = table(spark, sf_dir, "documents")
    base = F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 16), 16, -10).cast("long")
    flips = " ^ ".join(f"shiftleft(1L, CAST({at} + pmod(doc_id, {n}) AS INT))" for at, n in FLIPS)
    return d.select(F.col("doc_id").alias("id"), base.bitwiseXOR(F.expr(flips)).alias("h"))


FLIPS = ((0, 13), (13, 11), (24, 7), (31, 5))  # first bit, bits to choose from
HASHES = """hv AS (
  SELECT doc_id AS id, xor(CAST('0x' || substr(md5(coalesce(text, '')), 1, 16) AS UBIGINT), """ + " | ".join(
    f"(CAST(1 AS UBIGINT) << CAST({at} + doc_id % {n} AS UBIGINT))" for at, n in FLIPS) + """) AS h
  FROM documents)"""
