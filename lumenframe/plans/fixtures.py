"""Images derived from plain tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filled(t: DataFrame, key: str) -> DataFrame:
    """t with the side w of the image that all its rows fill, and rows of nulls for the places that they leave in it."""
    sides = t.agg(F.count("*").alias("n")).select("n", F.ceil(F.sqrt("n")).cast("long").alias("w"))
    free = sides.select(F.explode(F.expr("sequence(n, n + pmod(-n, w))")).alias(key), "n", "w").filter(f"{key} < n + pmod(-n, w)")
    whole = t.unionByName(free.select(key), allowMissingColumns=True)
    return whole.crossJoin(F.broadcast(sides.select("w")))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gray image of the events' values, black where there are none."""
    t = _filled(_table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    return t.selectExpr("0L as image_id", "cast(event_id div w as int) as y", "cast(event_id % w as int) as x", "cast(if(value is null, 0, least(255, floor(value))) as int) as v")


def em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gray image of 8 x 8 pixels for each embedding."""
    t = _table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) as (p, e)")
    return t.selectExpr("vec_id as image_id", "cast(p div 8 as int) as y", "cast(p % 8 as int) as x", "cast(least(255, greatest(0, floor((cast(e as double) + 1) * 127.5D))) as int) as v")


def mx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images of unequal sizes: of each embedding's image the upper left part, 3 to 8 pixels high and wide."""
    return em(spark, sf_dir).filter("x < 3 + image_id % 6 and y < 3 + (image_id div 6) % 6")


def rg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One colour image of the orders, black where there are none."""
    t = _filled(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    return t.selectExpr(
        "0L as image_id", "cast(o_orderkey div w as int) as y", "cast(o_orderkey % w as int) as x", "cast(coalesce(o_custkey % 256, 0) as int) as b",
        "cast((o_orderkey * 7) % 256 as int) as g", "cast(coalesce(cast(floor(o_totalprice) as bigint) % 256, 0) as int) as r", "cast(255 - (o_orderkey % 16) as int) as a",
    )


def template(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    """A square part of the event image, or as much of it as there is."""
    return ev(spark, sf_dir).filter(f"y between 5 and {4 + size} and x between 7 and {6 + size}").selectExpr("y - 5 as ty", "x - 7 as tx", "v as tv")


EV = """ew AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM events),
ef AS (SELECT event_id, value FROM events UNION ALL SELECT unnest(range(n, n + (w - n % w) % w)), NULL FROM ew),
ev AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST(event_id // w AS INTEGER) AS y, CAST(event_id % w AS INTEGER) AS x,
       CAST(CASE WHEN value IS NULL THEN 0 ELSE least(255, floor(value)) END AS INTEGER) AS v FROM ef, ew)"""

EM = """em AS (SELECT vec_id AS image_id, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x,
       CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS INTEGER) AS v
       FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))"""

MX = EM + """, mx AS (SELECT * FROM em WHERE x < 3 + image_id % 6 AND y < 3 + (image_id // 6) % 6)"""

RG = """ow AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM orders),
os AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT unnest(range(n, n + (w - n % w) % w)), NULL, NULL FROM ow),
rg AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST(o_orderkey // w AS INTEGER) AS y, CAST(o_orderkey % w AS INTEGER) AS x,
       CAST(coalesce(o_custkey % 256, 0) AS INTEGER) AS b, CAST((o_orderkey * 7) % 256 AS INTEGER) AS g,
       CAST(coalesce(CAST(floor(o_totalprice) AS BIGINT) % 256, 0) AS INTEGER) AS r, CAST(255 - (o_orderkey % 16) AS INTEGER) AS a
       FROM os, ow)"""


def template_sql(size: int = 8) -> str:
    return f"t AS (SELECT y - 5 AS ty, x - 7 AS tx, v AS tv FROM ev WHERE y BETWEEN 5 AND {4 + size} AND x BETWEEN 7 AND {6 + size})"
