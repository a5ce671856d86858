"""Permission records derived from the star-schema tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows shipped before this date are the baseline.
CUT = "1998-01-01"
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "raw"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject (supplier), permission (brand > type), raw (return flag) and what orders them."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", F.col("l_returnflag").alias("raw"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit(" > "), "p_type").alias("permission"), "p_brand")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("subject"), "s_nationkey")
    return lines.join(parts, "l_partkey").join(suppliers, "l_suppkey")


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of both sides, `of` (b, a) tells which. `ord` is a struct: it orders rows without a global sort."""
    from ..functions.values import normalize_value

    # flags are few: each is read once, not once a line
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("raw")).distinct().withColumn("value", normalize_value(F.col("raw")))
    flags = flags.withColumnRenamed("raw", "_flag")
    rows = shipped(spark, sf_dir).withColumn("ord", F.struct(*ORDER))
    rows = rows.join(F.broadcast(flags), F.col("raw").eqNullSafe(F.col("_flag")), "left").drop("_flag")
    early = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    baseline = early & (F.col("s_nationkey") != 3) & (F.col("p_brand") != "Brand#3")
    actual = ~early & (F.col("s_nationkey") != 7) & (F.col("p_brand") != "Brand#7")
    return rows.filter(baseline | actual).select("subject", "permission", "value", "raw", "ord", F.when(early, "b").otherwise("a").alias("of"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(baseline, actual) records."""
    rows = sided(spark, sf_dir)
    return rows.filter("of = 'b'").drop("of"), rows.filter("of = 'a'").drop("of")


#: The same records and their classification in SQL; the queries' SQL begins with it.
PAIRS_SQL = """
WITH src AS (
  SELECT s_name AS subject, p_brand || ' > ' || p_type AS permission, l_returnflag AS raw, s_nationkey, p_brand, l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_partkey,
         CASE l_returnflag WHEN 'A' THEN 'Y' WHEN 'N' THEN 'N' ELSE lower(l_returnflag) END AS value
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
ranked AS (
  SELECT *, l_shipdate < TIMESTAMP '1998-01-01' AS early FROM src),
sided AS (
  SELECT *, CASE WHEN early THEN 'b' ELSE 'a' END AS side FROM ranked
  WHERE CASE WHEN early THEN s_nationkey <> 3 AND p_brand <> 'Brand#3' ELSE s_nationkey <> 7 AND p_brand <> 'Brand#7' END),
last AS (
  SELECT * FROM sided QUALIFY row_number() OVER (PARTITION BY side, subject, permission ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_partkey DESC, raw DESC) = 1),
b AS (SELECT * FROM last WHERE side = 'b'), a AS (SELECT * FROM last WHERE side = 'a'),
bs AS (SELECT DISTINCT subject FROM b), asub AS (SELECT DISTINCT subject FROM a),
bp AS (SELECT DISTINCT permission FROM b), ap AS (SELECT DISTINCT permission FROM a),
joined AS (
  SELECT coalesce(b.subject, a.subject) AS subject, coalesce(b.permission, a.permission) AS permission, b.value AS bv, a.value AS av, b.raw AS braw, a.raw AS araw
  FROM b FULL OUTER JOIN a ON a.subject = b.subject AND a.permission = b.permission),
known AS (
  SELECT j.*, bs.subject IS NOT NULL AS sb, asub.subject IS NOT NULL AS sa, bp.permission IS NOT NULL AS pb, ap.permission IS NOT NULL AS pa
  FROM joined j LEFT JOIN bs ON bs.subject = j.subject LEFT JOIN asub ON asub.subject = j.subject LEFT JOIN bp ON bp.permission = j.permission LEFT JOIN ap ON ap.permission = j.permission),
typed AS (
  SELECT *, CASE WHEN NOT sa THEN 'user-not-in-actual' WHEN NOT sb THEN 'user-not-in-baseline'
    WHEN bv IS NOT NULL AND av IS NULL AND pa THEN 'missing' WHEN bv IS NOT NULL AND av IS NULL THEN 'permission-not-in-actual'
    WHEN bv = av THEN 'ok' WHEN bv = 'N' AND av <> 'N' THEN 'excess' WHEN bv IS NOT NULL AND bv <> 'N' AND av = 'N' AND bv <> 'Y' THEN 'different'
    WHEN bv IS NOT NULL AND bv <> 'N' AND av = 'N' THEN 'missing' WHEN bv IS NOT NULL THEN 'different'
    WHEN pb AND av <> 'N' THEN 'excess' WHEN pb THEN 'ok' ELSE 'permission-not-in-baseline' END AS type FROM known),
pairs AS (
  SELECT *, CASE type WHEN 'user-not-in-actual' THEN CASE WHEN bv <> 'N' THEN 'medium' ELSE 'info' END
    WHEN 'user-not-in-baseline' THEN CASE WHEN av <> 'N' THEN 'high' ELSE 'info' END
    WHEN 'missing' THEN CASE WHEN bv <> 'N' THEN 'medium' ELSE 'info' END WHEN 'permission-not-in-actual' THEN 'low' WHEN 'ok' THEN 'info'
    WHEN 'excess' THEN 'high' WHEN 'different' THEN 'medium' ELSE CASE WHEN av <> 'N' THEN 'low' ELSE 'info' END END AS severity,
    CASE WHEN bv IS NULL THEN '' WHEN lower(braw) = lower(bv) THEN bv ELSE bv || ' (' || braw || ')' END AS expected,
    CASE WHEN av IS NULL THEN '' WHEN lower(araw) = lower(av) THEN av ELSE av || ' (' || araw || ')' END AS actual FROM typed),
single AS (
  SELECT subject, permission, type, severity FROM pairs WHERE type NOT LIKE 'user-%'
  UNION ALL SELECT subject, '' AS permission, type, CASE WHEN type = 'user-not-in-actual' THEN 'medium' WHEN bool_or(av <> 'N') THEN 'high' ELSE 'low' END AS severity
  FROM pairs WHERE type LIKE 'user-%' GROUP BY subject, type),
found AS (SELECT * FROM single WHERE type <> 'ok')
"""
