"""Catalog of known settings: look-up, enrichment, coverage, cross-check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import first_bare, norm_key
from .match import closest


def catalog(rows: DataFrame) -> DataFrame:
    """key, name, description, type, grp, ord: the first row of each name (rows: name, description, type, grp, ord)."""
    keyed = rows.withColumn("key", norm_key(F.col("name"))).filter("key <> ''")
    rest = [c for c in keyed.columns if c != "key"]
    return keyed.groupBy("key").agg(F.min_by(F.struct(*rest), "ord").alias("first")).select("key", "first.*")


def groups(cat: DataFrame) -> DataFrame:
    return cat.groupBy("grp").agg(F.count(F.lit(1)).alias("total"), F.min("ord").alias("ord"))


def lookup(names: DataFrame, cat: DataFrame, column: str = "permission") -> DataFrame:
    """names with catalog_key: the first hit of the full name, then of the name without its leading parts."""
    distinct = names.select(F.col(column).alias("_name")).distinct()
    parts = F.split("_name", ">")
    suffix = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ">")))
    tried = distinct.select("_name", suffix.alias("pos", "suffix")).withColumn("key", norm_key(F.col("suffix")))
    hit = tried.join(cat.select("key"), "key").groupBy("_name").agg(F.min_by("key", "pos").alias("catalog_key"))
    return names.join(hit, F.col(column) == F.col("_name"), "left").drop("_name")


def enrich(found: DataFrame, cat: DataFrame, column: str = "permission") -> DataFrame:
    """Adds grp and description of the catalog's setting."""
    known = cat.select(F.col("key").alias("catalog_key"), "grp", "description")
    return lookup(found, cat, column).join(known, "catalog_key", "left").drop("catalog_key")


def coverage(cat: DataFrame, baseline_permissions: DataFrame, actual_records: DataFrame) -> DataFrame:
    """Per catalog setting: in_baseline, and granted_to (records of the actual state that grant it)."""
    covered = lookup(baseline_permissions.select(F.col("display").alias("permission")), cat).select(F.col("catalog_key").alias("key")).dropna().distinct().withColumn("in_baseline", F.lit(True))
    held = lookup(actual_records.filter("value NOT IN ('N', '')").select("permission"), cat).groupBy(F.col("catalog_key").alias("key")).agg(F.count(F.lit(1)).alias("granted_to"))
    out = cat.join(covered, "key", "left").join(held, "key", "left")
    return out.select("key", "name", "grp", "description", "type", "ord", F.coalesce("in_baseline", F.lit(False)).alias("in_baseline"), F.coalesce("granted_to", F.lit(0)).alias("granted_to"))


def coverage_by_group(covered: DataFrame) -> DataFrame:
    open_ = ~F.col("in_baseline") & (F.col("granted_to") > 0)
    return covered.groupBy("grp").agg(F.count(F.lit(1)).alias("total"), F.count_if("in_baseline").alias("covered"), F.count_if(open_).alias("granted_uncovered")).orderBy(F.desc("total"), "grp")


def bare_name(names: DataFrame, cat: DataFrame, column: str = "permission") -> DataFrame:
    """Adds bare: the catalog's name where it knows the setting, else what stands behind the first '>'."""
    known = cat.select(F.col("key").alias("catalog_key"), F.col("name").alias("_known"))
    return lookup(names, cat, column).join(known, "catalog_key", "left").withColumn("bare", F.coalesce("_known", first_bare(F.col(column)))).drop("_known", "catalog_key")


def cross_check(names: DataFrame, cat: DataFrame, threshold: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known, unknown with suggestion and its grp, uncovered catalog settings) of names: permission."""
    found = lookup(names.select("permission").distinct(), cat)
    known = found.filter("catalog_key IS NOT NULL")
    missing = found.filter("catalog_key IS NULL").withColumn("key", norm_key(first_bare(F.col("permission"))))
    near = closest(missing, cat.select("key", F.col("name").alias("display"), "ord"), threshold)
    unknown = missing.select("permission", "key").join(near, "key", "left").join(cat.select(F.col("key").alias("suggested_key"), "grp"), "suggested_key", "left")
    unknown = unknown.select("permission", F.coalesce("suggestion", F.lit("")).alias("suggestion"), F.coalesce("grp", F.lit("")).alias("grp"))
    return known, unknown, cat.join(known.select(F.col("catalog_key").alias("key")), "key", "left_anti")
