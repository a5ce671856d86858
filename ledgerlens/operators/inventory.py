"""Inventory of one side, and both sides next to each other, as pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import first_bare, norm_key
from ..functions.values import is_granted
from .order import dictionary, placed


def _mark(value: Column) -> Column:
    return F.when(value == "Y", "X").when(value.isNull() | value.isin("N", ""), "").otherwise(value)


def subjects_of(records: DataFrame, limit: int) -> list[str]:
    """The pivot's columns; a sheet has a bounded number of them, and more is an error."""
    names = [x[0] for x in records.select("subject").distinct().orderBy("subject").limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} subjects don't fit a pivot: filter them, or use the long form")
    return names


def settings(records: DataFrame) -> DataFrame:
    """Records with the setting's key and first-seen name (category stripped); last value per subject and setting."""
    rows = records.withColumn("key", norm_key(first_bare(F.col("permission"))))
    return rows.groupBy("key", "subject").agg(F.max_by("value", "ord").alias("value"), F.min_by(first_bare(F.col("permission")), "ord").alias("setting"), F.min("ord").alias("ord"))


def inventory(records: DataFrame, subjects: list[str] | None = None, limit: int = 10_000) -> DataFrame:
    """setting x subject: X, blank or level; and how many hold it."""
    held = settings(records)
    wide = held.groupBy("key").pivot("subject", subjects or subjects_of(records, limit)).agg(F.first(_mark(F.col("value"))))
    names = held.groupBy("key").agg(F.min_by("setting", "ord").alias("setting"), F.count_if(is_granted(F.col("value"))).alias("held_by"))
    return names.join(wide, "key").drop("key")


def setting_list(records: DataFrame) -> DataFrame:
    """setting, held_by, who (subjects in order, comma-joined)."""
    held = settings(records)
    granted = F.when(is_granted(F.col("value")), F.col("subject"))
    out = held.groupBy("key").agg(F.min_by("setting", "ord").alias("setting"), F.count(granted).alias("held_by"), F.array_join(F.array_sort(F.collect_set(granted)), ", ").alias("who"))
    return out.drop("key")


def subject_list(records: DataFrame) -> DataFrame:
    """subject, held, listed."""
    return settings(records).groupBy("subject").agg(F.count_if(is_granted(F.col("value"))).alias("held"), F.count(F.lit(1)).alias("listed"))


def shown_cell() -> Column:
    """What both sides show for a pair: one text where they agree (without what the cell said), else 'expected → actual', '—' for nothing."""
    either = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    return F.when(F.col("type") == "ok", F.regexp_replace("actual", r"(?s) \(.*\)$", "")).otherwise(F.concat(either("expected"), F.lit(" → "), either("actual")))


def side_by_side(pairs: DataFrame, subjects: list[str] | None = None, limit: int = 10_000) -> DataFrame:
    """permission x subject, as `shown_cell` has it."""
    return pairs.groupBy("permission").pivot("subject", subjects or subjects_of(pairs, limit)).agg(F.first(shown_cell())).orderBy(*dictionary("permission"))


def side_by_side_tiles(pairs: DataFrame, width: int = 1000) -> DataFrame:
    """The same for any number of subjects, as tiles: permission, tile (a block of `width` subjects in order) and cells, an array of subject, cell and type in order of subjects."""
    names = placed(pairs.select("subject").distinct(), [F.col("subject")]).select("subject", F.floor(F.col("place") / width).cast("int").alias("tile"))
    cells = pairs.select("permission", "subject", shown_cell().alias("cell"), "type").join(names, "subject")
    return cells.groupBy("permission", "tile").agg(F.array_sort(F.collect_list(F.struct("subject", "cell", "type"))).alias("cells"))


def _documented(records: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """The last value of each setting and subject, settings by the catalog's key where it knows them; key, subject, value, setting, grp, description, in_catalog."""
    from .catalog import lookup

    rows = records if "description" in records.columns else records.withColumn("description", F.lit(""))
    bare = first_bare(F.col("permission"))
    group = F.when(F.col("permission").contains(">"), F.trim(F.substring_index("permission", ">", 1))).otherwise("")
    if catalog is None:
        rows = rows.select("subject", "value", "ord", norm_key(bare).alias("key"), bare.alias("setting"), group.alias("grp"), "description", F.lit(False).alias("in_catalog"))
    else:
        known = catalog.select(F.col("key").alias("catalog_key"), F.col("name").alias("_n"), F.col("grp").alias("_g"), F.col("description").alias("_d"))
        rows = lookup(rows, catalog).join(known, "catalog_key", "left")
        rows = rows.select("subject", "value", "ord", F.coalesce("catalog_key", norm_key(bare)).alias("key"), F.coalesce("_n", bare).alias("setting"), F.coalesce("_g", group).alias("grp"), F.coalesce(F.nullif("_d", F.lit("")), "description").alias("description"), F.col("catalog_key").isNotNull().alias("in_catalog"))
    first = F.min_by(F.struct("setting", "grp", "in_catalog"), "ord").alias("first")
    out = rows.groupBy("key", "subject").agg(F.max_by("value", "ord").alias("value"), first, F.min("ord").alias("ord"), F.min_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.col("ord"))).alias("description"))
    return out.select("key", "subject", "value", "ord", "first.*", F.coalesce("description", F.lit("")).alias("description"))


def _settings_with_catalog(held: DataFrame, catalog: DataFrame | None, more: list[Column]) -> DataFrame:
    """One row per setting (its first name and group, its first description), and for settings of the catalog that nobody lists."""
    names = held.groupBy("key").agg(F.min_by(F.struct("setting", "grp", "in_catalog"), "ord").alias("first"), F.min_by("description", F.when(F.col("description") != "", F.col("ord"))).alias("description"), *more)
    names = names.select("key", "first.*", F.coalesce("description", F.lit("")).alias("description"), *[c for c in names.columns if c not in ("key", "first", "description")])
    if catalog is not None:
        rest = catalog.join(names.select("key"), "key", "left_anti").select("key", F.col("name").alias("setting"), "grp", F.lit(True).alias("in_catalog"), "description")
        names = names.unionByName(rest, allowMissingColumns=True)
    return names


def documented(records: DataFrame, catalog: DataFrame | None, subjects: list[str]) -> DataFrame:
    """grp, setting, description, a column per subject, held_by, in_catalog."""
    held = _documented(records, catalog)
    wide = held.groupBy("key").pivot("subject", subjects).agg(F.first(_mark(F.col("value"))))
    names = _settings_with_catalog(held, catalog, [F.count_if(is_granted(F.col("value"))).alias("held_by")])
    return names.withColumn("held_by", F.coalesce("held_by", F.lit(0))).join(wide, "key", "left").drop("key")


def documented_list(records: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """grp, setting, description, held_by, who."""
    granted = F.when(is_granted(F.col("value")), F.col("subject"))
    names = _settings_with_catalog(_documented(records, catalog), catalog, [F.count(granted).alias("held_by"), F.array_join(F.array_sort(F.collect_set(granted)), ", ").alias("who")])
    return names.select("grp", "setting", "description", F.coalesce("held_by", F.lit(0)).alias("held_by"), F.coalesce("who", F.lit("")).alias("who"), "in_catalog")
