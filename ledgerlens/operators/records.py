"""From cells to records: carry-forward, melting, headings, role lists, role expansion, read diagnostics.

Cell rows have file, sheet, sheet_no, row and cells (ARRAY<STRING>), and kinds (ARRAY<STRING>: str, num,
bool or blank). `ord` = (file, sheet_no, row, column) orders records; within a sheet rows are ordered by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import clean, join_name, norm_key
from ..functions.values import glob, normalize_value
from ..plans.lineage import cut

# Columns that look as if they should be left out.
NOT_VALIDATED = r"(?i)(dont|don t|do not|no) need to validate|do not validate|skip|ignore"
# Words in the names of roles.
ROLE_WORDS = ["admin", "user", "super", "provider", "nurse", "rn", "ma", "lvn", "biller", "billing", "front desk", "psr", "specialist", "read only", "assistant", "coordinator", "supervisor", "analyst", "liaison", "liason", "compliance", "him", "it"]


def carry_forward(df: DataFrame, column: str, partition: list[str], order: list[str], into: str | None = None, ranges: int | None = None) -> DataFrame:
    """Blank cells take the last non-blank one above.

    ranges: rows are dealt by so many ranges of partition and order, so that one sheet of any length is carried by
    several tasks; else a sheet is one task's (a window).
    """
    filled = F.nullif(F.col(column), F.lit(""))
    if ranges is not None:
        return _carried_in_ranges(df, filled, partition, order, into or column, ranges)
    above = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(into or column, F.last(filled, ignorenulls=True).over(above))


def _carried_in_ranges(df: DataFrame, filled: Column, partition: list[str], order: list[str], into: str, ranges: int) -> DataFrame:
    """A segmented scan: each range carries its own cells; what comes from above a range is the last cell of the ranges before it, told from one row a range and partition."""
    keys = [F.col(c) for c in (*partition, *order)]
    dealt = df.withColumn("_cell", filled).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    held = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", *partition).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = held.groupBy("_range", *partition).agg(F.max_by("_cell", F.when(F.col("_cell").isNotNull(), F.col("_at"))).alias("_last"))
    ends = ends.select(F.col("_range").alias("_its"), *(F.col(c).alias(f"_p{k}") for k, c in enumerate(partition)), F.last("_last", ignorenulls=True).over(before).alias("_above"))
    same = F.col("_range") == F.col("_its")
    for k, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_p{k}"))
    carried = held.withColumn("_own", F.last("_cell", ignorenulls=True).over(own)).join(ends, same, "left")
    out = carried.withColumn(into, F.coalesce("_own", "_above"))
    return out.select(*df.columns, *([into] if into not in df.columns else []))


def cell(i: int) -> Column:
    return clean(F.get("cells", F.lit(i)))


def _raw(i: Column) -> Column:
    return F.coalesce(F.get("cells", i), F.lit(""))


def long_records(cells: DataFrame, header_row: int, subject: int, permission: int, value: int, category: int | None = None, ignore: str = "", blank_is_no: bool = True, ranges: int | None = None) -> DataFrame:
    """One record per row. Subject and category are printed once per block; ignored subjects don't carry their category on. ranges: see `carry_forward`."""
    sheet = ["file", "sheet_no"]
    rows = cells.filter(F.col("row") > header_row).withColumn("subject", cell(subject)).withColumn("permission", cell(permission))
    rows = carry_forward(rows, "subject", sheet, ["row"], ranges=ranges).filter(F.col("subject").isNotNull() & ~glob(F.col("subject"), ignore))
    if category is not None:
        rows = carry_forward(rows.withColumn("category", cell(category)), "category", sheet, ["row"], ranges=ranges)
        rows = rows.withColumn("permission", F.when(F.col("permission") != "", join_name(F.col("category"), F.col("permission"))).otherwise(""))
    rows = rows.filter("permission <> ''")
    raw = _raw(F.lit(value))
    if not blank_is_no:
        rows = rows.filter(F.trim(raw) != "")
    return rows.select("subject", "permission", normalize_value(raw, F.get("kinds", F.lit(value))).alias("value"), raw.alias("raw"), "file", "sheet", "row", F.struct("file", "sheet_no", "row", F.lit(value).alias("col")).alias("ord"))


def matrix_records(cells: DataFrame, header_row: int, headers: list[str], label: int, first_data: int, *, users_down: bool = False, category: int | None = None, description: int | None = None, ignore: str = "", blank_is_no: bool = True, ranges: int | None = None) -> DataFrame:
    """One record per cell of a grid. Rows without values are headings, unless there is a category column or users go down."""
    sheet = ["file", "sheet_no"]
    rows = cells.filter(F.col("row") > header_row).withColumn("label", cell(label))
    data = [i for i in range(first_data, len(headers)) if clean_text(headers[i])]
    blank = F.forall(F.slice("cells", first_data + 1, max(1, len(headers) - first_data)), lambda c: clean(c) == "") if len(headers) > first_data else F.lit(True)
    rows = rows.filter("label <> ''")
    if category is not None:
        rows = carry_forward(rows.withColumn("category", cell(category)), "category", sheet, ["row"], ranges=ranges)
    elif users_down:
        rows = rows.withColumn("category", F.lit(None).cast("string"))
    else:
        rows = rows.withColumn("heading", F.when(blank, F.col("label")).otherwise(""))
        rows = carry_forward(rows, "heading", sheet, ["row"], "category", ranges=ranges).filter("heading = ''")
    names = F.array(*(F.struct(F.lit(i).alias("col"), F.lit(clean_text(headers[i])).alias("head")) for i in data)) if data else F.array().cast("array<struct<col:int,head:string>>")
    melted = rows.select("*", F.explode(names).alias("at")).select("*", "at.col", "at.head")
    raw = _raw(F.col("col"))
    named = join_name(F.col("category"), F.col("label")) if not users_down else F.col("head")
    out = melted.select(
        (F.col("label") if users_down else F.col("head")).alias("subject"), named.alias("permission"), normalize_value(raw, F.get("kinds", F.col("col"))).alias("value"), raw.alias("raw"),
        (cell(description) if description is not None else F.lit("")).alias("description"), "file", "sheet", "row", F.struct("file", "sheet_no", "row", "col").alias("ord"),
    )
    out = out.filter(~glob(F.col("subject"), ignore))
    return out if blank_is_no else out.filter(F.trim("raw") != "")


def clean_text(x) -> str:
    return " ".join(str(x if x is not None else "").replace("﻿", " ").split())


def role_list_records(cells: DataFrame, header_row: int, role: str | Column, name: int, permission: int | None = None, group: int | None = None, description: int | None = None) -> DataFrame:
    """Roles' exports in catalog columns: with a permission column its values, else every listed row is held. role: its name, or the column that has it."""
    role = F.lit(role) if isinstance(role, str) else role
    rows = cells.filter(F.col("row") > header_row).withColumn("name", cell(name)).filter("name <> ''")
    if permission is None:
        raw, value = F.lit("listed"), F.lit("Y")
    else:
        raw = _raw(F.lit(permission))
        value = normalize_value(raw, F.get("kinds", F.lit(permission)))
    return rows.select(
        role.alias("subject"), role.alias("role"), "name", (cell(group) if group is not None else F.lit("")).alias("grp"), value.alias("value"), raw.alias("raw"), (cell(description) if description is not None else F.lit("")).alias("description"),
        F.lit(permission is None).alias("listed_only"), "file", "sheet", "row", F.struct("file", "sheet_no", "row", F.lit(name).alias("col")).alias("ord"),
    ).withColumnRenamed("name", "permission")


def role_map(cells: DataFrame, header_row: int, user: int, role: int) -> DataFrame:
    """user_key, user, role: the last row of each user; ord: where the user is first."""
    rows = cells.filter(F.col("row") > header_row).select(cell(user).alias("user"), cell(role).alias("role"), F.struct("file", "sheet_no", "row").alias("ord")).filter("user <> '' AND role <> ''")
    return rows.groupBy(norm_key(F.col("user")).alias("user_key")).agg(F.max_by(F.struct("user", "role"), "ord").alias("last"), F.min("ord").alias("ord")).select("user_key", "last.*", "ord")


def expand_roles(records: DataFrame, users: DataFrame, always: bool = False) -> DataFrame:
    """Records of roles as records of the users who have them; other subjects stay. Only if half the subjects are roles, or always. Where both have ord, records are in order of users, the others last."""
    in_order = "ord" in users.columns and "ord" in records.columns
    place = users["ord"] if in_order else F.lit(None)
    roles = users.select(norm_key(F.col("role")).alias("role_key"), "user", F.col("role").alias("held_role"), place.alias("_place"))
    keyed = records.withColumn("role_key", norm_key(F.col("subject")))
    if not always:
        row = keyed.select("role_key").distinct().join(roles.select("role_key", F.lit(1).alias("hit")).distinct(), "role_key", "left").agg(F.count("hit"), F.count(F.lit(1))).first()
        if 2 * row[0] < row[1]:
            return records
    columns = [c for c in records.columns if c not in ("subject", "role")]
    if in_order:
        kind = users.schema["ord"].dataType
        rank = lambda last, at: F.struct(F.lit(last).alias("kept"), at.alias("user"), F.col("ord").alias("own"))
        first = keyed.join(roles, "role_key").withColumn("ord", rank(0, F.col("_place")))
        keyed = keyed.withColumn("ord", rank(1, F.lit(None).cast(kind)))
    else:
        first = keyed.join(roles, "role_key")
    held = first.select(F.col("user").alias("subject"), *columns, F.col("held_role").alias("role"))
    rest = keyed.join(roles.select("role_key").distinct(), "role_key", "left_anti").select("subject", *columns, F.lit(None).cast("string").alias("role"))
    return held.unionByName(rest)


def role_gaps(records: DataFrame, users: DataFrame) -> DataFrame:
    """side, name: roles that no record has, and subjects that are no role."""
    roles = users.select(norm_key(F.col("role")).alias("key"), F.col("role").alias("name")).dropDuplicates(["key"])
    subjects = records.select(norm_key(F.col("subject")).alias("key"), F.col("subject").alias("name")).dropDuplicates(["key"])
    a = roles.join(subjects.select("key"), "key", "left_anti").select(F.lit("role without records").alias("side"), "name")
    return a.unionByName(subjects.join(roles.select("key"), "key", "left_anti").select(F.lit("subject without role").alias("side"), "name"))


def duplicates(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, conflict and, where records have row, rows: keys that occur more than once, whether neighbours among them differ in value, and where they stand."""
    w = Window.partitionBy(*keys).orderBy("ord")
    rows = records.withColumn("differs", F.coalesce((F.col("value") != F.lag("value").over(w)).cast("int"), F.lit(0)))
    places = [F.array_sort(F.collect_set("row")).alias("rows")] if "row" in records.columns and "row" not in keys else []
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("differs") == 1).alias("conflict"), *places).filter("n > 1")


def looks_like_roles(records: DataFrame) -> DataFrame:
    """share and looks_like_roles: at least half the subjects' names are words for roles."""
    names = records.select("subject").distinct()
    return names.agg(F.avg(F.col("subject").rlike(rf"(?i)\b({'|'.join(ROLE_WORDS)})\b").cast("int")).alias("share")).select("share", (F.coalesce("share", F.lit(0.0)) >= 0.5).alias("looks_like_roles"))


def diagnostics(records: DataFrame, cells: DataFrame, header_row: int) -> DataFrame:
    """file, sheet, code, n, sample: what was read oddly."""
    from ..functions.values import is_annotated

    def noted(df: DataFrame, code: str, sample: Column) -> DataFrame:
        return df.groupBy("file", "sheet").agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set(sample)), 1, 6).alias("sample"))

    note = is_annotated(F.col("raw"))
    ticks = noted(records.filter(note & (F.col("value") == "Y")), "annotated tick", F.substring("raw", 1, 80))
    levels = noted(records.filter(note & ~F.col("value").isin("Y", "N") & (F.length("value") <= 30)), "level", F.col("value"))
    pasted = noted(records.filter(note & ~F.col("value").isin("Y", "N") & (F.length("value") > 30)), "pasted text", F.substring("raw", 1, 80))
    used = records.select("file", "sheet", "row").distinct()
    filled = F.exists("cells", lambda c: clean(c) != "")
    skipped = noted(cells.filter((F.col("row") > header_row) & filled).join(used, ["file", "sheet", "row"], "left_anti"), "skipped row", F.col("row").cast("string"))
    twice = duplicates(records.withColumn("subject_key", norm_key(F.col("subject"))).withColumn("permission_key", norm_key(F.col("permission"))), ["file", "sheet", "subject_key", "permission_key"])
    # a setting that stands twice is one finding, whatever number of subjects it stands twice for
    twice = twice.groupBy("file", "sheet", "permission_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rows")))).alias("rows"), F.max("conflict").alias("conflict"))
    twice = noted(twice, "duplicate", F.concat("permission_key", F.lit(" rows "), F.array_join("rows", "/"), F.when(F.col("conflict"), " (copies disagree)").otherwise("")))
    out = ticks
    for more in (levels, pasted, skipped, twice):
        out = out.unionByName(more)
    return out


def profile(records: DataFrame, column: str) -> DataFrame:
    """Distinct values with counts, most frequent first."""
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def read_notes(cells: DataFrame, found, ignore: str = "") -> DataFrame:
    """file, sheet, code, n, sample: everything that was read oddly under a layout (see `layout.Layout`): notes on ticks, levels, pasted text, rows without a name or without a subject, headings, duplicates, columns left out, without a name, or not to be validated."""
    from ..sources.layout import to_records

    sheet = ["file", "sheet"]
    below = cells.filter(F.col("row") > found.header_row)
    filled = F.exists("cells", lambda c: clean(c) != "")
    rows = to_records(cells, found, ignore=ignore)
    out = diagnostics(rows, cells, found.header_row).filter("code <> 'skipped row'")

    def noted(df: DataFrame, code: str, sample: Column) -> DataFrame:
        return df.groupBy(*sheet).agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set(sample)), 1, 6).alias("sample"))

    number = F.col("row").cast("string")
    if found.kind == "long":
        held = carry_forward(below.withColumn("subject", cell(found.subject)), "subject", ["file", "sheet_no"], ["row"])
        return out.unionByName(noted(held.filter(filled & F.col("subject").isNull() & (cell(found.permission) != "")), "row without a subject", number))
    heads = list(enumerate(map(clean_text, found.headers)))[found.first_data :]
    at = lambda which: F.array(*(F.struct(F.lit(i).alias("i"), F.lit(h).alias("h")) for i, h in heads if which(i, h))).cast("array<struct<i:int,h:string>>")
    named, nameless = at(lambda i, h: h), at(lambda i, h: not h)
    values = F.exists(named, lambda x: clean(F.get("cells", x["i"])) != "")
    label = cell(found.permission)
    out = out.unionByName(noted(below.filter((label == "") & values), "row without a name", number))
    if not found.users_down and found.category is None:
        out = out.unionByName(noted(below.filter((label != "") & ~values), "section heading", label))
    columns = below.select(*sheet, F.explode(nameless).alias("x"), "cells").filter(clean(F.get("cells", F.col("x.i"))) != "").select(*sheet, "x.i").distinct()
    out = out.unionByName(noted(columns, "column without a name", F.col("i").cast("string")))
    if not found.users_down:
        heads_of = below.select(*sheet).distinct().select(*sheet, F.explode(named).alias("x")).select(*sheet, "x.h")
        dropped = glob(F.col("h"), ignore)
        out = out.unionByName(noted(heads_of.filter(dropped), "column left out", F.col("h"))).unionByName(noted(heads_of.filter(~dropped & F.col("h").rlike(NOT_VALIDATED)), "column not to be validated", F.col("h")))
    return out
