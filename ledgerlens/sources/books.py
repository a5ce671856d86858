"""From the cells of whole files to records, users, aliases and catalogs: which sheet is what, and which are read.

Sheets are told apart by a bounded sample of each (one collect of at most SAMPLED rows a sheet). Those laid out
alike are read by one plan, whatever their number, and one count over all candidates says which have records.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import clean, norm_key, perm_key
from ..operators import catalog as cat
from ..operators import records as rec
from . import layout as lay

SAMPLED = lay.HEADER_ROWS + lay.BODY_ROWS + 1
EVERY = ("all", "*")
# Sheets that map users to roles, and names of sheets that say nothing.
_MAPPING = re.compile(r"(?i)(user|users|role map|roles map|mapping|user roles|users roles|staff|assignments?)\Z")
_GENERIC = re.compile(r"(?i)(sheet\s*\d*|security settings?|export|data|table\s*\d*)\Z")


@dataclass
class SheetSample:
    file: str
    sheet: str
    number: int
    places: list[int]
    rows: list[list[str]]

    @property
    def at(self) -> tuple[str, int]:
        return self.file, self.number


@dataclass
class Book:
    """What was read: records (with role where roles are known), the user map, and how each sheet was taken."""

    records: DataFrame
    users: DataFrame | None
    expanded: bool
    layouts: dict[tuple[str, str], lay.Layout]
    ignored: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def samples(cells: DataFrame) -> list[SheetSample]:
    """The first rows of each sheet, in order of files and sheets."""
    first = Window.partitionBy("file", "sheet_no").orderBy("row")
    rows = cells.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= SAMPLED).select("file", "sheet", "sheet_no", "row", "cells").collect()
    out: dict[tuple, SheetSample] = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["sheet_no"], r["row"])):
        held = out.setdefault((r["file"], r["sheet_no"]), SheetSample(r["file"], r["sheet"], r["sheet_no"], [], []))
        held.places.append(r["row"])
        held.rows.append(list(r["cells"]))
    return list(out.values())


def only(cells: DataFrame, sheets: list[SheetSample], roles: dict[tuple, str] | None = None) -> DataFrame:
    """Cells of the given sheets; with roles, their role as _role."""
    spark = cells.sparkSession
    listed = [(s.file, s.number, (roles or {}).get(s.at)) for s in sheets]
    small = spark.createDataFrame(listed, "_file string, _number int, _role string")
    out = cells.join(F.broadcast(small), (F.col("file") == F.col("_file")) & (F.col("sheet_no") == F.col("_number"))).drop("_file", "_number")
    return out if roles is not None else out.drop("_role")


def _placed(found: lay.Layout, s: SheetSample) -> lay.Layout:
    return replace(found, header_row=s.places[found.header_row])


def _count(cells: DataFrame, s: SheetSample):
    def filled(at: int, width: int) -> dict[int, int]:
        below = only(cells, [s]).filter(F.col("row") > s.places[at])
        held = below.select(F.posexplode(F.slice("cells", 1, width)).alias("at", "cell")).filter(clean(F.col("cell")) != "")
        return {r["at"]: r["count"] for r in held.groupBy("at").count().collect()}

    return filled


def _detected(cells: DataFrame, s: SheetSample, options: dict) -> lay.Layout:
    return _placed(lay.detect(s.rows, count=_count(cells, s) if len(s.rows) >= SAMPLED else None, **options), s)


def _list_role(s: SheetSample, found: lay.Layout, role: str | None) -> str | None:
    """Whose list a catalog-shaped sheet is: as told, by its title, or (with values) by its own name."""
    own = s.sheet.strip() if found.value is not None and not _GENERIC.match(s.sheet.strip()) else None
    return role or found.role or own


def _rows(cells: DataFrame, taken: dict[tuple, tuple[SheetSample, lay.Layout]], read: dict) -> DataFrame | None:
    """Records of all sheets taken, one plan for each layout."""
    by_layout: dict[lay.Layout, list[SheetSample]] = {}
    for s, found in taken.values():
        by_layout.setdefault(replace(found, role=None), []).append(s)
    out = None
    for found, sheets in by_layout.items():
        if found.kind in ("role-list", "catalog"):
            roles = {s.at: taken[s.at][1].role for s in sheets}
            part = rec.role_list_records(only(cells, sheets, roles), found.header_row, F.col("_role"), found.permission, found.value, found.category, found.description)
            part = part.withColumn("permission", _grouped(F.col("grp"), F.col("permission"))).drop("grp")
        else:
            part = lay.to_records(only(cells, sheets), found, **read)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _grouped(group: Column, name: Column) -> Column:
    return F.when((group != "") & (norm_key(group) != norm_key(name)), F.concat(group, F.lit(" > "), name)).otherwise(name)


def read(cells: DataFrame, *, sheet: str | None = None, role: str | None = None, roles: dict[str, str] | None = None, roles_by_name: bool = False, users: DataFrame | None = None, roles_sheet: str | None = None, expand: bool = True, columns: dict | None = None, kind: str | None = None, orientation: str | None = None, ignore: str = "", blank_is_no: bool = True, ranges: int | None = None) -> Book:
    """Records of one file or of several.

    sheet: a sheet's name, or 'all'; else the first sheet of each file with records. role, roles (by file): whose
    list a catalog-shaped file is; roles_by_name takes the file's stem. users: user, role pairs; else a sheet that
    maps users to roles, if there is one. A workbook of sheets with values in catalog columns is one role a sheet.
    ranges: into how many ranges rows are dealt where names are carried down (for sheets too large for one task).
    """
    options = {k: v for k, v in (("columns", columns), ("kind", kind), ("orientation", orientation)) if v}
    reading = {"ignore": ignore, "blank_is_no": blank_is_no, "ranges": ranges}
    every = samples(cells)
    if not every:
        raise ValueError("no sheet has any rows")
    taken: dict[tuple, tuple[SheetSample, lay.Layout]] = {}
    open_: dict[str, list[tuple[SheetSample, lay.Layout]]] = {}
    maps: list[tuple[SheetSample, tuple[int, int, int]]] = []
    warnings, errors, ignored = [], [], []
    for file in dict.fromkeys(s.file for s in every):
        sheets = [s for s in every if s.file == file]
        given = (roles or {}).get(file) or role or (os.path.splitext(os.path.basename(file))[0] if roles_by_name else None)
        shaped = [] if options else [(s, found) for s in sheets if (found := lay.detect_catalog(s.rows)) is not None]
        if not given and len(sheets) > 1 and len(shaped) == len(sheets) and all(f.value is not None for _, f in shaped):
            taken |= {s.at: (s, replace(_placed(f, s), role=s.sheet)) for s, f in shaped}
            continue
        named = sheet if sheet and sheet.lower() not in EVERY else None
        wanted = [s for s in sheets if named is None or lay.key(s.sheet) == lay.key(named)]
        if not wanted:
            raise ValueError(f'{file}: no sheet "{named}"; its sheets: {", ".join(s.sheet for s in sheets)}')
        lists = [(s, f) for s, f in shaped if s in wanted]
        if lists:
            s, found = lists[0]
            whose = _list_role(s, found, given)
            if not whose:
                what = "one role's list, but doesn't say whose: name the role" if found.value is not None else "a catalog of settings without subjects: use it as the catalog, or name the role whose list it is"
                raise ValueError(f'{file}, sheet "{s.sheet}": {what}')
            taken[s.at] = (s, replace(_placed(found, s), kind="role-list", role=whose))
            ignored += [(file, x.sheet) for x in sheets if x is not s]
            if found.value is None:
                warnings.append(f'{file}, sheet "{s.sheet}": no value column, all that is listed counts as granted to "{whose}"')
            continue
        mapping = None
        if users is None and (roles_sheet or expand):
            for s in sheets:
                if lay.key(s.sheet) == lay.key(roles_sheet or "") if roles_sheet else len(sheets) > 1 and _MAPPING.match(s.sheet.strip()):
                    at = lay.is_role_map(s.rows)
                    if at:
                        mapping = s
                        maps.append((s, at))
                        break
            if roles_sheet and mapping is None:
                raise ValueError(f'{file}: sheet "{roles_sheet}" maps no users to roles')
        for s in wanted:
            if s is mapping:
                continue
            try:
                open_.setdefault(file, []).append((s, _detected(cells, s, options)))
            except ValueError as e:
                errors.append(e)
                ignored.append((file, s.sheet))
    if open_:
        candidates = {s.at: (s, f) for held in open_.values() for s, f in held}
        counted = {(r["file"], r["n"]) for r in _rows(cells, candidates, reading).select("file", F.col("ord")["sheet_no"].alias("n")).distinct().collect()}
        for file, held in open_.items():
            full = [(s, f) for s, f in held if s.at in counted]
            ignored += [(file, s.sheet) for s, _ in held if s.at not in counted]
            chosen = full if sheet and sheet.lower() in EVERY else full[:1]
            taken |= {s.at: (s, f) for s, f in chosen}
            if len(full) > len(chosen):
                warnings.append(f"{file}: not read though they have records: {', '.join(s.sheet for s, _ in full[1:])} (sheet='all' reads them)")
            ignored += [(file, s.sheet) for s, _ in full[len(chosen) :]]
    if not taken:
        raise errors[-1] if errors else ValueError("no sheet has records")
    whose = [f.role for _, f in taken.values() if f.role]
    twice = sorted({x for x in whose if sum(lay.key(x) == lay.key(y) for y in whose) > 1})
    if twice:
        warnings.append(f"roles that several files list (the last one counts): {', '.join(twice)}")
    out = _rows(cells, taken, reading)
    if "role" not in out.columns:
        out = out.withColumn("role", F.lit(None).cast("string"))
    if maps:
        users = None
        for s, (at, user, own) in maps:
            more = rec.role_map(only(cells, [s]), s.places[at], user, own)
            users = more if users is None else users.unionByName(more)
    expanded = False
    if users is not None:
        before = out
        out = rec.expand_roles(out, users, always=not maps or roles_sheet is not None)
        expanded = out is not before
    return Book(out, users, expanded, {(s.file, s.sheet): f for s, f in taken.values()}, ignored, warnings)


def users(cells: DataFrame) -> DataFrame:
    """user_key, user, role of the first sheet that maps users to roles."""
    for s in samples(cells):
        found = lay.is_role_map(s.rows)
        if found:
            return rec.role_map(only(cells, [s]), s.places[found[0]], found[1], found[2])
    raise ValueError("no sheet with a column of users and one of roles")


def catalog(cells: DataFrame, sheet: str | None = None) -> DataFrame:
    """The catalog on the first sheet (or the one named) that is one."""
    for s in samples(cells):
        found = lay.detect_catalog(s.rows) if sheet is None or lay.key(s.sheet) == lay.key(sheet) else None
        if found is not None and found.value is None:
            named = {"name": found.permission, "description": found.description, "type": found.type, "grp": found.category}
            rows = only(cells, [s]).filter(F.col("row") > s.places[found.header_row])
            return cat.catalog(rows.select(*((rec.cell(i) if i is not None else F.lit("")).alias(k) for k, i in named.items()), "row", F.struct("file", "sheet_no", "row").alias("ord")).filter("name <> ''"))
    raise ValueError("no sheet is a catalog of settings")


def aliases(cells: DataFrame) -> DataFrame:
    """kind, from_key, to_key, ord: pairs of names in the first two filled cells of a row, or behind a cell that says which kind (settings, if none does)."""
    rows = cells.select(F.filter(F.transform("cells", clean), lambda x: x != "").alias("c"), F.struct("file", "sheet_no", "row").alias("ord")).filter("size(c) > 1")
    rows = rows.filter(~F.col("c")[0].rlike("(?i)^(baseline|from|old|kind|type)$"))
    told = (F.size("c") > 2) & F.col("c")[0].rlike("(?i)^(users?|settings?|permission)$")
    kind = F.when(told & F.col("c")[0].rlike("(?i)^user"), "subject").otherwise("permission")
    at = F.when(told, 1).otherwise(0)
    rows = rows.select("ord", kind.alias("kind"), F.get("c", at).alias("a"), F.get("c", at + 1).alias("b"))
    key = lambda x: F.when(F.col("kind") == "subject", norm_key(F.col(x))).otherwise(perm_key(F.col(x)))
    return rows.select("kind", key("a").alias("from_key"), key("b").alias("to_key"), "ord")


@dataclass
class Inspection:
    """How a file is read: each sheet with header and preview, then what its records hold, or the error that reading met."""

    sheets: list[dict]
    error: str | None = None
    book: Book | None = None
    kind: str = "permissions"
    subjects: DataFrame | None = None
    settings: DataFrame | None = None
    values: DataFrame | None = None
    sample: DataFrame | None = None


def inspect(cells: DataFrame, **options) -> Inspection:
    """Never fails for cells that could be read: what goes wrong behind is told in error."""
    size = {(r["file"], r["sheet_no"]): r for r in cells.groupBy("file", "sheet_no").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("cells")).alias("columns")).collect()}
    sheets, held = [], samples(cells)
    for s in held:
        at = lay.find_header(s.rows)
        sheets.append({"file": s.file, "sheet": s.sheet, "rows": size[s.at]["rows"], "columns": size[s.at]["columns"], "header_row": s.places[at], "headers": [lay.clean(x) for x in s.rows[at]][:40], "preview": [r[:12] for r in s.rows[:12]]})
    out = Inspection(sheets)
    try:
        out.book = read(cells, **options)
    except ValueError as e:
        out.error = str(e)
        if any((f := lay.detect_catalog(s.rows)) is not None and f.value is None for s in held):
            out.kind = "catalog"
        return out
    rows = out.book.records
    if all(x.kind == "role-list" for x in out.book.layouts.values()):
        out.kind = "role-list"
    out.subjects = rows.groupBy("subject").agg(F.countDistinct("permission").alias("settings"), F.max("role").alias("role"))
    out.settings = rows.groupBy("permission").agg(F.countDistinct("subject").alias("subjects"))
    out.values = rec.profile(rows.withColumn("value", F.when(F.col("value") == "", "(blank)").otherwise(F.col("value"))), "value")
    out.sample = rows.orderBy("ord").limit(10)
    return out
