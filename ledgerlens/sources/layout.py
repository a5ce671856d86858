"""How a sheet is laid out, told from a bounded sample of its rows on the driver and, where it takes the number of rows, one count over the sheet."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.values import GRANTED, NOT_GRANTED

# What columns are called.
SUBJECT = ["user", "username", "user name", "userid", "user id", "login", "login id", "login name", "staff", "staff name", "employee", "employee name", "provider", "provider name", "name", "account", "role", "role name", "security role", "group", "job title", "title"]
PERMISSION = ["permission", "permissions", "security setting", "security settings", "setting", "settings", "item", "item name", "privilege", "right", "rights", "access right", "feature", "function", "option", "security item", "security option", "menu item", "description"]
VALUE = ["value", "access", "allowed", "allow", "granted", "grant", "permitted", "enabled", "status", "setting value", "y/n", "yes/no", "assigned", "has access", "checked", "selected", "level", "access level"]
DESCRIPTION = ["description", "security setting description", "setting description", "what it controls", "what it does", "details", "help", "notes", "comment", "comments"]
CATEGORY = ["category", "module", "section", "group name", "area", "menu", "tab", "security group", "setting group", "folder"]
ROLE = ["role", "role name", "security role", "job title", "title", "group"]
CATALOG_NAME = ["security setting name", "setting name", "security setting", "security attribute", "attribute name", "attribute", "name", "setting", "permission", "permission name", "item", "item name"]
CATALOG_DESCRIPTION = ["security setting description", "description", "setting description", "attribute description", "what it controls", "what it does", "details", "help"]
CATALOG_TYPE = ["security setting type", "setting type", "type", "attribute type"]
CATALOG_GROUP = ["security group name", "group name", "security group", "group", "category", "module", "section"]
CATALOG_VALUE = ["permission", "permissions", "granted", "allowed", "access", "checked", "enabled", "value", "yes no", "y n", "assigned", "has access"]
#: Rows that may hold the header, and rows below it that are looked at.
HEADER_ROWS, BODY_ROWS = 20, 29


def key(x) -> str:
    text = unicodedata.normalize("NFKC", str(x if x is not None else "").lower())
    return re.sub("[^a-z0-9]+", " ", text).strip()


def clean(x) -> str:
    return " ".join(str(x if x is not None else "").replace("﻿", " ").split())


@cache
def _phrase(text: str) -> tuple[str, ...]:
    return tuple(key(text).split())


def _holds(whole: tuple[str, ...], part: tuple[str, ...]) -> bool:
    """The words of part follow each other in whole."""
    return any(whole[i : i + len(part)] == part for i in range(len(whole) - len(part) + 1))


def header_score(cell, names: list[str]) -> int:
    """2: a known name; 1: holds one, or stands in one, as whole words; 0: neither. Below four letters nothing stands in anything."""
    words = tuple(key(cell).split())
    listed = {_phrase(n) for n in names} - {()}
    if words in listed:
        return 2
    long = lambda x: len(" ".join(x)) > 3
    return int(long(words) and any(_holds(*sorted((words, n), key=len, reverse=True)) for n in listed if long(n)))


def best_column(headers: list[str], names: list[str], taken: set[int]) -> int | None:
    scores = [(header_score(h, names), -i) for i, h in enumerate(headers) if i not in taken]
    best = max(scores, default=(0, 0))
    return -best[1] if best[0] else None


def _label(cell) -> bool:
    k, s = key(cell), clean(cell)
    return len(k) >= 2 and k not in GRANTED + NOT_GRANTED and s not in GRANTED + NOT_GRANTED


def find_header(rows: list[list[str]]) -> int:
    """The row that looks most like a header: known names first, then width, then data below it."""
    filled = [sum(map(bool, map(clean, row))) for row in rows[: HEADER_ROWS + 1]] + [0]

    def weight(i: int) -> tuple[int, int]:
        labels = list(filter(_label, rows[i]))
        if len(labels) < 2:
            return -1, -i
        known = sum(max(header_score(c, names) for names in (SUBJECT, PERMISSION, VALUE, CATEGORY)) for c in labels)
        return 10 * known + min(len(labels), 8) + (5 if filled[i + 1] > 1 else 0), -i  # the upper one of equals

    return max(range(min(len(rows), HEADER_ROWS)), key=weight, default=0)


@dataclass(frozen=True)
class Layout:
    """kind: long, matrix, role-list or catalog. Columns count from 0; header_row is the sheet's own row number."""

    kind: str
    header_row: int
    headers: tuple[str, ...] = ()
    subject: int | None = None
    permission: int | None = None
    value: int | None = None
    category: int | None = None
    description: int | None = None
    first_data: int = 1
    users_down: bool = False
    role: str | None = None
    type: int | None = None


def detect(rows: list[list[str]], *, kind: str | None = None, orientation: str | None = None, columns: dict[str, str | int] | None = None, header: int | None = None, count: Callable[[int, int], dict[int, int]] | None = None) -> Layout:
    """The layout of sampled rows (header_row counts from 0 here). columns: subject, permission, value or category by name or number. count: the filled cells of each column in all rows below a header of some width, if rows are not the whole sheet."""
    at = find_header(rows) if header is None else header
    headers = [clean(h) for h in (rows[at] if at < len(rows) else [])]
    taken: set[int] = set()
    found: dict[str, int | None] = {}
    for name, names in (("subject", SUBJECT), ("permission", PERMISSION), ("value", VALUE), ("category", CATEGORY)):
        wanted = (columns or {}).get(name)
        if wanted is None or wanted == "":
            found[name] = best_column(headers, names, taken)
        elif isinstance(wanted, int):
            found[name] = wanted
        else:
            same = [i for i, h in enumerate(headers) if key(h) == key(wanted)]
            if not same:
                raise ValueError(f'no column "{wanted}" in the header row: {" | ".join(headers)}')
            found[name] = same[0]
        if found[name] is not None:
            taken.add(found[name])
    three = [found[n] for n in ("subject", "permission", "value")]
    complete = all(x is not None for x in three)
    exact = complete and all(header_score(headers[i], names) == 2 for i, names in zip(three, (SUBJECT, PERMISSION, VALUE), strict=True))
    kind = kind or ("long" if complete and (exact or sum(1 for h in headers if h) <= 6) else "matrix")
    if kind == "long":
        if not complete:
            raise ValueError(f"a long layout needs subject, permission and value columns; the header row is: {' | '.join(headers)}")
        return Layout("long", at, tuple(headers), found["subject"], found["permission"], found["value"], found["category"])
    body = rows[at + 1 :]
    filled = {i: n for i in range(len(headers)) if (n := sum(1 for r in body if i < len(r) and clean(r[i])))}
    if count and 0 not in filled:  # a column may begin below the sample
        filled, count = count(at, len(headers)), None
    label = min(filled, default=0)
    if orientation is None:
        first = headers[label] if label < len(headers) else ""
        if header_score(first, PERMISSION) or header_score(first, CATEGORY):
            orientation = "permissions-down"
        elif header_score(first, SUBJECT):
            orientation = "users-down"
        else:
            filled = count(at, len(headers)) if count else filled
            orientation = "permissions-down" if filled.get(label, 0) >= sum(1 for h in headers[label + 1 :] if h) else "users-down"
    category, permission, description, first_data = None, label, None, label + 1
    if orientation == "permissions-down":
        lead = headers[label] if label < len(headers) else ""
        if label + 1 < len(headers) and header_score(lead, CATEGORY) and (not header_score(lead, PERMISSION) or (found["category"] == label and found["permission"] == label + 1)):
            category, permission = label, label + 1
        first_data = permission + 1
        for c in range(permission + 1, min(len(headers), permission + 5)):
            if header_score(headers[c], DESCRIPTION):
                description = c
            elif category is None and header_score(headers[c], CATEGORY):
                category = c
            else:
                break
            first_data = c + 1
    return Layout("matrix", at, tuple(headers), None, permission, None, category, description, first_data, orientation == "users-down")


def detect_catalog(rows: list[list[str]]) -> Layout | None:
    """A catalog, or one role's export in its columns, if the sheet is one: few headers, all of them claimed, no bare yes or no as a name."""
    at = find_header(rows)
    headers = [clean(h) for h in (rows[at] if at < len(rows) else [])]
    named = [i for i, h in enumerate(headers) if h]
    if not 2 <= len(named) <= 7:
        return None
    taken: set[int] = set()
    found = {}
    for name, names in (("name", CATALOG_NAME), ("description", CATALOG_DESCRIPTION), ("type", CATALOG_TYPE), ("group", CATALOG_GROUP), ("value", CATALOG_VALUE)):
        found[name] = best_column(headers, names, taken)
        if found[name] is not None:
            taken.add(found[name])
    body = [r for r in rows[at + 1 : at + 1 + BODY_ROWS] if any(clean(c) for c in r)]
    if found["name"] is None or (found["description"] is None and found["group"] is None) or set(named) - taken or not body:
        return None
    if any(found["name"] < len(r) and key(r[found["name"]]) in ("y", "n", "yes", "no") for r in body):
        return None
    return Layout("role-list" if found["value"] is not None else "catalog", at, tuple(headers), None, found["name"], found["value"], found["group"], found["description"], role=role_from_title(rows[:at]), type=found["type"])


def role_from_title(rows: list[list[str]]) -> str | None:
    """The role that a one-cell title above the header names."""
    for row in rows:
        held = [clean(c) for c in row if clean(c)]
        if len(held) == 1:
            m = re.match(r"(?i)(?:(?:security )?role(?: name)?|security settings?)\s*[:\-\u2013\u2014]\s*(.+)$", held[0])
            if m:
                return m[1].strip()
    return None


def is_role_map(rows: list[list[str]]) -> tuple[int, int, int] | None:
    """(header row, user column, role column) of a sheet that maps users to roles."""
    at = find_header(rows)
    headers = [clean(h) for h in (rows[at] if at < len(rows) else [])]
    if sum(1 for h in headers if h) > 6:
        return None
    role = best_column(headers, ROLE, set())
    user = best_column(headers, [x for x in SUBJECT if x not in ROLE], {role} if role is not None else set())
    return None if role is None or user is None else (at, user, role)


def _sampled(cells: DataFrame, sheet_no: int) -> list[Row]:
    return cells.filter(F.col("sheet_no") == sheet_no).orderBy("file", "row").limit(HEADER_ROWS + BODY_ROWS + 1).collect()


def sample(cells: DataFrame, sheet_no: int = 0) -> tuple[list[int], list[list[str]]]:
    """Row numbers and cells of a sheet's first rows, at most HEADER_ROWS + BODY_ROWS of the first file."""
    rows = _sampled(cells, sheet_no)
    return [r["row"] for r in rows], [list(r["cells"]) for r in rows]


def infer(cells: DataFrame, sheet_no: int = 0, **options) -> Layout:
    """The layout of a sheet of cells (of the first file that has one of that number), with the sheet's own row number of its header. For whole files see `books.read`."""
    rows = _sampled(cells, sheet_no)
    if not rows:
        raise ValueError("a sheet without rows")

    def count(at: int, width: int) -> dict[int, int]:
        below = cells.filter((F.col("sheet_no") == sheet_no) & F.col("file").eqNullSafe(rows[at]["file"]) & (F.col("row") > rows[at]["row"]))
        held = below.select(F.posexplode(F.slice("cells", 1, width)).alias("at", "cell")).filter(keys.clean(F.col("cell")) != "")
        return {r["at"]: r["count"] for r in held.groupBy("at").count().collect()}

    texts = [list(r["cells"]) for r in rows]
    layout = (None if options else detect_catalog(texts)) or detect(texts, count=count, **options)
    return replace(layout, header_row=rows[layout.header_row]["row"])


def to_records(cells: DataFrame, layout: Layout, role: str | None = None, **options) -> DataFrame:
    """Records of cells that are laid out as told."""
    from ..operators import records

    if layout.kind == "long":
        return records.long_records(cells, layout.header_row, layout.subject, layout.permission, layout.value, layout.category, **options)
    if layout.kind == "matrix":
        return records.matrix_records(cells, layout.header_row, list(layout.headers), layout.permission, layout.first_data, users_down=layout.users_down, category=layout.category, description=layout.description, **options)
    named = role or layout.role
    if not named:
        raise ValueError("this sheet lists one role's settings without saying whose: name the role")
    return records.role_list_records(cells, layout.header_row, named, layout.permission, layout.value, layout.category, layout.description)
