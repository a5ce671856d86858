"""Comparison keys of names, as Column -> Column functions."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " > "
#: What counts as white space in cells: also no-break spaces and byte-order marks.
BLANKS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; null as ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{BLANKS}|{BLANKS}$", "")


def clean(c: Column) -> Column:
    """White space runs as one blank, trimmed; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, " "))


def _alnum(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


@cache
def _compatible() -> dict[str, str]:
    """Characters beyond ASCII whose compatibility form has small letters or digits: what is left of it."""
    out = {}
    for x in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.decomposition(x) or x.lower() != x:
            form = re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKC", x.lower()))
            if form.strip():
                out[x] = form
    return out


@cache
def _composed() -> str:
    """A pattern of letters and digits that combine with a mark behind them into one character beyond ASCII."""
    marks: dict[str, list[str]] = {}
    for x in map(chr, range(128, 0x3000)):
        form = unicodedata.normalize("NFD", x)
        if len(form) == 2 and re.fullmatch("[a-z0-9]", form[0]) and unicodedata.normalize("NFC", form) == x:
            marks.setdefault(form[0], []).append(f"\\x{{{ord(form[1]):04X}}}")
    return "|".join(f"{letter}\\p{{M}}*?[{''.join(own)}]" for letter, own in sorted(marks.items()))


def _compatibility_form(c: Column) -> Column:
    """Of a lower-cased text beyond ASCII, as far as letters and digits go. JVM functions only; ASCII texts pass by."""
    table = F.from_json(F.lit(json.dumps(_compatible())), "map<string,string>")  # a constant: folded before the query runs
    apart = F.split(F.regexp_replace(c, _composed(), " "), "")
    wide = F.array_join(F.transform(apart, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_element_at(table, x), F.lit(" "))).otherwise(x)), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), wide).otherwise(c)


def norm_key(c: Column) -> Column:
    """Small ASCII letters and digits of the compatibility form (wide letters, ligatures, circled digits), everything else as one blank."""
    return _alnum(_compatibility_form(F.lower(F.coalesce(c, F.lit("")))))


def perm_key(c: Column, key=norm_key) -> Column:
    """'Category > Setting' with each part as a key; empty parts drop out."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ">"), key), lambda x: x != ""), SEPARATOR)


def short_name(key: Column) -> Column:
    """What stands behind the last separator of a key."""
    return F.element_at(F.split(key, SEPARATOR), -1)


def first_bare(name: Column) -> Column:
    """What stands behind the first '>' of a name, or the name."""
    return F.trim(F.when(name.contains(">"), F.regexp_replace(name, "^[^>]*>", "")).otherwise(name))


def plain_name(name: Column) -> Column:
    """The name up to its first parenthesis."""
    return clean(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?s)\(.*$", ""))


def plain_key(name: Column, key=norm_key) -> Column:
    return key(plain_name(name))


def join_name(category: Column, name: Column) -> Column:
    """'category > name', or one of them where the other is empty or the same."""
    category, name = clean(category), clean(name)
    both = (category != "") & (name != "") & (norm_key(category) != norm_key(name))
    return F.when(both, F.concat(category, F.lit(SEPARATOR), name)).when(name != "", name).otherwise(category)
