"""Permission values: 'Y', 'N' or a level in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import norm_key, strip

# Cells that mean granted, and cells that mean not granted.
GRANTED = ["y", "yes", "true", "1", "x", "✓", "✔", "☑", "check", "checked", "allow", "allowed", "grant", "granted", "on", "enabled", "enable", "permitted", "permit", "full", "full access", "access", "assigned", "active", "ok", "a"]
NOT_GRANTED = ["n", "no", "false", "0", "", "-", "—", "–", "x-", "✗", "✘", "☐", "unchecked", "deny", "denied", "none", "no access", "off", "disabled", "disable", "not allowed", "not permitted", "revoke", "revoked", "unassigned", "inactive", "null", "n/a", "n a", "na", "blank", "d"]
#: Severities by rank.
SEVERITIES = ["info", "low", "medium", "high"]
TYPES = ["ok", "excess", "missing", "different", "user-not-in-baseline", "user-not-in-actual", "permission-not-in-baseline", "permission-not-in-actual"]


def normalize_value(raw: Column, kind: Column | None = None, key=norm_key) -> Column:
    """'Y', 'N' or the key of a level. kind: 'num' or 'bool' where the cell was a number or a truth value, else text."""
    k, s = key(raw), strip(raw)
    text = (
        F.when(k.isin(GRANTED) | s.isin(GRANTED), "Y")
        .when(k.isin(NOT_GRANTED) | s.isin(NOT_GRANTED), "N")
        .when(k.rlike("^(x|y|yes)( |$)") | k.rlike("(^| )added( |$)"), "Y")
        .otherwise(k)
    )
    if kind is None:
        return text
    number = F.when(F.coalesce(raw.try_cast("double"), F.lit(0.0)) != 0, "Y").otherwise("N")
    truth = F.when(F.lower(s) == "true", "Y").otherwise("N")
    return F.when(kind == "num", number).when(kind == "bool", truth).otherwise(text)


def is_annotated(raw: Column, key=norm_key) -> Column:
    """A cell that says more than yes or no."""
    k, s = key(raw), strip(raw)
    known = k.isin(GRANTED + NOT_GRANTED) | s.isin(GRANTED + NOT_GRANTED)
    return (s != "") & ~known


def is_granted(value: Column) -> Column:
    return ~value.isin("N", "")


def show(value: Column, raw: Column, key=norm_key) -> Column:
    """The value (Y, N or the key of a level), with what the cell said where that differs."""
    s = strip(raw)
    blank = F.coalesce(raw, F.lit("")) == ""
    return F.when(value.isNull(), "").when(blank, F.when(value == "N", "N (blank)").otherwise(value)).when(key(s) == F.lower(value), value).otherwise(F.concat(value, F.lit(" ("), s, F.lit(")")))


def severity_rank(severity: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")


def glob(c: Column, patterns: str | list[str] | None) -> Column:
    """True where the text matches one of the comma-separated patterns; * stands for anything."""
    listed = patterns.split(",") if isinstance(patterns, str) else patterns or []
    out = F.lit(False)
    for pattern in filter(None, (x.strip() for x in listed)):
        regex = ".*".join("\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E" if x else "" for x in pattern.split("*"))
        out = out | F.coalesce(c, F.lit("")).rlike(f"(?is)\\A{regex}\\z")
    return out
