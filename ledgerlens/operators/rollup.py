"""Summaries of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import SEVERITIES, TYPES, severity_rank
from .compare import TICK_NOTE, Index
from .order import dictionary


def _tally(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """A count for each of a fixed list of names, zero where none."""
    sums = df.agg(*(F.count_if(F.col(column) == n).alias(str(k)) for k, n in enumerate(names)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias(column), F.col(str(k)).alias("n")) for k, n in enumerate(names)))).alias("x")).select("x.*")


def single_rows(pairs: DataFrame) -> DataFrame:
    """Pairs with one row for each subject that one side lacks."""
    alone = F.col("type").isin("user-not-in-actual", "user-not-in-baseline")
    return pairs.filter(~alone).select("subject", "permission", "type", "severity").unionByName(pairs.filter(alone).select("subject", F.lit("").alias("permission"), "type", "severity").dropDuplicates(["subject", "type"]))


def counts_by_type(pairs: DataFrame) -> DataFrame:
    return _tally(single_rows(pairs), "type", TYPES)


def counts_by_severity(found: DataFrame) -> DataFrame:
    return _tally(found, "severity", list(reversed(SEVERITIES)))


def permission_order() -> list[Column]:
    return [F.expr("excess + missing + different").desc(), *dictionary("permission")]


def subject_order() -> list[Column]:
    return [F.desc("high"), F.desc("medium"), *dictionary("subject")]


def action_order() -> list[Column]:
    return [F.size("remove").desc(), F.size("grant").desc(), *dictionary("subject")]


def by_permission(pairs: DataFrame) -> DataFrame:
    """permission (as shown), ok, excess, missing, different, other; those with something to say, most differences first."""
    rows = pairs.filter(~F.col("type").isin("user-not-in-actual", "user-not-in-baseline") & (F.col("permission") != ""))
    named = ["ok", "excess", "missing", "different"]
    out = rows.groupBy("permission").agg(*(F.count_if(F.col("type") == t).alias(t) for t in named), F.count_if(~F.col("type").isin(named)).alias("other"))
    return out.filter("excess + missing + different + other > 0").orderBy(*permission_order())


def by_subject(found: DataFrame) -> DataFrame:
    """subject, high, medium, low, info, excess, missing, different, other."""
    named = ["excess", "missing", "different"]
    levels = list(reversed(SEVERITIES))
    out = found.groupBy("subject").agg(
        *(F.count_if(F.col("severity") == s).alias(s) for s in levels), *(F.count_if(F.col("type") == t).alias(t) for t in named), F.count_if(~F.col("type").isin([*named, "ok"])).alias("other")
    )
    return out.orderBy(*subject_order())


def actions(found: DataFrame) -> DataFrame:
    """subject, remove, grant, review (lists in dictionary order) and status: what there is to do."""
    kind, severity = F.col("type"), F.col("severity")
    review = (
        F.when((kind == "different") & F.col("note").contains(TICK_NOTE), F.concat("permission", F.lit(": "), "note"))
        .when(kind == "different", F.concat("permission", F.lit(": the system has "), "actual", F.lit(", the baseline wants "), "expected"))
        .when((kind == "permission-not-in-baseline") & (severity == "low"), F.concat("permission", F.lit(": granted, not covered by the baseline")))
    )
    hint = F.when(F.col("suggestion") != "", F.concat(F.lit(" (closest: "), "suggestion", F.lit(")"))).otherwise("")
    status = (
        F.when((kind == "user-not-in-baseline") & (severity == "high"), F.concat(F.lit("not in the baseline but holds grants: add it, or retire the subject"), hint))
        .when(kind == "user-not-in-baseline", F.lit("not in the baseline (no grants): add it or ignore"))
        .when(kind == "user-not-in-actual", F.concat(F.lit("expected by the baseline but missing: export it, or retire it there"), hint))
    )
    rows = found.select(
        "subject", F.when(kind == "excess", F.col("permission")).alias("remove"), F.when((kind == "missing") & (severity != "info"), F.col("permission")).alias("grant"), review.alias("review"), status.alias("status")
    ).filter("coalesce(remove, grant, review, status) IS NOT NULL")
    listed = [F.array_sort(F.collect_list(c)).alias(c) for c in ("remove", "grant", "review")]
    out = rows.groupBy("subject").agg(*listed, F.coalesce(F.max("status"), F.lit("")).alias("status"))
    return out.orderBy(*action_order())


def sizes(baseline: Index, actual: Index) -> DataFrame:
    """kind (subject, permission), baseline, actual, both: how many keys each side has."""
    parts = []
    for kind in ("subjects", "permissions"):
        b, a = (getattr(x, kind).select("key").distinct().withColumn(c, F.lit(1)) for x, c in ((baseline, "b"), (actual, "a")))
        every = b.join(a, "key", "full_outer")
        parts.append(every.agg(F.count("b").alias("baseline"), F.count("a").alias("actual"), F.count(F.expr("b + a")).alias("both")).select(F.lit(kind[:-1]).alias("kind"), "*"))
    return parts[0].unionByName(parts[1])


def verdict(pairs: DataFrame, found: DataFrame, fail_on: str = "medium") -> DataFrame:
    """compared, worst severity, passed (no high, no medium) and exit_code (1 if something as severe as fail_on was found)."""
    compared = single_rows(pairs).agg(F.count_if(F.col("type").isin("ok", "excess", "missing", "different")).alias("compared"))
    worst = found.agg(F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(-1)).alias("rank"))
    least = SEVERITIES.index(fail_on if fail_on in SEVERITIES else "medium")
    both = compared.join(worst)
    return both.select("compared", F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), F.col("rank")), F.lit("none")).alias("worst"), (F.col("rank") < 2).alias("passed"), (F.col("rank") >= least).cast("int").alias("exit_code"))
