"""Reconciliation of a baseline with the actual state: index, pair, join, classify.

Records have subject, permission, value, raw, row, ord and listed_only (role where known). `ord` orders
them within a side: the last of equal keys gives the value, the first gives the name that is shown.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import norm_key, perm_key, plain_key, short_name
from ..functions.values import glob, is_granted, severity_rank, show
from ..plans.lineage import cut, shared_dir, together
from .match import closest, rewrite, unique_pairs
from .order import dictionary, dictionary_classes

TICK_NOTE = "instead of a tick"
#: Names that were matched and pass through the driver to every task rather than being shuffled, at most.
SMALL = 100_000
#: Subjects or permissions of both sides that are sent to every task rather than shuffled, at most (some 100 bytes each).
SPREAD = 500_000
_WINNER = ["permission", "value", "raw", "row", "role"]


@dataclass
class Options:
    ignore_subjects: str = ""
    ignore_permissions: str = ""
    only_subjects: str = ""
    aliases: DataFrame | None = None
    match_by_name: bool = True
    report_unknown_permissions: bool = True
    report_ok: bool = False
    #: Look for near names of what stands on one side only.
    suggest: bool = True
    #: Keep the records' order with the pairs: findings name the first settings of a subject that nobody has reviewed.
    order: bool = True
    #: Compute the pairs once, for several readers; a single reader saves writing them.
    keep: bool = True
    #: Tell what is expected and what is there in words; without, both are null.
    texts: bool = True
    key: object = field(default=norm_key)


@dataclass
class Index:
    """One side: its records by key (one each), its subjects, its permissions. Their ord is null where nothing asked for it (see `both_sides`)."""

    records: DataFrame
    subjects: DataFrame
    permissions: DataFrame


@dataclass
class Result:
    pairs: DataFrame
    #: None where order or texts were not asked for.
    findings: DataFrame | None
    matches: DataFrame
    baseline: Index
    actual: Index


def kept(records: DataFrame, options: Options) -> DataFrame:
    """Records that the globs leave in; they see names before aliases."""
    keep = ~glob(F.col("subject"), options.ignore_subjects) & ~glob(F.col("permission"), options.ignore_permissions)
    if options.only_subjects:
        keep = keep & glob(F.col("subject"), options.only_subjects)
    return records.filter(keep)


def last_wins(records: DataFrame, keys: list[str]) -> DataFrame:
    """The last record of each key by ord, without a sort."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("last")).select(*keys, "last.*")


def first_wins(records: DataFrame, keys: list[str]) -> DataFrame:
    """The first record of each key by ord."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("first")).select(*keys, "first.*")


@dataclass
class Both:
    """Both sides in one: what each has of a pair, of a subject and of a permission (columns b_ and a_, null where it has nothing)."""

    pairs: DataFrame
    subjects: DataFrame
    permissions: DataFrame
    #: value, raw, shown: what cells say.
    texts: DataFrame
    #: How many names subjects and permissions have (no fewer than there are of them), and how many texts there are.
    sizes: tuple[int, int, int]
    #: The pairs by their names (subject, permission) in place of keys, where each key has one name; else None.
    named: DataFrame | None = None

    def side(self, s: str) -> Index:
        """One side's index."""
        own = lambda df, *more: df.filter(f"{s}_has").select("key", *(F.col(f"{s}_{c}").alias(c) for c in ("display", "ord", *more)))
        records = self.pairs.filter(f"{s}_has").select("subject_key", "permission_key", *(F.col(f"{s}_{c}").alias(c) for c in (*_WINNER, "ord")))
        return Index(records, own(self.subjects, "listed_only", "role"), own(self.permissions))


_SIDES = ("b", "a")


def _sided(baseline: DataFrame, actual: DataFrame | None, options: Options) -> DataFrame:
    """Records of both sides in columns of their own, so that they lie in one table whatever the types of their ord; what the records don't have gets no column.

    A record's ord, value, raw, row and role stand in one struct; what else is told of them is told when they are aggregated, as every line passes the shuffle.
    """

    def held(records: DataFrame, s: str, own) -> list[Column]:
        has = records.columns
        last = F.struct("ord", "value", (F.col("raw") if "raw" in has else F.lit("")).alias("raw"), *(F.col(c) for c in ("row", "role") if c in has))
        listed = [own(F.col("listed_only").cast("boolean")).alias(f"{s}_listed_only")] if "listed_only" in has else []
        return [own(last).alias(f"{s}_last"), *listed]

    names = ["subject", "permission"]
    if actual is None:  # one table, read once
        columns = [c for s in _SIDES for c in held(baseline, s, lambda c, s=s: F.when(F.col("of") == s, c))]
        return kept(baseline, options).select(*names, "of", *columns)
    b, a = (kept(x, options).select(*names, F.lit(s).alias("of"), *held(x, s, lambda c: c)) for s, x in zip(_SIDES, (baseline, actual), strict=True))
    return b.unionByName(a, allowMissingColumns=True)


def _all_records(rows: DataFrame, by: list[str], wide: bool, firsts: tuple[str, ...]) -> DataFrame:
    """One row for each subject, permission and `by`: whether a side has it, what it has last (with its ord if wide), the first ord of the sides in `firsts`, whether it is listed only, its first role.

    Lines are dealt by a hash of the names and sorted once, behind the shuffle, by the hash first, as names that all begin alike are slow to compare.
    """
    names, aggregates, out = ["subject", "permission", *by], [], []
    for s in _SIDES:
        last, fields = F.col(f"{s}_last"), rows.schema[f"{s}_last"].dataType.names
        aggregates.append(F.max(last).alias(f"{s}_last"))
        has = last.isNotNull()
        out += [F.when(has, True).alias(f"{s}_has"), F.when(has, F.struct(*(last[x].alias(x) for x in fields if wide or x != "ord"))).alias(f"{s}_last")]
        more = {f"{s}_ord": F.min(last["ord"])} if s in firsts else {}
        if f"{s}_listed_only" in rows.columns:
            more[f"{s}_listed_only"] = F.max(f"{s}_listed_only")
        if "role" in fields:
            more[f"{s}_role"] = F.min(F.when(last["role"] != "", F.struct(last["ord"].alias("ord"), last["role"].alias("role"))))
        aggregates += [c.alias(n) for n, c in more.items()]
        out += more
    dealt = rows.select(F.xxhash64(*names).alias("_hash"), *names, *(c for c in rows.columns if c[:2] in ("b_", "a_"))).repartition("_hash")
    return dealt.groupBy("_hash", *names).agg(*aggregates).select(*names, *out)


def _merged(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row for each `by`: of a side's columns, `last` by its ord, `role` and `ord` the first, the rest true if any is.

    The rows are sorted by a hash of `by` first, as names that all begin alike are slow to compare.
    """
    how = lambda c: (F.min if c[2:] in ("ord", "role") else F.max)(c).alias(c)
    return df.groupBy(F.xxhash64(*by).alias("_hash"), *by).agg(*map(how, columns)).drop("_hash")


def _keys(names: DataFrame, column: str, options: Options, aliased: bool) -> DataFrame:
    """Adds the names' keys, and whether other names have the same key; names with an empty key are dropped."""
    key = options.key(F.col(column)) if column == "subject" else perm_key(F.col(column), options.key)
    out = names.withColumn("key", key)
    if aliased:  # the baseline's keys only
        out = rewrite(out.filter("of = 'b'"), "key", options.aliases, column).unionByName(out.filter("of = 'a'"))
    return out.filter("key <> ''").withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("key")) > 1)


def _seen(records: DataFrame, by: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subjects, permissions (each with the given columns) and texts (value, raw) of the records, told in one reading of them."""
    sets = [["subject", *by], ["permission", *by], *([f"{s}_value", f"{s}_raw"] for s in _SIDES)]
    every = list(dict.fromkeys(c for x in sets for c in x))
    number = [sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in x) for x in sets]
    how = lambda c: (F.min if c[2:] in ("ord", "role") else F.max)(c).alias(c)
    flat = records.select("subject", "permission", *by, *(F.col(f"{s}_last.{x}").alias(f"{s}_{x}") for s in _SIDES for x in ("value", "raw")), *columns)
    told = cut(flat.groupingSets(sets, *every).agg(F.grouping_id().alias("_set"), *map(how, columns)))
    of = lambda k: told.filter(F.col("_set") == number[k])
    texts = of(2).select(F.col("b_value").alias("value"), F.col("b_raw").alias("raw")).union(of(3).select("a_value", "a_raw")).distinct()
    return of(0).select(*sets[0], *columns), of(1).select(*sets[1], *(c for c in columns if c[2:] in ("has", "ord"))), texts


def both_sides(baseline: DataFrame, actual: DataFrame | None, options: Options) -> Both:
    """One aggregate over the records of both sides by their names is their index and their full outer join at once; without `actual`, `baseline` holds both sides' records and says by a column `of` ('b', 'a') whose they are.

    Names are few beside records, so their keys are told from this (smaller) result, once a name; only pairs of names that share a key with others meet in a further aggregate.
    Subjects and permissions are aggregates of it, too. The records' own order is carried on only where names share a key, are suggested, or findings are told.
    """
    spark = (baseline if actual is None else actual).sparkSession
    aliased = options.aliases is not None  # a name's key then depends on its side
    by = ["of"] if aliased else []
    rows = _sided(baseline, actual, options)

    def told(wide: bool) -> tuple[DataFrame, list[DataFrame]]:
        records = cut(_all_records(rows, by, wide, _SIDES if wide else ("a",) if options.order else ()))
        columns = [c for c in records.columns if c[2:] in ("has", "listed_only", "role") or wide and c[2:] == "ord"]
        subjects, permissions, texts = _seen(records, by, columns)
        named = lambda t, column: lambda: cut(_keys(t, column, options, aliased))
        shown = lambda: cut(texts.withColumn("shown", show(F.col("value"), F.col("raw"), options.key)))
        # all are small beside the pairs and are read again and again: by pairing, comparison, matches and suggestions
        return records, together(spark, named(subjects, "subject"), named(permissions, "permission"), shown)

    def counted(subjects: DataFrame, permissions: DataFrame, texts: DataFrame) -> tuple[list[int], bool]:
        held = subjects.select("shared", F.lit(0).alias("which")).union(permissions.select("shared", F.lit(1))).union(texts.select(F.lit(False), F.lit(2)))
        sizes, shared = [0, 0, 0], False
        for r in held.groupBy("which").agg(F.count(F.lit(1)).alias("names"), F.max("shared").alias("shared")).collect():
            sizes[r["which"]], shared = r["names"], shared or r["shared"]
        return sizes, shared

    wide = options.suggest or aliased
    records, (subjects, permissions, shown) = told(wide)
    sizes, shared = counted(subjects, permissions, shown)
    if shared and not wide:  # which of them is first, which last
        wide = True
        records, (subjects, permissions, shown) = told(wide)
    no_ord = {f"{s}_ord": F.lit(None).cast(rows.schema[f"{s}_last"].dataType["ord"].dataType) for s in _SIDES}
    if not wide:
        subjects, permissions = (t.withColumns(no_ord) for t in (subjects, permissions))
    pairs = records = records.withColumns({n: c for n, c in no_ord.items() if n not in records.columns})
    for k, (table, column) in enumerate(((subjects, "subject"), (permissions, "permission"))):
        keys = table.select(column, *by, F.col("key").alias(f"{column}_key"), F.col("shared").alias(f"{column}_shared"))
        pairs = pairs.join(_spread(keys, sizes[k]), [column, *by])
    own = {s: {x: F.col(f"{s}_last.{x}") if x in records.schema[f"{s}_last"].dataType.names else F.lit(None).cast("int" if x == "row" else "string") for x in _WINNER[1:]} for s in _SIDES}
    for s in _SIDES:
        own[s] = {"permission": F.when(F.col(f"{s}_has"), F.col("permission")), **own[s]}
    keys, columns = ["subject_key", "permission_key"], [f"{s}_{x}" for s in _SIDES for x in ("has", "ord")]
    flat = lambda df, of, by=keys: df.select(*by, *columns, *(c.alias(f"{s}_{x}") for s in _SIDES for x, c in of(s).items()))
    if shared:
        some = F.col("subject_shared") | F.col("permission_shared")
        last = {s: F.when(F.col(f"{s}_has"), F.struct(F.col(f"{s}_last.ord").alias("ord"), *(c.alias(x) for x, c in own[s].items()))) for s in _SIDES}
        met = _merged(pairs.filter(some).withColumns({f"{s}_last": c for s, c in last.items()}), keys, [*columns, *(f"{s}_last" for s in _SIDES)])
        pairs = flat(pairs.filter(~some), own.get).unionByName(flat(met, lambda s: {x: F.col(f"{s}_last.{x}") for x in _WINNER}))
    else:
        pairs = flat(pairs, own.get)

    def by_key(table: DataFrame, column: str, more: bool) -> DataFrame:
        """A row a key: the name that its side has first."""
        cols = [c for c in table.columns if c[:2] in ("b_", "a_")]
        first = [F.min(F.when(F.col(f"{s}_has"), F.struct(f"{s}_ord", column))).alias(f"{s}_first") for s in _SIDES]
        out = table.groupBy("key").agg(*first, *((F.min if c[2:] in ("ord", "role") else F.max)(c).alias(c) for c in cols))
        side = lambda s: [f"{s}_has", F.col(f"{s}_first.{column}").alias(f"{s}_display"), f"{s}_ord"]
        rest = lambda s: [F.col(f"{s}_listed_only") if f"{s}_listed_only" in cols else F.when(F.col(f"{s}_has"), False).alias(f"{s}_listed_only"), (F.col(f"{s}_role.role") if f"{s}_role" in cols else F.lit(None).cast("string")).alias(f"{s}_role")]
        return cut(out.select("key", *(x for s in _SIDES for x in (*side(s), *(rest(s) if more else [])))))

    subjects, permissions = together(spark, lambda: by_key(subjects, "subject", True), lambda: by_key(permissions, "permission", False))
    return Both(pairs, subjects, permissions, shown, tuple(sizes), None if shared or aliased else flat(records, own.get, ["subject", "permission"]))


def _spread(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= SPREAD else df


def paired_names(both: Both, options: Options) -> tuple[DataFrame, DataFrame]:
    """Subjects alike but for a parenthesis, permissions alike but for the category; each unique on both sides (see `unique_pairs`)."""
    out = []
    for table, name in ((both.subjects, lambda display: plain_key(display, options.key)), (both.permissions, lambda _: short_name(F.col("key")))):
        sides = [table.filter(f"{s}_has").select(name(F.col(f"{s}_display")).alias("name"), "key", F.col(f"{s}_display").alias("display"), F.lit(s == "b").alias("in_baseline"), F.col(f"{o}_has").isNull().alias("alone")) for s, o in (("b", "a"), ("a", "b"))]
        out.append(unique_pairs(sides[0].unionByName(sides[1])))
    return out[0], out[1]


def _renamed(both: Both, subjects: DataFrame | None, permissions: DataFrame | None) -> Both:
    """The baseline's keys rewritten by from_key, to_key; names stay. A rewritten key stands on one side only, so a group has one row of each side at most."""

    def to(df: DataFrame, column: str, table: DataFrame | None) -> DataFrame:
        if table is None:
            return df
        table = table.select(F.col("from_key").alias("_from"), F.col("to_key").alias("_to"))
        return df.join(table, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")

    def merged(df: DataFrame, keys: list[str], tables: list[DataFrame | None]) -> DataFrame:
        if not any(t is not None for t in tables):
            return df
        for key, table in zip(keys, tables, strict=True):
            df = to(df, key, table)
        return df.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in df.columns if c not in keys))

    if subjects is None and permissions is None:
        return both
    pairs = merged(both.pairs, ["subject_key", "permission_key"], [subjects, permissions])
    return Both(pairs, merged(both.subjects, ["key"], [subjects]), merged(both.permissions, ["key"], [permissions]), both.texts, both.sizes)


#: Type and severity by rule; None: by whether the value is granted.
RULES = [
    ("user-not-in-actual", None), ("user-not-in-baseline", None), ("different", "medium"), ("missing", "medium"), ("ok", "info"), ("missing", None), ("permission-not-in-actual", "low"), ("ok", "info"),
    ("excess", "high"), ("different", "medium"), ("missing", "medium"), ("different", "medium"), ("excess", "high"), ("ok", "info"), ("permission-not-in-baseline", None),
]


def rule() -> Column:
    """The number of the first rule that holds for a joined pair row, as a tree: each condition stands in it once, so that what Spark generates for it stays small enough to be compiled."""
    b, a = F.col("b_value"), F.col("a_value")
    text, granted_b, granted_a = ~b.isin("Y", "N"), is_granted(b), is_granted(a)
    listed = F.when(text, 2).when(granted_b, 3).otherwise(4)
    lacking = F.when(F.col("listed_only"), listed).when(F.col("permission_in_actual"), 5).otherwise(6)
    held = F.when(a == b, 7).when(granted_a & ~granted_b, 8).when(granted_b & ~granted_a, F.when(text, 9).otherwise(10)).otherwise(11)
    alone = F.when(F.col("permission_in_baseline"), F.when(granted_a, 12).otherwise(13)).otherwise(14)
    known = F.when(F.col("has_baseline"), F.when(F.col("has_actual"), held).otherwise(lacking)).otherwise(alone)
    return F.when(~F.col("subject_in_actual"), 0).when(~F.col("subject_in_baseline"), 1).otherwise(known)


def classify(pairs: DataFrame) -> DataFrame:
    """Adds type and severity."""
    granted = {0: ("medium", "info"), 1: ("high", "info"), 5: ("medium", "info"), 14: ("low", "info")}
    fixed = F.get(F.array(*(F.lit(level) for _, level in RULES)), F.col("rule"))
    held = is_granted(F.coalesce("b_value", "a_value"))
    by_grant = F.when(held, F.get(F.array(*(F.lit(granted.get(k, (None,))[0]) for k in range(len(RULES)))), F.col("rule"))).otherwise("info")
    out = pairs.withColumn("rule", rule()).withColumn("type", F.get(F.array(*(F.lit(name) for name, _ in RULES)), F.col("rule")))
    return out.withColumn("severity", F.coalesce(fixed, by_grant)).drop("rule")


def reconcile(both: Both, options: Options) -> DataFrame:
    """One row per (subject, permission) that either side has, with type and severity.

    What is known of the subject and the permission comes from their tables, which go to every task while they are small.
    """

    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    held, names = (both.pairs, ["subject_key", "permission_key"]) if both.named is None else (both.named, ["subject", "permission"])
    pairs = held.select(*(F.col(c).alias(f"_{c}") for c in names), has("b_has").alias("has_baseline"), has("a_has").alias("has_actual"), *(f"{s}_{c}" for s in _SIDES for c in (*_WINNER, "ord")))
    display = F.coalesce("b_display", "a_display")
    by = lambda k: (F.col("key") if both.named is None else display).alias(f"_{names[k]}")
    subjects = both.subjects.select(
        by(0), F.col("key").alias("subject_key"), display.alias("subject"), F.coalesce("b_role", F.lit("")).alias("role"), F.coalesce("a_listed_only", F.lit(False)).alias("listed_only"),
        has("b_has").alias("subject_in_baseline"), has("a_has").alias("subject_in_actual"),
    )
    known = both.permissions.select(by(1), F.col("key").alias("permission_key"), has("b_has").alias("permission_in_baseline"), has("a_has").alias("permission_in_actual"))
    pairs = pairs.join(_spread(subjects, both.sizes[0]), f"_{names[0]}").join(_spread(known, both.sizes[1]), f"_{names[1]}").drop(*(f"_{c}" for c in names))
    for s in _SIDES:
        if not options.texts:
            pairs = pairs.withColumn(f"{s}_shown", F.lit(None).cast("string"))
            continue
        said = both.texts.select(F.col("value").alias("_value"), F.col("raw").alias("_raw"), F.col("shown").alias(f"{s}_shown"))
        pairs = pairs.join(_spread(said, both.sizes[2]), F.col(f"{s}_value").eqNullSafe(F.col("_value")) & F.col(f"{s}_raw").eqNullSafe(F.col("_raw")), "left").drop("_value", "_raw")
    pairs = classify(pairs)
    pairs = pairs.withColumn("permission", F.coalesce("b_permission", "a_permission"))
    listed = F.col("has_baseline") & ~F.col("has_actual") & F.col("listed_only") & F.col("subject_in_actual")
    expected = F.when(F.col("has_baseline"), F.col("b_shown")).otherwise("")
    held = F.when(F.col("has_actual"), F.col("a_shown")).when(listed, "N (not listed)").otherwise("")
    nothing = F.lit(None).cast("string")
    pairs = pairs.withColumn("expected", expected if options.texts else nothing).withColumn("actual", held if options.texts else nothing)
    if not options.report_unknown_permissions:
        pairs = pairs.filter("type <> 'permission-not-in-baseline'")
    return pairs.drop("b_shown", "a_shown", "b_ord", *(f"{s}_{c}" for s in _SIDES for c in ("permission", "role")))


def _note() -> Column:
    """What a finding says of its pair, by what the pair is."""
    kind = F.col("type")
    said = lambda side: F.concat(F.lit('"'), F.coalesce(f"{side}_raw", F.lit("")), F.lit('"'))
    absent = ~F.col("has_actual")
    pasted = ~F.col("b_value").isin("Y", "N") & F.coalesce(F.col("a_value"), F.lit("N")).isin("N", "")
    cases = [
        (kind == "excess", F.when(F.col("has_baseline"), "held against the baseline: take it away, or change the baseline").otherwise("held, and the baseline has no line for this subject here: take it away, or add the line")),
        ((kind == "different") & pasted, F.concat(F.lit("baseline cell with "), said("b"), F.lit(f" {TICK_NOTE}; not held: correct the cell"))),
        (kind == "different", F.concat(F.lit("levels differ: held "), said("a"), F.lit(", wanted "), said("b"))),
        (kind == "missing", F.when(F.col("listed_only"), "wanted, and the subject's list lacks it: give it").when(absent, "wanted, and known to the system, but no line for this subject").otherwise("wanted but not held: give it")),
        (kind == "permission-not-in-actual", F.lit("the system has no such setting: renamed there, or misspelt here")),
        (kind == "permission-not-in-baseline", F.when(F.col("severity") == "low", "held, and outside the baseline: decide on it").otherwise("outside the baseline, not held")),
    ]
    out = F.lit("")
    for holds, text in reversed(cases):
        out = F.when(holds, text).otherwise(out)
    return out


def findings(pairs: DataFrame, baseline: Index, actual: Index, options: Options) -> DataFrame:
    """The finding list: pairs that differ, and one row for each subject that one side lacks."""
    # told by the subject rather than by the type, so that pairs that are not kept are filtered before they are classified
    alone = ~(F.col("subject_in_actual") & F.col("subject_in_baseline"))
    listed = pairs.filter(~alone) if options.report_ok else pairs.filter(~alone).filter(F.col("type") != "ok")
    columns = ["severity", "type", "subject", "permission", "expected", "actual", "note", "baseline_row", "actual_row", "suggestion", "subject_key", "permission_key"]
    listed = listed.withColumn("note", _note()).withColumn("baseline_row", F.col("b_row")).withColumn("actual_row", F.col("a_row"))
    value = F.coalesce("b_value", "a_value")
    single = pairs.filter(alone).groupBy("subject_key", "subject", "type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_granted(value)).alias("granted"),
        F.slice(F.array_sort(F.collect_list(F.when(is_granted(value), F.struct(F.col("a_ord"), F.col("permission"))))), 1, 8).alias("first"),
    )
    many = F.concat(F.col("n").cast("string"), F.lit(" settings ("), F.col("granted").cast("string"), F.lit(" granted)"))
    missing = F.col("type") == "user-not-in-actual"
    some = F.concat(F.lit("nobody has reviewed what this subject holds: "), F.array_join(F.transform("first", lambda x: x["permission"]), "; "), F.when(F.col("granted") > 8, "; ...").otherwise(""))
    single = single.select(
        F.when(missing, "medium").when(F.col("granted") > 0, "high").otherwise("low").alias("severity"), "type", "subject", F.lit("").alias("permission"),
        F.when(missing, many).otherwise("").alias("expected"), F.when(missing, "").otherwise(many).alias("actual"),
        F.when(missing, "expected, but the system does not list this subject: left out, or under another name").when(F.col("granted") > 0, some).otherwise("not expected, and holds nothing").alias("note"),
        F.lit(None).cast("int").alias("baseline_row"), F.lit(None).cast("int").alias("actual_row"), "subject_key", F.lit("").alias("permission_key"),
    )
    out = listed.withColumn("suggestion", F.lit("")).select(*columns).unionByName(single.withColumn("suggestion", F.lit("")).select(*columns))
    return suggestions(out, baseline, actual) if options.suggest else out


def suggestions(found: DataFrame, baseline: Index, actual: Index) -> DataFrame:
    """Nearest names for what one side lacks: each distinct name is looked up once, subjects and settings together."""
    name = F.when(F.col("type").isin("user-not-in-actual", "user-not-in-baseline"), F.col("subject")).otherwise(F.col("permission_key"))
    named = found.withColumn("_name", name)
    near = None
    for side, kinds in ((actual, ("user-not-in-actual", "permission-not-in-actual")), (baseline, ("user-not-in-baseline", "permission-not-in-baseline"))):
        tables = [x.select(F.lit(kind).alias("type"), "key", "display", "ord") for x, kind in zip((side.subjects, side.permissions), kinds, strict=True)]
        part = closest(named.filter(F.col("type").isin(*kinds)).select("type", F.col("_name").alias("key")), tables[0].unionByName(tables[1]), by=("type",))
        part = part.select(F.col("type").alias("_type"), F.col("key").alias("_key"), F.col("suggestion").alias("_near"))
        near = part if near is None else near.unionByName(part)
    out = named.join(near, (F.col("_name") == F.col("_key")) & (F.col("type") == F.col("_type")), "left")
    said = F.concat(F.col("note"), F.lit('; closest: "'), F.col("_near"), F.lit('"'))
    out = out.withColumn("note", F.when(F.col("_near").isNotNull(), said).otherwise(F.col("note"))).withColumn("suggestion", F.coalesce("_near", "suggestion"))
    return out.drop("_name", "_key", "_near", "_type")


def finding_order() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), *dictionary("subject", "permission")]


def with_order(found: DataFrame) -> tuple[DataFrame, list[Column]]:
    """found with columns of numbers, and the same order told by them (see `dictionary_classes`). It is read once for the names, so it should be cheap to read."""
    names = ("subject", "permission")
    for name, (t, size) in zip(names, dictionary_classes(found, *names), strict=True):
        table = t.select(F.col(name).alias("_name"), F.col("class").alias(f"_{name}_class"))
        found = found.join(_spread(table, size), F.col(name) == F.col("_name"), "left").drop("_name")  # a null name stays, and stands first
    return found, [severity_rank(F.col("severity")).desc(), *(F.col(f"_{n}_class") for n in names), *map(F.col, names)]


def ordered(found: DataFrame) -> DataFrame:
    """Findings by falling severity, then subject and permission in dictionary order."""
    return found.orderBy(*finding_order())


def detail(result: Result) -> DataFrame:
    """Every pair in dictionary order of subjects, then of settings: subject, role, permission, type, expected, actual."""
    return result.pairs.orderBy(*dictionary("subject", "permission")).select("subject", "role", "permission", "type", "expected", "actual")


def _few(table: DataFrame) -> DataFrame | None:
    """The matches as a table that may go to every task, while they are few; as it is, if there are more; None if there are none."""
    held = table.limit(SMALL + 1).collect()
    if not held:
        return None
    return F.broadcast(table.sparkSession.createDataFrame(held, table.schema)) if len(held) <= SMALL else table


def compare(baseline: DataFrame, actual: DataFrame | None, options: Options | None = None) -> Result:
    """Without `actual`, `baseline` holds both sides' records (see `both_sides`)."""
    options = options or Options()
    spark = baseline.sparkSession
    shared_dir(spark)
    both = both_sides(baseline, actual, options)
    found: list = [None, None]
    if options.match_by_name:
        found = together(spark, *(lambda t=t: _few(t) for t in paired_names(both, options)))
    matches = []
    if options.aliases is not None:
        for kind, table in (("subject", both.subjects), ("permission", both.permissions)):
            used = options.aliases.filter(F.col("kind") == kind).select("from_key", F.col("to_key").alias("key")).distinct()
            matches.append(used.join(table.filter("a_has"), "key").select(F.col("from_key").alias("baseline"), F.col("a_display").alias("actual"), F.lit("alias").alias("by"), F.lit(kind).alias("kind")))
    for kind, table in zip(("subject", "permission"), found, strict=True):
        if table is not None:
            matches.append(table.select("baseline", "actual", F.lit("name").alias("by"), F.lit(kind).alias("kind")))
    both = _renamed(both, *found)
    pairs = reconcile(both, options)
    if options.keep:  # findings, counts and roll-ups all read them
        pairs = cut(pairs)
    every = matches[0] if matches else spark.createDataFrame([], "baseline string, actual string, by string, kind string")
    for more in matches[1:]:
        every = every.unionByName(more)
    b, a = both.side("b"), both.side("a")
    told = options.texts and (options.order or options.suggest)
    return Result(pairs, findings(pairs, b, a, options) if told else None, every, b, a)
