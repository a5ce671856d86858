"""Functions, matching, comparison, records, sources and frames on small tables, against plain Python."""

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import keys, values
from ledgerlens.operators import catalog, compare, inventory, match, records, rollup
from ledgerlens.sources import cells, layout, sinks
from ledgerlens.streaming import frames


def column(spark, items, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c")).alias("o")).collect()]


def test_keys(spark):
    assert column(spark, ["  Merge-Patients! ", None, "Ünal", "日本"], keys.norm_key) == ["merge patients", "", "nal", ""]
    odd = ["\ufb01le \uff211", "\u00e9x", "e\u0301x", "b\u0301x", "e\u0316\u0301x", "\u338f \u2469 \u2167 \u2121", "\u0130x", "\uff21nn", "\u212a", "", None, "\U0001d400\U0001d7cf", "\u00bd \u00b2", "x\uff1ey"]
    by_hand = [re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKC", (x or "").lower())).strip() for x in odd]
    assert column(spark, odd, keys.norm_key) == by_hand and by_hand[7] == "ann"
    assert column(spark, ["A > > b C", "x", " > "], keys.perm_key) == ["a > b c", "x", ""]
    assert column(spark, ["a > b > c", "x"], keys.short_name) == ["c", "x"]
    assert column(spark, ["APPS Admin (Admin (x))", "n"], keys.plain_name) == ["apps admin", "n"]
    assert column(spark, ["a ﻿ b ", None], keys.clean) == ["a b", ""]


def test_values(spark):
    cells_ = ["Yes", " x ", "X (added 9/13/24", "ADDED 6/12", "no access", "", None, "✓", "Read Only", "x-", "not added", "x ray", "日本"]
    assert column(spark, cells_, values.normalize_value) == ["Y", "Y", "Y", "Y", "N", "N", "N", "Y", "read only", "Y", "Y", "Y", "N"]
    assert column(spark, ["✓\n", "\u00a0✓\u00a0", "\ufeffx\t", "✗\u2003"], values.normalize_value) == ["Y", "Y", "Y", "N"]
    assert column(spark, ["✓\n", " \u00a0 ", "note\n"], values.is_annotated) == [False, False, True]
    rows = spark.createDataFrame([("2", "num"), ("0.0", "num"), ("true", "bool"), ("false", "bool"), ("2", "str")], "c string, k string")
    assert [r[0] for r in rows.select(values.normalize_value(F.col("c"), F.col("k"))).collect()] == ["Y", "N", "Y", "N", "2"]


def test_globs(spark):
    found = column(spark, ["test1", "Admin", "a.b", "axb", None], lambda c: values.glob(c, "test*, admin,a.b"))
    assert found == [True, True, True, False, False]


def plain_similarity(a, b):
    if a == b:
        return 1.0
    ta, tb = set(a.split(" ")), set(b.split(" "))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    near = 1 - row[-1] / max(len(a), len(b), 1)
    return max(len(ta & tb) / len(ta | tb) * 0.6 + near * 0.4, near, 0.9 if len(ta) > 1 and ta <= tb else 0)


def test_closest_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeilnorst") for _ in range(r.randint(1, 6)))
    pool = sorted({" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(60)})
    wanted = sorted({re.sub("[aeiou]", "", x, count=1).strip() or x for x in pool} | {x[:-1] for x in pool if len(x) > 2 and x[-2] != " "})
    candidates = spark.createDataFrame([(x, x, i) for i, x in enumerate(pool)], "key string, display string, ord long")
    got = {x.key: x.suggested_key for x in match.closest(spark.createDataFrame([(x,) for x in wanted], "key string"), candidates).collect()}
    for name in wanted:
        best, score = None, 0.72
        for x in pool:
            s = max(plain_similarity(name, x), plain_similarity(name, x) * 0.95, plain_similarity(name, x) * 0.97)
            if s > score + 1e-12:
                best, score = x, s
        assert got.get(name) == best, name


def side(spark, rows, listed=False):
    return spark.createDataFrame([(s, p, v, v, i, i, listed) for i, (s, p, v) in enumerate(rows)], "subject string, permission string, value string, raw string, row int, ord long, listed_only boolean")


def brute(base, actual):
    """Pair types by nested loops over dictionaries."""
    b, a = ({(s, p): v for s, p, v in rows} for rows in (base, actual))
    subjects, perms = [{k[0] for k in x} for x in (b, a)], [{k[1] for k in x} for x in (b, a)]
    out = {}
    for s, p in b.keys() | a.keys():
        x, y = b.get((s, p)), a.get((s, p))
        if s not in subjects[1]:
            t = "user-not-in-actual"
        elif s not in subjects[0]:
            t = "user-not-in-baseline"
        elif x is None:
            t = ("excess" if y != "N" else "ok") if p in perms[0] else "permission-not-in-baseline"
        elif y is None:
            t = "missing" if p in perms[1] else "permission-not-in-actual"
        elif x == y:
            t = "ok"
        elif x == "N":
            t = "excess"
        elif y == "N":
            t = "missing" if x == "Y" else "different"
        else:
            t = "different"
        out[s, p] = t
    return out


@pytest.mark.parametrize("seed", range(3))
def test_compare_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [[(f"role {r.randint(0, 5)}{k}"[:7], f"area > set {r.randint(0, 7 + k)}", r.choice(["Y", "N", "view"])) for _ in range(40)] for k in (0, 1)]
    result = compare.compare(*(side(spark, x) for x in rows), compare.Options(match_by_name=False, suggest=False))
    got = {(x.subject_key, x.permission_key): x.type for x in result.pairs.collect()}
    assert got == brute(*rows)
    counts = {x.type: x.n for x in rollup.counts_by_type(result.pairs).collect()}
    assert set(counts) == set(values.TYPES) and counts["ok"] == sum(t == "ok" for t in got.values())


def test_compare_all_types(spark):
    base = [("a", "one", "Y"), ("a", "two", "N"), ("a", "three", "Y"), ("a", "old name", "Y"), ("a", "level", "view"), ("gone", "one", "Y"), ("a", "text", "see note")]
    actual = [("A", "One", "Y"), ("a", "two", "Y"), ("a", "three", "N"), ("a", "level", "edit"), ("new", "one", "Y"), ("a", "extra thing", "Y"), ("a", "text", "N")]
    result = compare.compare(side(spark, base), side(spark, actual))
    found = {(x.subject, x.permission): (x.type, x.severity) for x in result.findings.collect()}
    assert found == {
        ("a", "two"): ("excess", "high"), ("a", "three"): ("missing", "medium"), ("a", "old name"): ("permission-not-in-actual", "low"), ("a", "level"): ("different", "medium"),
        ("gone", ""): ("user-not-in-actual", "medium"), ("new", ""): ("user-not-in-baseline", "high"), ("a", "extra thing"): ("permission-not-in-baseline", "low"), ("a", "text"): ("different", "medium"),
    }
    todo = {x.subject: x for x in rollup.actions(result.findings).collect()}
    assert todo["a"].remove == ["two"] and todo["a"].grant == ["three"] and len(todo["a"].review) == 3
    assert rollup.verdict(result.pairs, result.findings).first()[1:] == ("high", False, 1)
    assert "FAIL" in sinks.text_summary(result)
    assert sinks.findings_csv(result.findings).count("\r\n") == 9
    book = sinks.workbook(sinks.report(result))
    assert {x[0] for x in cells.parse(book)} == {"Summary", "Actions", "Findings", "Side by side", "Subjects", "Settings", "Matches"}


def test_last_wins_listed_only_and_aliases(spark):
    base = side(spark, [("a", "p", "N"), ("a", "p", "Y"), ("a", "q", "N"), ("a", "r", "note"), ("b", "grp > only", "Y")])
    actual = side(spark, [("a", "p", "Y"), ("bb", "other > only", "Y")], listed=True)
    aliases = spark.createDataFrame([("subject", "b", "bb")], "kind string, from_key string, to_key string")
    result = compare.compare(base, actual, compare.Options(aliases=aliases))
    assert {(x.subject, x.permission): x.type for x in result.pairs.collect()} == {("a", "p"): "ok", ("a", "q"): "ok", ("a", "r"): "different", ("b", "grp > only"): "ok"}
    assert sorted((x.baseline, x.actual, x.by) for x in result.matches.collect()) == [("b", "bb", "alias"), ("grp > only", "other > only", "name")]


def test_round_trip_of_a_matrix(spark):
    r = random.Random(7)
    roles, settings = [f"Role {i}" for i in range(6)], [f"Area {i % 3} > Setting {i}" for i in range(30)]
    grants = {(a, b): r.random() < 0.45 for a in roles for b in settings}
    book = sinks.workbook([sinks.Sheet("m", [["Security Setting", *roles], *([s, *("X" if grants[a, s] else "" for a in roles)] for s in settings)])])
    held = cells.read_bytes(spark, book, "m.xlsx")
    lay = layout.infer(held, orientation="permissions-down")
    baseline = layout.to_records(held.filter("size(filter(slice(cells, 2, 10), c -> c <> '')) > 0 OR row = 1"), lay)
    rows = [(a, s, "Y" if g else "N") for (a, s), g in grants.items()]
    known = {s for s in settings if any(grants[a, s] for a in roles)}
    clean = compare.compare(baseline, side(spark, [x for x in rows if x[1] in known]))
    assert clean.findings.count() == 0
    changed = [(a, s, ("N" if v == "Y" else "Y") if (a, s) == ("Role 3", sorted(known)[0]) else v) for a, s, v in rows if a != "Role 5" and s in known]
    assert sorted(x.type for x in compare.compare(baseline, side(spark, changed)).findings.collect())[-1] == "user-not-in-actual"


def test_long_records_carry(spark):
    text = "User,Category,Setting,Value\nann,Charts,View,Y\n,,Edit,N\nbob,,Print,x\nskip me,Other,Z,Y\n,,Y2,Y\ncid,,Last,\n"
    held = cells.read_bytes(spark, text.encode(), "a.csv")
    lay = layout.infer(held)
    assert lay.kind == "long"
    got = [(x.subject, x.permission, x.value) for x in layout.to_records(held, lay, ignore="skip*").orderBy("ord").collect()]
    assert got == [("ann", "Charts > View", "Y"), ("ann", "Charts > Edit", "N"), ("bob", "Charts > Print", "Y"), ("cid", "Charts > Last", "N")]


def test_matrix_headings_and_users_down(spark):
    text = "Security Setting,jdoe,asmith\nReports,,\nRun,Y,\nStop,x - added 1/2,view\n"
    held = cells.read_bytes(spark, text.encode(), "a.csv")
    got = [(x.subject, x.permission, x.value) for x in layout.to_records(held, layout.infer(held)).orderBy("ord").collect()]
    assert got == [("jdoe", "Reports > Run", "Y"), ("asmith", "Reports > Run", "N"), ("jdoe", "Reports > Stop", "Y"), ("asmith", "Reports > Stop", "view")]
    across = cells.read_bytes(spark, b"User,Delete patient,Merge patients\nann,Y,N\n", "b.csv")
    assert [(x.subject, x.permission, x.value) for x in layout.to_records(across, layout.infer(across)).orderBy("ord").collect()] == [("ann", "Delete patient", "Y"), ("ann", "Merge patients", "N")]
    notes = {x.code: x.n for x in records.diagnostics(layout.to_records(held, layout.infer(held)), held, 1).collect()}
    assert notes == {"annotated tick": 1, "level": 1, "skipped row": 1}


def test_roles(spark):
    held = spark.createDataFrame([("Nurse", "p", 1), ("Biller", "q", 2), ("zed", "p", 3)], "subject string, permission string, ord int")
    users = spark.createDataFrame([("u1", "Nurse", "u1"), ("u2", "nurse ", "u2"), ("u3", "Biller", "u3"), ("u4", "Clerk", "u4")], "user string, role string, user_key string")
    assert sorted((x.subject, x.permission) for x in records.expand_roles(held, users).collect()) == [("u1", "p"), ("u2", "p"), ("u3", "q"), ("zed", "p")]
    assert sorted((x.side, x.name) for x in records.role_gaps(held, users).collect()) == [("role without records", "Clerk"), ("subject without role", "zed")]


def test_catalog(spark):
    cat = catalog.catalog(spark.createDataFrame([("Merge > All", "d1", "t", "G1", 1), ("View", "d2", "t", "G2", 2), ("view", "d3", "t", "G3", 3)], "name string, description string, type string, grp string, ord long"))
    names = spark.createDataFrame([("Area > Merge > All",), ("x > y > View",), ("Veiw chart",)], "permission string")
    assert {x.permission: x.grp for x in catalog.enrich(names, cat).collect()} == {"Area > Merge > All": "G1", "x > y > View": "G2", "Veiw chart": None}
    _, unknown, uncovered = catalog.cross_check(names, cat)
    assert [x.permission for x in unknown.collect()] == ["Veiw chart"] and uncovered.count() == 0


def test_inventory(spark):
    rows = side(spark, [("r1", "G > a", "Y"), ("r2", "a", "N"), ("r1", "b", "view"), ("r2", "b", "Y")])
    assert {x.setting: (x.held_by, x.r1, x.r2) for x in inventory.inventory(rows).collect()} == {"a": (1, "X", ""), "b": (2, "view", "X")}
    with pytest.raises(ValueError):
        inventory.inventory(rows, limit=1)


def test_sources(spark, tmp_path):
    book = sinks.workbook([sinks.Sheet("One", [["h1", "h2"], ["a", 1], [], ["b", True]]), sinks.Sheet("Two", [["x"]])])
    assert book == sinks.workbook([sinks.Sheet("One", [["h1", "h2"], ["a", 1], [], ["b", True]]), sinks.Sheet("Two", [["x"]])])
    (tmp_path / "a.xlsx").write_bytes(book)
    (tmp_path / "b.csv").write_bytes('﻿p;q\r\n\r\n"x ""y""\nz";-1.5\r\n'.encode())
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    for read in (cells.read_cells, cells.read_cells_anywhere):
        got = sorted((x.sheet, x.row, x.cells, x.kinds) for x in read(spark, str(tmp_path)).collect())
        assert got == [("One", 1, ["h1", "h2"], ["str", "str"]), ("One", 2, ["a", "1"], ["str", "num"]), ("One", 4, ["b", "true"], ["str", "bool"]), ("Sheet1", 1, ["p", "q"], ["str", "str"]), ("Sheet1", 2, ['x "y"\nz', "-1.5"], ["str", "num"]), ("Two", 1, ["x"], ["str"])]
    for bad in (b"PK\x03\x04junk", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        with pytest.raises(cells.UnreadableError):
            list(cells.parse(bad))
    assert [cells.column_letters(cells.column_number(x)) for x in ("A", "Z", "AA", "AZ", "BA")] == ["A", "Z", "AA", "AZ", "BA"]


def test_layout_titles_and_catalogs():
    rows = [["Role: Nurse"], ["Security Setting Name", "Description", "Security group Name", "Permission"], ["View", "d", "g", "TRUE"]]
    found = layout.detect_catalog(rows)
    assert (found.kind, found.role, found.permission, found.value) == ("role-list", "Nurse", 0, 3)
    assert layout.is_role_map([["User", "Role"], ["a", "b"]]) == (0, 0, 1)
    with pytest.raises(ValueError):
        layout.detect([["A", "B"], ["1", "2"]], columns={"subject": "Who"})


def test_layout_counts_rows_beyond_the_sample(spark):
    """A blank corner: the orientation is told by all rows, and so is the first column that holds anything."""
    grid = [["", *(f"Nurse {i}" for i in range(60))], *([f"View {k}", *("X" if (k + i) % 3 else "" for i in range(60))] for k in range(400))]
    book = lambda rows: cells.read_bytes(spark, "\n".join(",".join(r) for r in rows).encode(), "a.csv")
    lay = layout.infer(book(grid))
    assert (lay.kind, lay.header_row, lay.permission, lay.users_down) == ("matrix", 1, 0, False)
    assert {x.subject for x in layout.to_records(book(grid), lay).select("subject").distinct().collect()} == {f"Nurse {i}" for i in range(60)}
    assert layout.infer(book(grid[:41])).users_down
    late = [["", *r] for r in grid[:60]] + [["Z", "View 400", *grid[1][1:]]]
    assert layout.infer(book(late)).permission == 0


def band(kind, k, checked=False):
    r = random.Random(k)
    return {"top": None, "bottom": None, "kind": kind, "checked": checked, "cut_top": False, "cut_bottom": False, "fp": [r.randint(10, 250) for _ in range(12)]}


def test_frames_merge_batch_and_stream(spark, tmp_path):
    rows = [band("group" if k % 5 == 0 else "data", k, k % 3 == 0) for k in range(21)]
    shots = [(role, n, rows[a:b]) for role in ("r", "s") for n, (a, b) in enumerate([(0, 8), (5, 13), (10, 18), (15, 21)]) if not (role == "s" and n == 1)]
    df = spark.createDataFrame([(a, b, [tuple(x.values()) for x in c]) for a, b, c in shots], f"role string, frame_no int, bands array<{frames.BAND}>")
    merged = frames.merge_frames(df)
    got = {x.role: (x.n, x.gaps) for x in merged.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.max("gaps").alias("gaps")).collect()}
    assert got == {"r": (21, 0), "s": (8, 2)}
    df.write.parquet(str(tmp_path / "in"))
    stream = frames.stream_merge(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("merged").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("merged").filter("role = 'r'").agg(F.max("pos")).first()[0] == 20
    cat = spark.createDataFrame([(f"s{g}{k}", "", "", f"g{g}", g * 10 + k) for g in range(4) for k in range(4)], "name string, description string, type string, grp string, ord long")
    assigned = frames.assign(merged.filter("role = 'r'"), catalog.catalog(cat)).filter("problem IS NULL")
    assert assigned.count() == 16 and assigned.filter("permission = 'g0 > s02'").first().value == "Y"


def test_same_row(spark):
    df = spark.createDataFrame([([10, 20], [10, 20]), ([0, 0], [0, 0]), ([10, 20], [20, 10])], "a array<int>, b array<int>")
    assert [x[0] for x in df.select(frames.same_row(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_registry():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 35
    assert not [a for a, b in itertools.pairwise(sorted(queries)) if a == b]


def test_names_that_share_keys_meet_and_keys_are_told_once_a_name(spark, monkeypatch):
    plans = []
    kept = compare.cut
    monkeypatch.setattr(compare, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    schema = "subject string, permission string, value string, raw string, ord int, role string, listed_only boolean"
    b = spark.createDataFrame([("Ann", "P > one", "Y", "Y", 2, "", False), ("ann ", "p>One", "N", "N", 3, "boss", False), ("ANN", "P > one", "lead", "Lead", 1, "chief", False), ("Bob", "P > two", "Y", "Y", 4, None, False), ("--", "P > two", "Y", "Y", 5, "", False)], schema)
    a = spark.createDataFrame([("Robert", "P > two", "Y", "Y", 1, "", False), ("aNN", "P > ONE", "Y", "x", 3, "", False), ("Ann", "P > one", "N", "", 2, "", True)], schema)
    aliases = spark.createDataFrame([("subject", "bob", "robert")], "kind string, from_key string, to_key string")
    result = compare.compare(b, a, compare.Options(suggest=False, match_by_name=False, aliases=aliases))
    got = {tuple(r) for r in result.pairs.select("subject", "permission", "role", "type", "expected", "actual", "listed_only").collect()}
    assert got == {("ANN", "p>One", "chief", "excess", "N", "Y (x)", True), ("Bob", "P > two", "", "ok", "Y", "Y", False)}
    assert {tuple(r) for r in result.actual.subjects.select("key", "display", "ord", "listed_only").collect()} == {("ann", "Ann", 2, True), ("robert", "Robert", 1, False)}
    assert "regexp_replace" not in plans[0].lower()  # the aggregate of all records
    plain = compare.compare(b.filter("ord <> 4"), a.filter("ord > 1"), compare.Options(suggest=False, match_by_name=False))
    assert [tuple(r) for r in plain.pairs.select("subject", "permission", "type", "expected").collect()] == [("ANN", "p>One", "excess", "N")]


@pytest.mark.parametrize("shared", [False, True])
def test_lines_of_both_sides_are_read_and_sorted_once(spark, monkeypatch, tmp_path, shared):
    r = random.Random(5)
    names = ["Ann", "Bob", "Cy", "Di", *(["ann ", "BOB"] if shared else [])]
    lines = [(s, f"P > {r.randint(0, 6)}", v, v, i, r.choice(["", "boss", None]), r.random() < 0.5, "b" if s == "Cy" or s != "Di" and r.random() < 0.5 else "a") for i in range(120) for s, v in [(r.choice(names), r.choice(["Y", "N", "view"]))]]
    spark.createDataFrame(lines, "subject string, permission string, value string, raw string, ord int, role string, listed_only boolean, of string").coalesce(1).write.parquet(f"{tmp_path}/lines")
    rows = spark.read.parquet(f"{tmp_path}/lines")
    plans = []
    kept = compare.cut
    monkeypatch.setattr(compare, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    few = compare.compare(rows, None, compare.Options(suggest=False, match_by_name=False, order=False, texts=False, keep=False))
    assert plans[0].count("FileScan") == 1 and "Aggregate" not in plans[0].split("Exchange hashpartitioning(_hash")[1]
    assert sum("b_last" in x and "Aggregate" in x for x in plans) == (4 if shared else 2)  # the records, then their names and texts; again with their order where names share keys
    whole = compare.compare(rows.filter("of = 'b'").drop("of"), rows.filter("of = 'a'").drop("of"), compare.Options(suggest=False, match_by_name=False))
    columns = ["subject", "permission", "role", "type", "severity", "listed_only", "has_baseline", "b_value", "a_value", "a_row"]
    assert sorted(map(str, few.pairs.select(columns).collect())) == sorted(map(str, whole.pairs.select(columns).collect())) and few.findings is None
    told = rollup.by_permission(few.pairs)
    if not shared:
        assert "Union" not in told._jdf.queryExecution().optimizedPlan().toString()  # pairs are read once
    kinds = ["ok", "excess", "missing", "different"]
    singles = rollup.single_rows(whole.pairs).filter("permission <> ''").groupBy("permission").agg(*(F.count_if(F.col("type") == t).alias(t) for t in kinds), F.count_if(~F.col("type").isin(kinds)).alias("other"))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, singles.filter("excess + missing + different + other > 0").collect()))
    both = compare.compare(rows, None, compare.Options(suggest=False, match_by_name=False))
    assert sorted(map(str, both.findings.collect())) == sorted(map(str, whole.findings.collect()))


def test_pairs_hold_what_findings_read_and_no_more(spark):
    base = side(spark, [("a", "p1", "Y")])
    actual = side(spark, [("a", "p1", "Y"), ("new", "p3", "Y"), ("new", "p1", "Y"), ("new", "p2", "N"), ("new", "p0", "Y")])
    rows = base.withColumn("of", F.lit("b")).unionByName(actual.withColumn("of", F.lit("a")))
    for result in (compare.compare(base, actual, compare.Options(suggest=False)), compare.compare(rows, None, compare.Options(suggest=False))):
        assert not {"b_ord", *(f"{s}_{c}" for s in "ba" for c in ("permission", "role"))} & set(result.pairs.columns)
        found = result.findings.collect()
        assert [(x.subject, x.actual, x.note) for x in found] == [("new", "4 settings (3 granted)", "nobody has reviewed what this subject holds: p3; p1; p0")]


def test_code_of_findings_is_small_enough_to_be_compiled(spark):
    """Java's virtual machine leaves methods of more than 8,000 bytes to its interpreter."""
    import re

    rows = side(spark, [("a", "p1", "Y"), ("b", "p1", "N")]).withColumn("of", F.lit("b")).unionByName(side(spark, [("a", "p1", "N"), ("b", "p2", "x")]).withColumn("of", F.lit("a")))
    found = compare.compare(rows, None, compare.Options(suggest=False, keep=False)).findings
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # whose plans have no code before they run
    try:
        text = spark._jvm.PythonSQLUtils.explainString(found.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000, sizes
    kinds = {(x.subject, x.permission): x.type for x in found.collect()}
    assert kinds == {("a", "p1"): "missing", ("b", "p2"): "permission-not-in-baseline"} | {k: t for k, t in kinds.items() if k == ("b", "p1")}
