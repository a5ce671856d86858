"""Nearest names by filters against all pairs, total order by ranges, columns and headers that were misread before."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import compare, match, order, records
from ledgerlens.sources import layout, sinks

from .test_engine import plain_similarity


def key(x):
    return re.sub("[^a-z0-9]+", " ", x.lower()).strip()


def score(name, candidate, display):
    near = lambda a, b: abs(len(a) - len(b)) if max(len(a), len(b)) > 200 else None

    def similar(a, b):
        if a == b or near(a, b) is None:
            return plain_similarity(a, b)
        ta, tb = set(a.split(" ")), set(b.split(" "))
        edits = 1 - near(a, b) / max(len(a), len(b))
        return max(len(ta & tb) / len(ta | tb) * 0.6 + edits * 0.4, edits, 0.9 if len(ta) > 1 and ta <= tb else 0)

    bare = [key(re.sub(r"(?s)\(.*$", "", x)) for x in (name, display)]
    return max(similar(name, candidate), similar(name.split(" > ")[-1], candidate.split(" > ")[-1]) * 0.95, similar(*bare) * 0.97 if all(bare) else 0)


def pool(seed, n):
    """Names of one to nine words with categories, parentheses, repeated letters, one letter, and over 200 characters."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aaabcdeilnorst") for _ in range(r.randint(1, 7)))
    out = ["a", "b", "aa", "aaaa", "aaaaa", "ab ab ab", "x y", "y x z"]
    for _ in range(n):
        name = " ".join(word() for _ in range(r.choice([1, 1, 2, 3, 5, 9])))
        out.append(name if r.random() < 0.6 else f"{word()} > {name}")
    out += [" ".join(["the"] * 60), " ".join(["of"] * 80), "q" * 180]
    return sorted(set(out))


def changed(r, name):
    at = r.randrange(len(name))
    return re.sub(" +", " ", r.choice([name[:at] + name[at + 1 :], name[:at] + r.choice("abcz") + name[at:], " ".join(reversed(name.split(" "))), name + " old", name[: 1 + at]])).strip() or "a"


@pytest.mark.parametrize(("threshold", "block"), [(0.5, 20_000), (0.6, 7), (0.72, 20_000), (0.72, 3), (0.85, 20_000), (0.95, 20_000)])
def test_closest_equals_all_pairs(spark, threshold, block):
    r = random.Random(int(threshold * 100))
    held = [(k, k if r.random() < 0.7 else f"{k} (Note {r.randint(1, 9)})", i) for i, k in enumerate(pool(3, 110))]
    wanted = sorted({changed(r, changed(r, k)) for k, _, _ in held} | set(pool(4, 30)))
    candidates = spark.createDataFrame(held, "key string, display string, ord long").repartition(3)
    got = {x.key: (x.suggested_key, x.score) for x in match.closest(spark.createDataFrame([(x,) for x in wanted], "key string"), candidates, threshold, block=block).collect()}
    for name in wanted:
        best, most = None, threshold
        for k, display, _ in held:
            s = score(name, k, display)
            if s > most + 1e-12:
                best, most = k, s
        assert got.get(name, (None,))[0] == best, (name, best, most, got.get(name))
        assert best is None or abs(got[name][1] - most) <= 0.005 + 1e-9


def test_closest_limits(spark):
    names, candidates = spark.createDataFrame([("a b",)], "key string"), spark.createDataFrame([("a b", "A b", 1)], "key string, display string, ord long")
    assert match.closest(names, candidates).collect()[0].suggestion == "A b"
    assert match.closest(names.limit(0), candidates).count() == 0 and match.closest(names, candidates.limit(0)).count() == 0
    for threshold in (0.4, 1.0):
        with pytest.raises(ValueError):
            match.closest(names, candidates, threshold)


def test_closest_pairs_few_names_of_one_kind(spark):
    """Names that share their commonest words are told apart by their rare ones before any pair is scored."""
    names = spark.range(3000).select(F.format_string("security setting number %05d", "id").alias("key"))
    candidates = names.select("key", F.col("key").alias("display"), F.col("key").alias("ord"))
    asked = names.limit(200).select(F.concat("key", F.lit("x")).alias("key"))
    found = match.closest(asked, candidates, 0.9)
    assert found.filter("suggested_key || 'x' = key").count() == 200


@pytest.mark.parametrize("parts", [1, 7])
def test_placed_equals_a_sort(spark, parts):
    r = random.Random(2)
    rows = [(r.choice("aAbBcC") + r.choice(["", "#", " "]) + str(r.randint(0, 9)), r.randint(0, 3), k) for k in range(500)]
    df = spark.createDataFrame(rows, "name string, n int, k long").repartition(5)
    by = [F.col("n").desc(), *order.dictionary("name"), F.col("k")]
    got = {x.place: (x.name, x.n, x.k) for x in order.placed(df, by, parts=parts).collect()}
    assert [got[i] for i in range(500)] == [(x.name, x.n, x.k) for x in df.orderBy(*by).collect()]
    assert order.placed(df.limit(0), by, parts=parts).count() == 0
    assert [x[0] for x in order.placed(spark.createDataFrame([("zoe",), ("Ann",), ("ann",), ("Bob",)], "name string"), order.dictionary("name")).orderBy("place").collect()] == ["ann", "Ann", "Bob", "zoe"]


def test_placed_needs_no_single_task(spark):
    plan = order.placed(spark.range(100).withColumn("name", F.col("id").cast("string")), order.dictionary("name"), parts=4)
    text = plan._jdf.queryExecution().toString()
    assert "Window" not in text and "SinglePartition" not in text


def grid(spark, rows):
    return spark.createDataFrame([("f", "s", 0, i, r, ["str"] * len(r)) for i, r in enumerate(rows, 1)], "file string, sheet string, sheet_no int, row int, cells array<string>, kinds array<string>")


def test_columns_go_only_if_asked(spark):
    heads = ["Security Setting", "Admin", "Support - do not validate", "SUPPORT-DONT NEED TO VALIDATE", "Nurse"]
    cells = grid(spark, [heads, ["Run", "X", "X", "X", "X"]])
    assert sorted(x.subject for x in records.matrix_records(cells, 1, heads, 0, 1).collect()) == sorted(heads[1:])
    assert sorted(x.subject for x in records.matrix_records(cells, 1, heads, 0, 1, ignore="*validate*").collect()) == ["Admin", "Nurse"]
    lay = layout.Layout("matrix", 1, tuple(heads), permission=0, first_data=1)
    notes = {x.code: x.sample for x in records.read_notes(cells, lay).collect()}
    assert notes["column not to be validated"] == sorted(heads[2:4])


@pytest.mark.parametrize("heads", [["Security Attribute", "Attribute Description", "Attribute Type", "Module"], ["Item Name", "Details", "Section"], ["Permission Name", "Help", "Group"], ["Attribute", "What it does", "Category", "Granted"]])
def test_catalog_headers(heads):
    found = layout.detect_catalog([heads, ["Lock chart", "Locks it", "Charts", "Charts"][: len(heads)]])
    assert found is not None and found.permission == 0 and found.kind == ("role-list" if "Granted" in heads else "catalog")


def test_detail_in_dictionary_order(spark):
    rows = [("zoe", "Walk", "Y"), ("Ann", "run", "Y"), ("ann b", "Walk", "N"), ("zoe", "Run", "N")]
    side = spark.createDataFrame([(s, p, v, v, i, i) for i, (s, p, v) in enumerate(rows)], "subject string, permission string, value string, raw string, row int, ord long")
    result = compare.compare(side, side.filter("subject <> 'zoe'"), compare.Options(suggest=False))
    assert [(x.subject, x.permission) for x in compare.detail(result).collect()] == [("Ann", "run"), ("ann b", "Walk"), ("zoe", "Run"), ("zoe", "Walk")]


def test_template_takes_groups_by_key(spark):
    rows = spark.createDataFrame([("Beta", "one", "d"), ("alpha", "two", "d"), ("Gamma ", "three", "d")], "grp string, name string, description string")
    sheets = sinks.template(rows, groups=["ALPHA", "gamma"])
    assert [r[:2] for r in sheets[0].rows[1:]] == [["alpha", "two"], ["Gamma ", "three"]] and sheets[0].rows[0][3:] == list(sinks.TEMPLATE_ROLES)
    assert sheets[1].rows == [["User", "Role"], ["", "Provider"]]


def test_a_setting_twice_is_noted_once(spark):
    heads = ["Security Setting", "Admin", "Support", "Nurse"]
    cells = grid(spark, [heads, ["Run", "X", "X", ""], ["Walk", "X", "X", "X"], ["run", "", "X", ""], ["Walk", "X", "X", "X"]])
    note = next(x for x in records.read_notes(cells, layout.Layout("matrix", 1, tuple(heads), permission=0, first_data=1)).collect() if x.code == "duplicate")
    assert note.n == 2 and note.sample == ["run rows 2/4 (copies disagree)", "walk rows 3/5"]


def test_side_by_side_in_tiles(spark):
    from ledgerlens.operators import inventory

    n = 700
    pairs = spark.range(n * 3).select(F.concat(F.lit("s"), F.col("id") % n).alias("subject"), F.concat(F.lit("p"), F.col("id") % 3).alias("permission"), F.lit("ok").alias("type"), F.lit("Y").alias("expected"), F.lit("Y (x)").alias("actual"))
    tiles = inventory.side_by_side_tiles(pairs, 100).collect()
    assert len(tiles) == 21 and all(len(x.cells) == 100 and list(x.cells) == sorted(x.cells) for x in tiles)
    cells = {(x.permission, c.subject): c.cell for x in tiles for c in x.cells}
    assert len(cells) == 3 * n and set(cells.values()) == {"Y"}
    assert len({frozenset(c.subject for c in x.cells) for x in tiles}) == 7


def test_summary_pages_are_those_of_the_document(spark):
    rows = [(f"s{k % 5}", f"p{k % 7}", "Y" if k % 3 else "N", "", k) for k in range(35)]
    side = spark.createDataFrame(rows, "subject string, permission string, value string, raw string, ord long")
    other = side.withColumn("value", F.when(F.col("ord") % 4 == 0, "N").otherwise("Y")).filter("subject <> 's4'")
    result = compare.compare(side, other, compare.Options(suggest=False))
    pages = {x.name: (x.role, x.status, [(g["kind"], list(g["items"])) for g in x.groups]) for x in sinks.summary_pages(result).collect()}
    assert pages == {p["name"]: (p["role"], p["status"], [(g["kind"], [i["text"] for i in g["items"]]) for g in p["groups"]]) for p in sinks.summary_document(result)["subjects"]}
