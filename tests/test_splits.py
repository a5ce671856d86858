"""Files in parts: delimited files by byte ranges, workbooks by sheets, filters that the source takes, carrying in ranges."""

import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import records
from ledgerlens.sources import cells, sinks, splits


def messy(seed, n=400):
    """Rows with quoted line ends of all kinds, doubled and stray quotes, blank lines, quoted blanks, and letters of several bytes."""
    r = random.Random(seed)
    odd = ['"a\nb"', '"c\r\nd ""e"" f"', '"\r"', '""', '" \n "', 'x"y', 'é', "1.5", "", '"q, \n""', "ﬁ z", '"ends"x']
    ends = ["\n", "\r\n", "\r"]
    out = ["﻿Name,Value" + r.choice(ends)]
    for _ in range(n):
        out.append(r.choice(["", "  ", ",,", '" "'] if r.random() < 0.1 else [",".join(r.choice([*odd, "word"]) for _ in range(r.randint(1, 4)))]) + r.choice(ends))
    return "".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_agree_with_the_whole(seed):
    """Whatever the ranges, following the states from the first on gives every row once, numbered as in one pass."""
    text = messy(seed) + ('"open to the end\nof file' if seed == 5 else "")
    data = text.encode()
    whole = [[x for x, _ in row] for row in cells.parse_delimited(data.decode("utf-8-sig", "replace"))]
    for size in (1, 3, 17, 100, 1000, len(data) + 5):
        f = io.BytesIO(data)
        state, got, counted = False, [], 0
        for start in range(0, len(data), size):
            a, b = splits.line_begin(f, start), splits.line_begin(f, min(start + size, len(data)))
            if a < b:
                kept, after = splits.survey(f, a, b, state, ",")
                rows = [[x for x, _ in cells.as_cells(row)] for row, _ in splits.rows_from(f, a, b, state, ",") if any(x.strip() for x in row)]
                assert len(rows) == kept
                got, counted, state = got + rows, counted + kept, after
        assert got == whole and counted == len(whole), (seed, size)


def test_large_files_by_ranges_and_sheets(spark, tmp_path):
    text = messy(9, 300)
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.tsv").write_bytes(b"x\ty\n1\t2\n")
    (tmp_path / "c.xlsx").write_bytes(sinks.workbook([sinks.Sheet(n, [[n, "v"], *([k, "w"] for k in range(50))]) for n in ("One", "Two", "Three")]))
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(cells.read_cells(spark, str(tmp_path)))
    for split in (700, 2000):
        df = cells.read_cells(spark, str(tmp_path), split_bytes=split)
        assert rows(df) == whole and df.rdd.getNumPartitions() > 4
    assert {x[1] for x in rows(cells.read_cells(spark, str(tmp_path), sheet="two", split_bytes=700))} == {"Two", "Sheet1"}  # delimited files have no sheets to choose from


def test_filters_reach_the_source(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.xlsx").write_bytes(sinks.workbook([sinks.Sheet(n, [[n, name]]) for n in ("One", "Two")]))
    (tmp_path / "damaged.xlsx").write_bytes(b"PK not an archive")
    df = cells.read_cells(spark, str(tmp_path), split_bytes=10)
    held = df.filter((F.col("file") == str(tmp_path / "a.xlsx")) & (F.col("sheet") == "Two") & (F.col("row") > 0))
    assert [x.cells for x in held.collect()] == [["Two", "a"]]  # the damaged file is never opened
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Two" not in plan and "row#" in plan  # the source has taken the sheet, Spark is left with the row
    assert held.rdd.getNumPartitions() <= 2
    assert [x.cells[1] for x in df.filter(F.col("sheet").isin("Two", "None") & F.col("file").endswith("b.xlsx") & (F.col("file") != str(tmp_path / "damaged.xlsx")) & F.col("file").isin(str(tmp_path / "b.xlsx"))).collect()] == ["b"]


def test_filters_of_one_use_dont_reach_another(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sinks.workbook([sinks.Sheet(n, [[n]]) for n in ("One", "Two", "Three")]))
    for split in (10, 1 << 20):
        df = cells.read_cells(spark, str(tmp_path), split_bytes=split)
        assert df.filter("sheet = 'One'").count() == 1 and df.count() == 3
        both = df.filter("sheet = 'One'").unionByName(df.filter("sheet = 'Two'"))
        assert sorted(x.sheet for x in both.collect()) == ["One", "Two"]


def test_findings_are_read_back_whatever_their_notes_say(spark, tmp_path):
    note = "nobody has reviewed what this subject holds: " + "; ".join(f"p{k}" for k in range(8)) + "; ..."
    rows = [("high", "user-not-in-baseline", f"s{k}", "", "", "9 settings (9 granted)", note, None, None) for k in range(6)]
    found = spark.createDataFrame(rows, "severity string, type string, subject string, permission string, expected string, actual string, note string, baseline_row int, actual_row int")
    sinks.write_findings(found, str(tmp_path), parts=2)
    held = cells.read_cells(spark, f"{tmp_path}/parts/part-*", delimiter=",")
    assert sorted(x.cells[2] for x in held.collect()) == [f"s{k}" for k in range(6)]
    ranges = cells.read_cells(spark, f"{tmp_path}/parts/part-*", delimiter=",", split_bytes=150)
    assert sorted(x.cells[2] for x in ranges.collect()) == [f"s{k}" for k in range(6)]


def test_tasks_dont_grow_with_the_number_of_ranges(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"{k},x\n" for k in range(4000)))
    df = cells.read_cells(spark, f"{tmp_path}/a.csv", split_bytes=50)
    assert df.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    assert sorted((x.row, int(x.cells[0])) for x in df.collect()) == [(k + 1, k) for k in range(4000)]


def sheet_of(spark, n, seed=1, sheets=2):
    r = random.Random(seed)
    rows = [("f", s, k, r.choice(["", "", "", f"v{r.randint(0, 99)}"]) if k > 3 else "") for s in range(sheets) for k in range(n)]
    return spark.createDataFrame(rows, "file string, sheet_no int, row int, cell string").repartition(7)


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_carrying_in_ranges_equals_the_window(spark, ranges):
    df = sheet_of(spark, 700)
    key = lambda x: (x.sheet_no, x.row, x.cell or "", x.out or "")
    whole = sorted(map(key, records.carry_forward(df, "cell", ["file", "sheet_no"], ["row"], "out").collect()))
    assert sorted(map(key, records.carry_forward(df, "cell", ["file", "sheet_no"], ["row"], "out", ranges=ranges).collect())) == whole
    empty = records.carry_forward(df.limit(0), "cell", ["file", "sheet_no"], ["row"], ranges=ranges)
    assert empty.count() == 0 and empty.columns == df.columns


def test_a_large_sheet_is_carried_by_several_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("f").alias("file"), F.lit(0).alias("sheet_no"), F.col("id").cast("int").alias("row"), F.when(F.col("id") % 50_000 == 7, F.concat(F.lit("v"), "id")).otherwise("").alias("cell"))
    out = records.carry_forward(df, "cell", ["file", "sheet_no"], ["row"], ranges=8)
    wrong = out.filter(F.coalesce("cell", F.lit("")) != F.when(F.col("row") < 7, "").otherwise(F.concat(F.lit("v"), (F.floor((F.col("row") - 7) / 50_000) * 50_000 + 7).cast("string"))))
    assert wrong.count() == 0 and out.count() == n


@pytest.mark.parametrize("parts", [1, 5])
def test_findings_in_parts_have_the_bytes_of_the_whole(spark, tmp_path, parts):
    import json

    from ledgerlens.operators import compare

    r = random.Random(3)
    names = ["plain", 'with "quotes"', "comma, here", "line\nend", "Ümlaut", ""]
    rows = [(r.choice(["high", "low", "info", "medium"]), "excess", f"s{k % 17}", f"p{k}", r.choice(names), r.choice(names), r.choice(names), k if k % 3 else None, None) for k in range(300)]
    found = spark.createDataFrame(rows, "severity string, type string, subject string, permission string, expected string, actual string, note string, baseline_row int, actual_row int").repartition(4)
    files = sinks.write_findings(found, str(tmp_path / "csv"), parts=parts)
    whole = b"".join((tmp_path / "csv" / f).read_bytes() for f in files)
    assert whole == sinks.findings_csv(compare.ordered(found)).encode() and json.loads((tmp_path / "csv" / "manifest.json").read_text()) == files
    lines = [json.loads(x) for f in sinks.write_findings(found, str(tmp_path / "json"), "json", parts) for x in (tmp_path / "json" / f).read_text().splitlines()]
    assert [x["permission"] for x in lines] == [x.permission for x in compare.ordered(found).collect()]


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_findings_are_computed_once_and_ordered_by_numbers(spark, tmp_path, kind):
    import json
    import os

    from ledgerlens.operators import compare

    r = random.Random(5)
    subjects, permissions = ["caf\u00e9", "cafe\u0301", "Caf\u00e9", "cafe", "zoe", "Ann", "ann", ""], ["\u00e9 > b", "e\u0301 > b", "E > b", "a", "B", "10", "9", ""]
    rows = [(level, "excess", s, p, "", "", "", None, None) for s in subjects for p in permissions for level in ("high", "low")] + [("high", "excess", None, "a", "", "", "", None, None)]
    r.shuffle(rows)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = spark.createDataFrame(rows, "severity string, type string, subject string, permission string, expected string, actual string, note string, baseline_row int, actual_row int").repartition(3)
    wanted = [(x.severity, x.subject, x.permission) for x in compare.ordered(found).collect()]
    files = sinks.write_findings(found.mapInArrow(counted, found.schema), str(tmp_path), kind, parts=3)
    assert seen.value == len(rows)  # for the names, the bounds of the ranges and the rows
    held, order = compare.with_order(found)
    assert [(x.severity, x.subject, x.permission) for x in held.orderBy(*order).collect()] == wanted
    if kind == "json":
        lines = [json.loads(x) for f in files for x in (tmp_path / f).read_text().split("\n") if x]
        assert [(x["severity"], x.get("subject"), x["permission"]) for x in lines] == wanted
    assert not os.path.exists(tmp_path / "found")
