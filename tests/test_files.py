"""Whole files: a sample of a baseline with users and an export, round trips, sheets told apart, loaders, captured screens, reports."""

import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import catalog, compare, inventory, records, rollup
from ledgerlens.sources import books, cells, images, layout, sinks
from ledgerlens.sources.samples import ROLES, USERS, sample
from ledgerlens.streaming import frames

@pytest.fixture(scope="module")
def compared(spark):
    baseline, export, listed = sample()
    b, a = (books.read(cells.read_bytes(spark, x, n)) for x, n in ((baseline, "baseline.xlsx"), (export, "export.xlsx")))
    cat = books.catalog(cells.read_bytes(spark, listed, "catalog.xlsx"))
    return b, a, cat, compare.compare(b.records, a.records)


def test_sample(compared):
    b, a, cat, result = compared
    assert b.expanded and [(x.kind, s) for (_, s), x in b.layouts.items()] == [("matrix", "Permissions")] and a.records.count() == 332
    assert b.records.filter("description = 'About Charts task a'").count() == 9
    counts = {x.severity: x.n for x in rollup.counts_by_severity(result.findings).collect()}
    assert counts == {"high": 3, "medium": 4, "low": 2, "info": 6}
    assert rollup.verdict(result.pairs, result.findings).first().compared == 288
    sizes = {x.kind: tuple(x)[1:] for x in rollup.sizes(result.baseline, result.actual).collect()}
    assert sizes == {"subject": (9, 9, 8), "permission": (36, 37, 36)}
    assert {x.subject_role for x in result.baseline.subjects.select(F.col("role").alias("subject_role")).collect()} == set(ROLES)
    covered = catalog.coverage(cat, result.baseline.permissions.select("display"), result.actual.records)
    assert covered.count() == 56 and covered.filter("in_baseline").count() == 36
    assert [(x.name, x.granted_to) for x in covered.filter("NOT in_baseline AND granted_to > 0").collect()] == [("Blast message", 2)]
    first = [x.subject for x in compare.detail(result).collect()]
    assert list(dict.fromkeys(first)) == sorted([*USERS, "TEMP 1"], key=str.lower) and len(first) == result.pairs.count()


def test_reports_of_the_sample(spark, compared, tmp_path):
    b, a, cat, result = compared
    sheets = {s.name: s for s in sinks.report(result, catalog=cat, warnings=["w1"])}
    assert list(sheets) == ["Summary", "Actions", "Findings", "Side by side", "Subjects", "Settings", "Matches", "Coverage", "Not in catalog"]
    assert len(sheets["Findings"].rows) == 16 and sheets["Findings"].colours[(1, 0)] == "red" and len(sheets["Coverage"].rows) == 57 and len(sheets["Not in catalog"].rows) == 1
    beside = sheets["Side by side"]
    assert len(beside.rows) == 2 + 37 and beside.rows[1][1:].count("both") == 8 and "system" in beside.rows[1] and "baseline" in beside.rows[1]
    assert sorted(x for r in beside.rows[2:] for x in r[1:] if x in ("N → Y", "N (blank) → Y", "Y → N")) == ["N → Y"] * 2 + ["Y → N"] * 2
    path = tmp_path / "out.xlsx"
    sinks.write(str(path), result)
    back = {s: [x.cells for x in rows] for s, rows in ((n, cells.read_cells(spark, str(path), n).orderBy("row").collect()) for n in ("Findings", "Side by side"))}
    assert len(back["Findings"]) == 16 and back["Findings"][0][:4] == ["severity", "type", "subject", "permission"]
    text = sinks.text_summary(result, books={"baseline": b, "system": a}, catalog=cat)
    assert text.startswith("FAIL: 288 pairs compared; worst finding: high") and "catalog: 36 of 56" in text and "baseline.xlsx [Permissions; matrix]" in text
    assert "    REMOVE  " in text and "    GRANT  " in text and "  findings: 3 high, 4 medium, 2 low, 6 info" in text and "2 pairs of settings that only one side has (low): " in text
    summary = [r[0] for r in sheets["Summary"].rows if r]
    assert "pairs that match" in summary and "names paired" in summary and "How" not in summary and "Findings" in summary
    assert ["baseline", "permission", "subject"] == sorted({"baseline", *(r[0] for r in sheets["Summary"].rows if r and r[0] in ("permission", "subject"))})
    page = sinks.summary_document(result, catalog=cat)
    assert any(i["description"] for p in page["subjects"] for g in p["groups"] for i in g["items"]) and all(i["text"] for p in page["subjects"] for g in p["groups"] for i in g["items"])
    assert page["verdict"]["passed"] is False and [p["name"] for p in page["subjects"] if p["status"]] == ["Quin Rost", "TEMP 1"] and page["matched"] == ["Gus Hall", "Ola Pratt"]
    listed = {s.name: s for s in sinks.inventory_workbook(a.records, a, cat)}
    assert list(listed) == ["Matrix", "Subjects", "Settings", "Source"] and len(listed["Matrix"].rows) == 57 and len(listed["Subjects"].rows) == 10
    blast = next(r for r in listed["Settings"].rows if r[1] == "Blast message")
    assert blast[0] == "Messages" and blast[3:] == [2, "ANN BELL, CY DORN"]
    made = {s.name: s for s in sinks.template(cat, ["R1"])}
    assert list(made) == ["Permissions", "Users", "How to"] and len(made["Permissions"].rows) == 57
    assert set(inventory.documented_list(a.records, None).columns) >= {"grp", "held_by"}


def test_round_trip_of_roles(spark, tmp_path):
    """12 roles by 80 settings, exported one file a role: nothing differs; then one grant less, one more, one role gone."""
    r = random.Random(7)
    names = [(f"Group {k % 5}", f"Setting {k}" + (" > with arrow" if k % 9 == 0 else "")) for k in range(80)]
    roles = [f"Role {k}" for k in range(12)]
    grants = {(a, k): r.random() < 0.45 for a in roles for k in range(80)}
    mark = lambda a, k: "X (added 1/2)" if (a, k) == (roles[0], 3) else "X" if grants[a, k] else ""
    grants[roles[0], 3] = True
    grid = [["Security Setting", "Group", *roles], *([s, g, *(mark(a, k) for a in roles)] for k, (g, s) in enumerate(names))]
    grid.append(grid[1])
    baseline = books.read(cells.read_bytes(spark, sinks.workbook([sinks.Sheet("m", grid)]), "m.xlsx")).records

    def exports(name, changed, gone=()):
        folder = tmp_path / name
        folder.mkdir()
        for a in roles:
            if a not in gone:
                rows = [["Security Setting Name", "Security Setting Description", "Security Setting Type", "Security group Name", "Permission"], *([s, "d", "Old", g, "TRUE" if grants[a, k] != ((a, k) in changed) else "FALSE"] for k, (g, s) in enumerate(names))]
                (folder / f"{a}.xlsx").write_bytes(sinks.workbook([sinks.Sheet("Sheet1", rows)]))
        book = books.read(cells.read_cells(spark, str(folder)), roles_by_name=True)
        assert len(book.layouts) == 12 - len(gone)
        return compare.compare(baseline, book.records)

    same = exports("same", ())
    row = rollup.verdict(same.pairs, same.findings).first()
    assert (row.compared, row.passed) == (960, True) and {x.type for x in same.pairs.select("type").distinct().collect()} == {"ok"}
    less, more = (next(k for k in range(80) if grants[a, k] == g) for a, g in ((roles[3], True), (roles[7], False)))
    other = exports("other", {(roles[3], less), (roles[7], more)}, {roles[11]})
    assert sorted(x.type for x in other.findings.filter("severity <> 'info'").collect()) == ["excess", "missing", "user-not-in-actual"]


def book_of(spark, sheets, name="b.xlsx"):
    return cells.read_bytes(spark, sinks.workbook([sinks.Sheet(n, rows, freeze=0) for n, rows in sheets.items()]), name)


def test_sheets_are_told_apart(spark):
    sheets = {"Read me": [["About this file"], ["It has two grids"]], "One": [["Setting", "A", "B"], ["Run", "Y", ""], ["Stop", "", "x"]], "Two": [["User", "Setting", "Value"], ["C", "Run", "Y"]], "Notes": [["Setting", "A"]]}
    held = book_of(spark, sheets)
    first = books.read(held)
    rows = lambda b: sorted((x.subject, x.permission, x.value, x.sheet) for x in b.records.collect())
    grid = [("A", "Run", "Y", "One"), ("A", "Stop", "N", "One"), ("B", "Run", "N", "One"), ("B", "Stop", "Y", "One")]
    assert rows(first) == grid and any("Two" in w for w in first.warnings) and ("b.xlsx", "Read me") in first.ignored
    assert rows(books.read(held, sheet="all")) == sorted([*grid, ("C", "Run", "Y", "Two")])
    assert rows(books.read(held, sheet="two")) == [("C", "Run", "Y", "Two")]
    with pytest.raises(ValueError, match="its sheets"):
        books.read(held, sheet="Three")
    with pytest.raises(ValueError):
        books.read(book_of(spark, {"Empty": [["Setting", "A"]]}))


def test_roles_of_files_and_sheets(spark):
    head = ["Security Setting Name", "Security Setting Description", "Security group Name", "Permission"]
    two = book_of(spark, {"Nurse": [head, ["Run", "d", "G", "TRUE"]], "Clerk": [head, ["Run", "d", "G", "FALSE"], ["Stop", "d", "Stop", "TRUE"]]})
    assert sorted((x.subject, x.permission, x.value, x.listed_only) for x in books.read(two).records.collect()) == [("Clerk", "G > Run", "N", False), ("Clerk", "Stop", "Y", False), ("Nurse", "G > Run", "Y", False)]
    short = [head[:3], ["Run", "d", "G"]]
    listed = books.read(book_of(spark, {"Sheet1": short}), role="Nurse")
    assert [(x.subject, x.role, x.value, x.listed_only) for x in listed.records.collect()] == [("Nurse", "Nurse", "Y", True)] and listed.warnings
    with pytest.raises(ValueError, match="catalog"):
        books.read(book_of(spark, {"Sheet1": short}))
    with pytest.raises(ValueError, match="whose"):
        books.read(book_of(spark, {"Sheet1": [head, ["Run", "d", "G", "TRUE"]]}))
    same = book_of(spark, {"Sheet1": short}, "x/one.xlsx").unionByName(book_of(spark, {"Sheet1": short}, "y/one.xlsx"))
    assert any("several files" in w for w in books.read(same, roles_by_name=True).warnings)
    for title, role in (("Security Settings — Front Desk", "Front Desk"), ("Security role: X", "X"), ("Role - Y", "Y"), ("Role name – Z", "Z"), ("Security settings", None), ("Roles: W", None)):
        assert layout.role_from_title([[title]]) == role, title


def test_loaders(spark):
    text = "kind,baseline,system\nuser,Ann B,ABELL\nsettings,Old > Name,New > Name\nRun it,Run\nuser,Ann B,ANNB\nlone\nFrom here,x,y\n"
    found = [(x.kind, x.from_key, x.to_key) for x in books.aliases(cells.read_bytes(spark, text.encode(), "a.csv")).orderBy("ord").collect()]
    assert found == [("subject", "ann b", "abell"), ("permission", "old > name", "new > name"), ("permission", "run it", "run"), ("subject", "ann b", "annb"), ("permission", "from here", "x")]
    users = books.users(cells.read_bytes(spark, b"User,Role\nann,Nurse\nbob,Clerk\nANN,Clerk\n", "u.csv"))
    assert sorted((x.user, x.role) for x in users.collect()) == [("ANN", "Clerk"), ("bob", "Clerk")]
    with pytest.raises(ValueError):
        books.users(cells.read_bytes(spark, b"A,B\n1,2\n", "u.csv"))
    grid = cells.read_bytes(spark, b"Setting,Nurse,Clerk,Boss\nRun,Y,,\nStop,,Y,Y\n", "m.csv")
    read = books.read(grid, users=users)
    assert read.expanded and sorted({(x.subject, x.role) for x in read.records.collect()}, key=str) == [("ANN", "Clerk"), ("Boss", None), ("Nurse", None), ("bob", "Clerk")]
    base = spark.createDataFrame([("Ann B", "Run", "Y", 1)], "subject string, permission string, value string, ord int")
    actual = spark.createDataFrame([("annb", "Run", "Y", 1)], "subject string, permission string, value string, ord int")
    pairs = [(x.from_key, x.to_key) for x in [("ann b", "zed"), ("ann b", "annb")] for x in [spark.createDataFrame([x], "from_key string, to_key string").first()]]
    aliases = spark.createDataFrame([("subject", a, b, k) for k, (a, b) in enumerate(pairs)], "kind string, from_key string, to_key string, ord int")
    assert [x.type for x in compare.compare(base, actual, compare.Options(aliases=aliases)).pairs.collect()] == ["ok"]


def test_inspection(spark):
    sheets = {"Read me": [["About"]], "Grid": [["Setting", "Nurse", "Clerk"], ["Run", "Y", ""], ["Stop", "view", "x"]]}
    seen = books.inspect(book_of(spark, sheets))
    assert [(s["sheet"], s["rows"], s["header_row"], s["headers"]) for s in seen.sheets] == [("Read me", 1, 1, ["About"]), ("Grid", 3, 1, ["Setting", "Nurse", "Clerk"])]
    assert seen.error is None and {x.value: x.n for x in seen.values.collect()} == {"Y": 2, "N": 1, "view": 1} and seen.subjects.count() == 2 and seen.settings.count() == 2
    bad = books.inspect(book_of(spark, {"S": [["Security Setting Name", "Description", "Security group Name"], ["Run", "d", "G"]]}))
    assert bad.kind == "catalog" and "catalog" in bad.error and len(bad.sheets) == 1


def test_role_words(spark):
    names = ["RN pool", "MA", "LVN float", "PSR", "IT analyst", "Supervisor", "Zed"]
    row = records.looks_like_roles(spark.createDataFrame([(n,) for n in names], "subject string")).first()
    assert row.looks_like_roles and round(row.share * 7) == 6


# ---- screens -----------------------------------------------------------------------------------

WIDTH, LEFT, RIGHT, BOX = 900, 40, 880, 820


def painted(rows, seed=0):
    """A whole list as an image: rows are (kind, height, checked, name)."""
    parts = []
    for n, (kind, height, checked, name) in enumerate(rows):
        part = np.full((height, WIDTH, 3), 240, np.uint8)
        part[:, LEFT:RIGHT] = {"header": (232, 214, 180), "group": (255, 255, 255), "data": (255, 255, 255) if n % 2 else (252, 244, 228)}[kind]
        part[0, LEFT:RIGHT] = 200
        letters = np.random.default_rng(sum(map(ord, name)) * 31 + len(name) + seed)
        for x in np.flatnonzero(letters.random(60) < 0.5):
            part[height // 2 - 4 : height // 2 + 4, LEFT + 40 + 6 * x : LEFT + 44 + 6 * x] = 30
        if kind == "group":
            part[height // 2 - 5 : height // 2 + 5, LEFT + 6 : LEFT + 18] = (240, 140, 30)
        if kind == "data":
            at = height // 2 - 7
            box = part[at : at + 14, BOX : BOX + 14]
            box[:] = (40, 110, 230) if checked else (252, 252, 252)
            if not checked:
                box[[0, -1]] = box[:, [0, -1]] = 120
        parts.append(part)
    return np.concatenate(parts)


CATALOG = [(f"group {g}", f"setting {g}-{k}") for g in range(4) for k in range(3 + g)]


def screen():
    rows = []
    for g in range(4):
        rows += [("group", 26, False, f"group {g}"), ("header", 24, False, "head")]
        rows += [("data", 30 + 4 * (k % 3), (k + g) % 4 == 0, f"setting {g}-{k}") for k in range(3 + g)]
    return rows


def test_bands_of_a_painted_screen():
    rows = screen()
    image = painted(rows)
    found = frames.find_bands(image)
    assert [(b["kind"], b["checked"]) for b in found] == [(k, c) for k, _, c, _ in rows]
    left, _, box = frames.find_table(image)
    assert abs(left - 36) <= 4 and box == (BOX, BOX + 13)
    tops = np.cumsum([0, *(h for _, h, _, _ in rows)])
    assert all(abs(b["top"] - t) <= 1 for b, t in zip(found, tops, strict=False))
    chrome = np.full((60, WIDTH, 3), 240, np.uint8)
    chrome[20:40, LEFT:RIGHT] = (240, 140, 30)
    cut = np.concatenate([chrome, image[: tops[6] + 14], chrome])
    held = frames.find_bands(cut)
    assert [b["kind"] for b in held] == [k for k, *_ in rows[: len(held)]] and not any(b["cut_top"] for b in held)
    assert frames.find_bands(np.full((50, 300, 3), 255, np.uint8)) == []


def frames_of(spark, image, places, role="r"):
    shots = [(role, n, 300, WIDTH, bytearray(np.pad(image[y : y + 300], ((0, max(0, y + 300 - len(image))), (0, 0), (0, 1)), constant_values=255).tobytes())) for n, y in enumerate(places)]
    return frames.bands_of(spark.createDataFrame(shots, "role string, frame_no int, height int, width int, data binary"))


def test_capture_of_a_whole_list(spark):
    image, rows = painted(screen()), [(s, "", "", g, k) for k, (g, s) in enumerate(CATALOG)]
    cat = catalog.catalog(spark.createDataFrame(rows, "name string, description string, type string, grp string, ord long"))
    steps = list(range(0, len(image) - 100, 200))
    merged = frames.merge_frames(frames_of(spark, image, steps))
    whole = frames.completeness(merged, cat).first()
    wanted = {s: c for k, _, c, s in screen() if k == "data"}
    assert whole.complete and (whole.seen, whole.gaps, whole.checked, whole.groups_seen) == (len(wanted), 0, sum(wanted.values()), 4)
    got = frames.assign(merged, cat)
    assert {x.name: x.value for x in got.collect()} == {s: "Y" if c else "N" for s, c in wanted.items()} and got.filter("problem IS NOT NULL").count() == 0
    sheet = sinks.captured_workbook(frames.captured(got, cat))[0]
    assert (sheet.name, len(sheet.rows)) == ("r", len(wanted) + 1) and {r[4] for r in sheet.rows[1:]} == {"TRUE", "FALSE"}
    back = books.read(cells.read_bytes(spark, sinks.workbook([sheet]), "r.xlsx"))
    assert back.records.count() == len(wanted) and back.records.first().subject == "r"
    jump = frames.completeness(frames.merge_frames(frames_of(spark, image, [0, len(image) - 290])), cat).first()
    assert jump.gaps == 1 and not jump.complete


def one(kind, k, checked=False, top=50, bottom=70, cut_top=False, cut_bottom=False):
    r = random.Random(k)
    return {"top": top, "bottom": bottom, "kind": kind, "checked": checked, "cut_top": cut_top, "cut_bottom": cut_bottom, "fp": [0] * 12 if kind == "header" else [r.randint(10, 250) for _ in range(12)]}


def shots(spark, frames_, height=None):
    rows = [("r", n, height, [tuple(b.values()) for b in bands]) for n, bands in enumerate(frames_)]
    return spark.createDataFrame(rows, f"role string, frame_no int, height int, bands array<{frames.BAND}>")


def test_merging_keeps_cut_rows_and_never_goes_by_headers(spark):
    seen = [
        [one("data", 1)], [one("header", 0), one("data", 1), one("data", 2, cut_bottom=True)], [one("data", 1, checked=True), one("data", 2, checked=True), one("header", 0), one("data", 3)],
        [one("header", 0), one("data", 9)], [one("header", 0)], [one("header", 0, top=0, bottom=20), one("data", 2, top=21, bottom=40), one("data", 3), one("data", 4)],
    ]
    steps = [frames.merge_frames(shots(spark, seen[:k], 300)).orderBy("pos").collect() for k in range(1, 7)]
    assert steps[0] == [] and [x.partial for x in steps[1]] == [False, False, True]
    assert [(x.kind, x.checked, x.partial, x.gaps) for x in steps[2]] == [("header", False, False, 0), ("data", True, False, 0), ("data", True, False, 0), ("header", False, False, 0), ("data", False, False, 0)]
    assert [(len(x), x[0].gaps) for x in steps[3:]] == [(5, 1), (5, 1), (6, 1)]
    rows = [("r", x.pos, x.kind, x.checked, x.partial, x.fp, 0) for x in steps[5]]
    cat = catalog.catalog(spark.createDataFrame([(f"s{g}{k}", "", "", f"g{g}", g * 10 + k) for g in range(2) for k in range(2)], "name string, description string, type string, grp string, ord long"))
    merged = spark.createDataFrame(rows, frames.MERGED)
    assert [x.permission for x in frames.assign(merged, cat).orderBy("row").collect()] == ["g0 > s00", "g0 > s01", "g1 > s10", "g1 > s11"]
    assert frames.completeness(merged, cat).first().complete


def random_capture(seed, n_rows, n_frames, jumps):
    """Frames of a scrolled list: mostly forward, at times back, at times too far ahead and back to where it was."""
    r = random.Random(seed)
    rows = [("header" if k % 20 == 1 else "group" if k % 20 == 0 else "data", k) for k in range(n_rows)]
    ticks = {k: r.random() < 0.5 for k in range(n_rows)}
    at, out = 0, []
    for _ in range(n_frames):
        ahead = at + 40 if out and r.random() < jumps else at
        here = [one(kind, k, ticks[k] and kind == "data") for kind, k in rows[ahead : ahead + 8]]
        if here and r.random() < 0.5:
            here[-1]["cut_bottom"] = True
        out.append(here)
        if r.random() < 0.1:
            k = r.randrange(n_rows)
            ticks[k] = not ticks[k]
        at = max(0, min(at + r.choice([3, 3, 4, 5, -6]), n_rows - 8)) if ahead == at else at
    return [x for x in out if x]


@pytest.mark.parametrize(("seed", "jumps"), [(1, 0.0), (2, 0.02), (3, 0.1)])
def test_runs_of_frames_join_to_the_whole(spark, seed, jumps):
    """Dealt over tasks in any way, a capture gives the rows of frames joined one by one, and as many gaps."""
    df = shots(spark, random_capture(seed, 300, 260, jumps)).repartition(5)
    key = lambda x: (x.pos, x.kind, x.checked, x.partial, tuple(x.fp), x.gaps)
    alone = sorted(map(key, frames.merge_frames(df, run=10_000).collect()))
    for run, meet in ((64, 16), (7, 2), (1, 4)):
        assert sorted(map(key, frames.merge_frames(df, run=run, meet=meet).collect())) == alone
    assert len(alone) > 100


def test_offsets_by_diagonals_equal_one_by_one():
    r = random.Random(6)
    strip = lambda ks, n: frames.Strip.of([{**one(r.choice(["header", "group"]) if k < 3 else "data", k), "partial": r.random() < 0.2} for k in ks], n, False)
    for _ in range(60):
        a, b = strip([r.randrange(9) for _ in range(r.randrange(1, 12))], 0), strip([r.randrange(9) for _ in range(r.randrange(1, 6))], 1)
        near = frames._profiles_alike(a.fp, b.fp)
        wanted = None
        for at in range(-len(b) + 1, len(a)):
            pairs = [(at + j, j) for j in range(len(b)) if 0 <= at + j < len(a)]
            fits = lambda i, j: a.kind[i] == b.kind[j] and (a.kind[i] == 0 or not a.whole[i] or not b.whole[j] or near[i, j])
            if all(fits(i, j) for i, j in pairs) and any(a.telling[i] and b.telling[j] for i, j in pairs):
                wanted = at
        assert frames.offset_of(a, b) == wanted



def test_lines_name_settings_and_groups(spark):
    cat = catalog.catalog(spark.createDataFrame([("Merge charts", "", "", "Front office", 1), ("Print labels", "", "", "Billing desk", 2)], "name string, description string, type string, grp string, ord long"))
    bands = spark.createDataFrame([("r", 1, 0, 19, "group", False), ("r", 1, 20, 39, "data", True), ("r", 1, 40, 59, "data", False), ("r", 2, 0, 19, "data", False), ("r", 2, 20, 39, "data", True)], "role string, frame_no int, top int, bottom int, kind string, checked boolean")
    lines = spark.createDataFrame([("r", 1, 2, 12, "Bililng desk"), ("r", 1, 22, 32, "Merge_charts"), ("r", 1, 50, 68, "Prnit labels"), ("r", 2, 0, 10, "Print labels"), ("r", 2, 21, 30, "zzzz qqqq")], "role string, frame_no int, top int, bottom int, text string")
    got = sorted((x.permission, x.value) for x in frames.read_lines(lines, bands, cat).collect())
    assert got == [("Billing desk > Merge charts", "Y"), ("Billing desk > Print labels", "N")]


def png(image, how):
    """A PNG file whose rows are all filtered in one way."""
    step, rows = image.shape[2], []
    flat = image.reshape(len(image), -1).astype(int)
    for y, line in enumerate(flat):
        up = flat[y - 1] if y else np.zeros_like(line)
        left, corner = (np.concatenate([np.zeros(step, int), x[:-step]]) for x in (line, up))
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: near}[how]
        rows.append(bytes([how]) + ((line - guess) % 256).astype(np.uint8).tobytes())
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, {1: 0, 3: 2, 4: 6}[step], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    r = np.random.default_rng(1)
    for step in (1, 3, 4):
        image = r.integers(0, 256, (7, 5, step), np.uint8)
        for how in range(5):
            got = images.decode(png(image, how))
            assert (got[..., :3] == (image[..., :3] if step > 1 else image)).all() and (got[..., 3] == (image[..., 3] if step == 4 else 255)).all()
    with pytest.raises(images.UnreadableImageError):
        images.decode(b"GIF89a")
    whole = np.concatenate([np.full((40, WIDTH, 3), 240, np.uint8), painted(screen())])
    for n, y in enumerate(range(0, len(whole) - 100, 200)):
        (tmp_path / f"Front Desk {n}.png").write_bytes(png(whole[y : y + 300], 1))
    shots = frames.bands_of(images.read_images(spark, str(tmp_path)))
    merged = frames.merge_frames(shots)
    assert merged.count() == len(screen()) and merged.first().role == "Front Desk"


def test_shared_and_rich_strings(spark):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst {main}><si><t>plain</t></si><si><r><t>ri</t></r><r><rPr><b/></rPr><t xml:space="preserve">ch &amp; more</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="D2" t="s"><v>0</v></c></row><row r="5"><c t="b"><v>1</v></c><c><v>2.5</v></c></row></sheetData></worksheet>')
    got = [(x.row, x.cells, x.kinds) for x in cells.read_bytes(spark, out.getvalue(), "s.xlsx").collect()]
    assert got == [(2, ["", "rich & more", "", "plain"], ["blank", "str", "blank", "str"]), (5, ["true", "2.5"], ["bool", "num"])]


def test_duplicates_say_their_rows(spark):
    rows = spark.createDataFrame([("a", "p", "Y", 3, 1), ("a", "p", "N", 7, 2), ("a", "q", "Y", 4, 3)], "subject string, permission string, value string, row int, ord int")
    assert [(x.permission, x.n, x.conflict, x.rows) for x in records.duplicates(rows, ["subject", "permission"]).collect()] == [("p", 2, True, [3, 7])]


def test_frames_of_many_roles_share_batches(spark):
    band = lambda x: {"kind": "group" if x == 0 else "data", "checked": x % 2 == 1, "cut_top": False, "cut_bottom": False, "fp": [100 * (x == k) + 1 for k in range(8)]}
    rows = [(f"r{k}", no, [band(x) for x in range(max(0, no), no + 3)]) for k in range(40) for no in range(1 + k % 5)]
    df = spark.createDataFrame(rows, "role string, frame_no int, bands array<struct<kind:string,checked:boolean,cut_top:boolean,cut_bottom:boolean,fp:array<int>>>")
    for run, meet in ((64, 16), (1, 2)):
        merged = frames.merge_frames(df, run=run, meet=meet)
        assert "FlatMapGroups" not in merged._jdf.queryExecution().optimizedPlan().toString()
        got = {}
        for r in merged.collect():
            got.setdefault(r["role"], []).append((r["pos"], r["checked"], r["gaps"]))
        assert {k: sorted(v) for k, v in got.items()} == {f"r{k}": [(x, x % 2 == 1, 0) for x in range(3 + k % 5)] for k in range(40)}


@pytest.mark.parametrize("limit", [12, 60])
def test_a_report_in_several_workbooks_is_that_of_one(spark, compared, tmp_path, monkeypatch, limit):
    b, a, cat, result = compared
    given = {"catalog": cat, "warnings": ["w1"], "books": {"baseline": b, "system": a}}

    def held(path) -> dict[str, list[list[str]]]:
        """By sheet its rows that aren't blank."""
        out = {}
        for name, _, _, row in cells.parse_workbook(path.read_bytes()):
            out.setdefault(name, []).append([x for x, _ in row])
        return out

    whole = sinks.workbook(sinks.report(result, **given))
    folder, rows_of, collected = tmp_path / "many", sinks.rows_of, []
    monkeypatch.setattr(sinks, "rows_of", lambda df, *rest: collected.append(df.columns) or rows_of(df, *rest))
    files = sinks.write_report(result, str(folder), one=0, cells=limit, **given)
    assert collected and all("subject" not in x and "permission" not in x for x in collected)  # counts alone
    monkeypatch.undo()
    assert sorted(x.name for x in folder.iterdir()) == sorted({"manifest.json", *(f for x in files.values() for f in x)})
    assert len(files["Findings"]) > 2 and len(files["Side by side"]) > 2
    assert sinks.write_report(result, str(tmp_path / "small"), **given) == {n: ["report.xlsx"] for n in files}
    assert (tmp_path / "small" / "report.xlsx").read_bytes() == whole
    whole = held(tmp_path / "small" / "report.xlsx")
    parts = {name: [held(folder / f) for f in x] for name, x in files.items()}
    assert all(list(x) == [name] for name, some in parts.items() for x in some) and list(files) == list(whole)
    for name in files:
        if name != "Side by side":
            assert [whole[name][0], *(r for x in parts[name] for r in x[name][1:])] == whole[name] and all(x[name][0] == whole[name][0] for x in parts[name])
    cut = lambda rows: {(r[0], n): (x, s) for r in rows[2:] for n, s, x in zip(rows[0][1:], rows[1][1:], r[1:], strict=False) if x}
    grids = [cut(x["Side by side"]) for x in parts["Side by side"]]
    wanted = cut(whole["Side by side"])
    assert sum(map(len, grids)) == len(wanted) and {k: v for x in grids for k, v in x.items()} == wanted
    order = [r[0] for r in whole["Side by side"][2:]]
    assert all((at := [order.index(p) for p in dict.fromkeys(p for p, _ in x)]) == sorted(at) for x in grids)


def test_a_sheet_without_rows_has_its_header(spark, tmp_path):
    kind = "subject string, permission string, value string, ord int"
    same = spark.createDataFrame([("s", "p", "Y", 1), ("t", "p", "N", 2)], kind).withColumn("raw", F.col("value"))
    for name in ("findings-00007-00000-1.xlsx", "findings-2026.xlsx"):  # of an attempt that failed, and somebody else's
        (tmp_path / name).write_bytes(b"")
    files = sinks.write_report(compare.compare(same, same), str(tmp_path), one=0)
    assert {x.name for x in tmp_path.iterdir()} == {"manifest.json", "findings-2026.xlsx", *(f for x in files.values() for f in x)}
    held = cells.read_cells(spark, str(tmp_path / files["Findings"][0])).collect()
    assert [x.cells for x in held] == [sinks.FINDING_COLUMNS] and [x.row for x in held] == [1]
    assert {x.cells[0]: x.cells[1:] for x in cells.read_cells(spark, str(tmp_path / files["Side by side"][0])).collect()} == {"permission": ["s", "t"], "": ["both", "both"], "p": ["Y", "N"]}


def test_a_report_of_more_subjects_than_a_sheet_has(spark, tmp_path):
    """10,050 suppliers: an error until the report went into several workbooks."""
    import datetime

    import __spark_entry__

    n = 10_050
    days = [datetime.datetime(1997, 1, 1), datetime.datetime(1999, 1, 1)]
    frames_ = {
        "supplier": spark.range(n).select(F.col("id").alias("s_suppkey"), F.format_string("Supplier#%09d", "id").alias("s_name"), F.lit(1).alias("s_nationkey")),
        "part": spark.createDataFrame([(0, "Brand#1", "LARGE"), (1, "Brand#2", "SMALL")], "p_partkey long, p_brand string, p_type string"),
        "lineitem": spark.range(2 * n).select(F.lit(0).cast("long").alias("l_orderkey"), (F.col("id") % 3 % 2).alias("l_partkey"), F.floor(F.col("id") / 2).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_extendedprice"), F.when(F.col("id") % 5 == 0, "A").otherwise("N").alias("l_returnflag"), F.when(F.col("id") % 2 == 0, F.lit(days[0])).otherwise(F.lit(days[1])).cast("timestamp_ntz").alias("l_shipdate")),
    }
    for name, df in frames_.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = __spark_entry__.queries()["report_back"](spark, str(tmp_path))
    beside = out.filter("sheet = 'Side by side'")
    lines = frames_["lineitem"].groupBy(F.format_string("Supplier#%09d", "l_suppkey").alias("name")).agg(F.countDistinct("l_partkey").cast("string").alias("a"))
    assert beside.count() == n and beside.select("name", "a").exceptAll(lines).count() == 0
    assert out.filter("sheet = 'Settings'").count() == 2
