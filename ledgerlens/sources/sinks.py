"""Writers: workbooks, CSV, JSON and text of results bounded by max_rows; findings of any number as ordered part files (`write_findings`), reports of any size as workbooks that tasks write (`write_report`)."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.keys import norm_key
from ..operators.order import dictionary
from ..plans.lineage import drop_folder, filed, together
from .cells import column_letters

#: Names that the text summary lists of what only one side has.
NAMED = 6
#: Rows that a report collects at most; more is an error, not a cut.
MAX_ROWS = 1_000_000
#: Pairs (and rows of the catalog) up to which `write_report` lets the driver write one workbook; beyond, tasks write several.
ONE_BOOK = 100_000
#: Subjects side by side that the driver writes at most.
ONE_SUBJECTS = 10_000
#: Cells with a text or number that a task holds, and so a workbook of several has, at most (and what is left of a row of subjects).
BOOK_CELLS = 250_000
#: Subjects side by side in one sheet; workbooks have 16,384 columns.
SHEET_SUBJECTS = 16_000
#: Tasks that write subjects side by side, at most; each has neighbouring sheets.
BESIDE_TASKS = 4_000
FINDING_COLUMNS = ["severity", "type", "subject", "permission", "expected", "actual", "note", "baseline_row", "actual_row"]
_FIXED = (1980, 1, 1, 0, 0, 0)


@dataclass
class Sheet:
    """rows, and by (row, column) from 0 the name of a colour."""

    name: str
    rows: list[list] = field(default_factory=list)
    widths: list[int] = field(default_factory=list)
    freeze: int = 1
    colours: dict[tuple[int, int], str] = field(default_factory=dict)


#: Fill colours by name; a cell's style is 0, 1 for headers, or 2 and the colour's place.
COLOURS = {"red": "FFF4CCCC", "amber": "FFFCE5CD", "yellow": "FFFFF2CC", "green": "FFD9EAD3", "blue": "FFD0E0F0", "grey": "FFEEEEEE"}
SEVERITY_COLOURS = {"high": "red", "medium": "amber", "low": "yellow", "info": "grey"}
TYPE_COLOURS = {"ok": "green", "excess": "red", "missing": "amber", "different": "yellow"}


def rows_of(df: DataFrame, max_rows: int = MAX_ROWS) -> list[list]:
    """Header and rows, or an error if there are too many for a sheet."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows: write them with df.write instead")
    return [df.columns, *(list(r) for r in rows)]


def sheet_name(name: str, used: set[str]) -> str:
    """A name that workbooks accept: 31 characters, no []:*?/\\, none twice."""
    base = re.sub(r"[\[\]:*?/\\]", " ", name).strip()[:31] or "Sheet"
    out, n = base, 2
    while out.lower() in used:
        tail = f" ({n})"
        out, n = base[: 31 - len(tail)] + tail, n + 1
    used.add(out.lower())
    return out


def _cell(value, row: int, column: int, style: int) -> str:
    ref = f'r="{column_letters(column)}{row}" s="{style}"'
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c {ref} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"<c {ref}><v>{value}</v></c>"
    if isinstance(value, list | tuple):
        value = "; ".join(map(str, value))
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))
    return f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook(sheets: list[Sheet]) -> bytes:
    """The same bytes for the same sheets."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    used: set[str] = set()
    names = [sheet_name(s.name, used) for s in sheets]
    parts = {}
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    parts["[Content_Types].xml"] = (
        f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>'
    )
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    parts["_rels/.rels"] = f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    parts["xl/workbook.xml"] = f'{head}<workbook {main} xmlns:r="{office}"><sheets>{listed}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'{head}<Relationships xmlns="{package}">{links}<Relationship Id="rId{len(sheets) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>'
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in COLOURS.values())
    styles = "".join(f'<xf fontId="0" fillId="{2 + k}" applyFill="1"/>' for k in range(len(COLOURS)))
    places = {c: 2 + k for k, c in enumerate(COLOURS)}
    parts["xl/styles.xml"] = (
        f'{head}<styleSheet {main}><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts><fills count="{2 + len(COLOURS)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{2 + len(COLOURS)}"><xf fontId="0"/><xf fontId="1" applyFont="1"/>{styles}</cellXfs></styleSheet>'
    )
    for i, sheet in enumerate(sheets, 1):
        width = max((len(r) for r in sheet.rows), default=1)
        widths = sheet.widths or [max(8, min(60, max((len(str(r[c])) for r in sheet.rows[:50] if c < len(r) and r[c] is not None), default=8) + 2)) for c in range(width)]
        columns = "".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for c, w in enumerate(widths, 1))
        pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{sheet.freeze}" topLeftCell="A{sheet.freeze + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if sheet.freeze else ""
        body = "".join(f'<row r="{r}">{"".join(_cell(v, r, c, places.get(sheet.colours.get((r - 1, c)), int(r <= sheet.freeze))) for c, v in enumerate(row))}</row>' for r, row in enumerate(sheet.rows, 1))
        ref = f'<autoFilter ref="A{sheet.freeze}:{column_letters(width - 1)}{max(len(sheet.rows), 1)}"/>' if sheet.freeze and sheet.rows else ""
        parts[f"xl/worksheets/sheet{i}.xml"] = f"{head}<worksheet {main}>{pane}<cols>{columns}</cols><sheetData>{body}</sheetData>{ref}</worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, _FIXED), text.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def findings_csv(found: DataFrame, max_rows: int = MAX_ROWS) -> str:
    """Nine columns, quoted where needed, lines end with CR LF."""
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\r\n")
    for row in rows_of(found.select(*FINDING_COLUMNS), max_rows):
        writer.writerow(["" if x is None else x for x in row])
    return out.getvalue()


def _csv_line(columns: list[str]) -> Column:
    """A row as the CSV writer has it, without its end."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(",", *(F.when(t.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in texts))


MANIFEST = "manifest.json"


def write_findings(found: DataFrame, folder: str, kind: str = "csv", parts: int | None = None) -> list[str]:
    """Findings of any number, in their order, as part files that tasks write: CSV of the columns and line ends of `findings_csv`, or JSON lines.

    manifest.json lists the files whose contents make up the whole, the header first. Spark's committer keeps what failed tasks wrote out.
    The findings are computed once, into column files beside the parts that go when the parts are written: names, bounds of ranges and rows are told from these.
    """
    from ..operators.compare import with_order
    from .cells import place

    spark = found.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        held, order = with_order(filed(found.select(*FINDING_COLUMNS), f"{folder}/found"))
        dealt = held.repartitionByRange(n, *order).sortWithinPartitions(*order)
        if kind == "csv":
            dealt.select(_csv_line(FINDING_COLUMNS).alias("value")).write.option("lineSep", "\r\n").text(f"{folder}/parts")
        else:
            dealt.select(*FINDING_COLUMNS).write.json(f"{folder}/parts")
    finally:
        drop_folder(spark, f"{folder}/found")
    fs, base = place(folder)
    import pyarrow.fs as pafs

    names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(f"{base}/parts")) if x.base_name.startswith("part-"))
    files = [f"parts/{x}" for x in names]  # partitions are ranges, and part files are numbered by partition
    if kind == "csv":
        with fs.open_output_stream(f"{base}/header.csv") as f:
            f.write((",".join(FINDING_COLUMNS) + "\r\n").encode())
        files.insert(0, "header.csv")
    with fs.open_output_stream(f"{base}/{MANIFEST}") as f:
        f.write(json.dumps(files).encode())
    return files


def to_json(parts: dict[str, DataFrame], meta: dict | None = None, max_rows: int = MAX_ROWS) -> str:
    """{meta, name: [rows]}."""
    out = {"meta": meta or {}}
    for name, df in parts.items():
        header, *rows = rows_of(df, max_rows)
        out[name] = [dict(zip(header, r, strict=True)) for r in rows]
    return json.dumps(out, default=str, ensure_ascii=False)


def side_by_side(result, limit: int = ONE_SUBJECTS) -> Sheet:
    """Settings by subjects (see `inventory.shown_cell`), coloured by type; under the names, which side has the subject."""
    from ..operators import inventory

    names = inventory.subjects_of(result.pairs, limit)
    known = {r["subject"]: r for r in result.pairs.groupBy("subject").agg(F.max("subject_in_baseline").alias("b"), F.max("subject_in_actual").alias("a")).collect()}
    side = {n: "both" if known[n]["b"] and known[n]["a"] else "baseline" if known[n]["b"] else "system" for n in names}
    lines = {r[0]: [] for r in result.pairs.select("permission").distinct().orderBy(*dictionary("permission")).collect()}
    for r in inventory.side_by_side_tiles(result.pairs).select("permission", "cells").toLocalIterator():
        lines[r["permission"]] += r["cells"]
    return _beside(side, list(lines.items()))


def _beside(side: dict[str, str], lines: list[tuple[str, list]]) -> Sheet:
    """side: of each subject, which side has it; lines: settings with their (subject, cell, type)."""
    names = sorted(side)
    places = {n: k for k, n in enumerate(names, 1)}
    rows, colours = [["permission", *names], ["", *(side[n] for n in names)]], {}
    for i, (permission, held) in enumerate(lines, 2):
        row = [permission, *[None] * len(names)]
        for subject, cell, kind in held:
            row[places[subject]] = cell
            if kind in TYPE_COLOURS:
                colours[i, places[subject]] = TYPE_COLOURS[kind]
        rows.append(row)
    return Sheet("Side by side", rows, freeze=2, colours=colours)


#: What the sheets of a report are, and what severities mean.
HOW_TO_READ = [
    ["Actions", "by subject: what to take away, give or look at"], ["Findings", "every difference, worst first, with its row in either file"], ["Side by side", "every setting by subject, expected and actual"],
    ["Subjects, Settings", "where differences gather"], ["Matches", "names that were paired by an alias or by what they share"],
    ["high", "held without being wanted"], ["medium", "wanted but not held, another level, or a subject that the system lacks"], ["low, info", "what only one side has"],
]


def _read_as(books: dict) -> list[list]:
    """For each side its files, sheets and layouts."""
    rows = [[side, file, sheet, layout.kind] for side, book in books.items() for (file, sheet), layout in book.layouts.items()]
    return [["side", "file", "sheet", "read as"], *rows, []] if rows else []


@dataclass
class Table:
    """A sheet of a report as a frame: its columns, what orders its rows, and of a row (column, colour or None)."""

    name: str
    rows: DataFrame
    by: list[Column]
    columns: list[str]
    colour: Callable[[list], tuple[int, str | None]] | None = None
    #: Rows lie in column files.
    filed: bool = False

    def sheet(self, rows: list[list]) -> Sheet:
        """rows: with the header."""
        told = [self.colour(row) for row in rows[1:]] if self.colour else []
        return Sheet(self.name, rows, colours={(r, at): c for r, (at, c) in enumerate(told, 1) if c})

    def held(self, max_rows: int) -> Sheet:
        return self.sheet(rows_of(self.rows.orderBy(*self.by).select(*self.columns), max_rows))


def _tables(result, catalog: DataFrame | None, actual_records: DataFrame | None) -> dict[str, Table]:
    """The sheets of a report that are lists, by their names."""
    from ..operators import catalog as cat
    from ..operators import rollup
    from ..operators.compare import finding_order

    roles = result.pairs.groupBy("subject").agg(F.max("role").alias("role"))
    found, more = result.findings, []
    if catalog is not None:
        more = ["group", "description"]
        found = cat.enrich(found, catalog).withColumn("group", F.coalesce("grp", F.lit(""))).withColumn("description", F.coalesce("description", F.lit("")))
    todo = rollup.actions(result.findings).join(roles, "subject", "left")
    subjects = rollup.by_subject(result.findings).join(roles, "subject", "left")
    settings = rollup.by_permission(result.pairs)
    out = [
        Table("Actions", todo, rollup.action_order(), ["subject", "role", "remove", "grant", "review", "status"]),
        Table("Findings", found, finding_order(), [*FINDING_COLUMNS, *more], lambda row: (0, SEVERITY_COLOURS.get(row[0]))),
        Table("Subjects", subjects, rollup.subject_order(), subjects.columns),
        Table("Settings", settings, rollup.permission_order(), settings.columns),
        Table("Matches", result.matches, [F.desc("kind"), F.col("baseline"), F.col("actual")], result.matches.columns),
    ]
    if catalog is not None:
        held = actual_records if actual_records is not None else result.actual.records
        covered = cat.coverage(catalog, result.baseline.permissions.select("display"), held)
        unknown = not_in_catalog(result, catalog)
        out += [
            Table("Coverage", covered, dictionary("grp", "name"), ["grp", "name", "description", "in_baseline", "granted_to", "type"], lambda row: (3, "green" if row[3] else "amber" if row[4] else None)),
            Table("Not in catalog", unknown, [F.col("side"), F.col("permission")], unknown.columns),
        ]
    return {x.name: x for x in out}


def _summary(result, named: int, warnings: list[str] | None, books: dict | None) -> Sheet:
    """named: how many names were paired."""
    from ..operators import rollup

    verdict, counts, severity, sizes = map(rows_of, (rollup.verdict(result.pairs, result.findings), rollup.counts_by_type(result.pairs), rollup.counts_by_severity(result.findings), rollup.sizes(result.baseline, result.actual)))
    rows = [*verdict, [], *counts, [], *severity, [], *_read_as(books or {}), *sizes, [], ["pairs that match", next(r[1] for r in counts if r[0] == "ok")], ["names paired", named], [], *HOW_TO_READ]
    return Sheet("Summary", [*rows, *([[], ["warnings"], *([x] for x in warnings)] if warnings else [])], colours={(1, 2): "green" if verdict[1][2] else "red"})


def report(result, max_rows: int = MAX_ROWS, catalog: DataFrame | None = None, actual_records: DataFrame | None = None, warnings: list[str] | None = None, books: dict | None = None) -> list[Sheet]:
    """The sheets of a comparison: Summary, Actions, Findings, Side by side, Subjects, Settings, Matches; with a catalog also Coverage and Not in catalog. All are held by the driver: `write_report` writes those of any size."""
    held = {name: t.held(max_rows) for name, t in _tables(result, catalog, actual_records).items()}
    summary = _summary(result, len(held["Matches"].rows) - 1, warnings, books)
    return [summary, held.pop("Actions"), held.pop("Findings"), side_by_side(result), *held.values()]


def _file_name(sheet: str) -> str:
    return sheet.lower().replace(" ", "-")


def _written(dealt: DataFrame, folder: str, empty: Sheet, sheets: Callable[[Iterator], Iterator[Sheet]]) -> list[str]:
    """What tasks make of their rows' batches, each sheet as a workbook; their files in order of partitions. A file is named by its task's attempt, so that a repeated task writes over nothing. empty: the sheet if there are no rows."""
    from .cells import place

    name = _file_name(empty.name)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .cells import place

        task, files = TaskContext.get(), []
        fs, base = place(folder)
        for k, sheet in enumerate(sheets(batches)):
            files.append(f"{name}-{task.partitionId():05d}-{k:05d}-{task.taskAttemptId()}.xlsx")
            with fs.open_output_stream(f"{base}/{files[-1]}") as f:
                f.write(workbook([sheet]))
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    out = sorted(r[0] for r in dealt.mapInArrow(run, "file string").collect())
    if out:
        return out
    fs, base = place(folder)
    with fs.open_output_stream(f"{base}/{name}-00000.xlsx") as f:
        f.write(workbook([empty]))
    return [f"{name}-00000.xlsx"]


def _write_table(table: Table, folder: str, cells: int) -> tuple[int, list[str]]:
    """Its number of rows, and its workbooks' files in order; one that has the header alone, if there are no rows."""
    from ..operators.compare import with_order

    held = table.rows if table.filed else filed(table.rows, f"{folder}/{_file_name(table.name)}.rows")
    by, header = table.by, table.columns
    lists = [c for c in header if isinstance(held.schema[c].dataType, ArrayType)]
    size = sum((F.size(c) for c in lists), F.lit(len(header)))  # what a list names counts as a cell each
    n, total = held.agg(F.count(F.lit(1)), F.sum(size)).first()
    if table.name == "Findings":  # as many as pairs: sorted by numbers rather than by collation
        held, by = with_order(held)
    made = Table(table.name, None, [], header, table.colour)

    def sheets(batches):
        rows, filled, at = [header], 0, [header.index(c) for c in lists]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(list(row))
                filled += len(header) + sum(len(row[k]) for k in at)
                if filled >= cells:
                    yield made.sheet(rows)
                    rows, filled = [header], 0
        if len(rows) > 1:
            yield made.sheet(rows)

    return n, _written(held.repartitionByRange(max(1, -(-(total or 0) // cells)), *by).sortWithinPartitions(*by).select(*header), folder, made.sheet([header]), sheets)


def _write_beside(pairs: DataFrame, folder: str, n: int, cells: int) -> list[str]:
    """Settings by subjects, as `side_by_side` has them, in workbooks of as many neighbouring subjects as their cells allow; what doesn't fit goes on in a further one, from the next setting on. A workbook has those settings and subjects that have cells in it, so all cells stand in one of them. n: how many pairs there are."""
    from ..operators import inventory
    from ..operators.compare import _spread
    from ..operators.order import dictionary_classes, placed

    subjects = pairs.groupBy("subject").agg(F.max("subject_in_baseline").alias("b"), F.max("subject_in_actual").alias("a"))
    names = placed(subjects, [F.col("subject")])
    size = names.count()
    width = max(1, min(SHEET_SUBJECTS, cells * size // max(n, 1)))
    tiles = max(1, -(-size // width))
    tasks = min(tiles, BESIDE_TASKS)
    ((settings, number),) = dictionary_classes(pairs.select("permission"), "permission")
    where = F.when(F.col("b") & F.col("a"), "both").when(F.col("b"), "baseline").otherwise("system")
    names = names.select("subject", F.floor(F.col("place") / width).cast("int").alias("tile"), where.alias("side"))
    rows = pairs.select("permission", "subject", inventory.shown_cell().alias("cell"), "type").join(_spread(names, size), "subject").join(_spread(settings, number), "permission")
    task = F.floor(F.col("tile") * tasks / tiles).cast("int")
    dealt = rows.repartitionById(tasks, task).sortWithinPartitions("tile", "class", "permission", "subject").select("tile", "permission", "subject", "side", "cell", "type")

    def sheets(batches):
        block, last, side, lines, filled = None, None, {}, [], 0
        for batch in batches:
            for tile, permission, subject, at, cell, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a line is a list of all its subjects when it is written, so sheets with few cells end by their area
                if tile != block or (permission != last and (filled >= cells or len(lines) * len(side) >= 16 * cells)):
                    if lines:
                        yield _beside(side, lines)
                    block, last, side, lines, filled = tile, None, {}, [], 0
                if not lines or permission != last:
                    lines.append((permission, []))
                    last = permission
                side[subject] = at
                lines[-1][1].append((subject, cell, kind))
                filled += 1
        if lines:
            yield _beside(side, lines)

    return _written(dealt, folder, _beside({}, []), sheets)


def write_report(result, folder: str, catalog: DataFrame | None = None, actual_records: DataFrame | None = None, warnings: list[str] | None = None, books: dict | None = None, one: int = ONE_BOOK, cells: int = BOOK_CELLS) -> dict[str, list[str]]:
    """The sheets of `report`, of any size, as workbooks in a folder: by sheet the files that make it up, in order (manifest.json says the same).

    Up to `one` pairs it is one workbook, report.xlsx. Beyond, a sheet has workbooks of its own, each of some `cells` cells,
    which tasks write as they have sorted its rows: the driver has the summary and the names of files.
    """
    from .cells import place

    spark = result.pairs.sparkSession
    fs, base = place(folder)
    fs.create_dir(base, recursive=True)
    scratch = [f"{folder}/pairs.rows", f"{folder}/findings-of-pairs.rows"]
    told = ["subject", "role", "permission", "type", "severity", "expected", "actual", "subject_in_baseline", "subject_in_actual"]
    try:
        pairs, found = together(spark, lambda: filed(result.pairs.select(*told), scratch[0]), lambda: filed(result.findings.select(*FINDING_COLUMNS, "suggestion"), scratch[1]))
        result = replace(result, pairs=pairs, findings=found)
        n = pairs.count()
        small = n + (catalog.count() if catalog is not None else 0) <= min(one, MAX_ROWS)
        if small:  # that many pairs may still be a grid of many blanks
            subjects, settings = (pairs.select(c).distinct().count() for c in ("subject", "permission"))
            small = subjects <= ONE_SUBJECTS and subjects * settings <= 16 * one
        if small:
            sheets = report(result, catalog=catalog, actual_records=actual_records, warnings=warnings, books=books)
            files = {s.name: ["report.xlsx"] for s in sheets}
            made = {"report.xlsx": sheets}
        else:
            tables = _tables(result, catalog, actual_records)
            tables["Findings"].filed = catalog is None
            scratch += [f"{folder}/{_file_name(name)}.rows" for name in tables]
            beside, *rest = together(spark, lambda: _write_beside(pairs, folder, n, cells), *(lambda t=t: _write_table(t, folder, cells) for t in tables.values()))
            listed = dict(zip(tables, rest, strict=True))
            files = {"Summary": ["summary.xlsx"], **{k: listed.pop(k)[1] for k in ("Actions", "Findings")}, "Side by side": beside}
            made = {"summary.xlsx": [_summary(result, listed["Matches"][0], warnings, books)]}
            files |= {k: f for k, (_, f) in listed.items()}
        for name, sheets in made.items():
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(workbook(sheets))
    finally:
        for x in scratch:
            drop_folder(spark, x)
    import pyarrow.fs as pafs

    kept = {f for held in files.values() for f in held}
    own = re.compile(rf"({'|'.join(map(_file_name, files))})-\d{{5,}}(-\d{{5,}}-\d+)?\.xlsx")
    for x in fs.get_file_info(pafs.FileSelector(base)):  # of attempts that failed, or of an earlier report
        if x.base_name not in kept and own.fullmatch(x.base_name):
            fs.delete_file(x.path)
    with fs.open_output_stream(f"{base}/{MANIFEST}") as f:
        f.write(json.dumps(files).encode())
    return files


def not_in_catalog(result, catalog: DataFrame) -> DataFrame:
    """side, permission, suggestion, grp: settings of either side that the catalog doesn't know; near names are sought for the baseline's."""
    from ..operators import catalog as cat

    sides = [x.permissions.select(F.col("display").alias("permission")) for x in (result.baseline, result.actual)]
    mine = cat.cross_check(sides[0], catalog)[1].select(F.lit("baseline").alias("side"), "permission", "suggestion", "grp")
    theirs = cat.lookup(sides[1].distinct(), catalog).filter("catalog_key IS NULL").select(F.lit("system").alias("side"), "permission", F.lit("").alias("suggestion"), F.lit("").alias("grp"))
    return mine.unionByName(theirs).orderBy("side", "permission")


def text_summary(result, limit: int = 40, books: dict | None = None, catalog: DataFrame | None = None) -> str:
    """Verdict, how the sides were read, counts, coverage, and what there is to do for the first `limit` subjects. books: what `books.read` gave, by side."""
    from ..operators import catalog as cat
    from ..operators import rollup

    compared, worst, passed, _ = rollup.verdict(result.pairs, result.findings).first()
    lines = [f"{'PASS' if passed else 'FAIL'}: {compared} pairs compared; worst finding: {worst}"]
    for side, book in (books or {}).items():
        lines += [f"  {side}: {file} [{sheet}; {layout.kind}]" for (file, sheet), layout in book.layouts.items()]
        lines += [f"  warning: {x}" for x in book.warnings]
    lines += [f"  {r['kind']}s: {r['baseline']} in the baseline, {r['actual']} in the system, {r['both']} in both" for r in rollup.sizes(result.baseline, result.actual).collect()]
    severity = rollup.counts_by_severity(result.findings).collect()
    lines.append("  findings: " + ", ".join(f"{r['n']} {r['severity']}" for r in severity))
    lines += [f"  {r['n']:>8}  {r['type']}" for r in rollup.counts_by_type(result.pairs).collect()]
    if catalog is not None:
        row = cat.coverage(catalog, result.baseline.permissions.select("display"), result.actual.records).agg(F.count_if("in_baseline").alias("n"), F.count(F.lit(1)).alias("total")).first()
        lines.append(f"  catalog: {row['n']} of {row['total']} settings are in the baseline")
        for r in not_in_catalog(result, catalog).limit(limit).collect():
            lines.append(f"  not in the catalog: {r['permission']}" + (f"; closest: \"{r['suggestion']}\" ({r['grp']})" if r["suggestion"] else ""))
    todo = rollup.actions(result.findings)
    held = todo.limit(limit).collect()
    if held:
        lines += ["", "What to do, by subject:"]
    for row in held:
        lines.append(f"  {row['subject']}" + (f": {row['status']}" if row["status"] else ""))
        lines += [f"    {word}  {x}" for word, key in (("REMOVE", "remove"), ("GRANT", "grant"), ("REVIEW", "review")) for x in row[key]]
    more = todo.count() - limit
    if more > 0:
        lines.append(f"  ... {more} more subjects (see the report)")
    one_sided = result.findings.filter("severity = 'low' AND type LIKE 'permission-%'")
    n = one_sided.count()
    if n:
        names = [r["permission"] for r in one_sided.select("permission").distinct().orderBy(*dictionary("permission")).limit(NAMED + 1).collect()]
        lines += ["", f"{n} pairs of settings that only one side has (low): {' | '.join(names[:NAMED])}{' | ...' if len(names) > NAMED else ''}"]
    return "\n".join(lines)


def summary_pages(result) -> DataFrame:
    """The pages of `summary_document` as rows, for any number of subjects: name, role, status and groups (kind, items in order; no empty ones)."""
    from ..operators import rollup

    roles = result.pairs.groupBy("subject").agg(F.max("role").alias("role"))
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("items")) for k in ("remove", "grant", "review")))
    todo = rollup.actions(result.findings).join(roles, "subject", "left")
    return todo.select(F.col("subject").alias("name"), F.coalesce("role", F.lit("")).alias("role"), "status", F.filter(every, lambda g: F.size(g["items"]) > 0).alias("groups"))


def summary_document(result, meta: dict | None = None, max_rows: int = MAX_ROWS, catalog: DataFrame | None = None) -> dict:
    """One page for each subject with something to do, as data: title, meta, verdict (passed, headline, detail), subjects (name, role, status, groups of items: text and, from the catalog, description), matched (subjects without differences)."""
    from ..operators import catalog as cat
    from ..operators import rollup

    compared, worst, passed, _ = rollup.verdict(result.pairs, result.findings).first()
    roles = result.pairs.groupBy("subject").agg(F.max("role").alias("role"), F.max(F.col("subject_in_baseline") & F.col("subject_in_actual")).alias("both"))
    todo = rollup.actions(result.findings)
    rows = [dict(zip(("subject", "remove", "grant", "review", "status"), r, strict=True)) for r in rows_of(todo.select("subject", "remove", "grant", "review", "status"), max_rows)[1:]]
    known = {r["subject"]: r for r in roles.collect()}
    about = {}
    if catalog is not None:
        listed = result.findings.filter("permission <> ''").select("permission").distinct()
        about = {p: d or "" for p, d in rows_of(cat.enrich(listed, catalog).select("permission", "description"), max_rows)[1:]}
    n = {k: sum(len(r[k]) for r in rows) for k in ("remove", "grant", "review")}
    busy = {r["subject"] for r in rows}
    matched = sorted(s for s, r in known.items() if r["both"] and s not in busy)
    count = lambda k, word: f"{k} {word}{'' if k == 1 else 's'}"
    headline = "the system is as the baseline says" if passed else f"{count(len(rows), 'subject')} to look at"
    detail = f"{count(compared, 'pair')} compared; " + (", ".join(f"{k} {count(v, 'setting')}" for k, v in n.items() if v) or "nothing to change") + f"; {count(len(matched), 'subject')} without differences"
    pages = [{"name": r["subject"], "role": known[r["subject"]]["role"] if r["subject"] in known else "", "status": r["status"], "groups": [{"kind": k, "items": [{"text": x, "description": about.get(x.split(": ")[0] if k == "review" else x, "")} for x in r[k]]} for k in ("remove", "grant", "review") if r[k]]} for r in rows]
    sizes = {r["kind"]: [r["baseline"], r["actual"], r["both"]] for r in rollup.sizes(result.baseline, result.actual).collect()}
    return {"title": "Differences by subject", "meta": {**(meta or {}), **sizes}, "verdict": {"passed": passed, "worst": worst, "headline": headline, "detail": detail}, "subjects": pages, "matched": matched}


def inventory_workbook(records: DataFrame, book=None, catalog: DataFrame | None = None, limit: int = 10_000) -> list[Sheet]:
    """What one side has, without a baseline: Matrix (settings by subjects), Subjects, Settings, Source. Catalog settings that nobody has are listed too."""
    from ..operators import catalog as cat
    from ..operators import inventory

    names = inventory.subjects_of(records, limit)
    wide = inventory.documented(records, catalog, names)
    matrix = rows_of(wide.orderBy(*dictionary("grp", "setting")).select("grp", "setting", "description", *(F.col(f"`{n}`") for n in names), "held_by", *(["in_catalog"] if catalog is not None else [])))
    colours = {(r, c): "green" for r, row in enumerate(matrix) if r for c in range(3, 3 + len(names)) if row[c]}
    listed = rows_of(inventory.documented_list(records, catalog).orderBy(*dictionary("grp", "setting")).select("grp", "setting", "description", "held_by", "who"))
    source = [["what", "value"], ["subjects", len(names)], ["settings", len(matrix) - 1], ["catalog", catalog.count() if catalog is not None else "none: groups are those of the exports"]]
    if book is not None:
        source += [[f"{file} [{sheet}]", layout.kind + (f" of {layout.role}" if layout.role else "")] for (file, sheet), layout in book.layouts.items()] + [["warning", x] for x in book.warnings]
    return [Sheet("Matrix", matrix, colours=colours), Sheet("Subjects", rows_of(inventory.subject_list(records).orderBy("subject"))), Sheet("Settings", listed), Sheet("Source", source)]


def captured_workbook(captured: DataFrame, max_rows: int = MAX_ROWS) -> list[Sheet]:
    """One sheet for each captured role, in catalog columns with Permission (see `frames.captured`)."""
    columns = [c for c in captured.columns if c != "role"]
    header, *rows = rows_of(captured.orderBy("role", "Security group Name", "Security Setting Name").select("role", *columns), max_rows)
    by_role: dict[str, list[list]] = {}
    for role, *row in rows:
        by_role.setdefault(role, []).append(row)
    return [Sheet(role, [columns, *held], [44, 70, 8, 34, 10]) for role, held in by_role.items()]


# The roles of a template for which none are named.
TEMPLATE_ROLES = ("Provider", "Nurse", "Front Desk", "Biller", "Practice Admin")


def template(catalog_rows: DataFrame, roles: Sequence[str] = TEMPLATE_ROLES, groups: list[str] | None = None) -> list[Sheet]:
    """A baseline to fill in: the catalog's settings by blank role columns, a sheet that maps users to roles, and one that says how to."""
    keys = [r[0] for r in catalog_rows.sparkSession.createDataFrame([(g,) for g in groups], "g string").select(norm_key(F.col("g"))).collect()] if groups else []
    rows = catalog_rows.filter(norm_key(catalog_rows["grp"]).isin(keys)) if groups else catalog_rows
    body = rows_of(rows.orderBy(*dictionary("grp", "name")).select("grp", "name", "description"))[1:]
    how = [["How to fill it in"], ["Put X where the role should hold the setting, leave the cell blank where it should not."], ["A level, such as read only, goes into the cell as it is named in the system."], ["On Users, name each user's role if the system lists users rather than roles."]]
    return [Sheet("Permissions", [["Category", "Security Setting", "What it controls", *roles], *([*r, *[""] * len(roles)] for r in body)]), Sheet("Users", [["User", "Role"], ["", *roles[:1]]]), Sheet("How to", how)]


def write(path: str, result, **more) -> None:
    """By the path's ending: .xlsx, .csv, .json, else text; on any file system that pyarrow knows, folders are made. more: what report and text_summary take."""
    from ..operators.compare import ordered
    from .cells import place

    if path.endswith(".xlsx"):
        data = workbook(report(result, **more))
    elif path.endswith(".csv"):
        data = findings_csv(ordered(result.findings)).encode()
    elif path.endswith(".json"):
        data = to_json({"findings": ordered(result.findings), "matches": result.matches}).encode()
    else:
        data = text_summary(result, **more).encode()
    fs, base = place(path)
    fs.create_dir(base.rpartition("/")[0] or "/", recursive=True)
    with fs.open_output_stream(base) as f:
        f.write(data)
