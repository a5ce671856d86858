"""Registered queries on captured screens: a catalog's list is painted as a screen would show it, and read again from the pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..sources import books, cells, sinks
from ..streaming import frames
from .derived import table
from .lineage import cut, drop_folder, put_files
from .registry import query

WIDTH, LEFT, RIGHT, BOX, WINDOW, STEP = 500, 30, 480, 440, 300, 180
#: Whether a role (a customer segment) holds a nation's setting.
_HELD_SQL = "(n_nationkey * 7 + length(m)) % 3 = 0"
_ROWS_SQL = """WITH roles AS (SELECT DISTINCT c_mktsegment AS m FROM customer), settings AS (SELECT n_nationkey, n_name, r_name, min(n_nationkey) OVER (PARTITION BY r_name) AS g FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as settings, regions as groups, in order of nations."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return cat.catalog(rows.select(F.col("n_name").alias("name"), F.lit("").alias("description"), F.lit("").alias("type"), F.col("r_name").alias("grp"), F.col("n_nationkey").alias("ord")))


def _band(kind: str, checked: bool, name: str, odd: bool) -> np.ndarray:
    height = 26 if kind != "data" else 28
    part = np.full((height, WIDTH, 3), 240, np.uint8)
    part[:, LEFT:RIGHT] = {"header": (232, 214, 180), "group": (255, 255, 255), "data": (255, 255, 255) if odd else (252, 244, 228)}[kind]
    part[0, LEFT:RIGHT] = 200
    letters = np.random.default_rng(list(name.encode())).random(50) < 0.5
    for x in np.flatnonzero(letters):
        part[9:17, LEFT + 40 + 6 * x : LEFT + 44 + 6 * x] = 30
    if kind == "group":
        part[8:18, LEFT + 5 : LEFT + 17] = (240, 140, 30)
    if kind == "data":
        box = part[7:21, BOX : BOX + 14]
        box[:] = (40, 110, 230) if checked else (252, 252, 252)
        if not checked:
            box[[0, -1]] = box[:, [0, -1]] = 120
    return part


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role, frame_no, height, width, data: overlapping windows over each role's list, painted by the task that has the role."""
    settings = _catalog(spark, sf_dir).withColumn("g", F.min("ord").over(_by_group())).select(F.struct("g", "ord", "name", "grp").alias("x")).agg(F.array_sort(F.collect_list("x")).alias("settings"))
    roles = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role")).distinct().join(F.broadcast(settings))

    def paint(batches):
        for batch in batches:
            for role, held in zip(batch["role"], batch["settings"], strict=True):
                parts, last = [np.full((40, WIDTH, 3), 240, np.uint8)], None  # what is above the list
                for k, s in enumerate(held):
                    if s["grp"] != last:
                        parts += [_band("group", False, s["grp"], False), _band("header", False, "head", False)]
                        last = s["grp"]
                    parts.append(_band("data", (s["ord"] * 7 + len(role)) % 3 == 0, s["name"], k % 2 == 0))
                image = np.concatenate(parts)
                image = np.concatenate([image, np.zeros((*image.shape[:2], 1), np.uint8)], axis=2)
                tops = range(0, max(1, len(image) - WINDOW + STEP), STEP)
                yield pd.DataFrame([(role, n, len(part := image[y : y + WINDOW]), WIDTH, part.tobytes()) for n, y in enumerate(tops)], columns=["role", "frame_no", "height", "width", "data"])

    return roles.mapInPandas(paint, "role string, frame_no int, height int, width int, data binary")


def _by_group():
    from pyspark.sql import Window

    return Window.partitionBy("grp")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(frames.merge_frames(frames.bands_of(_shots(spark, sf_dir))))


@query(_ROWS_SQL + f" SELECT m AS subject, r_name || ' > ' || n_name AS permission, CASE WHEN {_HELD_SQL} THEN 'Y' ELSE 'N' END AS value, CASE WHEN {_HELD_SQL} THEN 'checked' ELSE 'unchecked' END AS raw FROM settings, roles")
def screen_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Painted frames to bands, merged, and assigned by position."""
    return frames.assign(_merged(spark, sf_dir), _catalog(spark, sf_dir)).filter("problem IS NULL").select("subject", "permission", "value", "raw")


@query(_ROWS_SQL + f" SELECT m AS role, count(*) AS seen, count(*) FILTER ({_HELD_SQL}) AS checked, CAST(0 AS INT) AS gaps, count(DISTINCT r_name) AS groups_seen, count(DISTINCT r_name) AS groups_total, true AS complete FROM settings, roles GROUP BY m")
def screen_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.completeness(_merged(spark, sf_dir), _catalog(spark, sf_dir)).drop("problems")


@query(_ROWS_SQL + f""" SELECT m AS role, kind, checked, count(*) AS n FROM (SELECT m, 'data' AS kind, {_HELD_SQL} AS checked FROM settings, roles UNION ALL SELECT DISTINCT m, 'group ' || r_name, false FROM settings, roles UNION ALL SELECT DISTINCT m, 'header ' || r_name, false FROM settings, roles) GROUP BY ALL""".replace("'group ' || r_name, false", "'group', false, r_name").replace("'header ' || r_name, false", "'header', false, r_name").replace(f"{_HELD_SQL} AS checked FROM settings", f"{_HELD_SQL} AS checked, n_name FROM settings"))
def screen_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the merged lists by kind."""
    return _merged(spark, sf_dir).groupBy("role", "kind", "checked").agg(F.count(F.lit(1)).alias("n"))


@query(_ROWS_SQL + f" SELECT m AS subject, r_name || ' > ' || n_name AS permission, CASE WHEN {_HELD_SQL} THEN 'Y' ELSE 'N' END AS value FROM settings, roles")
def captured_workbook_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured roles as a workbook with a sheet each, read back as role lists."""
    catalog = _catalog(spark, sf_dir)
    sheets = sinks.captured_workbook(frames.captured(frames.assign(_merged(spark, sf_dir), catalog), catalog))
    folder = put_files(spark, {"captured.xlsx": sinks.workbook(sheets)})
    try:
        return cut(books.read(cells.read_cells(spark, folder)).records.select("subject", "permission", "value"))
    finally:
        drop_folder(spark, folder)


@query(_ROWS_SQL + f" SELECT m AS subject, r_name || ' > ' || n_name AS permission, CASE WHEN {_HELD_SQL} THEN 'Y' ELSE 'N' END AS value FROM settings, roles")
def screen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines, with a slip in each longer name, matched to settings and groups; every setting is sighted twice and the last one counts."""
    catalog = _catalog(spark, sf_dir)
    rows = catalog.join(F.broadcast(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role")).distinct()))
    held = (F.col("ord") * 7 + F.length("role")) % 3 == 0
    sighted = rows.select("role", "name", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), "ord", "grp", held.alias("held"))
    top = (F.col("ord") * 20).cast("int")
    bands = sighted.select("role", F.col("n").alias("frame_no"), top.alias("top"), (top + 19).alias("bottom"), F.lit("data").alias("kind"), F.when(F.col("n") == 0, ~F.col("held")).otherwise(F.col("held")).alias("checked"))
    slip = F.when(F.length("name") >= 7, F.concat(F.lit("N"), F.col("name"))).otherwise(F.col("name"))
    lines = sighted.select("role", F.col("n").alias("frame_no"), top.alias("top"), (top + 12).alias("bottom"), slip.alias("text"))
    return frames.read_lines(lines, bands, catalog).select("subject", "permission", "value")
