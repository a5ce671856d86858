"""Registered queries: each operator on the star-schema tables, and the SQL that its result must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import clean, norm_key, perm_key, short_name
from ..functions.similarity import edit_distance, similarity, token_jaccard
from ..functions.values import GRANTED, NOT_GRANTED, is_annotated, is_granted, normalize_value, show
from ..functions.values import glob as matches_glob
from ..operators import catalog as cat
from ..operators import compare as cmp
from ..operators import inventory as inv
from ..operators import match, records, rollup
from ..streaming import frames
from .derived import sided, sides, table
from .registry import query


def _compared(spark: SparkSession, sf_dir: str, **options) -> cmp.Result:
    return cmp.compare(sided(spark, sf_dir), None, cmp.Options(suggest=False, **options))


@query("SELECT subject, permission, type, severity, expected, actual FROM pairs", pairs=True)
def reconcile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).pairs.select("subject", "permission", "type", "severity", "expected", "actual")


@query("SELECT subject, permission, type, severity FROM found", pairs=True)
def finding_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmp.ordered(_compared(spark, sf_dir).findings).select("subject", "permission", "type", "severity")


@query("""SELECT t.type, count(s.type) AS n FROM (SELECT unnest(['ok', 'excess', 'missing', 'different', 'user-not-in-baseline', 'user-not-in-actual',
    'permission-not-in-baseline', 'permission-not-in-actual']) AS type) t LEFT JOIN single s ON s.type = t.type GROUP BY t.type""", pairs=True)
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.counts_by_type(_compared(spark, sf_dir).pairs)


@query("SELECT t.severity, count(f.severity) AS n FROM (SELECT unnest(['high', 'medium', 'low', 'info']) AS severity) t LEFT JOIN found f ON f.severity = t.severity GROUP BY t.severity", pairs=True)
def counts_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.counts_by_severity(_compared(spark, sf_dir).findings)


_TYPE_SUMS = "count(*) FILTER (type = 'excess') AS excess, count(*) FILTER (type = 'missing') AS missing, count(*) FILTER (type = 'different') AS different"


@query(f"""SELECT * FROM (SELECT permission, count(*) FILTER (type = 'ok') AS ok, {_TYPE_SUMS}, count(*) FILTER (type NOT IN ('ok', 'excess', 'missing', 'different')) AS other
    FROM single WHERE permission <> '' GROUP BY permission) WHERE excess + missing + different + other > 0""", pairs=True)
def rollup_by_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.by_permission(_compared(spark, sf_dir, order=False, texts=False, keep=False).pairs)


@query(f"""SELECT subject, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
    count(*) FILTER (severity = 'info') AS info, {_TYPE_SUMS}, count(*) FILTER (type NOT IN ('excess', 'missing', 'different')) AS other FROM found GROUP BY subject""", pairs=True)
def rollup_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.by_subject(_compared(spark, sf_dir).findings)


@query("""SELECT subject, coalesce(string_agg(CASE WHEN type = 'excess' THEN permission END, '; ' ORDER BY permission), '') AS remove,
    coalesce(string_agg(CASE WHEN type = 'missing' AND severity <> 'info' THEN permission END, '; ' ORDER BY permission), '') AS "grant",
    count(*) FILTER (type = 'different' OR (type = 'permission-not-in-baseline' AND severity = 'low')) AS n_review FROM found
    WHERE type IN ('excess', 'different', 'user-not-in-baseline', 'user-not-in-actual') OR (type = 'missing' AND severity <> 'info') OR (type = 'permission-not-in-baseline' AND severity = 'low') GROUP BY subject""", pairs=True)
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.actions(_compared(spark, sf_dir).findings)
    return out.select("subject", F.array_join("remove", "; ").alias("remove"), F.array_join("grant", "; ").alias("grant"), F.size("review").cast("long").alias("n_review"))


@query("""SELECT (SELECT count(*) FROM single WHERE type IN ('ok', 'excess', 'missing', 'different')) AS compared,
    CASE WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium') THEN 'medium' WHEN bool_or(severity = 'low') THEN 'low' ELSE 'info' END AS worst,
    NOT bool_or(severity IN ('high', 'medium')) AS passed, CAST(bool_or(severity IN ('high', 'medium')) AS INT) AS exit_code FROM found""", pairs=True)
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _compared(spark, sf_dir)
    return rollup.verdict(result.pairs, result.findings)


@query("""SELECT 'subject' AS kind, (SELECT count(*) FROM bs) AS baseline, (SELECT count(*) FROM asub) AS actual, (SELECT count(*) FROM bs JOIN asub USING (subject)) AS both
    UNION ALL SELECT 'permission', (SELECT count(*) FROM bp), (SELECT count(*) FROM ap), (SELECT count(*) FROM bp JOIN ap USING (permission))""", pairs=True)
def set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = cmp.both_sides(*sides(spark, sf_dir), cmp.Options(match_by_name=False))
    return rollup.sizes(both.side("b"), both.side("a"))


@query("""SELECT subject, permission, CASE WHEN type IN ('missing', 'permission-not-in-actual') AND bv IS NOT NULL AND av IS NULL AND sa THEN CASE WHEN bv NOT IN ('Y', 'N') THEN 'different' WHEN bv = 'N' THEN 'ok' ELSE 'missing' END ELSE type END AS type
    FROM pairs WHERE bv IS NOT NULL""", pairs=True)
def listed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a = sides(spark, sf_dir)
    result = cmp.compare(b, a.withColumn("listed_only", F.lit(True)), cmp.Options(suggest=False, match_by_name=False))
    return result.pairs.filter("has_baseline").select("subject", "permission", "type")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE NOT (regexp_full_match(lower(s_name), '.*0000[1-3]') OR lower(s_name) = 'supplier#000000050') AND regexp_full_match(lower(s_name), 'supplier.*')""")
def glob_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ~matches_glob(F.col("s_name"), "*00001, *00002,*00003 ,SUPPLIER#000000050") & matches_glob(F.col("s_name"), "supplier*")
    return table(spark, sf_dir, "supplier").filter(keep).select("s_suppkey", "s_name")


_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_GRANTED, _NOT = ("(" + ",".join(f"'{x}'" for x in listed) + ")" for listed in (GRANTED, NOT_GRANTED))
_VALUES = """(SELECT DISTINCT l_returnflag AS raw FROM lineitem UNION SELECT DISTINCT o_orderstatus FROM orders UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT DISTINCT event_type FROM events
    UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT unnest(['x - added 1/16', 'Full Access', 'N/A', 'Read Only', 'x-', ' yes ', '', 'not added', 'Off']))"""


@query(f"""SELECT raw, CASE WHEN k IN {_GRANTED} THEN 'Y' WHEN k IN {_NOT} THEN 'N' WHEN regexp_matches(k, '^(x|y|yes)( |$)') OR regexp_matches(k, '(^| )added( |$)') THEN 'Y' ELSE k END AS value,
    trim(raw) <> '' AND k NOT IN {_GRANTED} AND k NOT IN {_NOT} AS annotated FROM (SELECT raw, {_KEY.format('raw')} AS k FROM {_VALUES})""")
def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [("lineitem", "l_returnflag"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("events", "event_type"), ("customer", "c_mktsegment")]
    rows = spark.createDataFrame([(x,) for x in ("x - added 1/16", "Full Access", "N/A", "Read Only", "x-", " yes ", "", "not added", "Off")], "raw string")
    for name, column in named:
        rows = rows.unionByName(table(spark, sf_dir, name).select(F.col(column).alias("raw")).distinct())
    return rows.distinct().select("raw", normalize_value(F.col("raw")).alias("value"), is_annotated(F.col("raw")).alias("annotated"))


@query(f"""SELECT DISTINCT l_returnflag AS raw, CASE l_returnflag WHEN 'A' THEN 'Y (A)' WHEN 'N' THEN 'N' ELSE 'r' END AS shown, l_returnflag <> 'N' AS granted FROM lineitem""")
def show_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("raw")).distinct().withColumn("value", normalize_value(F.col("raw")))
    return rows.select("raw", show(F.col("value"), F.col("raw")).alias("shown"), is_granted(F.col("value")).alias("granted"))


@query(f"""SELECT p_partkey, {_KEY.format('p_name')} AS key, {_KEY.format('p_brand')} || ' > ' || {_KEY.format('p_type')} AS permission_key, {_KEY.format('p_type')} AS short, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS cleaned FROM part""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = perm_key(F.concat("p_brand", F.lit(" > > "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", norm_key(F.col("p_name")).alias("key"), full.alias("permission_key"), short_name(full).alias("short"), clean(F.col("p_name")).alias("cleaned"))


@query("""SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("cell", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).otherwise(""))
    return records.carry_forward(rows, "cell", ["user_id"], ["ts", "event_id"], "carried").select("event_id", "carried")


@query("""SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def carry_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one sheet, carried by several tasks."""
    rows = table(spark, sf_dir, "events").withColumn("cell", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).otherwise(""))
    return records.carry_forward(rows, "cell", [], ["ts", "event_id"], "carried", ranges=8).select("event_id", "carried")


@query("""SELECT s_name AS permission, unnest(['Even', 'Rich', 'Nation']) AS subject, unnest([CASE WHEN s_suppkey % 2 = 0 THEN 'Y' ELSE 'N' END, CASE WHEN s_acctbal > 5000 THEN 'Y' ELSE 'N' END, 'level ' || s_nationkey]) AS value, CAST(s_suppkey + 2 AS INT) AS row FROM supplier""")
def melt_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of suppliers (down) by three columns, as cells, melted."""
    row = (F.col("s_suppkey") + 2).cast("int").alias("row")
    held = F.array("s_name", F.when(F.col("s_suppkey") % 2 == 0, "X").otherwise(""), F.when(F.col("s_acctbal") > 5000, "yes").otherwise(""), F.concat(F.lit("Level "), F.col("s_nationkey").cast("string")))
    grid = table(spark, sf_dir, "supplier").select(F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.lit(0).alias("sheet_no"), row, held.alias("cells"), F.transform(held, lambda x: F.lit("str")).alias("kinds"))
    out = records.matrix_records(grid, 1, ["Security Setting", "Even", "Rich", "Nation"], 0, 1)
    return out.select("permission", "subject", "value", "row")


@query("""SELECT conv_id, turn, heading FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading
    FROM conversations) WHERE role <> 'system'""")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("heading", F.when(F.col("role") == "system", F.col("text")).otherwise(""))
    return records.carry_forward(rows, "heading", ["conv_id"], ["turn"]).filter("role <> 'system'").select("conv_id", "turn", "heading")


_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_partkey", "l_returnflag", F.col("l_returnflag").alias("value"), F.struct(*_LINE_ORDER).alias("ord"))


@query(f"""SELECT l_partkey, max_by(l_returnflag, o) AS last_value, min_by(l_returnflag, o) AS first_value FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(_LINE_ORDER)}) AS o FROM lineitem) GROUP BY l_partkey""")
def last_and_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    last = cmp.last_wins(rows, ["l_partkey"]).select("l_partkey", F.col("value").alias("last_value"))
    return last.join(cmp.first_wins(rows, ["l_partkey"]).select("l_partkey", F.col("value").alias("first_value")), "l_partkey")


@query(f"""SELECT l_partkey, count(*) AS n, bool_or(coalesce(l_returnflag <> before, false)) AS conflict FROM (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_partkey ORDER BY {', '.join(_LINE_ORDER)}) AS before FROM lineitem) GROUP BY l_partkey HAVING count(*) > 1""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.duplicates(_lines(spark, sf_dir), ["l_partkey"])


def _role_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order priorities held by market segments, and customers with their segment as role."""
    customers = table(spark, sf_dir, "customer")
    held = customers.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("subject"), F.col("o_orderpriority").alias("permission")).distinct()
    return held.unionByName(spark.createDataFrame([("Auditors", "1-URGENT")], "subject string, permission string")), customers.select(F.col("c_name").alias("user"), F.col("c_mktsegment").alias("role"))


_ROLES_SQL = """WITH held AS (SELECT DISTINCT c_mktsegment AS subject, o_orderpriority AS permission FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT 'Auditors', '1-URGENT'),
    users AS (SELECT c_name AS "user", c_mktsegment AS role FROM customer)"""


@query(_ROLES_SQL + """ SELECT "user" AS subject, permission, role FROM held JOIN users ON subject = role UNION ALL SELECT subject, permission, NULL FROM held WHERE subject NOT IN (SELECT role FROM users)""")
def role_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, users = _role_records(spark, sf_dir)
    return records.expand_roles(held, users).select("subject", "permission", "role")


@query(_ROLES_SQL + """ SELECT DISTINCT 'role without records' AS side, role AS name FROM users WHERE role NOT IN (SELECT subject FROM held) UNION ALL SELECT DISTINCT 'subject without role', subject FROM held WHERE subject NOT IN (SELECT role FROM users)""")
def role_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.role_gaps(*_role_records(spark, sf_dir))


@query("""SELECT n_nationkey, coalesce(t, n_name) AS key FROM nation LEFT JOIN (SELECT n_name AS f, r_name || ' ' || n_name AS t FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')) ON f = n_name""")
def alias_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    aliases = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name IN ('ASIA', 'EUROPE')").select(F.lit("subject").alias("kind"), F.col("n_name").alias("from_key"), F.concat_ws(" ", "r_name", "n_name").alias("to_key"))
    return match.rewrite(nations.select("n_nationkey", F.col("n_name").alias("key")), "key", aliases, "subject").select("n_nationkey", "key")


_NAMES_SQL = """WITH l AS (SELECT DISTINCT lower(p_brand) || ' > ' || lower(p_type) || ' ' || p_size || ' ' || CAST(floor(p_retailprice) AS BIGINT) AS key, lower(p_type) || ' ' || p_size || ' ' || CAST(floor(p_retailprice) AS BIGINT) AS s FROM part),
    r AS (SELECT DISTINCT 'old > ' || lower(p_type) || ' ' || p_size || ' ' || CAST(floor(p_retailprice) AS BIGINT) AS key, lower(p_type) || ' ' || p_size || ' ' || CAST(floor(p_retailprice) AS BIGINT) AS s FROM part),
    lu AS (SELECT s, max(key) AS f FROM l GROUP BY s HAVING count(*) = 1), ru AS (SELECT s, max(key) AS t FROM r GROUP BY s HAVING count(*) = 1)"""


@query(_NAMES_SQL + " SELECT f AS from_key, t AS to_key FROM lu JOIN ru USING (s) WHERE f NOT IN (SELECT key FROM r) AND t NOT IN (SELECT key FROM l)")
def unique_bare_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", F.lower("p_type"), F.col("p_size").cast("string"), F.floor("p_retailprice").cast("string"))
    left = parts.select(F.concat(F.lower("p_brand"), F.lit(" > "), name).alias("key")).distinct()
    right = parts.select(F.concat(F.lit("old > "), name).alias("key")).distinct()
    return match.unique_matches(*(x.withColumn("short", short_name(F.col("key"))) for x in (left, right)), "short")


@query("""SELECT lower(s_name) || ' (old)' AS from_key, lower(s_name) AS to_key FROM supplier""")
def unique_plain_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import plain_key

    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.lower("s_name").alias("key"))
    left = suppliers.select(F.concat("key", F.lit(" (old)")).alias("key"))
    return match.unique_matches(*(x.select("key", plain_key(F.col("key")).alias("plain")) for x in (left, suppliers)), "plain")


_SIM = """CASE WHEN a = b THEN 1.0::DOUBLE ELSE greatest(j * 6e-1 + n * 4e-1, n, CASE WHEN len(ta) > 1 AND i = len(ta) THEN 9e-1 ELSE 0e0 END) END"""


@query(f"""SELECT a, b, distance, round(j, 9) AS jaccard, round({_SIM}, 9) AS score FROM (SELECT *, levenshtein(a, b) AS distance, 1e0 - levenshtein(a, b) / greatest(length(a), length(b), 1)::DOUBLE AS n, len(list_intersect(ta, tb)) AS i,
    len(list_intersect(ta, tb)) / greatest(len(list_distinct(list_concat(ta, tb))), 1)::DOUBLE AS j
    FROM (SELECT a, b, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM (SELECT min(p_name) AS a FROM part GROUP BY p_type UNION SELECT max(p_name) FROM part GROUP BY p_type UNION SELECT min(p_name) || ' old' FROM part GROUP BY p_type), (SELECT DISTINCT p_name AS b FROM part)) GROUP BY ALL)""")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of names (the first and last of each type, and the first with a word more) against all names."""
    names = table(spark, sf_dir, "part")
    asked = {y for x in names.groupBy("p_type").agg(F.min("p_name"), F.max("p_name"), F.concat(F.min("p_name"), F.lit(" old"))).collect() for y in x[1:]}  # three names a type
    pairs = names.select(F.explode(F.array(*map(F.lit, sorted(asked)))).alias("a"), F.col("p_name").alias("b")).distinct()
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", edit_distance(a, b).cast("long").alias("distance"), F.round(token_jaccard(a, b), 9).alias("jaccard"), F.round(similarity(a, b), 9).alias("score"))


_SCORED = """(SELECT *, 1e0 - levenshtein(a, b) / greatest(length(a), length(b), 1)::DOUBLE AS n, len(list_intersect(ta, tb)) AS i, len(list_intersect(ta, tb)) / greatest(len(list_distinct(list_concat(ta, tb))), 1)::DOUBLE AS j
    FROM (SELECT a, b, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM (SELECT DISTINCT substr(p_name, 1, length(p_name) - 2) AS a FROM part), (SELECT DISTINCT p_name AS b FROM part)))"""


@query(f"""SELECT a AS key, max_by(b, (s, -o)) AS suggestion, round(max(s), 2) AS score FROM (SELECT a, b, {_SIM} AS s, dense_rank() OVER (ORDER BY b) AS o FROM {_SCORED}) WHERE s > 72e-2 GROUP BY a""")
def closest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    wanted = names.select(F.expr("substring(p_name, 1, length(p_name) - 2)").alias("key"))
    candidates = names.select(F.col("p_name").alias("key"), F.col("p_name").alias("display"), F.col("p_name").alias("ord"))
    return match.closest(wanted, candidates).select("key", "suggestion", "score")


@query(f"""SELECT a AS key, max_by(b, (s, -o)) AS suggestion, round(max(s), 2) AS score FROM (SELECT a, b, {_SIM} AS s, dense_rank() OVER (ORDER BY b) AS o FROM {_SCORED}) WHERE s > 5e-1 GROUP BY a""")
def closest_name_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    wanted = names.select(F.expr("substring(p_name, 1, length(p_name) - 2)").alias("key"))
    candidates = names.select(F.col("p_name").alias("key"), F.col("p_name").alias("display"), F.col("p_name").alias("ord"))
    return match.closest(wanted, candidates, 0.5).select("key", "suggestion", "score")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types in all brands but one as catalog settings; the brand is the group."""
    rows = table(spark, sf_dir, "part").filter("p_brand <> 'Brand#3'").select(F.concat_ws(" ", "p_type", "p_brand").alias("name"), F.col("p_name").alias("description"), F.col("p_type").alias("type"), F.col("p_brand").alias("grp"), F.col("p_partkey").alias("ord"))
    return cat.catalog(rows)


_CATALOG_SQL = f"""WITH cat AS (SELECT {_KEY.format("p_type || ' ' || p_brand")} AS key, min_by(p_type || ' ' || p_brand, p_partkey) AS name, min_by(p_brand, p_partkey) AS grp, min_by(p_name, p_partkey) AS description FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1),
    held AS (SELECT s_name, 'Area ' || p_size % 2 || ' > ' || p_type || ' ' || p_brand AS permission, {_KEY.format("p_type || ' ' || p_brand")} AS key, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    name = F.concat(F.lit("Area "), (F.col("p_size") % 2).cast("string"), F.lit(" > "), "p_type", F.lit(" "), "p_brand")
    return lines.select(F.col("s_name").alias("subject"), name.alias("permission"), normalize_value(F.col("l_returnflag")).alias("value"))


@query(_CATALOG_SQL + " SELECT DISTINCT permission, grp, description FROM held LEFT JOIN cat USING (key)")
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.enrich(_held(spark, sf_dir).select("permission").distinct(), _catalog(spark, sf_dir)).select("permission", "grp", "description")


_COVER = """, cover AS (SELECT c.*, EXISTS (SELECT 1 FROM held h WHERE h.key = c.key AND h.permission LIKE 'Area 0%') AS in_baseline, (SELECT count(*) FROM held h WHERE h.key = c.key AND l_returnflag <> 'N') AS granted_to FROM cat c)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held(spark, sf_dir)
    return cat.coverage(_catalog(spark, sf_dir), held.filter("permission LIKE 'Area 0%'").select(F.col("permission").alias("display")).distinct(), held)


@query(_CATALOG_SQL + _COVER + " SELECT name, grp, in_baseline, granted_to FROM cover")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).select("name", "grp", "in_baseline", "granted_to")


@query(_CATALOG_SQL + _COVER + " SELECT grp, count(*) AS total, count(*) FILTER (in_baseline) AS covered, count(*) FILTER (NOT in_baseline AND granted_to > 0) AS granted_uncovered FROM cover GROUP BY grp")
def coverage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.coverage_by_group(_covered(spark, sf_dir))


@query(f"""WITH cat AS (SELECT {_KEY.format("p_type || ' ' || p_brand")} AS key FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1), names AS (SELECT DISTINCT 'Area > ' || p_type || ' ' || p_brand || CASE WHEN p_size > 40 THEN ' zzqqxxyy kkjjww vvvv' ELSE '' END AS permission,
    {_KEY.format("p_type || ' ' || p_brand || CASE WHEN p_size > 40 THEN ' zzqqxxyy kkjjww vvvv' ELSE '' END")} AS key FROM part WHERE p_brand <> 'Brand#7')
    SELECT 'known' AS side, permission AS name FROM names WHERE key IN (SELECT key FROM cat) UNION ALL SELECT 'unknown', permission FROM names WHERE key NOT IN (SELECT key FROM cat) UNION ALL SELECT 'uncovered', key FROM cat WHERE key NOT IN (SELECT key FROM names)""")
def catalog_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("p_size") > 40, " zzqqxxyy kkjjww vvvv").otherwise("")
    names = table(spark, sf_dir, "part").filter("p_brand <> 'Brand#7'").select(F.concat(F.lit("Area > "), "p_type", F.lit(" "), "p_brand", odd).alias("permission"))
    known, unknown, uncovered = cat.cross_check(names, _catalog(spark, sf_dir))
    out = known.select(F.lit("known").alias("side"), F.col("permission").alias("name")).unionByName(unknown.select(F.lit("unknown").alias("side"), F.col("permission").alias("name")))
    return out.unionByName(uncovered.select(F.lit("uncovered").alias("side"), F.col("key").alias("name")))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _segment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.col("c_mktsegment").alias("subject"), F.concat(F.lit("Orders > "), "o_orderpriority").alias("permission"), F.when(F.col("o_orderstatus") == "O", "Y").when(F.col("o_orderstatus") == "F", "N").otherwise("p").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("ord"))


_SEGMENT_SQL = """WITH last AS (SELECT c_mktsegment AS subject, o_orderpriority AS setting, CASE o_orderstatus WHEN 'O' THEN 'Y' WHEN 'F' THEN 'N' ELSE 'p' END AS value FROM orders JOIN customer ON c_custkey = o_custkey
    QUALIFY row_number() OVER (PARTITION BY c_mktsegment, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


@query(_SEGMENT_SQL + " SELECT setting, count(*) FILTER (value <> 'N') AS held_by, " + ", ".join(f"max(CASE WHEN subject = '{s}' THEN CASE value WHEN 'Y' THEN 'X' WHEN 'N' THEN '' ELSE value END END) AS {s}" for s in _SEGMENTS) + " FROM last GROUP BY setting")
def pivot_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.inventory(_segment_records(spark, sf_dir), _SEGMENTS)


@query(_SEGMENT_SQL + " SELECT setting, count(*) FILTER (value <> 'N') AS held_by, coalesce(string_agg(CASE WHEN value <> 'N' THEN subject END, ', ' ORDER BY subject), '') AS who FROM last GROUP BY setting")
def inventory_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.setting_list(_segment_records(spark, sf_dir))


@query(_SEGMENT_SQL + " SELECT subject, count(*) FILTER (value <> 'N') AS held, count(*) AS listed FROM last GROUP BY subject")
def inventory_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.subject_list(_segment_records(spark, sf_dir))


@query("SELECT permission, subject, CASE WHEN type = 'ok' THEN regexp_replace(actual, ' \\(.*\\)$', '') ELSE coalesce(nullif(expected, ''), '—') || ' → ' || coalesce(nullif(actual, ''), '—') END AS cell FROM pairs", pairs=True)
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivot of all subjects in tiles, and back to a row for each cell."""
    tiles = inv.side_by_side_tiles(_compared(spark, sf_dir).pairs)
    return tiles.select("permission", F.inline("cells")).select("permission", "subject", "cell")


@query("""WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT 'union' AS op, k FROM (SELECT k FROM l UNION SELECT k FROM r) UNION ALL SELECT 'intersection', k FROM (SELECT k FROM l INTERSECT SELECT k FROM r) UNION ALL SELECT 'difference', k FROM (SELECT k FROM l EXCEPT SELECT k FROM r)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    left, right = orders.filter("o_orderstatus = 'P'").select("k"), orders.filter("o_orderpriority = '1-URGENT'").select("k")
    parts = {"union": left.union(right).distinct(), "intersection": left.intersect(right), "difference": left.exceptAll(left.intersect(right)).distinct().join(right, "k", "left_anti")}
    out = None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("op"), "k")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def profile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.profile(table(spark, sf_dir, "events"), "event_type")


@query("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ORDER BY n DESC, o_custkey LIMIT 12")
def top_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.profile(table(spark, sf_dir, "orders"), "o_custkey").limit(12)


_ROLE_WORDS = "|".join(records.ROLE_WORDS)


@query(f"""SELECT (count(*) FILTER (regexp_matches(k, '(^| )({_ROLE_WORDS})( |$)')) / count(*)::DOUBLE) AS share, count(*) FILTER (regexp_matches(k, '(^| )({_ROLE_WORDS})( |$)')) * 2 >= count(*) AS looks_like_roles
    FROM (SELECT DISTINCT lower(role) AS k FROM conversations UNION SELECT unnest(['provider', 'rn pool', 'ma', 'billing admin', 'support staff', 'it analyst', 'lvn', 'manager']))""")
def role_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("subject")).distinct()
    return records.looks_like_roles(rows.unionByName(spark.createDataFrame([(x,) for x in ("Provider", "RN pool", "MA", "Billing Admin", "Support Staff", "IT analyst", "LVN", "Manager")], "subject string")))


@query("""SELECT conv_id, turn, g, k, sum(1) OVER (PARTITION BY g, k) AS same_place FROM (SELECT conv_id, turn, g, row_number() OVER (PARTITION BY conv_id, g ORDER BY turn) AS k FROM (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM conversations))""")
def positional_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.positions(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    counts = rows.groupBy("g", "k").agg(F.count(F.lit(1)).alias("same_place"))
    return rows.join(counts, ["g", "k"]).select("conv_id", "turn", "g", "k", "same_place")


@query("SELECT CAST(conv_id AS VARCHAR) AS role, count(*) AS rows, CAST(0 AS INT) AS gaps FROM conversations GROUP BY conv_id")
def frame_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows over each conversation, as frames of bands, merged back into its turns."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("role"), "turn", F.md5("text").alias("m"))
    profile = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring("m", i + 1, F.lit(1)), 16, 10).cast("int") * 10 + 20)
    band = F.struct(F.when(F.col("turn") == 0, "group").otherwise("data").alias("kind"), F.lit(False).alias("checked"), F.lit(False).alias("cut_top"), F.lit(False).alias("cut_bottom"), profile.alias("fp"))
    dealt = turns.select("role", "turn", band.alias("band"), F.explode(F.array(F.floor(F.col("turn") / 2), F.greatest(F.floor(F.col("turn") / 2) - 1, F.lit(0)))).alias("frame_no")).distinct()
    framed = dealt.groupBy("role", "frame_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "band"))), lambda x: x["band"]).alias("bands"))
    return frames.merge_frames(framed).groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.max("gaps").alias("gaps"))
