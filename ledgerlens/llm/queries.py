"""The corpus queries by name and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, filter_audit, kneser_ney, licenses, minhash, ngram_join, quality_model, quality_rules, sentence_pieces, substring_dedup, token_files, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("matches")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), digests=True)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(_table(spark, sf_dir, "documents"), 7, 2)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_table(spark, sf_dir, "documents"), 50, digests=True)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"), 3, 90).drop("n_links")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 1)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, _table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(_table(spark, sf_dir, "documents"), 5, 85)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 16)


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_files": op6_token_files,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_model": op8_quality_model,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_minhash": op11_minhash,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}
_BLANK = "[ \\t\\n\\x0b\\x0c\\r]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _rules_sql(rules: quality_rules.Rules = quality_rules.Rules()) -> str:
    """op10: counts, median shares by language, Jensen-Shannon distances."""
    classes = [*quality_rules.CLASSES.values(), "[ \\t\\n\\x0b\\x0c\\r]", "[a-z]"]
    n = [f"length(text) - length(regexp_replace(text, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))" for c in classes]
    rest = f"length(text) - length(regexp_replace(regexp_replace(text, '[A-Za-z0-9]|[^\\x00-\\x7F]|[ \\t\\n\\x0b\\x0c\\r]', '', 'g'), '{quality_rules.CLASSES['stop'].replace(chr(39), chr(39) * 2)}|{quality_rules.CLASSES['symbol']}', '', 'g'))"
    rest = f"length(text) - ({rest})"
    listed = " ".join(f"WHEN '{k}' THEN [{', '.join(chr(39) + w + chr(39) for w in ws)}]" for k, ws in rules.common_words.items())
    middle = lambda c: f"(SELECT list(m ORDER BY i) FROM (SELECT i, quantile_cont(round({c}[i], {quality_rules.PLACES}), 0.5) AS m FROM s AS x, range(1, 30) AS r(i) WHERE x.key = k.key AND x.n_words > 0 AND i <= len({c}) GROUP BY i))"
    scaled = lambda c: f"list_transform({c}, lambda x: x / list_sum({c}))"
    term = lambda p, q: f"CASE WHEN {p}[i] > 0 THEN {p}[i] * log2(2 * {p}[i] / ({p}[i] + {q}[i])) ELSE 0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] * log2(2 * {q}[i] / ({p}[i] + {q}[i])) ELSE 0 END"
    apart = lambda p, q: f"coalesce(sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(p, q)})) / 2)), 0)"
    return f"""WITH d AS (SELECT doc_id, CASE WHEN lang IN ({', '.join(chr(39) + k + chr(39) for k in rules.common_words)}) THEN lang ELSE 'other' END AS key, coalesce(text, '') AS text, {_WORDS} AS ws,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ls FROM documents),
        c AS (SELECT *, len(ws) AS n_words, [{', '.join(n)}, {rest}] AS n, CASE key {listed} END AS common FROM d),
        s AS (SELECT *, CASE WHEN text <> '' THEN list_transform(n, lambda x: x / length(text)) END AS chars, CASE WHEN n_words > 0 THEN list_transform(common, lambda w: len(list_filter(ws, lambda x: x = w)) / n_words) END AS own FROM c),
        t AS (SELECT doc_id, g, unnest(list(i)) AS i, count(*) AS n FROM (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM s WHERE n_words > 2), LATERAL (SELECT array_to_string(ws[i:i + 2], ' ') AS g) GROUP BY doc_id, g HAVING count(*) > 1),
        r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t) GROUP BY doc_id),
        o AS (SELECT * REPLACE (list_append(own, 1 - list_sum(own)) AS own) FROM s),
        m AS (SELECT key, {scaled('a')} AS a, {scaled('b')} AS b FROM (SELECT key, {middle('chars')} AS a, {middle('own').replace('FROM s AS x', 'FROM o AS x')} AS b FROM (SELECT DISTINCT key FROM s) AS k)),
        j AS (SELECT doc_id, n_words, length(text) - n[{len(classes) - 1}] AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            CASE WHEN length(text) >= {rules.judged_chars} THEN {apart('chars', 'a')} ELSE 0 END AS x, CASE WHEN n_words >= {rules.judged_words} AND key <> 'other' THEN {apart('own', 'b')} ELSE 0 END AS y FROM o LEFT JOIN r USING (doc_id) LEFT JOIN m USING (key)),
        f AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM j)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x <= {rules.char_distance} AND y <= {rules.word_distance} AS kept FROM f"""


def _components_sql(width: int, percent: int) -> str:
    """found: doc_id, n_shingles, component_id of documents linked by their shingles' Jaccard similarity."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{_BLANK}'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        found AS (SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id))"""


def _audit_sql() -> str:
    """op12: failing masks per document, counted per part, then each step of each order by its masks."""
    letters, bits = "'A', 'B', 'C', 'D', 'E'", "CASE f WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END"
    apart = " AND ".join(f"o{j}.f <> o{k}.f" for k in range(1, 6) for j in range(1, k))
    return f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
        first AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
        good AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
                + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w JOIN first USING (text) LEFT JOIN good USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS t FROM m GROUP BY part, mask),
        letter AS (SELECT f, {bits} AS bit FROM (SELECT unnest([{letters}]) AS f)),
        orders AS (SELECT o1.f || o2.f || o3.f || o4.f || o5.f AS filter_order FROM letter AS o1, letter AS o2, letter AS o3, letter AS o4, letter AS o5 WHERE {apart}),
        steps AS (SELECT filter_order, step, l.bit, (SELECT coalesce(sum(b.bit), 0) FROM letter AS b WHERE strpos(filter_order, b.f) < step) AS gone FROM orders, range(1, 6) AS r(step) JOIN letter AS l ON l.f = substr(filter_order, step, 1)),
        counted AS (SELECT part, filter_order, step, bit,
            coalesce(sum(n) FILTER ((mask & (CAST(gone AS INT) | bit)) = 0), 0) AS kept,
            coalesce(sum(n) FILTER ((mask & CAST(gone AS INT)) = 0 AND (mask & bit) <> 0), 0) AS removed,
            coalesce(sum(n) FILTER ((mask & CAST(gone AS INT)) <> 0 AND (mask & bit) <> 0), 0) AS redundant,
            coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
            coalesce(sum(g) FILTER ((mask & CAST(gone AS INT)) = 0 AND (mask & bit) <> 0), 0) AS good_lost,
            coalesce(sum(t) FILTER ((mask & CAST(gone AS INT)) = 0 AND (mask & bit) <> 0), 0) AS toxic_lost FROM c, steps GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted"""


ORACLES: dict[str, str] = {
    "op4_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
        least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
        hit AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS pos FROM win JOIN least USING (g) WHERE m < doc_id) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256 FROM w LEFT JOIN hit USING (doc_id)""",
    "op5_ngram_join": f"{_components_sql(3, 90)} SELECT doc_id, n_shingles, component_id FROM found",
    "op7_decontaminate": f"""WITH w AS (SELECT doc_id, {_ALNUM} AS ws FROM documents), b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
        p AS (SELECT DISTINCT item_id, array_to_string(x, ' ') AS g, len(x) AS n FROM (SELECT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [ws] ELSE list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) END) AS x FROM b)),
        v AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w JOIN (SELECT DISTINCT n FROM p) ON len(ws) >= n)),
        f AS (SELECT doc_id, i, n, item_id FROM v JOIN p USING (g, n)),
        h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM f) GROUP BY doc_id),
        t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM f GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_warc": """WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages), f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND m < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND m < page_id THEN m END AS refers_to FROM p LEFT JOIN f USING (d)""",
    "op10_quality_rules": _rules_sql(),
    "op11_minhash": f"{_components_sql(5, 85)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM found",
    "op12_filter_audit": _audit_sql(),
}
