"""Quality rules by distribution divergence, in DataFrame and SQL functions only.

Per document: the shares of character classes and the shares of its language's common words (as written), each
held against the language's reference by Jensen-Shannon distance (base 2, so 0 to 1). References are
the median shares over all documents of the language (junk in a minority doesn't move them); languages without a word list share one reference
and skip the word rule. Short texts are guarded: below min_chars characters or min_words words the
respective distance is not judged.

Defined results: a null text counts as empty (no words, so base_failed), a null language as
unlisted, distances that are not judged are null and don't fail a document. Rows are independent
but for the references, so repeated rows and ids count again. A text of any length is one row's work: its
words are held as an array. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Common words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "on", "it"],
    "fr": ["le", "la", "de", "et", "les", "des", "un", "en", "que", "pour", "qui", "du"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "ein", "nicht"],
    "es": ["el", "la", "de", "que", "en", "los", "se", "del", "las", "un", "por", "con"],
}
#: Character classes that are counted; the rest (mostly a-z) and white space make two more.
CLASSES = {
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "stop": "[.,;:!?'\"()-]+",
    "symbol": r"[#$%&*+/<=>@\[\\\]^_`{|}~]+",
    "beyond": r"[^\x00-\x7F]+",
}
WHITE = " \t\n\x0b\x0c\r"
#: Decimal places of shares where references are sought.
PLACES = 4


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    char_distance: float = 0.20
    word_distance: float = 0.22
    judged_chars: int = 200
    judged_words: int = 100
    #: Up to so many words (65,536 at most) a window's hash and place are packed into one number.
    packed_words: int = 65_536
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def _without(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _shares(counts: list[Column]) -> Column:
    total = sum(counts[1:], counts[0]).cast("double")
    return F.when(total > 0, F.transform(F.array(*counts), lambda x: x.cast("double") / total))


def _same_hash(j: str) -> str:
    return f"shiftright(x, 16) = shiftright(get(packed, {j}), 16)"


#: Windows whose hashes are equal though their words aren't.
_CLASH = f"""exists(transform(packed, (x, j) -> j > 0 AND {_same_hash("j - 1")} AND NOT ({" AND ".join(f"get(words, int(x & 65535) + {k}) = get(words, int(get(packed, j - 1) & 65535) + {k})" for k in range(3))})), y -> y)"""


def _repeated_words() -> Column:
    """Words inside three-word windows that are found twice or more; reads packed (null where hashes don't tell windows apart), windows and n_words."""
    packed = f"""
        aggregate(sort_array(transform(
            filter(packed, (x, j) -> (j > 0 AND {_same_hash("j - 1")}) OR (j < size(packed) - 1 AND {_same_hash("j + 1")})),
            x -> x & 65535L)), named_struct('p', -3L, 'n', 0L),
            (a, p) -> named_struct('p', p, 'n', a.n + least(3L, p - a.p)), a -> a.n)"""
    # else the windows themselves are sorted
    whole = """
        aggregate(sort_array(transform(
            filter(windows, (x, j) -> (j > 0 AND x.w = get(windows, j - 1).w) OR (j < size(windows) - 1 AND x.w = get(windows, j + 1).w)),
            x -> x.p)), named_struct('p', -3L, 'n', 0L),
            (a, p) -> named_struct('p', p, 'n', a.n + least(3L, p - a.p)), a -> a.n)"""
    return F.expr(f"CASE WHEN n_words < 4 THEN 0L WHEN packed IS NOT NULL THEN {packed} ELSE {whole} END")


def counted(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, key (language or 'other'), the counts of each text, and chars and common (its two histograms as shares)."""
    text = F.coalesce(docs["text"], F.lit(""))
    key = F.when(docs["lang"].isin(list(rules.common_words)), docs["lang"]).otherwise("other")
    out = docs.select(docs["doc_id"], key.alias("key"), text.alias("text"))
    flat = F.col("text")
    for c in WHITE[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    out = out.withColumn("flat", flat)
    out = out.withColumn("words", F.array_remove(F.split("flat", " "), "")).withColumn("solid", F.replace("flat", F.lit(" "), F.lit("")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    out = out.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        # a-z go first, so the other classes are sought in what little is left
        F.regexp_replace("solid", "[a-z]+", "").alias("left"),
        F.concat(F.lit(" "), F.replace("flat", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("spaced"),
        lines.alias("lines"),
    )
    out = out.select("*", *[_without(F.col("left"), p).alias(f"c_{k}") for k, p in CLASSES.items()])
    n_left, n_white = F.length("left"), F.length("text") - F.col("word_chars")
    rest = n_left - sum((F.col(f"c_{k}") for k in CLASSES), F.lit(0))
    counts = [*(F.col(f"c_{k}") for k in CLASSES), n_white.cast("long"), (F.col("word_chars") - n_left).cast("long"), rest.cast("long")]
    common = F.lit(None).cast("array<double>")
    for k, listed in rules.common_words.items():
        hits = [((F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(f" {w} "), F.lit("")))) / F.lit(float(len(w.encode()) + 2))) for w in listed]
        shares = F.transform(F.array(*hits), lambda x: x / F.col("n_words"))
        common = F.when(F.col("key") == k, shares).otherwise(common)
    out = out.withColumn("listed", F.when(F.col("n_words") > 0, common))
    packed = "transform(sequence(0, size(words) - 3), i -> shiftleft(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), 16) | bigint(i))"
    whole = "sort_array(transform(sequence(0, size(words) - 3), i -> named_struct('w', array(get(words, i), get(words, i + 1), get(words, i + 2)), 'p', bigint(i))))"
    out = out.withColumn("packed", F.expr(f"CASE WHEN n_words BETWEEN 4 AND {rules.packed_words} THEN sort_array({packed}) END"))
    out = out.withColumn("packed", F.expr(f"CASE WHEN NOT {_CLASH} THEN packed END"))
    out = out.withColumn("windows", F.expr(f"CASE WHEN n_words > 3 AND packed IS NULL THEN {whole} END"))
    return out.select(
        "doc_id",
        "key",
        "n_words",
        "word_chars",
        # none of them is a letter or white space
        _without(F.col("left"), "[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words().alias("n_repeat_words"),
        F.length("text").alias("n_chars"),
        _shares(counts).alias("chars"),
        F.concat("listed", F.array(1.0 - F.aggregate("listed", F.lit(0.0), lambda a, x: a + x))).alias("common"),
    )


def references(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """key, char_reference, word_reference: each language's median share (to four places, so few values are told apart), scaled to the sum 1."""
    wide = {"chars": len(CLASSES) + 3, "common": 1 + max(map(len, rules.common_words.values()))}
    middle = [F.percentile(F.round(F.get(c, F.lit(i)), PLACES), F.lit(0.5)).alias(f"{c}_{i}") for c, n in wide.items() for i in range(n)]
    out = counts.filter(F.col("n_words") > 0).groupBy("key").agg(*middle)
    for c, n in wide.items():
        out = out.withColumn(c, F.array_compact(F.array(*(F.col(f"{c}_{i}") for i in range(n)))))
        out = out.withColumn(c, F.expr(f"transform({c}, x -> x / aggregate({c}, 0D, (a, y) -> a + y))"))
    return out.select("key", F.col("chars").alias("char_reference"), F.col("common").alias("word_reference"))


def _distance(share: str, reference: str) -> Column:
    """Jensen-Shannon distance of two arrays of shares; null if either is missing."""
    term = "IF(p > 0, p * log2(2 * p / (p + q)), 0D) + IF(q > 0, q * log2(2 * q / (p + q)), 0D)"
    total = f"aggregate(zip_with({share}, {reference}, (p, q) -> {term}), 0D, (a, x) -> a + x)"
    return F.expr(f"CASE WHEN size({share}) = size({reference}) THEN sqrt(greatest(0D, {total} / 2)) END")


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance."""
    # texts are read once: references and verdicts come from the counts
    counts = cut(counted(docs, rules))
    # at most one row per listed language and one more: its size is fixed by the rules
    out = counts.join(F.broadcast(references(counts, rules)), "key", "left")
    out = out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.when(F.col("n_chars") >= rules.judged_chars, _distance("chars", "char_reference")).alias("char_distance"),
        F.when((F.col("n_words") >= rules.judged_words) & (F.col("key") != "other"), _distance("common", "word_reference")).alias("word_distance"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > rules.char_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > rules.word_distance)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)
