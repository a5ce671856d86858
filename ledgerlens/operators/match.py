"""Pairing of names between two sides: aliases, unique short names, nearest names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_key, short_name
from ..functions.similarity import similarity


def rewrite(df: DataFrame, column: str, aliases: DataFrame | None, kind: str) -> DataFrame:
    """Replaces keys by their alias (one hop). aliases: kind, from_key, to_key and, where rows have an order, ord: the last of equal from_key wins (without ord the largest to_key)."""
    if aliases is None:
        return df
    mapped = aliases.filter(F.col("kind") == kind).groupBy(F.col("from_key").alias("_from")).agg((F.max_by("to_key", "ord") if "ord" in aliases.columns else F.max("to_key")).alias("_to"))
    return df.join(mapped, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def unique_pairs(names: DataFrame) -> DataFrame:
    """from_key, to_key, baseline, actual: where one key of each side has a name, and neither key stands on the other side.

    names: name, key, display, in_baseline (else of the other side), alone (the key stands on this side only). One aggregate.
    """
    b, a = F.col("in_baseline"), ~F.col("in_baseline")
    own = F.struct("key", "display", "alone")
    out = names.groupBy("name").agg(F.count_if(b).alias("n_b"), F.count_if(a).alias("n_a"), F.max(F.when(b, own)).alias("b"), F.max(F.when(a, own)).alias("a"))
    return out.filter("n_b = 1 AND n_a = 1 AND b.alone AND a.alone").select(F.col("b.key").alias("from_key"), F.col("a.key").alias("to_key"), F.col("b.display").alias("baseline"), F.col("a.display").alias("actual"))


def unique_matches(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """from_key, to_key where one key on each side has the group's value and neither key stands on the other side. Both sides: key and the group column."""
    only_left = left.join(right.select("key"), "key", "left_anti")
    only_right = right.join(left.select("key"), "key", "left_anti")
    one = [side.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("key")).filter("n = 1") for side in (left, right)]
    pairs = one[0].select(group, F.col("key").alias("from_key")).join(one[1].select(group, F.col("key").alias("to_key")), group)
    return pairs.join(only_left.select(F.col("key").alias("from_key")), "from_key", "left_semi").join(only_right.select(F.col("key").alias("to_key")), "to_key", "left_semi").select("from_key", "to_key")


def bare(name: Column) -> Column:
    return norm_key(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?s)\(.*$", ""))


def closest_score(key: Column, candidate: Column, display: Column) -> Column:
    """How near a name is to a candidate: as a whole, by short names, and without parentheses."""
    a, b = bare(key), bare(display)
    plain = F.when((a != "") & (b != ""), similarity(a, b) * 0.97).otherwise(0.0)
    return F.greatest(similarity(key, candidate), similarity(short_name(key), short_name(candidate)) * 0.95, plain)


#: What a name is compared by, and what its similarity counts there: the key, its short name, the name without its parenthesis.
FACTORS = (1.0, 0.95, 0.97)
#: Similarity of a name whose words all stand in the other, and texts from whose length on edit distance is that of lengths.
CONTAINED, LONG = 0.9, 200
#: Commonest tokens that are told from rare ones, by steps; rows of one token that stand in one block, at most.
COMMON, BLOCK = (16, 128), 20_000


def _none() -> Column:
    return F.array().cast("array<string>")


def _grams(form: Column, q: int) -> Column:
    return F.when(F.length(form) >= q, F.transform(F.sequence(F.lit(0), F.length(form) - q), lambda i: F.concat(F.lit("g"), F.substring(form, i + 1, F.lit(q))))).otherwise(_none())


def _words(form: Column) -> Column:
    return F.transform(F.array_distinct(F.split(form, " ")), lambda w: F.concat(F.lit("w"), w))


def _rare_first(tokens: str, common: tuple[frozenset[str], ...]) -> Column:
    """Tokens (a column's name) from rare to common, each with how often it stood before (so that repeated ones are told apart)."""
    rank = lambda x: sum((F.when(x.isin(*sorted(held)), 1).otherwise(0) for held in common), F.lit(0))
    return F.array_sort(F.transform(tokens, lambda x, i: F.struct(rank(x).alias("c"), x.alias("t"), F.size(F.filter(F.slice(tokens, 1, i), lambda y: y == x)).alias("k"))))


def _prefix(ordered: str, shared: Column) -> Column:
    """Of ordered tokens of which two near forms share so many at least: the first few, one of which both have among theirs."""
    n = F.greatest(F.size(ordered) - F.greatest(shared, F.lit(1)) + 1, F.lit(0))
    return F.transform(F.slice(ordered, 1, n), lambda x: F.concat(x["t"], F.lit("#"), x["k"].cast("string")))


def _with_tokens(df: DataFrame, form: str, q: int, common: tuple[frozenset[str], ...], asked: bool) -> DataFrame:
    """df with token, a row for each that `form` has by its `least` (similarity that a pair must be over)."""
    least, n = F.col("least"), F.length(form)
    held = df.withColumn("_n", n).withColumn("_g", F.when(n <= LONG, _grams(F.col(form), q)).otherwise(_none())).withColumn("_w", _words(F.col(form)))
    held = held.withColumn("_go", _rare_first("_g", common)).withColumn("_wo", _rare_first("_w", common))
    by_letters = F.when(n <= LONG, _prefix("_go", F.floor(n * (1 - q * (1 - least)) - (q - 1) + 1e-9).cast("int") + 1)).otherwise(_none())
    by_words = _prefix("_wo", F.floor(F.size("_w") * least + 1e-9).cast("int") + 1)
    short = F.when(n < q, F.array(F.concat(F.lit("="), F.col(form)))).otherwise(_none())
    rarest = F.when(F.size("_w") > 1, F.slice("_wo", 1, 1)["t"]).otherwise(_none()) if asked else F.col("_w")
    within = F.when(least < CONTAINED, F.transform(rarest, lambda w: F.concat(F.lit("in"), w))).otherwise(_none())
    # of texts over LONG only the length counts: each meets those of its step of lengths and of both beside it
    step = F.floor(F.log(n.cast("double")) / -F.log(least)).cast("int")
    near = F.array(*(F.concat(F.lit("l"), (step + k).cast("string")) for k in ((-1, 0, 1) if asked else (0,))))
    lengths = F.when(n > LONG * least, near).otherwise(_none())
    every = F.when(least < 1, F.array_distinct(F.concat(by_letters, by_words, short, within, lengths))).otherwise(_none())  # nothing is over 1
    return held.withColumn("token", F.explode(every)).drop("_n", "_g", "_w", "_go", "_wo")


def _forms(key: Column, display: Column) -> Column:
    """kind and form, for each way of comparing."""
    held = [key, short_name(key), bare(display)]
    every = F.array(*(F.struct(F.lit(k).alias("kind"), f.alias("form")) for k, f in enumerate(held)))
    return F.filter(every, lambda x: (x["kind"] != 2) | (x["form"] != ""))


def closest(names: DataFrame, candidates: DataFrame, threshold: float = 0.72, by: tuple[str, ...] = (), *, block: int = BLOCK) -> DataFrame:
    """key, suggestion, suggested_key, score: the nearest candidate over the threshold (the first of equals).

    names: key; candidates: key, display, ord; both also have the columns of by, which must be equal. A pair over the
    threshold is near by letters, by words, or has all words of the name in the candidate. Near by letters: few edits
    leave most grams alone, so of the grams in order of rarity one of the first few is shared, and lengths are alike.
    Near by words: the same with words. Contained: the name's rarest word stands in the candidate. Only pairs that
    share such a token are scored, each distinct pair of forms once; what the filters leave out can't be over the
    threshold. The rows of a token that many candidates have are split into blocks of about `block` rows.
    """
    if not 0.45 <= threshold < 1:
        raise ValueError("the filters hold for thresholds from 0.45 to 1")
    left = names.select(*by, "key").distinct()
    left = left.select(*by, "key", F.explode(_forms(F.col("key"), F.col("key"))).alias("x")).select(*by, "key", "x.*")
    right = candidates.select(*by, F.explode(_forms(F.col("key"), F.col("display"))).alias("x"), F.struct("display", F.col("key").alias("candidate")).alias("own"), "ord")
    # of candidates with one form the first counts
    right = right.groupBy(*by, F.col("x.kind").alias("kind"), F.col("x.form").alias("form")).agg(F.min_by("own", "ord").alias("own"), F.min("ord").alias("ord"))
    # two forms that are near share some pairs of letters at any length; below 2/3 only single letters do
    q = 2 if threshold >= 2 / 3 else 1
    least = F.element_at(F.array(*(F.lit(threshold / f) for f in FACTORS)), F.col("kind") + 1).alias("least")
    counts = right.select(F.explode(F.concat(F.array_distinct(_grams(F.col("form"), q)), _words(F.col("form")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(COMMON[-1]).collect()
    common = tuple(frozenset(x.token for x in top[:n]) for n in COMMON) if top else ()
    asked = _with_tokens(left.select(*by, "kind", "form", least).distinct(), "form", q, common, True)
    held = _with_tokens(right.select(*by, "kind", F.col("form").alias("other"), least), "other", q, common, False).drop("least")
    on = [*by, "kind", "token"]
    if top and top[0].n > block:
        crowded = held.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts")).filter("_parts > 1")
        held = held.join(crowded, on, "left").withColumn("_part", F.pmod(F.xxhash64("other"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        asked = asked.join(crowded, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        on.append("_part")
    alike = F.least(F.length("form"), F.length("other")) > (F.col("least") - 1e-9) * F.greatest(F.length("form"), F.length("other"))
    by_length = F.col("token").startswith("g") | F.col("token").startswith("l")
    pairs = asked.join(held, on).filter(~by_length | alike).select(*by, "kind", "form", "other").distinct()
    factor = F.element_at(F.array(*map(F.lit, FACTORS)), F.col("kind") + 1)
    scored = pairs.withColumn("score", similarity(F.col("form"), F.col("other")) * factor).filter(F.col("score") > threshold)
    named = scored.join(right.withColumnRenamed("form", "other"), [*by, "kind", "other"])
    first = named.groupBy(*by, "kind", "form").agg(F.min_by(F.struct("own", "score", "ord"), F.struct(-F.col("score"), F.col("ord"))).alias("best"))
    best = left.join(first, [*by, "kind", "form"]).groupBy(*by, "key").agg(F.min_by("best", F.struct(-F.col("best.score"), F.col("best.ord"))).alias("best"))
    return best.select(*by, "key", F.col("best.own.display").alias("suggestion"), F.col("best.own.candidate").alias("suggested_key"), F.round("best.score", 2).alias("score"))
